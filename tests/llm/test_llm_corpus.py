"""Operators across texts against brute force: suffix dedup, near-dedup, lines, shards, archives, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feira.llm import components, files, line_dedup, minhash, queries, sharding, store, suffix_dedup, warc


def bag(rows):
    return Counter(map(str, rows))


def hashes(spark, bodies):
    rows = spark.createDataFrame([(b,) for b in bodies], "t string").withColumn("h", F.xxhash64("t")).collect()
    return {r.t: r.h for r in rows}


def removal_of(pairs, hashed):
    """What suffix dedup leaves, by id and text."""
    seen, out = set(), {}
    for doc, body in sorted({(store.NULL_ID if d is None else d, t or "") for d, t in pairs}, key=lambda x: (x[0], hashed[x[1]])):
        raw = body.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc, body] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_suffix_dedup_matches_brute_force(spark, docs, made, batch):
    pairs = [(r[0], r[1]) for r in made]
    want = removal_of(pairs, hashes(spark, {t or "" for _, t in pairs}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # small batches: leads cross buckets
    try:
        got = suffix_dedup.remove_repeats(docs.repartition(3), "doc_id", "text").drop("kept").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bag(map(tuple, got)) == bag((d, *want[store.NULL_ID if d is None else d, t or ""]) for d, t in pairs)


def test_suffix_dedup_of_a_hot_passage(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcde ", k=400))
    pairs = [(i, "".join(rng.choices("xyz ", k=rng.randrange(120))) + (passage if i % 3 == 0 else "")) for i in range(150)]
    pairs += [(200, "ab" * 5000), (201, "ab" * 100)]
    want = removal_of(pairs, {t: 0 for _, t in pairs})
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, "doc_id", "text").drop("kept").collect()
    assert bag(map(tuple, got)) == bag((d, *want[d, t]) for d, t in pairs)


def test_suffix_dedup_of_nothing(spark, empty):
    assert suffix_dedup.remove_repeats(empty, "doc_id", "text").count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(blank, "doc_id", "text").collect()] == [0, 0]


def test_suffix_dedup_of_rows_that_repeat(spark, monkeypatch):
    """Equal rows send their spans once, and texts under a null id are not put together."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcde ", k=300))
    pairs = [(1, passage)] + [(2, "x" + passage + "y")] * 40
    pairs += [(None, "".join(rng.choices("pqrs ", k=150)) + passage) for _ in range(30)]
    hashed = hashes(spark, {t for _, t in pairs})
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    real, lists, places = suffix_dedup.removed_spans, [], []
    gather = suffix_dedup._repeated

    def spans(*args):
        got = real(*args)
        lists.extend(r[0] for r in got.select(F.size("spans")).collect())
        return got

    def repeated(leads):
        got = gather(leads)
        places.append(got.count())
        return got

    monkeypatch.setattr(suffix_dedup, "removed_spans", spans)
    monkeypatch.setattr(suffix_dedup, "_repeated", repeated)
    got = suffix_dedup.remove_repeats(df, "doc_id", "text").drop("kept").collect()
    want = removal_of(pairs, hashed)
    assert bag(map(tuple, got)) == bag((d, *want[store.NULL_ID if d is None else d, t]) for d, t in pairs)
    assert max(lists) < 40
    assert places == [32]  # a row for each text


def near_of(pairs, size, percent):
    """Set size and least reachable key of each row; rows that share an id are nodes of their own by set."""
    sets = []
    for _, body in pairs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    key = [store.NULL_ID if d is None else d for d, _ in pairs]
    least = defaultdict(lambda: 2**63)
    for k in range(len(pairs)):
        least[find(k)] = min(least[find(k)], key[k])
    return [(d, len(s), least[find(k)] if s else key[k]) for k, ((d, _), s) in enumerate(zip(pairs, sets))]


@pytest.mark.parametrize("how", [queries.NEAR, corpus_pipeline.NEAR])
def test_near_dedup_matches_brute_force(docs, made, how):
    want = near_of([(r[0], r[1]) for r in made], how.words, how.percent)
    got = minhash.link(docs, "doc_id", "text", how).select("rid", "n", "root")
    assert bag(map(tuple, got.collect())) == bag(want)


def near_copies(n, seed=4, edits=5):
    """A large group of near copies: many pairs lie just under the threshold, some over it."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randrange(1, edits)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(40 * n)}"
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("small", [0, 3, 32])
def test_large_groups_lose_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    pairs = near_copies(160) + [(1000 + i, t) for i, t in near_copies(60, 9, 9)]
    want = near_of(pairs, 3, 85)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = minhash.link(df, "doc_id", "text", queries.NEAR).select("rid", "n", "root")
    assert bag(map(tuple, got.collect())) == bag(want)


@pytest.mark.parametrize("share", [0, 0.08])
def test_work_in_large_groups_grows_with_their_members(spark, monkeypatch, share):
    """Near copies of one text, also with a phrase that a part of them has: rows and pairs met are in proportion."""
    made, real = Counter(), store.stored

    def stored(df, path):
        out = real(df, path)
        name = path.split("/")[-1]
        if name in ("groups", "elements"):
            made[name] += out.count()
        elif name == "met":
            made["met"] += out.count()
            meetings = out.where(F.col("met") <= minhash.FEW * minhash.SMALL).groupBy("group", "element").count()
            made["meetings"] += meetings.agg(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0))).first()[0]
        return out

    monkeypatch.setattr(store, "stored", stored)
    seen = []
    for n in (500, 2000):
        rng = random.Random(n)
        pairs = [(i, t + " shared words of some copies only, told once" * (rng.random() < share)) for i, t in near_copies(n, 8, 9)]
        made.clear()
        minhash.link(spark.createDataFrame(pairs, "doc_id long, text string"), "doc_id", "text", queries.NEAR).count()
        seen.append(dict(made))
    one, four = seen
    assert four["elements"] <= 4**1.1 * one["elements"]
    assert four["elements"] <= 30 * 2000 and four["groups"] <= 30 * 2000
    assert four["meetings"] <= minhash.FEW * minhash.SMALL * four["met"] and four["met"] <= 10 * 2000


def test_keep_one_keeps_one_row_of_each_group(docs, made, empty):
    how = corpus_pipeline.NEAR
    kept = minhash.keep_one(docs, "doc_id", "text", how)
    assert kept.schema == docs.schema
    got = [tuple(r) for r in kept.collect()]
    want = near_of([(r[0], r[1]) for r in made], how.words, how.percent)
    worded = {w[2] for w in want if w[1]}
    blank = [r for r, w in zip(made, want) if not w[1]]
    with_words = [r for r in got if re.search(r"\S", r[1] or "")]
    assert bag(r for r in got if not re.search(r"\S", r[1] or "")) == bag(blank)
    assert len(with_words) == len(worded)
    assert {store.NULL_ID if r[0] is None else r[0] for r in with_words} == worded
    assert set(map(str, got)) <= set(map(str, made))
    assert minhash.keep_one(empty, "doc_id", "text", how).count() == 0
    assert minhash.annotate(empty, "doc_id", "text", how).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(40)] + [(500, k) for k in range(500, 560)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df, store.scratch(spark, "components")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


def lines_of(made, ratio, least):
    space = " \t\n\v\f\r"
    pages, on = Counter(r[3] for r in made), Counter()
    for r in made:
        on.update({(r[3], x.strip(space)) for x in (r[1] or "").split("\n") if x.strip(space)})
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    clean = lambda r: None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(space)) not in bad)
    return [(r[0], clean(r), *r[2:]) for r in made], bad


@pytest.mark.parametrize("ratio,least", [(0.1, 3), (0.02, 2), (0.9, 1)])
def test_line_dedup_matches_brute_force(docs, made, ratio, least):
    want, bad = lines_of(made, ratio, least)
    got = line_dedup.drop_boilerplate(docs, "text", F.col("source"), ratio, least)
    assert got.columns == docs.columns
    assert bag(map(tuple, got.collect())) == bag(want)
    assert bad or ratio > 0.5


def test_line_dedup_stays_in_the_jvm_and_takes_empty_tables(docs, empty):
    plan = line_dedup.drop_boilerplate(docs, "text", F.col("source"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert line_dedup.drop_boilerplate(empty, "text", F.col("source")).count() == 0


def test_page_text_and_host(spark):
    rows = [("HTTP://user@WWW.Ex.org:80/a", "<p>a<b>b</b></p><script>x</script><li>c</li><!-- d -->"), ("nothing", None), (None, "")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in df.select(line_dedup.host_of(F.col("url")), line_dedup.page_text(F.col("html"))).collect()]
    assert got == [("www.ex.org", "\nab\n\nc\n"), ("", None), (None, "")]


def test_shards(spark, docs, made, empty):
    placed, versions = sharding.shard_records(docs, "doc_id", "text", 8)
    got = placed.collect()
    assert bag((r.id, r.size) for r in got) == bag((m[0], len((m[1] or "").encode()) + 1) for m in made)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.version for r in versions.select("version").distinct().collect()} == {0, 1}
    assert versions.groupBy("version").count().where(f"count != {sharding.SLOTS}").count() == 0
    placed, _ = sharding.shard_records(empty, "doc_id", "text", 8)
    assert placed.count() == 0


def balanced(sizes, shards):
    """The map after one rebalancing: what a shard holds beyond the mean, largest slots first, goes to the emptiest shards."""
    mean, moving, load, at = sum(sizes) / shards, [], [0] * shards, {}
    for k in range(shards):
        filled = 0
        for v in sorted((v for v in range(len(sizes)) if v % shards == k), key=lambda v: (-sizes[v], v)):
            filled += sizes[v]
            if filled <= mean or not sizes[v]:
                at[v] = k
                load[k] += sizes[v]
            else:
                moving.append((sizes[v], v))
    for size, v in sorted(moving, reverse=True):
        at[v] = load.index(min(load))
        load[at[v]] += size
    return at


def test_rows_that_repeat_keep_the_law(spark):
    """Half of all rows repeat one id and text, in one partition: shards stay near equal, places gapless, reruns alike."""
    rng = random.Random(3)
    rows = [(7, "the same text " * 6)] * 3000 + [(k, "w" * rng.randrange(200)) for k in range(3000)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed, versions = sharding.shard_records(df, "doc_id", "text", 8)
    got = placed.collect()
    want = bag((d, len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert bag((r.id, r.size, r.text_crc32) for r in got) == want
    sizes, places, slots = Counter(), defaultdict(list), Counter()
    for r in got:
        sizes[r.shard] += r.size
        slots[r.vslot] += r.size
        places[r.shard].append(r.place)
    assert len(sizes) == 8 and max(sizes.values()) <= 1.01 * min(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({r.vslot for r in got if r.id == 7}) > 1500  # the hot rows share no slot
    at = balanced([slots[v] for v in range(sharding.SLOTS)], 8)
    assert {r.vslot: r.shard for r in versions.where("version = 1").collect()} == at
    assert all(at[r.vslot] == r.shard for r in got)
    again, _ = sharding.shard_records(df.repartition(9), "doc_id", "text", 8)
    assert bag(map(tuple, again.collect())) == bag(map(tuple, got))


def test_shards_are_near_equal_and_edits_are_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed, versions = sharding.shard_records(docs, "doc_id", "text", 8)
    sizes = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.01 * min(sizes)
    old, new = (versions.where(F.col("version") == v).select("vslot", F.col("shard").alias(f"s{v}")) for v in (0, 1))
    moved = old.join(new, "vslot").where("s0 != s1").count()
    assert 0 < moved < sharding.SLOTS


def test_growing_moves_slots_only_to_the_new_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    records = docs.select(sharding.slot_of("doc_id", "text").alias("vslot"), (F.octet_length("text") + 1).cast("long").alias("size"))
    sizes = sharding.slot_sizes(records)
    even = sharding.rebalance(sizes, sharding.first_map(sizes, 8), 8)
    grown = sharding.grow(sizes, even, 8)
    both = even.select("vslot", "shard").join(grown.select("vslot", F.col("shard").alias("to"), "version"), "vslot")
    assert both.where("shard != to and to != 8").count() == 0
    assert both.select("version").distinct().first()[0] == 2
    loads = both.join(sizes, "vslot").groupBy("to").agg(F.sum("bytes").alias("b")).collect()
    assert len(loads) == 9 and max(r.b for r in loads) <= 1.1 * min(r.b for r in loads)


def test_a_stored_map_is_edited(spark, docs, made, tmp_path):
    maps = (tmp_path / "map").as_uri()
    _, before = sharding.shard_records(docs, "doc_id", "text", 8, maps=maps)
    old = {tuple(r) for r in before.collect()}
    for shards, last in ((9, 2), (5, 3)):  # one more, then fewer: none stays on a shard that is gone
        placed, versions = sharding.shard_records(docs, "doc_id", "text", shards, maps=maps)
        rows = {tuple(r) for r in versions.collect()}
        assert old < rows and {r[0] for r in rows - old} == {last} and len(rows - old) == sharding.SLOTS
        assert {r[2] for r in rows - old} <= set(range(shards))
        assert placed.count() == len(made)
        old = rows
    with pytest.raises(ValueError):
        sharding.shard_records(docs, "doc_id", "text", 8, 100, maps)


def archive_rows(made):
    return [(r[0], r[3], (r[1] or "") * (40 if k % 3 == 0 else 1) if r[1] is not None else None) for k, r in enumerate(made)]


def test_archives_round_trip(spark, made):
    pages = archive_rows(made)
    pages += [(5000 + k, "u\r\nX: y", "é" * 600) for k in range(30)] + [(None, None, "é" * 600)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = store.scratch(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(df, "page_id", "url", "html", folder, "2024-01-01T00:00:00Z"))
    newest = {}
    for page, _, body in pages:
        newest[body or ""] = max(newest.get(body or "", store.NULL_ID), store.NULL_ID if page is None else page)
    want = []
    for page, _, body in pages:
        raw = (body or "").encode()
        revisit = len(raw) >= 1000 and (store.NULL_ID if page is None else page) < newest[body or ""]
        to = newest[body or ""] if revisit else None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to, None if revisit else raw))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    plain = lambda r: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r)
    assert bag(plain(r) for r in got.select(*columns).collect()) == bag(want)
    none = spark.createDataFrame([], df.schema)
    assert warc.read_archives(warc.write_archives(none, "page_id", "url", "html", folder, "x")).count() == 0


def test_broken_archives_are_errors(tmp_path):
    good = warc.record(1, "u", "d", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None)

    def read(data):
        f = files.Output(tmp_path.as_uri(), ".gz")
        f.write(data)
        f.close()
        with files.open_stream(f.uri) as stream:
            return [warc.parse(m, f.uri) for m in warc.members(stream, f.uri)]

    assert len(read(good + good)) == 2
    wrong = warc.record(1, "u", "d", b"payload", 7, hashlib.sha1(b"other").hexdigest(), None)
    import gzip

    member = gzip.decompress(good)
    for bad in (good[:-9], wrong, gzip.compress(member[:-1]), gzip.compress(member + b"x"), gzip.compress(member.replace(b"payload\r", b"paYload\r")), gzip.compress(b"none")):
        with pytest.raises(Exception):
            read(bad)


def foreign(fields, block, version="WARC/1.0", end="\r\n\r\n"):
    """A record as other writers make it."""
    import gzip

    lines = "".join(f"{line}\r\n" for line in [version, *fields, f"Content-Length:{len(block)}"])
    return gzip.compress(lines.encode() + b"\r\n" + block + end.encode())


def test_archives_of_other_writers_are_read(spark, tmp_path):
    import base64

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = "né".encode() * 50
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    answer = ["WARC-Type:response", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http; msgtype=response"]
    records = [
        foreign(["WARC-Type: warcinfo", "WARC-Record-ID:<urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        foreign(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        foreign(["warc-type: metadata", "WARC-RECORD-ID:  <urn:uuid:3>  ", "WARC-Refers-To: <urn:uuid:5>"], b"seed: \r\n"),
        foreign(answer, http + body),  # without any digest
        foreign([*answer, f"WARC-Payload-Digest: sha1:{sha}", "WARC-Target-URI: http://a/", "\tb"], http + body, "WARC/1.1"),
        foreign([*answer, f"WARC-Block-Digest: sha256:{hashlib.sha256(http + body).hexdigest()}", "WARC-Payload-Digest: blub:AAAA"], http + body),
        foreign(["WARC-Type: resource", f"WARC-Payload-Digest: SHA-1:{hashlib.sha1(body).hexdigest()}"], body),
        foreign(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:8>", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\ncontent-length: 150\r\n\r\n"),
        foreign(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:9>"], b""),
    ]

    def archive(data):
        f = files.Output(tmp_path.as_uri(), ".gz")
        f.write(data)
        f.close()
        return spark.createDataFrame([(f.uri,)], "uri string")

    got = warc.read_records(archive(b"".join(records))).collect()
    hexed = hashlib.sha1(body).hexdigest()
    assert [(r.record_type, r.record_id) for r in got[:4]] == [
        ("warcinfo", "<urn:uuid:1>"), ("request", "<urn:uuid:2>"), ("metadata", "<urn:uuid:3>"), ("response", "<urn:uuid:5>"),
    ]
    assert [bytes(r.payload) for r in got[3:7]] == [body] * 4 and {r.payload_digest for r in got[3:7]} == {hexed}
    assert got[2].refers_to == "<urn:uuid:5>" and got[4].target_uri == "http://a/ b"
    assert [(r.payload_bytes, r.payload_digest, r.payload) for r in got[7:]] == [(150, hexed, None), (None, None, None)]
    pages = warc.read_archives(archive(b"".join(records))).collect()
    assert [(r.page_id, r.record_type) for r in pages] == [(None, "response")] * 3 + [(None, "revisit")] * 2
    for wrong in (
        foreign([*answer, "WARC-Payload-Digest: sha1:" + "A" * 32], http + body),
        foreign([*answer, f"WARC-Block-Digest: md5:{'0' * 32}"], http + body),
        foreign(["WARC-Type: response", "no field here"], b"x"),
        foreign(answer, http + body, end="\r\n"),
    ):
        with pytest.raises(Exception):
            warc.read_records(archive(wrong)).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, path)
    assert sorted(df.columns) == sorted(names)
    assert bag(map(tuple, df.select(*names).collect())) == bag(found.fetchall())


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 14))


def test_pipeline_stages_follow_each_other(spark, docs, made, items=None):
    from test_llm_text import contamination_of, quality_of

    benchmark = [(tuple(r)[0], r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    passage = " ".join(w for _, t in benchmark[:1] for w in t.split())
    extra = [(900 + k, f"{passage} tail{k}", "en", "s1", 1, *["c"] * 15) for k in range(3)]
    rows = made + extra
    df = spark.createDataFrame(rows, docs.schema)
    current, want = df, rows
    folder = store.scratch(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        current = store.stored(stage(spark, current, "/root/testdata/sf0.001"), f"{folder}/{k}")
        assert current.columns == docs.columns
        got = [tuple(r) for r in current.collect()]
        if k == 0:
            want = [r for r in want if quality_of(r[1])[-1]]
        elif k == 1:
            want = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), *r[5:]) for r in lines_of(want, 0.1, 3)[0]]
        elif k == 2:
            near = near_of([(r[0], r[1]) for r in want], 5, 80)
            assert len(got) == len({w[2] for w in near if w[1]}) + sum(not w[1] for w in near)
            assert set(map(str, got)) <= set(map(str, want))
            want = got
        else:
            judged = contamination_of(want, benchmark)
            want = [r for r, j in zip(want, judged) if not j[-1]]
        assert bag(got) == bag(want)
    last = corpus_pipeline.STAGES[-1][1](spark, current, "")
    assert last.count() == len(want) and "ids" in last.columns
