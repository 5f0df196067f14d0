"""Operators on single texts against brute force: quality, decontamination, BPE, token files, classifier."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feira.llm import bpe, classifier, decontaminate, files, quality, tasks, token_scan

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SPACE = r"[^\x20\x09-\x0D]+"


def bag(rows):
    return Counter(map(str, rows))


def quality_of(body):
    body = body or ""
    ws = re.findall(SPACE, body)
    n = len(ws)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    repeated, passages, longest = set(), set(), 0
    starts = [i for i in range(n - 7) if windows[tuple(ws[i : i + 8])] > 1]
    for i in starts:
        repeated.update(range(i, i + 8))
        for j in starts:
            k = 0
            while i < j and j + k < n and ws[i + k] == ws[j + k]:
                k += 1
            if k >= 20:
                longest = max(longest, k)
                passages |= {*range(i, i + k), *range(j, j + k)}
    lines = [x for x in body.split("\n") if re.search(SPACE, x)]
    failed = n < 20 or 100 * len(repeated) > 30 * n
    kept = not failed and 100 * len(passages) <= 20 * n and not (longest > 50 and 10 * longest > n)
    symbols = len(re.findall(r"[#*$%&|<>]", body))
    return n, sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(repeated), longest, failed, kept


def test_quality_measures_match_brute_force(docs, made):
    got = quality.annotate(docs, "doc_id", "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "base_failed", "kept"
    )
    assert bag(map(tuple, got.collect())) == bag((r[0], *quality_of(r[1])) for r in made)


def test_each_limit_rejects_what_the_base_keeps():
    import pyarrow as pa

    fresh = iter(range(10**6))

    def words(n):
        return [f"w{next(fresh)}" for _ in range(n)]

    paragraph, sentences = words(55), [words(24) for _ in range(3)]
    cases = {
        "clean": words(400),
        "long repeat": words(100) + paragraph + words(200) + paragraph,  # 110 of 410 words, one repeat of 55
        "passages": words(250) + [w for s in sentences + sentences for w in [*s, *words(30)]],  # 144 of 574 words
        "one sentence": words(200) + sentences[0] + words(100) + sentences[0],
        "long text": words(900) + paragraph + words(100) + paragraph,  # a paragraph twice in a long text
        "phrases": words(300) + [w for p in [words(9)] * 10 for w in [*p, *words(2)]],  # short phrases do not count
    }
    got = quality.measure(pa.array([" ".join(ws) for ws in cases.values()]), quality.Rules())
    assert not got["base_failed"].any()
    limits = {name: (bool(c * 100 > 20 * n), bool(longest > 50 and longest * 10 > n)) for name, c, longest, n in zip(cases, got["n_covered_words"].tolist(), got["longest_repeat"].tolist(), got["n_words"].tolist())}
    assert limits.pop("passages") == (True, False)
    alone = quality.measure(pa.array([" ".join(cases["long repeat"])]), quality.Rules(most_covered_percent=30))
    assert not alone["kept"][0] and alone["longest_repeat"][0] == 55  # by the longest repeat alone
    limits.pop("long repeat")
    assert set(limits.values()) == {(False, False)}
    kept = dict(zip(cases, got["kept"].tolist()))
    assert kept == {name: name not in ("long repeat", "passages") for name in cases}


@pytest.mark.parametrize("least", [2, 3, 8, 13])
def test_longest_repeats_of_any_least_length(least):
    rng = random.Random(least)
    bodies = [" ".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(80)]
    run = rng.choices("abcdefgh", k=40)  # repeats of many lengths, three and more times
    bodies += [
        " ".join(w for _ in range(6) for w in [*run[: rng.randrange(8, 40)], f"x{rng.random()}"]) for _ in range(40)
    ]
    import pyarrow as pa

    got = quality.measure(pa.array(bodies), quality.Rules(min_words=least))
    for k, body in enumerate(bodies):
        ws = body.split()
        best, covered = 0, set()
        for i in range(len(ws)):
            for j in range(i):
                n = 0
                while i + n < len(ws) and ws[i + n] == ws[j + n]:
                    n += 1
                best = max(best, n)
                if n >= least:
                    covered |= {*range(i, i + n), *range(j, j + n)}
        assert got["longest_repeat"][k] == (best if best >= least else 0)
        assert got["n_covered_words"][k] == len(covered)


def test_quality_filter_keeps_rows_whole(docs, made, empty):
    kept = quality.keep_good(docs, "text")
    assert kept.schema == docs.schema
    assert bag(map(tuple, kept.collect())) == bag(r for r in made if quality_of(r[1])[-1])
    assert quality.keep_good(empty, "text").count() == quality.annotate(empty, "doc_id", "text").count() == 0


def benchmark_words(body):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), body or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination_of(made, items):
    windows = {}
    for item, body in items:
        ws = benchmark_words(body)
        size = min(13, len(ws))
        for i in range(len(ws) - size + 1) if size else ():
            windows.setdefault(tuple(ws[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, body in ((r[0], r[1]) for r in made):
        ws, hit, found = benchmark_words(body), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(ws) - size + 1):
                match = windows.get(tuple(ws[i : i + size]))
                if match:
                    hit.update(range(i, i + size))
                    found |= match
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(ws)))
    return out


@pytest.fixture(scope="module")
def items(made):
    long = [r[1] for r in made if r[1] and len(r[1].split()) > 25]
    few = [(i, " ".join(long[i].split()[3:20])) for i in range(6)]
    return few + [(None, "zz"), (8, None), (9, ""), (2, "tan, SON"), (10, long[0]), (11, few[0][1]), (12, "tan")]


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination_matches_brute_force(spark, docs, made, items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(docs, "doc_id", "text", bench, "item_id", "text")
    want = contamination_of(made, items)
    assert bag(tuple(r)[:6] for r in got.collect()) == bag(want)
    kept = decontaminate.remove_contaminated(docs, "text", bench, "item_id", "text")
    assert kept.schema == docs.schema
    assert bag(map(tuple, kept.collect())) == bag(r for r, w in zip(made, want) if not w[-1])


def test_matches_are_longest_and_verbatim(spark, docs, made, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(docs.where("doc_id is not null and doc_id != 7").distinct(), "doc_id", "text", bench, "item_id", "text")
    bodies = {r[0]: benchmark_words(r[1]) for r in made}
    of_item = dict(items)
    checked = 0
    for row in got.collect():
        for m in row.matches:
            if m.item_id in ("", "2"):
                continue
            ws, q = bodies[row.doc_id], benchmark_words(of_item[int(m.item_id)])
            a, b, n = m.doc_word, m.item_word, m.n_words
            assert ws[a : a + n] == q[b : b + n]
            assert a == 0 or b == 0 or ws[a - 1] != q[b - 1]
            assert a + n == len(ws) or b + n == len(q) or ws[a + n] != q[b + n]
            checked += 1
    assert checked


def test_no_benchmark_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, "text", none, "item_id", "text").count() == docs.count()
    assert decontaminate.annotate(empty, "doc_id", "text", none, "item_id", "text").count() == 0


def test_the_driver_reads_no_benchmark_item(spark, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    whole, fetched = type(bench).toLocalIterator, []
    monkeypatch.setattr(
        type(bench), "toLocalIterator", lambda df, *a, **k: fetched.append(df.columns) or whole(df, *a, **k)
    )
    blocks = decontaminate.write_blocks(bench, "item_id", "text", 13)
    assert fetched == [["uri", "bytes"]]
    assert len(blocks) == 1 and len(blocks[0]) == 3  # a file of each task
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    assert len(decontaminate.write_blocks(bench, "item_id", "text", 13)) > 3


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_matches_the_library(docs, made, library, empty):
    got = bpe.encode(docs, "doc_id", "text", VOCABULARY)
    want = []
    for r in made:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((r[0], ids, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()))
    assert bag(map(tuple, got.collect())) == bag(want)
    back = bpe.decode(got.withColumnRenamed("doc_id", "d"), "d", "ids", VOCABULARY)
    assert bag(r.text for r in back.collect()) == bag(r[1] or "" for r in made)
    assert bpe.encode(empty, "doc_id", "text", VOCABULARY).count() == 0


def test_bpe_matches_the_library_on_odd_strings(library):
    mine = bpe.Bpe(bpe.read_spec(VOCABULARY))
    rng = random.Random(2)
    odd = [chr(c) for c in [*range(128), 0x85, 0xA0, 0xDF, 0xE9, 0x300, 0x558, 0x1C89, 0x2028, 0x3000, 0x4E2D, 0xFEFF, 0x1F600, 0x323B0]]
    odd += ["<|endoftext|>", "don't", " the", "  ", "\n\n", "ing", "'ll"]
    bodies = ["".join(rng.choices(odd, k=rng.randrange(50))) for _ in range(1500)]
    bodies += ["a" * 3000, "ab" * 200, "é" * 70, "x" * 64, "x" * 65, " ", "  a", "a ", "a \nb", "\n a"]
    for body, ids in zip(bodies, mine.encode_many(bodies)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(body, add_special_tokens=False).ids, body
        assert mine.decode(ids) == body


def test_side_by_side_trees_equal_single_trees():
    mine = bpe.Bpe(bpe.read_spec(VOCABULARY))
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"aeinthsor \xc3\xa9", k=rng.randrange(1, 70))) for _ in range(400)]
    assert mine.merge_many(pieces) == [mine.merge(p) for p in pieces]


def test_memory_stays_small(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    mine = bpe.Bpe(bpe.read_spec(VOCABULARY))
    first = mine.encode_many([f"word{k} other{k}" for k in range(200)])
    assert len(mine.words) <= 250 and mine.encode_many(["word7 other7"])[0] == first[7]
    mine.encode_many(["a " + "b" * 1000])
    assert max(map(len, mine.words)) <= 64


@pytest.mark.parametrize("stage", ["any", "bpe", "token files"])
def test_workers_give_memory_back(spark, monkeypatch, stage):
    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS_OF", stage)  # a worker of its own
    word = lambda k: F.hex(F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 17)))
    rows = spark.range(0, 5000, 1, 1).withColumnRenamed("id", "doc_id")
    rows = rows.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), word), " "))

    def many_arrays(batches):
        for batch in batches:
            arrays = [np.ones(8000) for _ in range(2000)]
            tasks.last = arrays[-1]  # holds the end of the heap
            yield batch

    def probe(batches):
        """Of the worker: private memory, and the words its tokenizers keep."""
        import re
        from pathlib import Path

        import pyarrow as pa

        from feira.llm import bpe

        for _ in batches:
            pass
        held = re.findall(r"\nPrivate_(?:Clean|Dirty):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        words = len(bpe.tokenizer(bpe.read_spec(VOCABULARY)).words)
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(int, held)) // 1024]), pa.array([words])], ["mb", "words"])

    asked = {
        "any": lambda: rows.select("doc_id").mapInArrow(tasks.tidy(many_arrays), "doc_id long"),
        "bpe": lambda: bpe.encode(rows, "doc_id", "text", VOCABULARY),
        "token files": lambda: token_scan.document_token_counts(rows, "doc_id", "text", VOCABULARY, "<|endoftext|>"),
    }
    assert asked[stage]().count() == 5000
    (left,) = spark.range(0, 1, 1, 1).mapInArrow(probe, "mb long, words long").collect()
    assert left.mb <= 135 and left.words <= bpe.WAITING, left


def test_token_counts(docs, made, library, empty):
    library.encode_special_tokens = True
    want = [(r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in made]
    library.encode_special_tokens = False
    got = token_scan.document_token_counts(docs, "doc_id", "text", VOCABULARY, "<|endoftext|>")
    assert bag(map(tuple, got.collect())) == bag(want)
    assert token_scan.document_token_counts(empty, "doc_id", "text", VOCABULARY, "<|endoftext|>").count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = random.Random(block)
    kinds = [[], [9], [9, 9], [1, 2, 3], [1, 9], [9, 1], [rng.choice([1, 2, 9]) for _ in range(200)], [1] * 50 + [9]]
    listed, want = [], []
    for ids in kinds:
        f = files.Output(tmp_path.as_uri(), ".bin")
        f.write(np.array(ids, "<u2").tobytes())
        f.close()
        listed.append((f.uri, f.size))
        docs, run = [], 0
        for t in ids:
            run = run + 1 if t != 9 else docs.append(run) or 0
        docs += [run] if run else []
        want += [(f.uri, k, n) for k, n in enumerate(docs)]
    table = spark.createDataFrame(listed, "uri string, bytes long")
    got = token_scan.token_counts(table, 9, 2, block).select("uri", "number", "n_tokens")
    assert bag(map(tuple, got.collect())) == bag(want)


def test_classifier_learns_from_held_in_rows_only(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    weights = classifier.train(docs, "doc_id", "text", labels, "doc_id", "quality", ~held)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.train(docs, "doc_id", "text", turned, "doc_id", "quality", ~held)
    assert (weights == again).all()
    scored = classifier.score(docs, "doc_id", "text", weights).join(labels, "doc_id").where(held)
    right = scored.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.95


def test_classifier_takes_awkward_rows(spark, docs, made, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (12, 0), (13, 1)], "doc_id long, quality int")
    weights = classifier.train(docs, "doc_id", "text", labels, "doc_id", "quality", F.lit(True))
    got = classifier.score(docs, "doc_id", "text", weights).collect()
    assert len(got) == len(made) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r, m in zip(got, made) if not (m[1] or "").strip()}
    assert len(blank) == 1
    none = classifier.train(docs, "doc_id", "text", labels.where("false"), "doc_id", "quality", F.lit(True))
    assert {r.score for r in classifier.score(docs, "doc_id", "text", none).collect()} == {0.5}
    assert classifier.score(empty, "doc_id", "text", weights).count() == 0
