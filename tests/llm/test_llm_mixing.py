"""Conversation trie, source mix and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import CLASHES
from pyspark.sql import functions as F

from feira.llm import fim, mixing, queries, running, store, trie

WORD = r"[^\x20\x09-\x0D]+"


def bag(rows):
    return Counter(map(str, rows))


# ---- conversation trie ----

NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(rows):
    """The trie's nodes, from the rebuilt conversations written out."""
    own = defaultdict(list)
    for c, turn, role, body, *_ in rows:
        if c is not None:
            order = (turn is not None, turn or 0, trie.digest_turn(role, body))
            own[c].append((order, (role or "", body or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        words = len(re.findall(WORD, path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * words
            leaves[path[:d]] += path not in children
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append(
            (min(convs), len(path), parent, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def talk_rows(n=130, seed=3):
    """Shared openings, null turns, roles and texts, repeated rows, bases that are missing or empty."""
    rng = random.Random(seed)
    says = ["", " ", "hi", "hi there", "a b c", "é ü ñ", "x " * 400, None]
    rows = []
    for c in range(n):
        if c % 20 == 0 and c % 60 == 40:
            continue  # a base without rows
        for k in range(rng.choice([1, 1, 2, 3, 6])):
            turn = None if rng.random() < 0.1 else k
            rows.append((c, turn, rng.choice(["user", "bot", None, ""]), rng.choice(says)))
    rows += [(None, 0, "user", "nobody")] * 2 + [(-7, 0, "user", "hi"), (-7, 1, "bot", "x"), (-20, 0, "user", "hi")]
    return rows + rows[:5]


TALK = "conv_id long, turn long, role string, text string"


def talk(spark, rows, parts=3):
    schema = TALK + ", " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["c"] * len(CLASHES)) for r in rows], schema).repartition(parts)


def trie_of(df, **options):
    return trie.prefix_nodes(df, "conv_id", "turn", "role", "text", **options)


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_trie_matches_brute_force(spark, batch):
    rows = talk_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # conversations go on in the next batch
    try:
        got = trie_of(talk(spark, rows)).select(*NODE_COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bag(map(tuple, got)) == bag(nodes_of(rows))


def test_trie_of_a_conversation_with_most_rows(spark, monkeypatch):
    """One conversation lies in many ranges, and one node is the end of more conversations than a piece holds."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rng = random.Random(9)
    rows = [(45, k, "user", rng.choice("abc")) for k in range(400)] + [(65, k, "user", rng.choice("abc")) for k in range(300)]
    rows += [(c, 0, "user", "same") for c in range(100, 300)]
    got = trie_of(talk(spark, rows, 8)).select(*NODE_COLUMNS).collect()
    assert bag(map(tuple, got)) == bag(nodes_of(rows))


def test_turnless_conversations_are_members_of_the_root(spark):
    turnless = [c for c in range(21, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "one turn") for c in turnless]
    got = [tuple(r) for r in trie_of(talk(spark, rows)).select(*NODE_COLUMNS).collect()]
    assert got == nodes_of(rows) and got[0][3:6] == (5, 0, 1)
    assert trie_of(talk(spark, [])).count() == 0
    assert trie_of(talk(spark, [(None, 1, "user", "x")])).count() == 0


def test_a_node_refers_to_its_last_turn(spark):
    rows = [r for r in talk_rows() if r[0] is not None and r[1] is not None][:150]
    df = talk(spark, rows)
    own = defaultdict(list)
    for c, turn, role, body in rows:
        own[c].append((turn, trie.digest_turn(role, body)))
    held = {(c, k + 1): d for c, v in own.items() for k, (_, d) in enumerate(sorted(v))}
    wanted = {(r[0], r[1]) for r in nodes_of(rows)}
    nodes = trie_of(df).where("depth > 0").collect()
    assert {(r.conv_id, r.depth) for r in nodes} | {(min(own), 0)} == wanted
    assert all((r.ref_conv, r.ref_turn) in held for r in nodes)


def test_clashing_products_start_again(spark, monkeypatch):
    rows, real, attempts = talk_rows(40), trie.Products, []

    class Weak(real):
        def __init__(self, attempt):
            attempts.append(attempt)
            super().__init__(attempt)
            if attempt == 0:  # turns are told apart by number only
                self.times, self.back = [0, 0], [0, 0]

    monkeypatch.setattr(trie, "Products", Weak)
    got = trie_of(talk(spark, rows)).select(*NODE_COLUMNS).collect()
    assert len(attempts) > 1 and bag(map(tuple, got)) == bag(nodes_of(rows))


def test_products_compose():
    how, rng = trie.Products(), np.random.default_rng(1)
    values = rng.integers(0, 2**63, 50, dtype=np.uint64)
    whole = how.shifted(0, values, np.arange(50)).sum(dtype=np.uint64)
    left = how.shifted(0, values[:20], np.arange(20)).sum(dtype=np.uint64)
    right = how.shifted(0, values[20:], np.arange(30)).sum(dtype=np.uint64)
    assert (np.array([left]) + how.shifted(0, np.array([right]), np.array([20])))[0] == whole
    assert how.shifted(0, how.shifted(0, values, np.full(50, 9)), np.full(50, -9)).tolist() == values.tolist()


# ---- source mix ----


def mix_of(rows, weight=lambda rank: rank % 3 + 1, most=3, seed=42):
    """Targets by sharing the excess again and again; entries taken one by one."""
    sized = [(r[0], r[1], len(re.findall(WORD, r[2] or ""))) for r in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = Counter()
    for _, s, n in sized:
        size[s] += n
    budget, weights = sum(size.values()), {s: weight(k) for k, s in enumerate(names)}
    target, free, left = {}, set(names), budget
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level >= most * size[s]}
        if not full:
            target |= {s: weights[s] * level for s in free}
            break
        target |= {s: most * size[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full

    def shuffle(doc):
        return hashlib.sha256(f"{seed}{'' if doc is None else f':{doc}'}".encode()).hexdigest()[:16]

    queue = sorted(((shuffle(d), store.NULL_ID if d is None else d, n, k) for k, (d, _, n) in enumerate(sized) if n), key=lambda x: x)
    entries, until = [], Counter()
    for turn in range(most):
        for h, _, n, k in queue:
            s = sized[k][1]
            until[s] += n
            entries.append((until[s] / target[s], names.index(s), h, n, k))
    taken, all_until = Counter(), 0
    for _, _, _, n, k in sorted(entries):
        all_until += n
        if all_until > budget:
            break
        taken[k] += 1
    return [(d, s, n, size[s], target[s], taken[k]) for k, (d, s, n) in enumerate(sized)]


def rounded(rows):
    return bag((*r[:4], round(float(r[4]), 6), r[5]) for r in rows)


def mix_rows(made):
    return [(r[0], r[3], r[1]) for r in made]


def test_mix_matches_brute_force(docs, made):
    got = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    assert rounded(map(tuple, got)) == rounded(mix_of(mix_rows(made)))


@pytest.mark.parametrize("seed", range(2))
def test_mix_of_uneven_sources(spark, seed):
    """Sources that reach their limit one after the other, one with a third of all rows, a document repeated often, none without words."""
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        source = rng.choice(["big"] * 6 + [f"s{j}" for j in range(12)] + [None, "é", "Z", "quiet"])
        rows.append((k, source, "" if source == "quiet" else "w " * rng.choice([0, 1, 2, 5, 40])))
    rows += [(1000, "big", "w w w")] * 80 + [(None, "s1", "w w")] * 3 + [(k % 3, "s2", "w") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = [tuple(r) for r in mixing.mix_sources(df, "doc_id", "text", "source").collect()]
    want = mix_of(rows)
    assert rounded(got) == rounded(want)
    taken = Counter()
    for _, s, n, _, _, times in got:
        taken[s] += n * times
        assert times <= 3
    for _, s, _, _, target, _ in got:
        assert abs(taken[s] - target) <= 41
    again = mixing.mix_sources(df.repartition(2), "doc_id", "text", "source").collect()
    assert bag(map(tuple, again)) == bag(got)


def test_mixture_gives_every_source_its_share_at_any_time(spark):
    rows = [(k, f"s{k % 3}", "w " * (1 + k % 4)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixture(df, "doc_id", "text", "source").orderBy("finish").collect()
    target = {s: t for _, s, _, _, t, _ in mix_of(rows)}
    taken = Counter()
    for k, r in enumerate(out):
        taken[r.source] += r.size
        if k % 50 == 49:
            shares = [taken[s] / target[s] for s in target]
            assert max(shares) - min(shares) < 0.05
    assert sum(taken.values()) <= sum(len(t.split()) for _, _, t in rows)
    want = Counter()
    for d, _, _, _, _, times in mix_of(rows):
        want[d] += times
    assert Counter(r.id for r in out) == +want


def test_mix_of_nothing_and_in_the_jvm(spark, docs, empty):
    assert mixing.mix_sources(empty, "doc_id", "text", "source").count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, "a", "")], "doc_id long, source string, text string")
    got = mixing.mix_sources(blank, "doc_id", "text", "source").select("id", "size", "source_size", "target", "times").collect()
    assert bag(map(tuple, got)) == bag([(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)])
    plan = mixing.mix_sources(docs, "doc_id", "text", "source")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_running_totals_of_groups_in_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(7)
    got = running.running(df, ["g"], ["k"], ["n"], store.scratch(spark, "running")).collect()
    until, want = Counter(), {}
    for g, k, n in sorted(rows):
        until[g] += n
        want[g, k] = until[g]
    assert {(r.g, r.k): r.n_until for r in got} == want and len(got) == len(rows)


# ---- fill in the middle ----

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_of(doc, body, fim_percent=50, spm_percent=80):
    body = body or ""
    units = UNIT.findall(body)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not body or any(s in body for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim_percent:
        return (doc, len(units), "plain", None, None, body, body)
    if h4 % 100 < spm_percent:
        return (doc, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", body)
    return (doc, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", body)


@pytest.mark.parametrize("how", [fim.Fim(), fim.Fim(fim_percent=100, spm_percent=40), fim.Fim(fim_percent=0)])
def test_fim_matches_brute_force(spark, docs, made, how):
    tricky = [(900 + k, t) for k, t in enumerate([" ", "\n\t", "a <P> b", "<", "<P", "P> <S", "a b", "é " * 9, " lead", "trail ", "<M>", "a<\n>b"] * 4)]
    tricky.append((2000, "long wörds " * 300_000))  # longer than a slice
    rows = [(r[0], r[1]) for r in made] + tricky
    extra = spark.createDataFrame(tricky, "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    got = fim.restore(fim.transform(df, "doc_id", "text", how), "output", "form").collect()
    assert bag(map(tuple, got)) == bag(fim_of(d, t, how.fim_percent, how.spm_percent) for d, t in rows)


def test_fim_takes_empty_tables_and_clashing_names(spark, docs, empty):
    assert fim.transform(empty, "doc_id", "text").count() == 0
    clash = docs.select("doc_id", "text", F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit("y").alias("output"), F.lit("z").alias("restored"))
    out = fim.transform(clash, "doc_id", "text")
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = fim.restore(out.withColumn("restored", F.lit("old")), "output", "form")
    assert back.columns == [*out.columns, "restored"] and back.where("restored = 'old'").count() == 0
    gone = spark.createDataFrame([(None, "plain")], "output string, form string")
    assert fim.restore(gone, "output", "form").collect()[0].restored is None


def test_rotation_exchanges_blocks_in_place():
    rng = random.Random(2)
    for _ in range(300):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        a, m, b = sorted(rng.choices(range(len(body) + 1), k=3))
        buffer = bytearray(body)
        fim.exchange(buffer, a, m, b)
        assert bytes(buffer) == body[:a] + body[m:b] + body[a:m] + body[b:]


def test_registered_queries_give_the_contract_columns(spark):
    path = "/root/testdata/sf0.001"
    assert queries.op11_conversation_trie(spark, path).columns == NODE_COLUMNS
    assert queries.op12_source_mix(spark, path).columns == ["doc_id", "size", "source_size", "target", "taken"]
    want = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert queries.op13_fill_in_middle(spark, path).columns == want
