"""Small texts with every awkward case, and the frame made of them."""

import random

#: Columns whose names the operators use inside.
CLASHES = ["id", "key", "row", "host", "bad", "n", "node", "label", "sig", "hash", "kept", "h", "did", "spans", "body"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def texts(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "tsé" for b in "ao" for c in ("n", "r.", "ñ,", "", "X")]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 30, 60, 200]))) for _ in range(n // 4)]
    out = [None, "", " ", "\n\n", "Und " * 300, "x" * 5000, "a b", "<|endoftext|> a <|endoftext|>", "A  B \n C\t", base[0]]
    while len(out) < n:
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["Q", " new words here ", ""]) + t[at + 1 :]
        elif kind < 0.5:
            t = t + "\n" + rng.choice(base) + "\nsame line\nsame line"
        out.append(t)
    return out


def rows(n=120, seed=5):
    """Null and repeated ids, repeated rows, one source with a third of the rows."""
    rng = random.Random(seed)
    made = []
    for i, t in enumerate(texts(n, seed)):
        doc = None if i % 19 == 3 else 7 if i % 23 == 5 else i
        source = None if i % 29 == 1 else "big" if rng.random() < 0.34 else f"s{i % 4}"
        made.append((doc, t, "en" if i % 3 else None, source, None if t is None else len(t), *["c"] * len(CLASHES)))
    return made + made[10:20]


def frame(spark, made):
    return spark.createDataFrame(made, SCHEMA)
