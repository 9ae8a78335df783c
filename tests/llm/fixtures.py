"""Small tables made from a seed: invented words, copies, near copies, planted passages, odd rows."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["ka", "lo", "mi", "ter", "san", "ou", "in", "da"], k=rng.randrange(1, 4))) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """n documents: the first of every six has an exact and a near copy; a few odd ones end the list."""
    rng = random.Random(seed)
    out: list[tuple] = []
    while len(out) < n:
        w = words(rng, rng.choice([3, 8, 40, 120, 300]))
        out.append(w)
        if len(out) % 6 == 1:
            out.append(list(w))
            near = list(w)
            near[len(near) // 2] = "changed"
            out.append(near)
    rows = [(i, " ".join(w), "en", f"src{i % 3}", len(" ".join(w))) for i, w in enumerate(out)]
    more = [None, "", "   \n\t", "one", "One  TWO", "one two", "x" * 5000, "é ü ß " * 20, rows[0][1].upper(), "<|endoftext|> 7 7"]
    return rows + [(1000 + i, t, None, None, None) for i, t in enumerate(more)]


def clashing(df):
    """The same table with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("id", "n", "score", "size", "text_", "part", "component", "h", "sig", "rep", "bucket", "r", "label", "y", "a", "b", "spans", "block", "digits", "range"):
        df = df.withColumn(c, F.lit("x"))
    return df
