"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ti", "re", "lu", "ma", "su", "pe") for b in ("n", "r", "lo", "sa", "mi", "ta", "ku", "ve", "x1", "é")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(rng: random.Random | None = None, plain: int = 25) -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, copies, near copies and repeated rows."""
    rng = rng or random.Random(5)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(plain)]
    long = sentence(rng, 30_000)
    near = texts[3].split() + sentence(rng, 200).split()
    texts += [None, "", "   ", "\n\t\x0b", "One", "two words", "é", long, long, " ".join(near), " ".join([*near[:-1], "zz"]), texts[0], texts[0], "\x00 nul \U0001f642 ▁mark"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None), (None, None, None, None, None), (1000, sentence(rng, 12), None, None, None)]
    return rows


def docs(spark, rows=None, extra: bool = False):
    """``rows`` as documents; ``extra`` adds columns with names that operators use inside."""
    out = spark.createDataFrame(awkward() if rows is None else rows, DOCS)
    if extra:
        for name in ("print", "component", "ids", "n_tokens", "matches", "row", "shard", "label", "score", "n", "home", "term", "digest", "payload", "canonical", "fit", "block", "least", "a", "b", "x"):
            out = out.selectExpr("*", f"'clash' as `{name}`")
    return out


def rows(df) -> list[tuple]:
    """All rows, sorted, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
