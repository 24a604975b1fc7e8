"""Small tables with the awkward rows that every operator must take."""

import random

AWKWARD = [None, "", " \t\n", "a", "ß ñ 浜崎 \U0001f600", "one two", "x" * 70_000, "same words here again", "same words here again", "\x00\x1c nul", "É" * 300]


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed: int = 5, n: int = 60):
    """(doc_id, text, lang, source, n_chars, fingerprint, n): the last two clash with names that operators use inside."""
    rng = random.Random(seed)
    texts = [*AWKWARD, *(words(rng, rng.randrange(1, 160)) for _ in range(n))]
    texts += [texts[-1], texts[-2].replace("w1", "v1", 1), texts[-3] + " tail"]
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return [*out, (None, "no id", None, None, None, None, None), out[-1]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n int"


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
