"""Small awkward tables and brute-force versions that the tests share."""

import random

LONG = "lorem ipsum dolor sit amet " * 4000

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\f\r ", "de", None),
    (5, "The quick brown fox jumps over the lazy dog", "en", "b"),
    (5, "The quick brown fox jumps over the lazy dog", "en", "b"),
    (None, "The  quick brown fox jumps over the lazy dog", None, "c"),
    (6, "one", "en", "b"),
    (7, "naïve café   x\u0085y  z 𝒳", "fr", "a"),
    (8, LONG, "la", "a"),
    (-9, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash with inner ones."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("_id", "_text", "kept", "score", "size", "n_tokens", "keep_id", "rank", "component_id", "spans", "_h", "node"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def made_up(n, seed=0, vocabulary=300, least=1, most=120):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(lexicon) for _ in range(rng.randint(least, most))) for _ in range(n)]
