import random


def docs(spark, rows, extra=False):
    """documents with these (doc_id, text)."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    """Null, empty, white space, long, repeated and tied rows, and a null id."""
    return [(1, None), (2, ""), (3, "  \n "), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "one two three four five six seven"),
            (6, "ab " * 20000), (7, "ONE two three four five six SEVEN"), (None, "one two"), (8, "é́ ﬁ Straße 日本"), (9, "x")]
