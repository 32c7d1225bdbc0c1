"""Small tables with everything that can be odd about a row."""

from pyspark.sql import types as T

CLASH = ("size", "key", "id", "n", "source_size", "version", "line", "gone", "score", "content", "TEXT", "__c0")

DOCS = T.StructType([
    *(T.StructField(name, T.StringType()) for name in CLASH[:6]),
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(name, T.StringType()) for name in CLASH[6:]),
])
LABELS = "doc_id bigint, quality int, toxic int, extra string"

PROSE = ("the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree and nobody "
         "in the village knows why the river turned silver on that cold morning in march").split()


def prose(seed: int, words: int = 40) -> str:
    out, state = [], seed * 7919 + 13
    for _ in range(words):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[(state >> 8) % len(PROSE)])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    long = "\n".join(prose(i, 60) for i in range(400))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "no id at all here", "en", "b"),
        (None, None, None, None), (4, prose(4), "en", "b"), (4, prose(4), "en", "b"), (4, prose(5), "de", "c"),
        (5, prose(4), "en", "a"), (6, long, "en", "a"), (7, long + " tail", "fr", "c"), (8, "one", None, "c"),
        (9, "123 456 !!", "en", "c"), (10, "é ü 😀 \x00 \x02\x03 end", "fr", "\U0001F600"),
        (11, "mail a@b.co and +1 (555) 123-4567 <|endoftext|>  two  spaces", "en", "a"), (-5, "negative id", "en", "a"),
    ]


def docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    full = [(*["x"] * 6, i, t, lang, s, None if t is None else len(t), *["y"] * (len(CLASH) - 6)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)
