"""Documents that try every edge: nulls in any column, empty and very long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 20000
#: Names that operators use inside, or return.
CLASHING = (
    "keep", "score", "r", "gone", "hashes", "d", "a", "b", "m", "node", "hi", "lo", "id", "holder", "line", "count", "rank", "length",
    "piece", "block", "slot", "w", "s", "f", "code", "key", "__r", "__gone", "__again", "__n", "__id", "__lang", "__rl", "__h", "__c", "__source", "__out", "__task", "__t",
)
ROWS = [
    (1, "One line that is long enough to count.\nAnother line that is long enough.", "en", "web", 72), (2, "One line that is long enough to count.", "en", "web", 38),
    (3, None, "en", "web", None), (4, "", None, None, 0), (None, "No id here but a text that is long enough.", "de", "books", 41), (None, None, None, None, None),
    (5, LONG, "xx", "books", len(LONG)), (6, LONG + " end", "xx", "books", None), (7, "   \n\t ", "fr", "web", 6), (8, "!!! ??? ...", "es", None, 11),
    (9, "same text", "en", "web", 9), (9, "same text", "en", "web", 9), (10, "same text", "en", "code", 9), (9, "another text under a used id", "en", "web", 28),
    (11, "Ünïcödé 日本語 \U0001f600 \u0000 text", "ja", "web", 20),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, clashing: bool = True):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING if clashing else ():
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
