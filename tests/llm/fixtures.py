"""Hand-made rows with everything an operator must bear: nulls, empty and long texts, ties, repeats."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
CAT = "The cat sat on the mat and looked at the dog"

# doc_id, text, lang, source
ROWS = [
    (1, CAT, "en", "a"),
    (2, CAT, "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (None, CAT, "en", None),
    (5, "the  CAT sat\ton the mat\nand looked at the dog", None, "a"),
    (6, LONG, "en", "b"),
    (7, "!!! 123", "en", "b"),
    (8, "\U0001d518\U0001d52b 中文 ÀÉ \x00 <|endoftext|> ՘", "xx", ""),
    (9, None, "en", "é"),
    (10, "one two", "en", "a"),
    (11, "the cat sat on the mat and looked at the cow", "en", "c"),
    (12, "one two", "en", "c"),
    (12, "one two", "en", "c"),
    (None, "no id here", None, "b"),
]

# extra columns with names that operators use inside or return
EXTRA = ("digest", "kept", "size", "salt", "row", "whole", "id", "component_id", "copies", "ids", "n_tokens", "window")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *EXTRA)]]
)


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def collected(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
