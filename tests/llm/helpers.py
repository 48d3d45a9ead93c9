"""Hard cases that every corpus operator must survive, and plain-Python counterparts."""

import re

SPACES = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30000))
PROSE = "the quick brown fox jumps over the lazy dog while many other animals watch from the hill and wonder what it is all about today my friends"
#: (doc_id, text): nulls, empty and blank texts, one word, copies, near copies, repeated rows, a repeated id, odd characters, a very long text.
ROWS = [
    (1, PROSE), (2, PROSE), (3, PROSE.upper()), (4, PROSE + " and more"), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"), (None, PROSE), (None, None),
    (10, "a b c d"), (11, "a b c d"), (12, LONG), (13, LONG + " end"), (14, "x" * 20000), (15, "héé ñandú 中文 😀   é <|endoftext|> İΣ"), (15, "héé ñandú 中文 😀   é <|endoftext|> İΣ"), (16, "spam " * 300),
    (17, "mail a.b@c.example.com call +1 (269) 555-3296 4524132264652876 host 10.0.0.1 or 300.1.1.1"), (17, "other text of the same id"), (18, "line\nline\n\nline\r\n" + "# $ % & | <>"), (-3, PROSE + " minus"), (2**40, "\x00 zero"),
]
SCHEMA = "doc_id long, text string"
#: Columns whose names operators might use themselves.
CLASHES = ("block", "bucket", "shard", "grp", "n", "size", "words", "found", "part", "bits", "train", "kept", "rep", "label", "score", "shingles", "same", "x", "_found", "at")


def table(spark, rows=None, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}) if clashes else df


def words(text, lower=False):
    text = text or ""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate(LOWER) if lower else text) if w]


def multiset(rows):
    return sorted(map(tuple, rows), key=repr)
