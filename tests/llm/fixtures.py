"""Small tables with the awkward cases: nulls in any column, empty and long texts, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion under the pale moon tonight"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

ROWS = [
    (1, BASE, "en", "a", 10),
    (2, BASE, "en", "a", 10),
    (3, BASE.upper() + "\n", "en", "b", 10),
    (4, BASE + " indeed", "en", "a", 10),
    (5, "", None, "a", 0),
    (6, None, "en", None, None),
    (7, "one two", "en", "a", 7),
    (8, "One\ttwo ", "de", "b", 8),
    (9, LONG, "en", "a", len(LONG)),
    (10, LONG + " tail", "en", "c", len(LONG) + 5),
    (11, 'password = "abcdefghijkl" token:secret:ABCDEFGHIJKLMN AKIA' + "Z" * 20 + " " + "0123456789abcdef" * 2, "en", "a", 1),
    (12, "Released under the MIT License; Apache License, Version 2.0 and CC-BY-NC. Under the mit license", "en", "a", 1),
    (13, "é" * 50 + " ünïcode — 日本語 \u00a0 text", "ja", "d", 1),
    (None, "a row without an id but with seven words", "en", "a", 1),
    (1, BASE, "en", "a", 10),
    (14, " \n\t ", "en", "a", 4),
    (15, "\x01 control \x02 marks \x1f here", "en", "a", 4),
]


def documents(spark, rows=ROWS):
    """The rows, with extra columns whose names clash with what operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("score", "key", "node", "label", "words", "shard", "kinds", "held", "size")})


def empty(spark):
    return documents(spark, [])


LABELS = "doc_id long, quality int, toxic int"
