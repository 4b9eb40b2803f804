"""Small texts with the cases that every operator must take."""

ODD = [
    (1, None),
    (2, ""),
    (3, "one"),
    (4, "  two\twords \n\n"),
    (5, "a b c a b c a b c\nline x\nline x\n\nline x "),
    (6, "Été à l'école — naïve “quotes” it's we'll 12,5 km\r\nx\x0by\x0cz"),
    (7, "word " * 3000),
    (8, "word " * 3000),
    (9, "THE END!! " * 60),
    (10, "# $ % & | < > * " * 20),
    (None, "no id here but text"),
    (11, " ".join(f"w{i}" for i in range(70)) + "\nsecond line"),
    (11, " ".join(f"w{i}" for i in range(70)) + "\nsecond line"),
    (12, "日本語 テキスト 😀 emoji"),
    (13, "x" * 50_000),
]


def frame(spark, rows=ODD):
    """With extra columns whose names clash with operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for name in ("piece", "length", "slot", "shard", "size", "bucket", "n_words", "kept", "score", "component_id", "lang", "source", "n_chars", "group_key", "ids", "value"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return frame(spark).filter("1 = 0")
