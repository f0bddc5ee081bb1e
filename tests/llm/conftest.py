import pytest

#: Rows that every operator must take: nulls, empty and blank texts, ties, repeated rows, one very long text.
LONG = "alpha beta gamma delta epsilon " * 3000
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "s1", 48), (2, "one two three four five six seven eight nine ten", "en", "s1", 48), (3, None, "en", "s2", None), (4, "", "de", None, 0),
    (5, " \n\t ", None, "s2", 4), (6, LONG, "en", "s1", len(LONG)), (6, LONG, "en", "s1", len(LONG)), (7, "Ärger über <|endoftext|> 😀 ıİ " * 9, "de", "s3", 0), (None, "no id here at all, none", "en", "s1", 23), (9, "x", "en", "", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """The odd rows, with columns whose names operators like to use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(TEXTS, SCHEMA)
    return docs.withColumns({c: F.lit(i).cast("long") for i, c in enumerate(["size", "n", "rank", "score", "comp", "key", "digests", "c0", "bucket", "sequence_id", "target", "copies"])})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def write(spark, tmp_path):
    """Writes tables to a folder that queries take as sf_dir."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
