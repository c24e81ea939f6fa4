import pytest

LONG = "word and " * 9000 + "4929 3483 8514 6306"
#: Nulls in any column, empty and very long texts, repeated rows, shared ids and an extra column with a clashing name.
ROWS = [
    (0, "Alpha beta.\nGamma a.b@c.de and 10.0.0.1!\nrest", "en", "s", 3),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, LONG, "en", "s", len(LONG)),
    (4, LONG, "en", "s", len(LONG)),
    (5, "ß ñ x x.y@mail.example.com 256.1.1.1 4929348385146306 +1 (017) 555-7713 +12 3", "de", None, 9),
    (5, "ß ñ x x.y@mail.example.com 256.1.1.1 4929348385146306 +1 (017) 555-7713 +12 3", "de", None, 9),
    (6, "a@b.c_x@d.e 1.2.3.4.5.6.7.8 0001.02.3.255 12 34-56 78 90 12 34 56 7", "de", "t", 1),
    (7, "... !!! 123", "fr", "t", 1),
    (8, "one two three", "fr", "t", 1),
    (9, "\n\n x \n\n", "fr", "t", 1),
    (None, "one two three four five six seven eight nine ten", "fr", "t", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, "extra", 1.5) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double").repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf_dir, odd):
    """The smallest documents with the odd rows, under ids of their own."""
    from pyspark.sql import functions as F

    some = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return some.unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang", "source", "n_chars").where("doc_id is not null"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
