import pytest

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    (1, None, "en", None),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, "a"),
    (4, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, "one two", "de", None),
    (7, "x" * 200_000, "en", "a"),
    (8, "word " * 30_000, "en", "a"),
    (None, "no id here at all", "en", "a"),
    (9, "naïve Éa été  double  spaces \n\n tabs\t\tend ", "fr", "c"),
    (9, "naïve Éa été  double  spaces \n\n tabs\t\tend ", "fr", "c"),
    (10, "<|endoftext|> odd <|endoftext|>token", "fr", "c"),
    (11, "don't stop 12,345 #$% it's", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, la, s, "k", 1, 2.0, 3, None, 4, "x", "y", 5, 6, "z", None) for i, t, la, s in ODD_TEXTS]
    more = "doc int, row string, bucket int, shard string, slot string, mix int, _mix int, stratum string, measured string"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, key string, size int, id double, {more}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
