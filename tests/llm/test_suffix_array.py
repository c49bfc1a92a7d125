"""The suffix array against a sort of all suffixes, and what it removes against the content sample."""

import random

from tallyfold.llm import substrings, suffix_array

from .conftest import SF


def test_ranks_equal_a_sort_of_all_suffixes(spark):
    rng = random.Random(4)
    for text in ("a", "banana", "".join(rng.choice("ab") for _ in range(100))):
        df = spark.createDataFrame([(k, ord(c)) for k, c in enumerate(text)], "g long, v long")
        got = {r.g: r["rank"] for r in suffix_array.suffix_ranks(df, len(text)).collect()}
        want = {g: k for k, g in enumerate(sorted(range(len(text)), key=lambda g: text[g:]))}
        assert got == want, text


def test_removal_equals_the_content_sample(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("octet_length(text) < 1000")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(suffix_array.dedup_by_suffixes(docs)) == rows(substrings.dedup_substrings(docs))
    assert suffix_array.dedup_by_suffixes(empty).count() == 0
