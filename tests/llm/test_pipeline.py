"""The pipeline against the composition of brute-force stages on the smallest tables."""

import zlib

import numpy as np

import corpus_pipeline
from tallyfold.llm import common, mixing, quality

from .conftest import SF
from .test_contracts import plain_ids
from .test_near_copies import plain_first


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    before = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = {r.id for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    good = [r for r in before if r.doc_id in kept]
    assert sorted(r.doc_id for r in rows["quality_rules"]) == sorted(r.doc_id for r in good) and len(good) < len(before)

    # near copies have a similarity of 0.8 or more of their five-word shingles
    first = plain_first([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in rows["simhash_near_dedup"]) == sorted(set(first.values()))

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in rows["benchmark_decontamination"]}
    assert not any(x in r.text for r in rows["benchmark_decontamination"] for x in items)
    gone = [r for r in rows["simhash_near_dedup"] if r.doc_id not in clean]
    assert all(any(" ".join(x.split()[k : k + 8]) in r.text for x in items for k in range(max(1, len(x.split()) - 7))) for r in gone)

    mixed = rows["source_mixing"]
    assert sorted(r.doc_id for r in mixed) == sorted(clean)
    order = {r.id: (r.slot, r.key) for r in mixing.schedule(spark.read.parquet(str(tmp_path / "benchmark_decontamination"))).collect()}
    want = sorted(clean, key=lambda i: (*order[i], i))

    texts, start = {r.doc_id: r.text for r in mixed}, 0
    got = {r.doc_id: r for r in rows["token_output"]}
    for i, ids in zip(want, plain_ids([texts[i] for i in want])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(want)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_two_pipelines_in_one_session(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (corpus_pipeline.quality_rules(spark, docs.where(f"doc_id % 2 = {k}"), SF) for k in range(2))
    first = corpus_pipeline.run(spark, SF)
    mixed = corpus_pipeline.source_mixing(spark, one, SF)
    again = corpus_pipeline.run(spark, SF)
    assert one.count() + two.count() > first.count() == again.count() and mixed.count() == one.count()


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing columns, and an empty table."""
    want = {
        "quality_rules": [None] * 0, "simhash_near_dedup": sorted([1, 4, 6, 7, 8, 9, 10, 11]), "benchmark_decontamination": None, "source_mixing": None,
    }
    ids = lambda df: sorted(i for i in (r.doc_id for r in df.collect()) if i is not None)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for table, label in ((odd, "odd"), (empty, "empty")):
            path = str(tmp_path / f"{k}-{label}")
            stage(spark, table, SF).write.parquet(path)
            out = spark.read.parquet(path)
            if name == "token_output":
                assert out.count() == table.count()
                continue
            assert out.columns == table.columns
            if label == "empty":
                assert out.count() == 0
            elif want[name] is not None:
                assert ids(out) == want[name]
            else:
                assert ids(out) == ids(odd)
            if label == "odd" and name != "quality_rules":
                assert out.where("doc_id is null").count() == 1


def test_texts_are_not_written_between_shuffles(spark):
    """Mixing writes no copy of the texts on its way; the one that the quality rules need is compressed harder than by default."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with common.recorded() as paths:
        mixed = [r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, SF).collect()]
    assert paths and not any("text" in spark.read.parquet(p).columns for p in paths)
    order = {r.id: (r.slot, r.key) for r in mixing.schedule(docs).collect()}
    assert mixed == sorted(order, key=lambda i: (*order[i], i))

    with common.recorded() as paths:
        corpus_pipeline.quality_rules(spark, docs, SF)
    copies = [p for p in paths if "text" in spark.read.parquet(p).columns]
    assert len(copies) == 1 and all(f.endswith(".zstd.parquet") for f in spark.read.parquet(*copies).inputFiles())
