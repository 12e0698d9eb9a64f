"""The pipeline against a plain run of its stages' definitions on one machine."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import packing, quality_model
from emberline.llm.quality_rules import RULES, Measured
from tests.llm.conftest import SF_DIR
from tests.llm.test_dedup import slow_similar


def test_stages_are_as_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing",
    ]


def test_run(spark, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = dict(given)
    left = {i for i, t in given if not any(r.rejects(Measured(t)) for r in RULES)}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    judged = quality_model.judge(docs.where(docs["doc_id"].isin(sorted(left))), labels)
    left &= {r["doc_id"] for r in judged.where("kept").collect()}
    last = {}
    for i in sorted(left):
        last[texts[i]] = i
    ids = sorted(last.values())
    ids = [i for n, (i, first) in enumerate(zip(ids, slow_similar([texts[i] for i in ids]), strict=True)) if n == first]
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 1024 for r in rows)
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    pieces = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert max(pieces.values()) == 1
    assert all(sum(p[0] == i for p in pieces) == len(packing.cut(tokens[i], 1024)) for i in ids)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).schema == docs.schema, name


def _packed(spark, tmp_path, name, docs):
    folder = tmp_path / name
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert _packed(spark, tmp_path, "none", docs.limit(0)).count() == 0


def test_clashing_columns_and_ids_that_are_null_or_repeat(spark, tmp_path):
    """Which texts stay does not hang on their ids, and columns named like those of the operators do no harm."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clashing = docs.withColumns({c: F.lit(c) for c in ("kept", "digest", "fp", "label", "host", "path", "evidence", "ids", "row", "key", "a.b")})
    plain = corpus_pipeline.run(spark, SF_DIR).collect()
    same = _packed(spark, tmp_path, "clashing", clashing).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in same) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in plain)
    odd = clashing.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 40))
    # labels follow ids, so only the number of texts can be compared, and only where the model still keeps them
    found = _packed(spark, tmp_path, "odd", odd).collect()
    assert found and {r["doc_id"] for r in found} <= {None, *range(40)}
