"""The native operators' plans, and the index over several batches."""

from __future__ import annotations

import re

from photonframe.llm import substring_dedup
from photonframe.llm.common import whole_texts
from photonframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_native_operators_run_no_python(spark):
    for name in ("op2_license_scan", "op5_linked_secrets"):
        out = QUERIES[name](spark, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", plan), name


def test_index_ingests_and_compacts(spark):
    texts = whole_texts(spark.read.parquet(f"{SF}/documents.parquet"))
    index = substring_dedup.SubstringIndex(spark, fanout=2, buckets=4)
    late, stored = [], None
    for k in range(3):
        batch = texts.where(f"doc_id div 67 = {k}")
        late += index.ingest(batch, stored).collect()
        stored = batch if stored is None else stored.unionByName(batch)
        assert len(index.runs) == 1  # compacted at two
    whole = substring_dedup.SubstringIndex(spark, buckets=4)
    want = whole.ingest(texts, None).collect()
    places = lambda rows: {(r.doc_id, p) for r in rows for p in r.late}
    assert places(late) == places(want) and places(want)
    index.drop()
    assert index.runs == []


def test_a_merge_join_reads_a_run_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = substring_dedup.SubstringIndex(spark, buckets=4)
        texts = whole_texts(spark.read.parquet(f"{SF}/documents.parquet"))
        a, b = (index._write_run(substring_dedup.fingerprints(texts.where(f"doc_id % 2 = {k}"))) for k in (0, 1))
        joined = index._counts(a).join(index._counts(b).selectExpr("fp", "n as m"), "fp")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
