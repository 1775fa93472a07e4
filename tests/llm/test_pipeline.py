from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from folioloom.llm import queries

from .helpers import clashing, empty, odd

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, apply in C.STAGES[:-1]:
        docs = C.stage(apply(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    assert [k for k, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


OWN = ["_fl_id", "_fl_digest", "_fl_source", "_fl_full", "_fl_cut", "_fl_copy"]


@pytest.mark.parametrize("shape", [lambda s: clashing(odd(s)).withColumns({k: F.lit(k) for k in OWN}), empty], ids=["odd", "empty"])
def test_all_stages_on_odd_tables(spark, tmp_path, shape):
    """Nulls, ties, repeated ids, no rows, and columns by names that operators use, through all stages in a row."""
    labels = spark.createDataFrame([(i, int(i % 2)) for i in (1, 3, 5, 6, 7, 8)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = shape(spark)
    columns = docs.columns
    for name, apply in C.STAGES[:-1]:
        before = docs
        docs = C.stage(apply(spark, docs, f"file://{tmp_path}"), f"odd-{name}")
        assert docs.columns == columns, name
        some = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())
        was, now = some(before), some(docs)
        assert set(now) <= set(was), name
        if name == "exact_dedup":
            stays = {}
            for i, text, *_ in was:
                stays[text or ""] = max(stays.get(text or "", (False, 0)), (i is not None, i or 0))
            assert sum(now.values()) == len(stays)
            assert {t or "": (i is not None, i or 0) for i, t, *_ in now} == stays
        if name == "mixing":
            assert all(n <= 2 * was[k] for k, n in now.items())
    packed = C.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
    assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in docs.collect()}


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {int(k[2:].split("_")[0]) for k in names} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
