"""The pipeline stage by stage against plain versions of what each decides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rollscope.llm import pii
from tests.llm.fixtures import documents, empty
from tests.llm.test_dedup import brute_leaks, brute_similar
from tests.llm.test_scans import contract_pii


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
        assert name == pipeline.STAGES[-1][0] or frames[-1].columns == columns
    texts = [{r.doc_id: r.text or "" for r in f.collect()} for f in frames[:-1]]

    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(texts[0]) - set(texts[1])
    assert all(texts[1][i] == texts[0][i] for i in texts[1])
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.02 * len(texts[0])

    ids = sorted(texts[1])
    label = brute_similar([texts[1][i] for i in ids])
    assert set(texts[2]) == {ids[k] for k in set(label)}

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = sorted(texts[2])
    leaky = {ids[d] for d, _ in brute_leaks([texts[2][i] for i in ids], items)}
    assert leaky and set(texts[3]) == set(ids) - leaky

    assert set(texts[4]) == set(texts[3])
    for i, t in texts[4].items():
        assert not contract_pii(t)
        if not pii.TRIGGER.search(texts[3][i]):
            assert t == texts[3][i]

    mixed = frames[-1].collect()
    assert {r.doc_id: r.text or "" for r in mixed} == texts[4] and all(r.taken <= 3 * r["size"] for r in mixed)
    for f in frames[1:]:
        f.unpersist()


def test_run(spark, sf):
    first = sorted(map(tuple, pipeline.run(spark, sf).select("doc_id", "size", "taken").collect()))
    assert first and len(first) == len({r[0] for r in first})


def test_stages_on_odd_rows(spark, sf):
    for df in (documents(spark), empty(spark)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, df, sf)
            assert out.count() <= df.count()
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
                df = out


CLASHING = ["_row_id", "_first_id", "_first_words", "_id", "_words", "row", "hash", "label", "made", "_made", "kept", "words", "size", "first", "n"]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_a_stage_decides_alike_with_clashing_columns(spark, sf, name, stage):
    """Columns that are called like the stages' own change no row, and stay as they were."""
    odd = documents(spark, extra=False)
    columns = odd.columns
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(columns).unionByName(odd)
    clashing = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})
    plain, found = stage(spark, docs, sf), stage(spark, clashing, sf)
    rows = lambda df, of: Counter(map(tuple, df.select(of).collect()))
    if name == pipeline.STAGES[-1][0]:
        assert rows(plain, plain.columns) == rows(found, plain.columns)
        return
    assert found.columns == clashing.columns
    assert rows(plain, columns) == rows(found, columns)
    assert found.filter(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(CLASHING))).isEmpty()
