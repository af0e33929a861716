"""The stages one after the other, and each query of the folder beside its SQL."""

from __future__ import annotations

import pytest

from sparkseek.llm import registry

from .. import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_beside_its_sql(name, spark, data):
    got = QUERIES[name](spark, data).toArrow()
    want = oracle.connection(data).sql(SQL[name]).to_arrow_table()
    assert oracle.rows(got) == oracle.rows(want)


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "best-fit packing"]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    last = P.STAGES[-1][1](spark, docs, data)
    whole = P.run(spark, data)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(last) == key(whole)


def test_pipeline_of_an_empty_table(spark, data, tmp_path):
    import corpus_pipeline as P

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{data}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
