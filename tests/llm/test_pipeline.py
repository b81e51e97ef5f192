"""The pipeline stage by stage, and registered queries against their SQL."""

import zlib

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from checks.compare import TABLES, compare
from faultline.llm.common import table, written
from faultline.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_others import hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        new = written(f(spark, docs, SF), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns_and_ids(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and [t for _, t in after.dtypes] == [t for _, t in before.dtypes]
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_near_duplicates_stage(stages):
    _, before, after = stages[1]
    want = brute.linked([(r.doc_id, r.text) for r in before.collect()], 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in want.items() if i == c)


def test_benchmark_stage(stages, spark):
    _, before, after = stages[3]
    found = hits([(r.doc_id, r.text) for r in before.collect()], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, h in found.items() if not h[1])


def test_passages_stage(stages):
    _, before, after = stages[2]
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in after.collect()}
    assert all(r.n_chars == len(r.text) for r in new.values())
    seen = {}
    for i in sorted(new):  # no long line is left twice
        for line in new[i].text.split("\n"):
            if len(line.split()) >= 25:
                assert seen.setdefault(line, i) == i
    assert all(len(brute.words(new[i].text)) <= len(brute.words(old[i])) for i in new)


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def test_quality_stage_keeps_clean_documents(stages, spark):
    _, _, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = table(spark, SF, "labels").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    assert sum(good) / len(good) >= 0.95


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert result.startswith("ok"), result


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k in QUERIES} and "pipeline" in names
    assert zlib.crc32(b"1") % 5 == 3


def test_texts_go_to_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_chars int")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            spark.conf.unset(setting)
            stage(spark, docs, SF)
            got = spark.range(0, 3 * corpus_pipeline.BATCH_ROWS, 1, 1).mapInArrow(sizes, "n long").collect()
            assert max(r.n for r in got) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(setting, before)
