"""Every operator and stage on odd rows, and on tables without rows."""

from pathlib import Path

import pytest

from corpus_pipeline import STAGES
from eventloom.llm import (hilbert_packing, language_crf, license_zstd, line_spread, mixing, pii, pivot_search,
                           probminhash, quality_rules, toxicity_pu)
from eventloom.session import scratch_root
from tests.llm import cases
from pyspark.sql import functions as F

LABEL_ROWS = [(4, 1, 1, "e"), (4, 0, 0, "e"), (5, None, None, "e"), (None, 1, 1, "e"), (6, 0, 1, "e"), (8, 1, 0, "e"), (99, 1, 1, "e")]

BY_ROW = {
    "language": lambda d, x: language_crf.identify(d),
    "pii": lambda d, x: pii.digest(pii.find_pii(d)),
    "toxicity": lambda d, x: toxicity_pu.toxicity(d, x),
    "license": lambda d, x: license_zstd.digest(license_zstd.scan_licenses(d)),
    "quality": lambda d, x: quality_rules.quality(d, x),
    "lines": lambda d, x: line_spread.without_boilerplate(d, counts=True),
    "classes": lambda d, x: probminhash.near_duplicates(d),
    "mix": lambda d, x: mixing.mix(d),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_result_per_row(spark, name):
    rows = cases.odd_rows()
    got = BY_ROW[name](cases.docs(spark), cases.labels(spark, LABEL_ROWS)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", BY_ROW)
def test_no_rows(spark, name):
    assert BY_ROW[name](cases.docs(spark, []), cases.labels(spark)).collect() == []


@pytest.mark.parametrize("name", BY_ROW)
def test_no_labels(spark, name):
    rows = [(i, cases.prose(i), None, "s") for i in range(6)]
    assert BY_ROW[name](cases.docs(spark, rows), cases.labels(spark)).count() == 6


def test_packing_of_odd_rows_and_of_none(spark):
    pieces = hilbert_packing.pack(cases.docs(spark)).collect()
    totals = sorted((str(r["doc_id"]), r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert len(totals) == len(cases.odd_rows())
    assert ("1", 1) in totals and ("2", 1) in totals and ("None", 1) in totals
    assert hilbert_packing.pack(cases.docs(spark, [])).collect() == []


@pytest.mark.parametrize("rows", [None, []], ids=["odd", "none"])
def test_stages_keep_columns(spark, tmp_path, rows):
    clean = [(1000 + i, cases.prose(i), "en", "d") for i in range(40)]
    toxic = [(2000 + i, f"{cases.prose(i, 9)} worthless scum", "en", "d") for i in range(20)]
    marked = [(i, 1, 0, "e") for i, *_ in clean] + [(i, 0, 1, "e") for i, *_ in toxic]
    cases.labels(spark, marked).write.parquet(f"{tmp_path}/labels.parquet")
    docs = cases.docs(spark, [*cases.odd_rows(), *clean, *toxic] if rows is None else rows)
    columns = docs.columns
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(STAGES) - 1:
            assert docs.columns == columns, name
    assert (docs.count() > 0) == (rows is None)


def test_small_tables_are_few_files(spark, tmp_path):
    """Also where Spark does not merge small shuffle partitions itself; each file costs the executor several calls."""
    rows = [(i, f"{cases.prose(i, 60)}\nbanner {i % 20}", "en", f"s{i % 6}") for i in range(240)]
    rows += [(1000 + i, f"{cases.prose(i % 40, 60)} tail{i}\nbanner {i % 20}", "en", f"s{i % 6}") for i in range(240)]
    cases.docs(spark, rows).repartition(4).write.parquet(f"{tmp_path}/docs.parquet")
    cases.labels(spark, [(i, 1, int(i % 6 == 0), "e") for i in range(240)]).write.parquet(f"{tmp_path}/labels.parquet")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in conf}
    scratch = Path(scratch_root(spark).removeprefix("file://"))
    earlier = set(scratch.iterdir()) if scratch.exists() else set()
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{k}")
            docs = spark.read.parquet(f"{tmp_path}/out-{k}")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    tables = {*scratch.iterdir(), *tmp_path.glob("out-*")} - earlier
    files = {path.name: len(list(path.glob("part-*"))) for path in tables}
    assert len(files) > 15 and max(files.values()) <= 12, files


def test_search_over_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]),
            (5, [nan, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [-1.0, -1.0]), (200, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    got = pivot_search.top_k(frame, F.col("vec_id") % 100 == 0)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    assert found[0, 1] == (1, 5 << 20) and found[0, 2] == (100, 1 << 19) and found[0, 5] == (7, -3 << 20)
    assert len([q for q, _ in found if q == 0]) == 5
    assert found[200, 1] == (0, 0)  # no components, so every score is 0 and ids decide
    assert pivot_search.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []
