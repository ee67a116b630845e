"""Versions of a bucketed store, and cleaning in one pass."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coterie.sources import tables
from coterie.sources.sinks import BucketStore


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_an_upsert_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), "k", "k bigint, v string", buckets=8)
    assert store.read().count() == 0 and store.versions() == []
    frame = lambda r: spark.createDataFrame(r, "v string, extra int, k bigint")
    store.upsert(frame([("a", 0, i) for i in range(100)]), 1)
    before = {f: f.stat().st_mtime_ns for f in Path(tmp_path).rglob("data/version=1/*/*.parquet")}
    store.upsert(frame([("b", 0, 5), ("new", 0, 500)]), 2)
    expected = sorted([(i, "a") for i in range(100) if i != 5] + [(5, "b"), (500, "new")])
    assert rows(store.read()) == expected
    assert {f: f.stat().st_mtime_ns for f in Path(tmp_path).rglob("data/version=1/*/*.parquet")} == before
    assert 1 <= len(list(Path(tmp_path).glob("data/version=2/bucket=*"))) <= 2
    store.upsert(frame([("c", 0, 5)]), 2)  # version 2 is complete: a retry changes nothing
    assert rows(store.read()) == expected and rows(store.read(1)) == [(i, "a") for i in range(100)]
    store.upsert(frame([(None, 0, None)]), 3)
    assert rows(store.read().filter("k is null")) == [(None, None)] and store.versions() == [1, 2, 3]
    with pytest.raises(ValueError, match="no version 9"):
        store.read(9)


def test_cleaning_reads_its_input_once_and_reports_what_it_drops(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "5"), ("", "7"), ("4", "-1"), (None, "x"), ("6", "8")], "id string, value string").withColumn("_reason", F.lit("mine"))
    checks = {"id": ~tables.has_text("id"), "value": F.coalesce(F.expr("try_cast(value as double)") < 0, F.lit(True))}
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kept, report = tables.clean(df.mapInArrow(count, df.schema), "t", "id", checks)
    assert kept.columns == df.columns and rows(kept) == [("2", "5", "mine"), ("6", "8", "mine")]
    assert rows(report) == rows(tables.quality_report(df, "t", "id", checks)) == [("t", "id", 2, ""), ("t", "value", 2, "1,4")]
    assert seen.value == 6
    kept, report = tables.clean(df.limit(0), "t", "id", checks)
    assert kept.count() == 0 and report.count() == 0
