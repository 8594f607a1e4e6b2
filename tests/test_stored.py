"""Stored tables: untouched partitions stay as they are, merges can be repeated, late rows are never lost."""

from __future__ import annotations

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from barloom.sources import cache, stored
from barloom.sources import files as readers
from barloom.streaming import bars as sb

ROWS = "symbol string, ts date, v int"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def month(k, day=1):
    return dt.date(2020 + (k - 1) // 12, (k - 1) % 12 + 1, day)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(s, month(k, d), k) for s in "ab" for k in range(1, 25) for d in (1, 9)], ROWS)
    stored.write_parts(old, path)
    before = files(path)
    fresh = spark.createDataFrame([("a", month(3, 9), -1), ("a", month(3, 20), -2), ("c", month(30), -3), ("a", month(3, 20), -5)], ROWS)
    assert stored.merge_into(path, fresh, ["symbol", "ts"]) == ["2020-03", "2022-06"]
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f for f in before if "part=2020-03" not in f} == same and len(same) == 23
    rows = lambda: sorted(map(tuple, stored.read_parts(spark, path).collect()))
    want = {(r.symbol, r.ts): r.v for r in old.collect()} | {("a", month(3, 9)): -1, ("a", month(3, 20)): -2, ("c", month(30)): -3}
    assert rows() == sorted((*k, v) for k, v in want.items())
    stored.merge_into(path, fresh, ["symbol", "ts"])
    assert rows() == sorted((*k, v) for k, v in want.items())
    stored.merge_into(path, fresh.withColumn("v", F.lit(99)), ["symbol", "ts"], prefer="existing")
    assert rows() == sorted((*k, v) for k, v in want.items())


def test_merge_reads_only_the_partitions_it_rewrites(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.write_parts(spark.createDataFrame([("a", month(k), k) for k in range(1, 13)], ROWS), path)
    like = spark.createDataFrame([], ROWS)
    some = stored.stored_parts(spark, path, ["2020-03"], like)
    assert len(some.inputFiles()) >= 1 and some.count() == 1
    assert re.search(r"PartitionFilters: \[[^\]]*part#", some._jdf.queryExecution().toString())


def test_merge_of_nothing_and_of_rows_without_time(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored.merge_into(path, spark.createDataFrame([], ROWS), ["symbol", "ts"]) == []
    assert stored.merge_into(path, spark.createDataFrame([("a", month(1), 1)], ROWS), ["symbol", "ts"]) == ["2020-01"]
    with pytest.raises(ValueError, match="no partition"):
        stored.merge_into(path, spark.createDataFrame([("a", None, 1)], ROWS), ["symbol", "ts"])


def test_late_rows_join_their_bar_and_no_state_is_kept(spark, tmp_path):
    feed, parts, store, progress = (str(tmp_path / x) for x in ("feed", "parts", "store", "progress"))
    schema = "symbol string, ts timestamp, price double"
    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    arrivals = [
        [("a", at(1, 9, 30), 5.0), ("a", at(1, 9, 40), 7.0), ("b", at(1, 9, 1), 1.0)],
        [("a", at(9, 9, 0), 2.0)],
        [("a", at(1, 9, 10), 6.0), ("a", at(1, 9, 59), 3.0), ("b", at(9, 9, 1), 4.0)],  # eight days late
    ]
    done = -1
    for rows in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        ticks = spark.readStream.schema(schema).parquet(feed)
        query = sb.stream_partials(ticks, parts, progress)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
        done = sb.settle(spark, parts, store, done)
    assert sb.settle(spark, parts, store, done) == done
    sb.settle(spark, parts, store)  # all batches once more: none counts twice
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.n) for r in stored.read_parts(spark, store).collect()}
    assert got == {
        ("a", at(1, 9, 0)): (6.0, 7.0, 3.0, 3.0, 4),
        ("b", at(1, 9, 0)): (1.0, 1.0, 1.0, 1.0, 1),
        ("a", at(9, 9, 0)): (2.0, 2.0, 2.0, 2.0, 1),
        ("b", at(9, 9, 0)): (4.0, 4.0, 4.0, 4.0, 1),
    }


def test_cache_rebuilds_only_what_changed(spark, tmp_path):
    source, copy = tmp_path / "source", str(tmp_path / "copy")
    source.mkdir()
    for k in range(30):
        (source / f"S{k}.csv").write_text(f"Date,Close\n2024-01-01,{k}\n")
    asked = []

    def read(paths):
        asked.append(len(paths))
        return readers.read_bars(spark, paths, fields=["close"])

    refresh = lambda: cache.refresh(spark, str(source), copy, read, buckets=16)
    rows = lambda: sorted((r.symbol, r.close) for r in cache.read_cache(spark, copy).collect())
    want = {f"S{k}": float(k) for k in range(30)}
    first = refresh()
    assert asked == [30] and rows() == sorted(want.items())
    assert refresh() == [] and asked == [30]
    (source / "S3.csv").write_text("Date,Close\n2024-01-01,333\n")
    (source / "NEW.csv").write_text("Date,Close\n2024-01-01,7\n")
    want |= {"S3": 333.0, "NEW": 7.0}
    parts = refresh()
    assert 1 <= len(parts) <= 2 and asked[-1] < 15 and rows() == sorted(want.items())
    mine = {r.bucket for r in cache.manifest(spark, str(source), buckets=16).where("path LIKE '%S5.csv'").collect()}
    gone = [r.path for r in cache.manifest(spark, str(source), buckets=16).collect() if r.bucket in mine]
    for f in gone:
        name = f.rsplit("/", 1)[1]
        os.remove(source / name)
        want.pop(name.removesuffix(".csv"))
    assert refresh() == sorted(mine) and rows() == sorted(want.items()) and len(first) > 1
