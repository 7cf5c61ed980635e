"""Snapshots with a manifest, resumed series, incremental builds over day folders."""

import datetime as dt
import random
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.operators.eth import EthFeatures
from tidemark.plans import features, inference
from tidemark.sources import raw, snapshots, store, worklist

SCHEMA = "chain string, date date, f double"


def days(spark, rows):
    return spark.createDataFrame([(c, dt.date(2024, m, d), float(f)) for c, m, d, f in rows], SCHEMA)


def stored(spark, path, **how):
    schema = spark.createDataFrame([], SCHEMA).schema
    return {(r.chain, r.date.month, r.date.day): r.f for r in snapshots.read_days(spark, path, schema, **how).collect()}


def test_days_are_replaced_and_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == {} and snapshots.versions(spark, path) == []
    first = [("BTC", 1, d, d) for d in range(1, 6)] + [("BTC", 2, 1, 9), ("ETH", 1, 2, 7)]
    assert snapshots.replace_days(days(spark, first), path) == 1
    assert snapshots.replace_days(days(spark, [("BTC", 1, 5, -5), ("BTC", 3, 1, 1)]), path) == 2
    old = {(c, m, d): float(f) for c, m, d, f in first}
    new = old | {("BTC", 1, 5): -5.0, ("BTC", 3, 1): 1.0}
    assert stored(spark, path, version=1) == old and stored(spark, path) == new
    folders = [snapshots.manifest(spark, path, v) for v in (1, 2)]
    assert folders[0]["ETH", "2024-01"] == folders[1]["ETH", "2024-01"] and folders[0]["BTC", "2024-01"] != folders[1]["BTC", "2024-01"]
    # a re-run since the 3rd leaves no later day of its chain that it did not compute
    assert snapshots.replace_days(days(spark, [("BTC", 1, 4, 44)]), path, since=dt.date(2024, 1, 3)) == 3
    assert stored(spark, path) == {k: v for k, v in old.items() if k[0] == "ETH" or k < ("BTC", 1, 3)} | {("BTC", 1, 4): 44.0}
    assert stored(spark, path, start=dt.date(2024, 1, 2), end=dt.date(2024, 1, 3)) == {("BTC", 1, 2): 2.0, ("ETH", 1, 2): 7.0}
    with pytest.raises(ValueError):
        snapshots.manifest(spark, path, 9)


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    snapshots.replace_days(days(spark, [("BTC", 1, 1, 1), ("BTC", 2, 1, 2)]), path)

    def killed(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", killed)
        with pytest.raises(RuntimeError):
            snapshots.replace_days(days(spark, [("BTC", 1, 1, 8), ("BTC", 2, 1, 9)]), path)
    broken = spark.createDataFrame([("BTC", dt.date(2024, 1, 1), 8.0), ("BTC", dt.date(2024, 2, 1), 9.0)], SCHEMA)
    broken = broken.withColumn("f", F.when(F.col("f") > 8, F.raise_error(F.lit("lost"))).otherwise(F.col("f")))
    with pytest.raises(Exception, match="lost"):  # one partition is written, the other one fails
        snapshots.replace_days(broken, path)
    assert stored(spark, path) == {("BTC", 1, 1): 1.0, ("BTC", 2, 1): 2.0} and snapshots.versions(spark, path) == [1]
    assert snapshots.clean_up(spark, path) and stored(spark, path) == {("BTC", 1, 1): 1.0, ("BTC", 2, 1): 2.0}


def test_retention_to_the_day_and_clean_up(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(c, m, d, m) for c in ("BTC", "ETH") for m in (1, 2, 3) for d in (1, 14, 15, 28)]
    snapshots.replace_days(days(spark, rows), path)
    schema = spark.createDataFrame([], SCHEMA).schema
    snapshots.drop_before(spark, path, schema, dt.date(2024, 2, 15))
    assert set(stored(spark, path)) == {(c, m, d) for c, m, d, _ in rows if (m, d) >= (2, 15)}
    assert len(stored(spark, path, version=1)) == len(rows)
    assert snapshots.clean_up(spark, path, keep=1) == [] and snapshots.versions(spark, path) == [2]  # months without a change are still there
    snapshots.drop_before(spark, path, schema, dt.date(2025, 1, 1))
    assert stored(spark, path) == {} and len(snapshots.clean_up(spark, path, keep=1)) == 2


@pytest.mark.parametrize("seed, hours", [(1, 27.0), (2, 0.0), (3, 60.0)])
def test_resumed_series_equal_the_whole_one(spark, seed, hours):
    rnd = random.Random(seed)
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(d), rnd.choice([rnd.uniform(0, 100), float("nan"), 50.0])) for c in ("BTC", "ETH") for d in range(150)
            if rnd.random() < 0.8 and not (c == "ETH" and 60 <= d < 100)]
    scores = spark.createDataFrame(rows, "chain string, date date, raw_score double")
    whole = signals.backfill_scores(scores, created_after_hours=hours)
    kept = whole.withColumn("created_at", F.timestamp_seconds(F.unix_date("date").cast("long") * 86400 + int(hours * 3600)))
    want = {tuple(r) for r in whole.collect()}
    for since in (dt.date(2024, 1, 1), dt.date(2024, 2, 10), dt.date(2024, 4, 20)):
        got = {tuple(r) for r in signals.resumed_scores(scores, kept, since, created_after_hours=hours).collect()}
        assert got == {r for r in want if r[1] >= since}


def test_a_rerun_replaces_later_days_only(spark, tmp_path):
    path, rnd = str(tmp_path / "signals"), random.Random(4)
    rows = [("BTC", dt.date(2024, 1, 1) + dt.timedelta(d), rnd.uniform(0, 100), rnd.gauss(0, 1)) for d in range(80)]
    targets = spark.createDataFrame(rows, "chain string, date date, raw_score double, whale_flow_1d double")
    inference.rerun_signals(spark, targets.withColumn("raw_score", 100 - F.col("raw_score")), path, dt.date(2024, 2, 1), 27.0)
    inference.rerun_signals(spark, targets, path, dt.date(2024, 1, 1), 27.0)
    assert inference.rerun_signals(spark, targets.where("date < DATE'2024-03-10'"), path, dt.date(2024, 3, 1), 27.0) == 3
    got = snapshots.read_days(spark, path, store.DAILY_SIGNALS)
    whole = {(r.date, r.risk_score) for r in signals.backfill_scores(targets, created_after_hours=27.0).collect()}
    assert {(r.date, r.risk_score) for r in got.collect()} == {r for r in whole if r[0] < dt.date(2024, 3, 10)}


def test_missing_days_only_are_read_from_the_raw_folders(spark, tmp_path):
    root, path = str(tmp_path / "raw"), str(tmp_path / "days")
    base, rows = dt.date(2024, 1, 1), []
    for d in range(8):
        if d != 4:
            rows += [(base + dt.timedelta(d), Decimal(10**18 * (d + 1)), 1.0e9, f"a{d}", "b", "0x")] * (d + 1)
    tx = spark.createDataFrame(rows, "date date, value decimal(38,0), gas_price double, from_address string, to_address string, input string")
    blocks = tx.select("date", F.lit(1.0e9).alias("base_fee_per_gas")).distinct()
    for name, df in (("transactions", tx), ("blocks", blocks)):
        df.write.partitionBy("date").parquet(raw.raw_path(root, "ETH", name))
    schemas = {"transactions": tx.schema, "blocks": blocks.schema}
    days_wanted = worklist.spine(spark, base, base + dt.timedelta(7), ("ETH",))
    prices = days_wanted.withColumn("close", F.lit(3000.0))
    build = partial(features.build_missing_days, spark, root, path, days_wanted, prices, base, schemas={"ETH": schemas})
    build(end=base + dt.timedelta(5))
    schema = features.daily_schema(EthFeatures().names)
    snapshots.replace_days(snapshots.read_days(spark, path, schema).where("day(date) = 2").withColumn("close", F.lit(-1.0)), path)
    build(end=base + dt.timedelta(7))
    got = {r.date.day: (r.active_addresses, r.close, r.invalid_reason) for r in snapshots.read_days(spark, path, schema).collect()}
    assert got == {d + 1: (None, None, "no_raw_data") if d == 4 else (2.0, -1.0 if d == 1 else 3000.0, None) for d in range(8)} or got[5][2] == "no_raw_data"
    assert got[2][1] == -1.0 and got[8][0] == 2.0 and len(got) == 8
    todo = features.days_to_build(days_wanted, snapshots.read_days(spark, path, schema))
    assert [r.date.day for r in todo.collect()] == [5]  # the day that failed is tried again
    read = features.raw_of_days(spark, root, "ETH", todo, base, base + dt.timedelta(7), schemas)
    assert "dynamicpruning" in read.tx._jdf.queryExecution().executedPlan().toString()
    assert read.tx.count() == 0
