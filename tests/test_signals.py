"""Signal series against a plain restatement of the rules, and day by day against the backfill."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.alerts import alert_rows, with_alerts
from tidemark.operators.signals import SignalRules, backfill, backfill_scores, signal_step
from tidemark.streaming.signals import stream_signals

START = dt.date(2024, 1, 1)
RULES = SignalRules()


def label(score):
    return "Bull" if score < 33 else "Neutral" if score < 66 else "Bear"


def plain_series(days, stored_hours):
    """The rules over a list of (date, raw score), looking the whole history up every day."""
    rows = []
    for day, raw in days:
        history = [h for h in reversed(rows) if 1 <= (day - h["date"]).days <= 30]
        if not history:
            rows.append({"date": day, "score": raw, "regime": label(raw)})
            continue
        newest = history[0]
        score = raw / 3 + newest["score"] * 2 / 3
        wanted = label(score)
        if abs(score - newest["score"]) < 10:
            wanted = newest["regime"]
        if wanted != newest["regime"]:
            others = [h for h in history if h["regime"] != newest["regime"]]
            ref = others[0] if others else history[-1]
            stored = dt.datetime.combine(ref["date"], dt.time()) + dt.timedelta(hours=stored_hours)
            if dt.datetime.combine(day, dt.time()) - stored < dt.timedelta(hours=48):
                wanted = newest["regime"]
        rows.append({"date": day, "score": score, "regime": wanted})
    return rows


def series(seed, n=120):
    rnd = random.Random(seed)
    day, out = START, []
    for _ in range(n):
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 1, 2, 40]))
        out.append((day, rnd.choice([0.0, 100.0, rnd.uniform(0, 100), rnd.uniform(0, 30), rnd.uniform(70, 100)])))
    return out


@pytest.mark.parametrize("stored_hours", [0, 27])
def test_backfill_follows_the_rules(spark, stored_hours):
    chains = {f"C{i}": series(i) for i in range(12)}
    df = spark.createDataFrame([(c, d, s) for c, days in chains.items() for d, s in days],
                               "chain string, date date, raw_score double")
    got = {(r.chain, r.date): r for r in backfill_scores(df, RULES, created_after_hours=stored_hours or None).collect()}
    changes = 0
    for chain, days in chains.items():
        want = plain_series(days, stored_hours)
        for w in want:
            g = got[(chain, w["date"])]
            assert g.risk_score == pytest.approx(w["score"], abs=1e-9) and g.regime == w["regime"]
        changes += sum(a["regime"] != b["regime"] for a, b in zip(want, want[1:]))
    assert changes > 50


@pytest.mark.parametrize("stored_hours", [None, 27.0])
def test_step_by_step_equals_backfill(spark, stored_hours):
    days = series(99, 40)
    df = spark.createDataFrame([("BTC", d, s) for d, s in days], "chain string, date date, raw_score double")
    whole = {r.date: r for r in backfill(df, RULES, created_after_hours=stored_hours).collect()}
    stored = [(r.chain, r.date, r.risk_score, r.regime, r.whale_index, r.momentum_score) for r in whole.values()]
    history = spark.createDataFrame(
        stored, "chain string, date date, risk_score double, regime string, whale_index double, momentum_score double"
    )
    if stored_hours:
        seconds = F.unix_date("date").cast("long") * 86400 + int(stored_hours * 3600)
        history = history.withColumn("created_at", F.timestamp_seconds(seconds))
    # every day's step sees the stored rows before it only, so all steps can run at once
    for r in signal_step(df, history, RULES).collect():
        assert r.risk_score == pytest.approx(whole[r.date].risk_score, abs=1e-9)
        assert r.regime == whole[r.date].regime and r.risk_state == whole[r.date].risk_state


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=1, max_size=30))
def test_scores_stay_in_range(spark, raw):
    rows = [("BTC", START + dt.timedelta(days=i), s) for i, s in enumerate(raw)]
    df = spark.createDataFrame(rows, "chain string, date date, raw_score double")
    out = backfill(df).collect()
    assert len(out) == len(raw)
    for r in out:
        assert all(0.0 <= v <= 100.0 for v in (r.risk_score, r.whale_index, r.stress_index, r.momentum_score))


SIGNAL = "chain string, date date, whale_index double, stress_index double, momentum_score double, regime string"


def test_alert_limits_are_strict(spark):
    rows = [("BTC", START, 50.0, 80.0, 60.0, "Bull"), ("BTC", START + dt.timedelta(1), 70.0, 80.5, 35.0, "Bull"),
            ("BTC", START + dt.timedelta(2), 90.5, 10.0, 9.0, "Bear")]
    got = [(r.date, r.alert_type, r.message) for r in
           alert_rows(spark.createDataFrame(rows, SIGNAL)).orderBy("date", "alert_type").collect()]
    assert [(d.day, t) for d, t, _ in got] == [(2, "stress_event"), (3, "momentum_collapse"), (3, "regime_shift"), (3, "whale_spike")]
    assert got[0][2] == "On-chain stress elevated: stress_index at 80.5."
    assert got[2][2] == "Regime shift from Bull to Bear."


def test_no_alerts_without_history(spark):
    df = spark.createDataFrame([("BTC", START, 99.0, 10.0, 0.0, "Bear")], SIGNAL)
    df = df.selectExpr("*", "CAST(NULL AS DOUBLE) prev_whale_index", "CAST(NULL AS DOUBLE) prev_momentum_score",
                       "CAST(NULL AS STRING) prev_regime")
    assert with_alerts(df).first().alerts == []


def test_stream_gives_the_backfill(spark, tmp_path):
    days = series(5, 30)
    schema = "chain string, date date, raw_score double"
    rows = [("BTC", d, s) for d, s in days]
    for i in range(0, 30, 10):
        spark.createDataFrame(rows[i:i + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [("BTC", days[3][0], 1.0)]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_signals(source, RULES).writeStream.format("memory").queryName("sig").outputMode("append")
    q = out.option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("sig").collect()
    want = {r.date: r for r in backfill_scores(spark.createDataFrame(rows, schema), RULES).collect()}
    in_time = {r.date: r for r in got if not r.is_late}
    assert {d: (r.risk_score, r.regime) for d, r in in_time.items()} == {d: (r.risk_score, r.regime) for d, r in want.items()}
    assert [r.date for r in got if r.is_late] == [days[3][0]]


def test_stream_of_shuffled_days_ends_as_the_batch_series(spark, tmp_path):
    rnd = random.Random(12)
    schema = "chain string, date date, raw_score double"
    rows = [(c, START + dt.timedelta(days=d), rnd.uniform(0, 100)) for c in ("BTC", "ETH") for d in range(90) if c == "BTC" or d % 3]
    order = sorted(rows, key=lambda r: r[1].toordinal() + rnd.uniform(0, 25))  # up to 25 days out of order
    for i in range(0, len(order), 9):
        spark.createDataFrame(order[i:i + 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = [("BTC", START + dt.timedelta(days=80), 1.0)]  # revised
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = (stream_signals(source, RULES).writeStream.foreachBatch(lambda df, n: seen.append((n, df.collect())))
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        q.processAllAvailable()
        spark.createDataFrame(again, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    last = {(r.chain, r.date): (r.risk_score, r.regime) for _, part in sorted(seen, key=lambda x: x[0]) for r in part if not r.is_late}
    final = [r if r[:2] != again[0][:2] else again[0] for r in rows]
    want = {(r.chain, r.date): (r.risk_score, r.regime) for r in backfill_scores(spark.createDataFrame(final, schema), RULES).collect()}
    assert last == want and not any(r.is_late for _, part in seen for r in part)
