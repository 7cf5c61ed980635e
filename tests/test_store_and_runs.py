"""Stored tables, training and inference end to end, stream aggregation."""

import datetime as dt
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.oracles import ORACLES
from checks.queries import training_evidence, train_days_learnt
from tests.compare import compare
from tidemark import spec
from tidemark.operators import metrics, normalize, training_data
from tidemark.operators.btc import BtcFeatures
from tidemark.operators.model import (
    ModelConfig, active_models, best_iteration, best_prefix, boost, first_trees, next_versions, risk_scores, train, tree_columns,
)
from tidemark.plans import inference, reports, training
from tidemark.sources import store
from tidemark.streaming.daily import stream_daily_aggregates, stream_daily_distinct, stream_daily_medians

T0 = dt.datetime(2024, 1, 2, 3)
NAN, INF = float("nan"), float("inf")


def signal(chain, date, score, created=T0):
    return (chain, date, score, "Bull", "Risk ON", 1.0, 2.0, 3.0, created)


def test_signals_are_upserted(spark, tmp_path):
    root = str(tmp_path)
    store.create_tables(spark, root)
    store.create_tables(spark, root)
    first = [signal("BTC", dt.date(2024, 1, 1), 1.0), signal("BTC", dt.date(2024, 2, 1), 2.0), signal("ETH", dt.date(2024, 1, 1), 3.0)]
    df = spark.createDataFrame(first, store.DAILY_SIGNALS)
    for _ in range(2):
        store.write_rows(spark, root, "daily_signals", df)
        assert store.read_table(spark, root, "daily_signals").count() == 3
    later = T0 + dt.timedelta(hours=1)
    new = spark.createDataFrame([signal("BTC", dt.date(2024, 1, 1), 8.0), signal("BTC", dt.date(2024, 1, 1), 9.0, later),
                                 signal("BTC", dt.date(2024, 1, 2), 5.0)], store.DAILY_SIGNALS)
    store.write_rows(spark, root, "daily_signals", new)
    got = {(r.chain, r.date): r.risk_score for r in store.read_table(spark, root, "daily_signals").collect()}
    assert got == {("BTC", dt.date(2024, 1, 1)): 9.0, ("BTC", dt.date(2024, 1, 2)): 5.0, ("BTC", dt.date(2024, 2, 1)): 2.0,
                   ("ETH", dt.date(2024, 1, 1)): 3.0}


def test_alerts_are_added_once(spark, tmp_path):
    root = str(tmp_path)
    store.create_table(spark, root, "alerts")
    rows = spark.createDataFrame([("BTC", dt.date(2024, 1, 1), "stress_event", "m", T0)],
                                 "chain string, date date, alert_type string, message string, created_at timestamp")
    for message in ("m", "other"):
        store.write_rows(spark, root, "alerts", store.with_alert_id(rows.withColumn("message", F.lit(message))))
    assert [r.message for r in store.read_table(spark, root, "alerts").collect()] == ["m"]


def test_features_are_stored_by_day(spark, tmp_path):
    path = str(tmp_path / "features")
    schema = "chain string, date date, f double"
    store.write_features(spark.createDataFrame([("BTC", dt.date(2024, 1, 1), 1.0), ("BTC", dt.date(2024, 1, 2), 2.0)], schema), path)
    again = [("BTC", dt.date(2024, 1, 2), NAN), ("ETH", dt.date(2024, 1, 2), 4.0), ("ETH", dt.date(2024, 1, 2), 4.0)]
    store.write_features(spark.createDataFrame(again, schema), path)
    got = {(r.chain, r.date.day): (r.f, r.g) for r in store.load_features(spark, path, ["f", "g"]).collect()}
    assert got == {("BTC", 1): (1.0, None), ("BTC", 2): (None, None), ("ETH", 2): (4.0, None)}


def test_a_day_written_again_keeps_the_month(spark, tmp_path):
    path = str(tmp_path / "features")
    schema = "chain string, date date, f double"
    store.write_features(spark.createDataFrame([("BTC", dt.date(2024, 1, i), float(i)) for i in range(1, 21)], schema), path)
    store.write_features(spark.createDataFrame([("BTC", dt.date(2024, 1, 20), -1.0)], schema), path)
    got = {r.date.day: r.f for r in store.load_features(spark, path, ["f"]).collect()}
    assert got == {i: float(i) if i < 20 else -1.0 for i in range(1, 21)}


def test_retention_drops_stored_months(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = [("BTC", dt.date(2024, m, d), 1.0) for m in (1, 2, 3) for d in (1, 20)]
    store.write_features(spark.createDataFrame(rows, "chain string, date date, f double"), path)
    assert store.drop_before(spark, path, dt.date(2024, 3, 10)) == ["chain=BTC/month=2024-01", "chain=BTC/month=2024-02"]
    assert sorted(r.date for r in store.load_features(spark, path, ["f"]).collect()) == [dt.date(2024, 3, 1), dt.date(2024, 3, 20)]


def test_invalid_rows_are_refused(spark, tmp_path):
    root = str(tmp_path)
    store.create_tables(spark, root)
    metrics_rows = [("BTC", "1.0.0", 0.7, 0.5, None, T0), ("BTC", "1.0.1", 7.5, 0.5, None, T0), ("ETH", "1.0.0", NAN, None, None, T0),
                    ("ETH", "1.0.1", None, -1.0, None, T0), ("ETH", "1.0.2", None, None, None, None)]
    refused = store.write_rows(spark, root, "performance_summary", spark.createDataFrame(metrics_rows, store.PERFORMANCE))
    assert {r.model_version for r in refused.collect()} == {"1.0.1", "1.0.0"} and refused.count() == 3
    assert {(r.chain, r.model_version) for r in store.read_table(spark, root, "performance_summary").collect()} == {("BTC", "1.0.0"), ("ETH", "1.0.2")}
    day = dt.date(2024, 1, 1)
    signal_rows = [("BTC", day, 50.0, "Bull", "Neutral", 1.0, 2.0, 3.0, T0), ("BTC", day + dt.timedelta(1), 150.0, "Bull", "Neutral", 1.0, 2.0, 3.0, T0),
                   ("DOGE", day, 50.0, "Bull", "Neutral", 1.0, 2.0, 3.0, T0), ("ETH", day, 50.0, "Odd", "Neutral", 1.0, 2.0, 3.0, T0),
                   ("ETH", dt.date(2030, 1, 1), 50.0, "Bull", "Neutral", 1.0, 2.0, 3.0, T0)]
    refused = store.write_rows(spark, root, "daily_signals", spark.createDataFrame(signal_rows, store.DAILY_SIGNALS), dt.date(2024, 2, 1))
    assert refused.count() == 4 and store.read_table(spark, root, "daily_signals").count() == 1
    alert_rows = [(1, "BTC", day, "stress_event", "m", T0), (2, "BTC", day, "noise", "m", T0), (3, "ETH", day, "stress_event", None, T0)]
    refused = store.write_rows(spark, root, "alerts", spark.createDataFrame(alert_rows, store.ALERTS))
    assert sorted(r.id for r in refused.collect()) == [2, 3] and store.read_table(spark, root, "alerts").count() == 1


def test_metrics_refuse_bad_input(spark):
    rows = [("ok", 1, 0.9), ("ok", 0, 0.1), ("nan", 1, NAN), ("nan", 0, 0.1), ("nan", 1, 0.7), ("range", 1, 1.5), ("range", 0, 0.2),
            ("label", 2, 0.5), ("label", 0, 0.4), ("label", 1, 0.6), ("null", None, 0.4), ("null", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r for r in metrics.evaluation_report(df, ["g"], with_reason=True).collect()}
    assert got["ok"].auc == 1.0 and got["ok"].recall == 1.0 and got["ok"].reason is None
    assert {g: r.reason for g, r in got.items() if g != "ok"} == {
        "nan": "bad_score", "range": "score_out_of_range", "label": "non_binary_label", "null": "bad_label,bad_score"}
    assert all(got[g].auc is None and got[g].recall is None and got[g].tp is None for g in ("nan", "range", "label", "null"))
    counts = {r.g: (r.tp, r.fp) for r in metrics.confusion(df.where("g = 'nan'"), ["g"]).collect()}
    assert counts == {"nan": (1, 0)}
    assert {r.g: r.auc for r in metrics.roc_auc(df, ["g"]).collect()} == {"ok": 1.0, "nan": None, "range": None, "label": None, "null": None}


def test_scaling_needs_parameters(spark):
    df = spark.createDataFrame([("BTC", dt.date(2024, 1, 1), 3.0), ("ETH", dt.date(2024, 1, 1), 7e6)], "chain string, date date, a double")
    params = spark.createDataFrame([("BTC", "a", 1.0, 2.0)], store.NORM_PARAMS)
    assert {r.chain: r.a for r in normalize.transform(df, params, ["a"]).collect()} == {"BTC": 1.0, "ETH": None}
    for names, chain in ((["b"], None), (["a"], "ETH")):
        with pytest.raises(ValueError):
            normalize.check_params(params, names, chain)
    assert normalize.check_params(params, ["a"], "BTC") is params


def test_scaling(spark, tmp_path):
    rows = [("BTC", dt.date(2024, 1, i), float(i), 5.0, INF) for i in range(1, 6)] + [("BTC", dt.date(2024, 1, 9), None, None, NAN)]
    df = spark.createDataFrame(rows, "chain string, date date, a double, b double, c double")
    params = normalize.fit_params(df, ["a", "b", "c", "gone"])
    assert {r.feature: (round(r["mean"], 9), round(r["std"], 9)) for r in params.collect()} == {
        "a": (3.0, round(2 ** 0.5, 9)), "b": (5.0, 0.0), "c": (0.0, 0.0)}
    z = normalize.transform(df, params, ["a", "b", "c"])
    stats = z.select(F.avg("a"), F.stddev_pop("a")).first()
    assert stats[0] == pytest.approx(0, abs=1e-12) and stats[1] == pytest.approx(1)
    last = z.where("a IS NULL").first()
    assert (last.b, last.c) == (None, None)
    assert normalize.transform_for_inference(df, params, ["a", "b"]).where("a IS NULL").first().b == 0.0
    path = str(tmp_path / "p")
    normalize.save_params(params, path, "1.0.0")
    assert normalize.load_params(spark, path, "1.0.0", strict=True).count() == 3
    broken = spark.createDataFrame([("BTC", "a", "x", "1"), ("BTC", "b", None, "NaN")], "chain string, feature string, mean string, std string")
    assert [(r.feature, r["mean"], r["std"]) for r in normalize.clean_params(broken).collect()] == [("b", 0.0, 0.0)]
    assert normalize.bad_params(broken).count() == 2
    with pytest.raises(ValueError):
        normalize.fit_params(df, [])
    with pytest.raises(ValueError):
        normalize.save_params(params.limit(0), path, "2")


@pytest.mark.parametrize("n, bad, kept", [(20, 1, 19), (50, 3, 50)])
def test_cleaning_drops_few_and_fills_many(spark, n, bad, kept):
    rows = [("BTC", i, INF if i < bad else float(i), 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "chain string, target int, a double, b double")
    out = training_data.clean_training_rows(df, ["a", "b"]).collect()
    assert len(out) == kept
    filled = [r.a for r in out if r.target < bad]
    assert filled == ([] if kept < n else [float(sorted(range(bad, n))[(n - bad) // 2])] * bad)


def test_return_ratios(spark):
    def ratios(values):
        df = spark.createDataFrame([(v,) for v in values], "ret double")
        r = metrics.return_ratios(df).first()
        return r.sharpe, r.sortino

    assert ratios([0.1]) == (None, INF)
    assert ratios([0.1, 0.1]) == (0.0, INF)
    assert ratios([-0.1, -0.1])[1] == 0.0
    assert ratios([0.1, NAN]) == (None, None)


def test_one_class_gives_no_auc(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, p double")
    r = metrics.evaluation_report(df, []).first()
    assert (r.auc, r.hitrate, r.precision, r.recall, r.tn, r.fp) == (None, None, 0.0, 0.0, 1, 1)


PERF = store.PERFORMANCE


def test_registry(spark):
    rows = [("BTC", "1.0.9", 0.7, 0.5, None, T0), ("BTC", "1.0.10", 0.6, 0.5, None, T0 + dt.timedelta(1)), ("ETH", "odd", 0.9, None, None, T0)]
    perf = spark.createDataFrame(rows, PERF)
    got = {r.chain: r.next_version for r in next_versions(perf, reports.chain_dimension(spark, ("BTC", "ETH", "X"))).collect()}
    assert got == {"BTC": "1.0.11", "ETH": "1.0.0", "X": "1.0.0"}
    assert {r.chain: r.model_version for r in active_models(perf).collect()} == {"BTC": "1.0.9", "ETH": "odd"}


@pytest.mark.parametrize("hours, status", [(24, "healthy"), (27, "degraded"), (48, "degraded"), (49, "unhealthy")])
def test_freshness_limits(spark, hours, status):
    signals = spark.createDataFrame([signal("BTC", dt.date(2024, 1, 30), 1.0)], store.DAILY_SIGNALS)
    as_of = dt.datetime(2024, 1, 30) + dt.timedelta(hours=hours)
    perf = spark.createDataFrame([("BTC", "1.0.0", 0.7, None, None, T0)], PERF)
    got = {r.chain: r.status for r in reports.chain_status(reports.chain_dimension(spark), signals, perf, as_of).collect()}
    assert got == {"BTC": status, "ETH": "unhealthy"}
    assert reports.service_freshness(signals, as_of).first().status == status
    assert reports.service_freshness(signals, as_of, "ETH").first().status == "degraded"


@pytest.mark.parametrize("as_of, want", [("2024-01-31 01:59", "too_early"), ("2024-01-31 02:00", "not_processed"), ("2024-02-01 00:00", "ready")])
def test_readiness(spark, as_of, want):
    days = spark.createDataFrame([(dt.date(2024, 1, 31),)], "date date")
    none = days.limit(0)
    assert reports.readiness(days, none, dt.datetime.fromisoformat(as_of)).first().readiness == want


def test_report_arguments(spark):
    alerts = spark.createDataFrame([], store.ALERTS)
    for bad in ({"days": 0}, {"days": 91}, {"limit": 0}, {"alert_type": "x"}, {"chain": "DOGE"}):
        with pytest.raises(ValueError):
            reports.recent_alerts(alerts, T0, **bad)
    with pytest.raises(ValueError):
        reports.alerts_for_date(alerts, dt.date(2025, 1, 1), T0)


def test_training_and_inference(spark, tmp_path):
    root, rnd = str(tmp_path), random.Random(1)
    rows = []
    for i in range(300):
        day = dt.date(2023, 1, 1) + dt.timedelta(days=i)
        for chain in spec.CHAINS:
            f = [rnd.gauss(0, 1) for _ in spec.ALL_FEATURES]
            rows.append((chain, day, *f, int(f[0] + f[4] + rnd.gauss(0, 0.2) > 0)))
    schema = "chain string, date date, " + ", ".join(f"{n} double" for n in spec.ALL_FEATURES) + ", target int"
    data = spark.createDataFrame(rows, schema)
    dates = training_data.SplitDates(dt.date(2023, 1, 1), dt.date(2023, 7, 31), dt.date(2023, 8, 1), dt.date(2023, 12, 31))
    config = ModelConfig(trees=6, max_depth=3, learning_rate=0.3)
    names = {**spec.FEATURES_BY_CHAIN, "SOL": ("whale_flow_1d",)}
    outcome = training.run_training(spark, data, root, T0, dates, names, config)
    assert (outcome["BTC"], outcome["ETH"]) == ("1.0.0", "1.0.0") and outcome["SOL"].startswith("failed")
    perf = store.read_table(spark, root, "performance_summary")
    assert {r.chain for r in active_models(perf).collect()} == {"BTC", "ETH"}
    models, params = inference.load_active(spark, root)
    assert set(models) == set(spec.CHAINS) and params.count() == 13
    last = dt.date(2023, 10, 20)
    features = data.drop("target").withColumn(
        "gas_price_median", F.when((F.col("chain") == "BTC") | (F.col("date") != F.lit(last)), F.col("gas_price_median")))
    for offset in (1, 0):
        day = last - dt.timedelta(days=offset)
        for _ in range(2):
            done = inference.run_inference(spark, features, params, models, root, day, dt.datetime(2023, 10, 21, 1))
        stored = {r.chain: r.stored for r in done.collect()}
        assert stored == {"BTC": True, "ETH": offset == 1}
    signals = store.read_table(spark, root, "daily_signals")
    assert signals.count() == 3
    assert signals.where("NOT risk_score BETWEEN 0 AND 100").isEmpty()
    plain = train(data.where("chain = 'BTC'"), ["whale_flow_1d"], ModelConfig(trees=2, max_depth=2), split=None)
    assert best_iteration(plain) == 2 and 1 <= best_iteration(models["BTC"]) <= 6
    assert risk_scores(plain, data.where("chain = 'BTC'")).where("raw_score IS NULL").isEmpty()
    scored = risk_scores(models["BTC"], features.where("chain = 'BTC'").fillna(0.0))
    assert scored.where("raw_score IS NULL OR NOT raw_score BETWEEN 0 AND 100").isEmpty()


def plain_auc(rows):
    ones, zeros = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)


@pytest.fixture(scope="module")
def boosting_rows(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        x = [rnd.gauss(0, 1) for _ in range(4)]
        rows.append((*x, int(x[0] + x[1] * x[2] + rnd.gauss(0, 0.3) > 0), "train" if i < 280 else "validation"))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, target int, split string")


def test_boosting_stops_and_keeps_the_best_trees(spark, boosting_rows):
    names, late = ["a", "b", "c", "d"], boosting_rows.where("split = 'validation'")
    config = ModelConfig(trees=14, max_depth=3, learning_rate=0.2, patience=14, chunk=5)
    whole = boost(boosting_rows, names, config)
    assert whole.fitted == 14 and len(whole.aucs) == 14
    all_trees = boost(boosting_rows, names, ModelConfig(trees=14, max_depth=3, learning_rate=0.2, patience=None, chunk=5)).model
    assert best_iteration(all_trees) == 14
    aucs = [plain_auc([(r.target, r.raw_score) for r in risk_scores(first_trees(all_trees, k), late).collect()]) for k in (1, 6, 14)]
    assert aucs == pytest.approx([whole.aucs[k - 1] for k in (1, 6, 14)])
    assert best_iteration(whole.model) == whole.aucs.index(max(whole.aucs)) + 1 and max(whole.aucs) > 0.75
    early = boost(boosting_rows, names, ModelConfig(trees=14, max_depth=3, learning_rate=0.2, patience=2, chunk=2))
    kept = best_iteration(early.model)
    assert early.aucs == pytest.approx(whole.aucs[: early.fitted]) and early.fitted <= kept + 2 + 2 and kept == best_prefix(whole.aucs[: early.fitted], 2)


def test_a_tree_splits_on_its_own_features_only(boosting_rows):
    names, config = ["a", "b", "c", "d"], ModelConfig(trees=6, max_depth=3, column_share=0.5, patience=None, chunk=4)
    model = boost(boosting_rows, names, config).model

    def used(node):
        return {node.split().featureIndex()} | used(node.leftChild()) | used(node.rightChild()) if node.subtreeDepth() else set()

    trees = [used(t.rootNode()) for t in model.stages[-1]._java_obj.trees()]
    drawn = [set(tree_columns(config, t, 4)) for t in range(6)]
    assert all(u and u <= d and len(d) == 2 for u, d in zip(trees, drawn)) and len(set(map(frozenset, drawn))) > 1


def test_evidence_of_days_with_one_label(spark, tmp_path):
    """Prices that never fall by the drawdown, as means of very many rows do not: no day has label 1, so there is no AUC."""
    rnd = random.Random(5)
    days = [dt.datetime(1995, 1, 2) + dt.timedelta(days=i) for i in range(110)] + [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    lines = [(8 * i + j, rnd.randrange(2000), rnd.randrange(100), 1 + j, float(rnd.randint(1, 50)), 5e4 + rnd.random() * 100, 0.0,
              rnd.random() / 10, rnd.choice("RAN"), "O", day) for i, day in enumerate(days) for j in range(4)]
    orders = [(i, rnd.randrange(1, 500), "O", rnd.random() * 1e5, day, "5-LOW" if i % 3 else "1-URGENT") for i, day in enumerate(days)]
    kinds = ("signup", "purchase", "view", "error")
    events = [(24 * i + h, dt.datetime(2024, 1, 1 + i, h), rnd.randrange(99), kinds[h % 4], 50 + rnd.random(), "{}") for i in range(30) for h in range(24)]
    con = duckdb.connect()
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, training_evidence, ORACLES["training_evidence"], str(tmp_path)) is None


@pytest.mark.parametrize("labels, scores, auc, want", [
    ([0] * 100, [10.0] * 100, None, (100, True)), ([0] * 100, [10.0] * 99 + [60.0], None, (100, False)),
    ([1] * 100, [90.0] * 100, None, (100, True)), ([1] * 100, [90.0] * 99 + [None], None, (100, False)),
    ([0, 1] * 50, [10.0] * 100, 0.5, (100, False)), ([0, 1] * 50, [10.0, 90.0] * 50, 1.0, (100, True)),
    ([0, 1] * 50, [10.0, None] * 50, None, (100, False)), ([0, 1], [90.0, 10.0], 0.0, (2, True))])
def test_train_days_learnt(spark, labels, scores, auc, want):
    rows = [(y, p, "train") for y, p in zip(labels, scores)] + [(0, 99.0, "validation"), (1, 1.0, "validation")]
    assert train_days_learnt(spark.createDataFrame(rows, "target int, raw_score double, split string"), auc) == want


@pytest.mark.parametrize("labels, scores, auc, want", [
    ([0, 1], [90.0, 10.0], 0.0, (2, False)), ([0, 1], [10.0, 90.0], 1.0, (2, True)), ([0, 1] * 3, [50.0] * 6, 0.5, (6, False)),
    ([1] * 6, [90.0] * 6, None, (6, True)), ([1] * 6, [90.0] * 5 + [40.0], None, (6, False)), ([0], [90.0], None, (1, False)),
    ([0, 1] * 49 + [0], [50.0] * 99, 0.5, (99, False)), ([], [], None, (0, False))])
def test_any_number_of_train_days_is_judged(spark, labels, scores, auc, want):
    rows = [(y, p, "train") for y, p in zip(labels, scores)] + [(0, 10.0, "validation"), (1, 90.0, "validation")]
    assert train_days_learnt(spark.createDataFrame(rows, "target int, raw_score double, split string"), auc, few=0) == want


@pytest.mark.parametrize("told, learns", [(False, False), (True, True)])
def test_evidence_of_few_days(spark, tmp_path, told, learns):
    """Six train days of both labels: their fit has learnt when a feature tells the labels, and not when each day has a twin of the other label."""
    rnd = random.Random(6)
    days = [dt.datetime(1995, 1, 2) + dt.timedelta(days=i) for i in range(20)] + [dt.datetime(2000, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    lines = [(8 * i + j, rnd.randrange(2000), rnd.randrange(100), 1 + j, float(rnd.randint(1, 50)), 5e4 + rnd.random() * 100, 0.0,
              rnd.random() / 10, rnd.choice("RAN"), "O", day) for i, day in enumerate(days) for j in range(4)]
    orders = [(i, rnd.randrange(1, 500), "O", rnd.random() * 1e5, day, "5-LOW" if i % 3 else "1-URGENT") for i, day in enumerate(days)]
    high = {d for d in range(60) if d in (1, 3, 5) or d > 5 and d % 20 == 0}  # closes that are followed by a fall; no other feature follows from the values
    calls = [24 * (d in high) if told else 1 + d // 2 % 3 * 4 for d in range(60)]
    events = [(60 * d + h, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), h, "click" if h < calls[d] else "view",
               90.0 if d in high and h > 12 else 50.0, "{}") for d in range(60) for h in range(24)]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("events", events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = {row["chain"]: row for row in training_evidence(spark, str(tmp_path)).collect()}
    assert (found["ETH"]["n_train"], found["ETH"]["learns"]) == (6, learns)


def test_chains_are_trained_at_the_same_time(spark):
    both = threading.Barrier(2, timeout=60)

    def run(chain):
        if chain == "bad":
            raise ValueError("no data")
        both.wait()  # passes only while the other one runs too
        n = spark.range(1000).groupBy(F.col("id") % 7).count().count()
        both.wait()
        return f"{chain} {n}"

    assert training.at_once(run, ["a", "b"]) == {"a": "a 7", "b": "b 7"}
    with pytest.raises(ValueError):
        training.at_once(run, ["bad"])


@pytest.mark.parametrize("aucs, patience, want", [
    ([0.5, 0.7, 0.6, 0.9], 50, 4), ([0.5, 0.7, 0.6, 0.65, 0.9], 2, 2), ([0.7, 0.7], 5, 1), ([None, None], 5, 0), ([None, 0.6], 5, 2), ([], 5, 0)])
def test_best_prefix(aucs, patience, want):
    assert best_prefix(aucs, patience) == want


def test_stream_aggregates_equal_batch(spark, tmp_path):
    schema = "chain string, ts timestamp, is_whale boolean, value_usd double, from_address string"
    base = dt.datetime(2024, 1, 1)
    rows = [("BTC", base + dt.timedelta(hours=h), h % 3 == 0, float(h), f"a{h % 7}") for h in range(24 * 4)]
    path = str(tmp_path / "tx")
    spark.createDataFrame(rows, schema).write.parquet(path)
    source = spark.readStream.schema(schema).parquet(path)
    q = (stream_daily_aggregates(source, BtcFeatures(), ["from_address"]).writeStream.format("memory").queryName("agg")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.date.day: (r.n_tx, r.whale, r.approx_from_address) for r in spark.table("agg").collect()}
    want = {d: (24, float(sum(h for h in range(24 * d - 24, 24 * d) if h % 3 == 0)), 7) for d in (1, 2)}
    assert got == want


def test_stream_medians_and_exact_distinct_counts_equal_batch(spark, tmp_path):
    rnd, base = random.Random(6), dt.datetime(2024, 1, 1)
    schema = "chain string, ts timestamp, gas_price double, from_address string, to_address string"
    rows = [(rnd.choice(["ETH", "BTC"]), base + dt.timedelta(minutes=10 * m), rnd.choice([None, NAN, rnd.uniform(1, 90), rnd.uniform(1, 90)]), f"a{rnd.randrange(60)}",
             rnd.choice([None, f"a{rnd.randrange(60)}"])) for m in range(144 * 5)]
    path = str(tmp_path / "tx")
    for i in range(0, len(rows), 200):
        spark.createDataFrame(rows[i:i + 200], schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = []
    for name, df in (("medians", stream_daily_medians(source, "gas_price")), ("senders", stream_daily_distinct(source, ["from_address", "to_address"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got.append({(r.chain, r.date.day): tuple(r)[2:] for r in spark.table(name).collect()})
    for day in (1, 2, 3):
        for chain in ("BTC", "ETH"):
            mine = [r for r in rows if r[0] == chain and r[1].day == day]
            values = sorted(r[2] for r in mine if r[2] is not None and r[2] == r[2])
            assert got[0][chain, day][0] == len(values) and got[0][chain, day][1] in values[(len(values) - 1) // 2 - 1 : len(values) // 2 + 2]
            assert got[1][chain, day] == (len({a for r in mine for a in r[3:] if a}),)
    with pytest.raises(ValueError):
        stream_daily_distinct(source, ["from_address"], lateness="2 hours")
