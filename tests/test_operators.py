import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import day
from vigil.operators import (
    alerts as alert_ops, anomaly, baselines, bundle, daily, directory, enrich, evaluation, forest, labels,
    machines, ordering, quality, reports, rolling, rules, supervised, trees, watch,
)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- cleaning and directory ------------------------------------------------------------


def test_dedupe_by_id_or_tuple(spark):
    data = [("1", "a"), ("1", "b"), (None, "a"), (None, "a"), (None, "b"), (None, None), (None, None)]
    df = spark.createDataFrame(data, "id string, pc string")
    kept = rows(enrich.dedupe_events(df, "id", ["pc"]).fillna("-"), "id", "pc")
    assert len(kept) == 4 and [k for k in kept if k[0] == "-"] == [("-", "-"), ("-", "a"), ("-", "b")]


def test_guards(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert enrich.expect_none(df, F.col("x") > 5, "too big").count() == 3
    with pytest.raises(Exception, match="too big"):
        enrich.expect_none(df, F.col("x") > 2, "too big").collect()
    with pytest.raises(Exception, match="repeated key"):
        enrich.expect_unique(df.union(df), ["x"]).collect()


def test_clean_events_adds_missing_columns(spark):
    data = [("1", "01/02/2010 20:00:00", "DTAA/U1", "http://x.wikileaks.org/a", "PC1"),
            ("1", "01/02/2010 20:00:00", "DTAA/U1", "http://x.wikileaks.org/a", "PC1")]
    raw = spark.createDataFrame(data, "id string, date string, user string, url string, pc string")
    got = enrich.clean_events(raw, "http").collect()
    assert len(got) == 1
    assert got[0].user_key == "u1" and got[0].after_hours and got[0].is_wikileaks and got[0].activity is None


def directory_rows(spark):
    data = [("a", "2010-01-01", "Ann  Lee", "Bob Ray", "ITAdmin"), ("b", "2010-01-01", "Bob Ray", None, "Clerk"),
            ("a", "2010-03-01", "Ann Lee", "bob  ray", "Clerk")]
    df = spark.createDataFrame(data, "user_key string, m string, employee_name string, supervisor string, role string")
    empty = [F.lit(None).cast("string").alias(c) for c in ("email", "business_unit", "functional_unit", "department", "team")]
    return df.select("user_key", F.col("m").cast("date").alias("snapshot_date"), "employee_name", "supervisor", "role", *empty)


def test_directory(spark):
    table = directory.build_directory(directory_rows(spark))
    got = rows(table, "user_key", "event_month", F.coalesce("supervisor_key", F.lit("-")), "is_admin", "first_seen", "last_seen")
    jan, mar = dt.date(2010, 1, 1), dt.date(2010, 3, 1)
    assert got == [("a", jan, "b", True, jan, mar), ("a", mar, "-", False, jan, mar), ("b", jan, "-", False, jan, jan)]
    assert rows(directory.termination_map(table), "user_key", "is_terminated") == [("a", False), ("b", True)]
    assert rows(directory.user_org(table), "user_key", "role_id") == [("a", "Clerk"), ("b", "Clerk")]


def test_supervisor_with_address_fails(spark):
    bad = directory_rows(spark).withColumn("supervisor", F.lit("boss@x.example"))
    with pytest.raises(Exception, match="names are required"):
        directory.build_directory(bad).collect()


def test_month_gap_is_active(spark):
    table = directory.attach_seen(directory.as_of_months(directory.snapshots(directory_rows(spark))))
    events = spark.createDataFrame([("a", "2010-02-01"), ("zz", "2010-01-01"), ("b", "2010-02-01")], "user_key string, m string")
    events = events.select("user_key", F.col("m").cast("date").alias("event_month"))
    got = enrich.enrich_events(events, table, directory.seen_bounds(table))
    assert rows(got, "user_key", "joined_ldap", "user_is_active_employee", "join_reason") == [
        ("a", False, True, "matched"), ("b", False, False, "post_departure"), ("zz", False, False, "not_in_ldap"),
    ]


def test_choose_shared_band_and_fallback(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 2), ("e", 2)], "pc string, distinct_non_admin_users int")
    assert rows(machines.choose_shared(df, 2, 3, 1), "pc") == [("a",), ("b",)]
    assert rows(machines.choose_shared(df, 3, 3, 1), "pc") == [("a",), ("b",), ("c",)]
    assert rows(machines.choose_shared(df, 4, 4, 2), "pc") == [("a",), ("b",)]
    assert rows(machines.choose_shared(df, 6, 9, 1), "pc") == [("a",)]


def test_assigned_pc_needs_days_and_share(spark):
    data = [("u", "p1", d) for d in range(4)] + [("u", "p2", d) for d in range(2)] + [("v", "p9", 0)]
    ts = [(u, p, dt.datetime(2024, 1, 1 + d, 9)) for u, p, d in data] + [("u", "p2", dt.datetime(2024, 1, 9, 20))]
    logon = spark.createDataFrame(ts, "user_key string, pc string, timestamp timestamp_ntz")
    shared = spark.createDataFrame([("lab",)], "pc string")
    got = rows(machines.assigned_pc(logon, shared), "user_key", F.coalesce("assigned_pc", F.lit("-")), "days_on_pc", "user_days")
    assert got == [("u", "p1", 4, 6), ("v", "-", 1, 1)]


# --- daily and rolling -----------------------------------------------------------------


def test_tall_equals_joined(spark):
    base = dt.datetime(2024, 1, 1, 8)
    ev = [("u", base, "logon", "p1", None), ("u", base, "logon", None, None), ("u", base, "device", "p1", "Connect"),
          ("v", base.replace(hour=22), "http", "p2", None)]
    df = spark.createDataFrame(ev, "user_key string, timestamp timestamp_ntz, domain string, pc string, activity string")
    df = df.withColumns({"after_hours": F.hour("timestamp") >= 19, "on_shared_pc": F.col("pc") == "p1",
                         "on_unassigned_pc": F.lit(False), "user_is_active_employee": F.col("user_key") == "u"})
    counts = daily.pc_day_counts(df)
    tall = daily.daily_user_tall(counts)
    wide = daily.daily_user({d: daily.domain_daily(counts, d) for d in daily.DAILY_COLUMNS})
    names = ["user_key", "day", *daily.wide_columns()]
    assert sorted(map(str, tall.select(names).collect())) == sorted(map(str, wide.select(names).collect()))
    got = {r.user_key: r for r in tall.collect()}
    assert got["u"].logon_n_logon == 2 and got["u"].logon_n_pc_used == 1 and got["u"].device_n_usb_connects == 1
    assert got["v"].http_n_events_post_departure == 1 and got["v"].logon_n_logon is None
    assert rows(daily.http_daily(df), "user_key", "n_http") == [("v", 1)]


def pandas_rolling(days, rate):
    """The windows of the compat formula on a densified series, by pandas' own time windows."""
    s = pd.Series(rate, index=pd.to_datetime(days)).asfreq("D").fillna(0.0)
    left37, left7 = s.rolling("37D", closed="left").mean(), s.rolling("7D", closed="left").mean()
    return s.rolling("7D", closed="both").mean(), ((37 * left37 - 7 * left7) / 30).clip(0, 1)


def test_rolling_compat_matches_time_windows(spark):
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(90, 40, replace=False).tolist())
    rate = rng.random(40)
    data = [("u", day(int(n)), float(r), int(r * 5)) for n, r in zip(days, rate)] + [("one", day(3), 0.5, 1)]
    df = spark.createDataFrame(data, "user_key string, day date, ah_rate_1d double, usb_count_1d bigint")
    got = rolling.add_rolling(df).orderBy("day").collect()
    trend, base = pandas_rolling([day(int(n)) for n in days], rate)
    for r in (g for g in got if g.user_key == "u"):
        stamp = pd.Timestamp(r.day)
        assert abs(r.ah_rate_trend - trend[stamp]) < 1e-9
        if pd.isna(base[stamp]):
            assert r.ah_rate_baseline is None
        else:
            assert abs(r.ah_rate_baseline - base[stamp]) < 1e-9
    single = [g for g in got if g.user_key == "one"][0]
    assert single.ah_rate_baseline is None and single.usb_count_baseline is None and single.ah_novel == 1


def test_windows_need_fourteen_rows(spark):
    data = [("a", day(2 * n), n) for n in range(14)] + [("b", day(n), n) for n in range(13)]
    df = spark.createDataFrame(data, "user_key string, day date, x int")
    got = rolling.windows(df, ["x"]).collect()
    assert [(r.user_key, r.end_day, len(r.window)) for r in got] == [("a", day(26), 14)]
    feats = rolling.window_features(df, ["x"]).collect()
    assert len(feats) == 1 and feats[0].mean_x == 6.5 and abs(feats[0].std_x - np.std(range(14))) < 1e-12
    text = spark.createDataFrame([('[{"day":"2024-01-02","x":2},{"day":"2024-01-01","x":1}]',)], "window_json string")
    assert [w.x for w in rolling.import_windows(text, ["x"]).first().window] == [1.0, 2.0]


def test_window_features_are_the_frame_aggregates_to_the_last_bit(spark):
    """Over batches shorter than a window and users of many lengths; one sliding frame a column is not planned."""
    rng = np.random.default_rng(5)
    data = [(u, day(2 * i), float(rng.normal()) * 1e3, int(rng.integers(9)), None if rng.random() < 0.3 else float(rng.random()))
            for u, length in [("a", 40), ("b", 13), ("c", 14), (None, 20), ("d", 1), ("e", 27)] for i in range(length)]
    df = spark.createDataFrame(data, "user_key string, day date, x double, y int, z double").repartition(3)
    frame, over = rolling.last_rows(14), {"mean": F.avg, "max": F.max, "std": F.stddev_pop}
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    want = df.select("user_key", F.col("day").alias("end_day"), F.count(F.lit(1)).over(frame).alias("n"), *[
        f(value(c)).over(frame).alias(f"{kind}_{c}") for kind, f in over.items() for c in "xyz"]).where("n = 14").drop("n")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, 5)
    try:
        feats = rolling.window_features(df, ["x", "y", "z"])
        assert feats.schema.names == want.schema.names
        assert sorted(map(repr, feats.collect())) == sorted(map(repr, want.collect())) and want.count() == 27 + 1 + 7 + 14
    finally:
        spark.conf.set(name, was)
    assert feats._jdf.queryExecution().optimizedPlan().toString().count("specifiedwindowframe") == 1


def test_no_look_ahead(spark, sf):
    """Cutting the input at a day leaves the earlier rows as they were."""
    from vigil.sources import driver_tables as tables

    days = tables.order_days(spark, sf)
    full = rolling.add_rolling(days)
    cut = rolling.add_rolling(enrich.as_of(days, "1998-06-30"))
    assert cut.exceptAll(enrich.as_of(full, "1998-06-30")).count() == 0


def test_densify(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(3), 2), ("b", day(1), 5)], "user_key string, day date, x int")
    assert rows(rolling.densify(df, ["x"]), "user_key", "day", "x") == [
        ("a", day(0), 1), ("a", day(1), 0), ("a", day(2), 0), ("a", day(3), 2), ("b", day(1), 5),
    ]


# --- labels ----------------------------------------------------------------------------


def test_labels(spark):
    days = spark.createDataFrame([("u", day(n)) for n in range(12)] + [("v", day(1))], "user_key string, day date")
    ranges = spark.createDataFrame(
        [("u", "SCENARIO_1", day(5), day(6)), ("u", "SCENARIO_1", day(9), day(9)), ("u", "OTHER", day(0), day(0))],
        "user_key string, scenario_id string, exfil_start date, exfil_end date",
    )
    got = {(r.user_key, r.day): r for r in labels.forecast_labels(days, ranges, horizon=2).collect()}
    lab = [got["u", day(n)].label_forecast_day for n in range(12)]
    assert lab == [0, 0, 0, 1, 1, None, None, 1, 1, None, 0, 0]
    assert got["u", day(4)].days_until_exfil == 1 and got["v", day(1)].days_until_exfil is None
    marked = labels.label_days(days, ranges)
    assert sorted(r.day for r in marked.where("label = 1").collect()) == [day(0), day(5), day(6), day(9)]


def test_user_split_is_stable(spark):
    df = spark.createDataFrame([(f"u{n}",) for n in range(1000)], "user_key string")
    one, two = labels.user_split(df.repartition(7)), labels.user_split(df.coalesce(1))
    assert one.exceptAll(two).count() == 0
    share = {r.split: r.n for r in one.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert 640 < share["train"] < 760 and 100 < share["val"] < 200


@pytest.mark.parametrize("n, train, val", [(90_000, 63_000, 13_500), (10, 7, 1), (7, 4, 1)])
def test_exact_split_of_whole_shares(spark, n, train, val):
    """0.7 * 90 000 is 63 000, though the product of doubles lies below; a user without a key is one more."""
    df = spark.range(n - 1).select(F.concat(F.lit("u"), "id").alias("user_key"))
    df = df.unionByName(spark.createDataFrame([(None,)], "user_key string"))
    got = labels.user_split_exact(df)
    share = {r.split: r.n for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert share == {"train": train, "val": val, "test": n - train - val}
    assert got.where("user_key IS NULL").first().split == "test"


# --- order statistics, baselines --------------------------------------------------------


def test_running_totals_with_ties(spark):
    vals = [0.1] * 500 + [float(x) / 7 for x in range(300)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "v double, label int")
    got = ordering.running_totals(df, "v", {"n": F.count(F.lit(1))}, ranges=16).orderBy("v").collect()
    want = pd.Series(vals).value_counts().sort_index().cumsum()
    assert [r.cum_n for r in got] == want.tolist()
    q = ordering.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], list("abcde")).first()
    assert np.allclose(list(q), np.quantile(vals, [0.0, 0.1, 0.5, 0.99, 1.0]))


def test_baselines(spark):
    data = [(f"u{u}", day(n), float((u * 7 + n * 3) % 11), "r", None if u == 2 else "x") for u in range(3) for n in range(6)]
    df = spark.createDataFrame(data, "user_key string, end_day date, base_score double, role_id string, team_id string")
    got = baselines.group_baselines(baselines.personal_baseline(df, 2), {"role_id": 3, "team_id": 3})
    pdf = pd.DataFrame(data, columns=["u", "d", "s", "r", "t"])
    for r in got.collect():
        prior = pdf[(pdf.u == r.user_key) & (pdf.d < r.end_day)].s
        assert (r.personal_mean is None) == (len(prior) < 2)
        if len(prior) >= 2 and prior.std() > 0:
            assert abs(r.z_personal - (r.base_score - prior.mean()) / prior.std()) < 1e-9
        role = pdf[pdf.d < r.end_day].s
        assert r.role_n == len(role)
        if len(role) >= 3:
            assert abs(r.role_std - role.std()) < 1e-9
        if r.user_key == "u2":
            assert r.team_id_n is None and r.z_team_id is None


def test_flat_group_gives_no_z(spark):
    df = spark.createDataFrame([(f"u{n % 5}", day(n), 0.3, "r") for n in range(30)], "user_key string, end_day date, base_score double, role_id string")
    got = baselines.group_baseline(df, "role_id", 5).collect()
    assert {r.z_role for r in got} == {None}


def test_z_boost(spark):
    data = [(0.3, 1.0), (0.3, None), (0.3, 3.6), (0.8, 3.0), (0.8, 0.5), (0.85, 4.0), (0.6, None)]
    df = spark.createDataFrame([(*d, f"u{i}", day(0)) for i, d in enumerate(data)], "base_score double, z_max double, user_key string, end_day date")
    got = {r.user_key: round(r.score, 6) for r in anomaly.z_boost(df).collect()}
    assert got == {"u3": 0.9, "u4": 0.4, "u5": 0.9, "u6": 0.6}


# --- rules ------------------------------------------------------------------------------


def feature_days(spark, data):
    """(user, day, usb, leak, after-hours rate, post-departure events)."""
    cols = ["user_key", "day", "device_n_usb_connects", "http_n_wikileaks", "logon_after_hours_rate", "logon_n_events_post_departure"]
    df = spark.createDataFrame(data, "user_key string, day date, a bigint, b bigint, c double, d bigint").toDF(*cols)
    have = set(cols)
    rest = [c for c in daily.wide_columns() if c not in have and c != "logon_n_logon"]
    df = df.withColumn("logon_n_logon", F.lit(10)).select("*", *[F.lit(None).cast("bigint").alias(c) for c in rest])
    return df.withColumns({"ah_novel": F.lit(1), "usb_novel": F.lit(1)})


def test_rule_cases(spark):
    data = []
    for u, usb, leak, post in (("chain", 1, 1, 0), ("post", 1, 1, 2), ("near", 2, 0, 0), ("calm", 0, 1, 0)):
        data += [(u, day(n), usb, leak if n == 2 else 0, 0.9, post if n == 2 else 0) for n in range(3)]
    data += [("short", day(n), 5, 1, 0.9, 0) for n in range(2)]
    got = {(r.user_key, r.day): r for r in rules.rule_alerts(feature_days(spark, data)).collect()}
    assert {k: v.reason for k, v in got.items()} == {
        ("chain", day(2)): "rules:s1_chain", ("post", day(2)): "rules:s1_chain_post_departure", ("near", day(2)): "rules:s1_near_miss",
    }
    post = got["post", day(2)]
    assert post.score == 0.95 and [t.kind for t in post.rule_timeline][-2:] == ["leak_site", "post_departure_chain"]
    assert post.rule_timeline == sorted(post.rule_timeline, key=lambda t: t.day)
    assert "3 total connections" in got["chain", day(2)].human_summary


def test_rule_of_week_agrees_with_batch(spark):
    from vigil.streaming.stateful import rule_days, rule_of_week

    rng = np.random.default_rng(5)
    data = [("u", day(int(n)), int(rng.integers(0, 3)), int(rng.integers(0, 2)), float(rng.random()), int(rng.integers(0, 2)))
            for n in sorted(rng.choice(60, 40, replace=False))]
    df = feature_days(spark, data)
    batch = {r.day: r.reason for r in rules.rule_alerts(df).collect()}
    kept, seen = [], {}
    for r in rule_days(rules.ah_signal(df)).orderBy("day").collect():
        kept = [*kept, tuple(r)[1:]][-14:]
        case = rule_of_week(kept, rules.RuleParams())
        if case:
            seen[r.day] = f"rules:{case}"
    assert batch and seen == batch


# --- alerts and reports -----------------------------------------------------------------


def raw_alerts(spark, data):
    df = spark.createDataFrame(data, "user_key string, day date, detector string, reason string, score double")
    return alert_ops.union_alerts(df)


def test_normalize_and_reports(spark):
    data = [("U1", day(0), "forecast", "forecast:x", 0.8), ("U1", day(3), "rules", "rules:s1_chain", 0.8),
            ("U1", day(3), "ml", "ml:x", 0.6), ("U2", day(1), "rules", "rules:s1_near_miss", 0.3), ("U2", day(1), "anomaly", "anomaly:x", 0.5)]
    alerts = alert_ops.normalize_alerts(alert_ops.prong_maxima(raw_alerts(spark, data)))
    chain = alerts.where("user_key = 'u1' and size(rule_hits) > 0").first()
    assert chain.ensemble_score >= 0.95 and chain.severity == "critical" and chain.escalated
    rolled = {(r.user_key, r.day): r for r in reports.user_day_rollup(alerts).collect()}
    assert rolled["u1", day(3)].rule_hits == ["s1_chain"] and rolled["u1", day(3)].ml_score == 0.6
    assert rolled["u2", day(1)].anomaly_score == 0.5 and not rolled["u2", day(1)].escalated
    early = reports.user_ranking(alerts, as_of=day(0)).collect()
    assert [(r.user_key, r.total_alerts, r.max_forecast) for r in early] == [("u1", 1, 0.8)]
    meta = {r.user_key: r for r in reports.risk_meta(alerts, as_of=day(2)).collect()}
    assert meta["u1"].severity_bucket == "medium" and meta["u1"].first_forecast_day == day(0)
    plain = {r.user_key: r for r in reports.user_ranking(alerts, as_of=day(2)).collect()}
    assert plain["u1"].severity_bucket == "critical"
    windows = watch.watch_windows(alerts).collect()
    assert [(w.user_key, w.start_day, w.escalation_day, w.lead_time_days) for w in windows] == [("u1", day(0), day(3), 3)]
    summary = reports.forecast_summary(watch.watch_windows(alerts), alerts).first()
    assert summary.correct_forecasts == 1 and summary.best_lead_time_days == 3 and summary.best_early_warning_user == "u1"
    kinds = [n.kind for r in reports.analyst_notes(alerts).where("user_key = 'u1'").collect() for n in r.notes]
    assert kinds == ["forecast_spike", "full_chain", "summary"]


def watch_days(spark, data):
    return spark.createDataFrame(data, "user_key string, day date, detector_rank int, forecast_score double, escalated boolean")


def test_watch_expiry_edges(spark):
    data = [("on", day(0), 3, 0.8, False), ("on", day(7), 1, None, True),
            ("after", day(0), 3, 0.8, False), ("after", day(8), 1, None, True), ("after", day(9), 3, 0.9, False),
            ("same", day(0), 1, None, True), ("same", day(0), 3, 0.8, False),
            ("stay", day(0), 3, 0.8, True), ("stay", day(30), 3, 0.95, False)]
    got = rows(watch.watch_windows(watch_days(spark, data)), "user_key", "start_day", "resolved", F.round("max_score", 2))
    assert got == [("after", day(0), False, 0.8), ("after", day(9), False, 0.9), ("on", day(0), True, 0.8),
                   ("same", day(0), False, 0.8), ("stay", day(0), True, 0.95)]
    again = watch.watch_windows(watch_days(spark, data), reopen=True)
    assert again.where("user_key = 'stay'").count() == 2


def test_evaluation(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 0), (0.1, 0)], "score double, label int")
    assert abs(evaluation.roc_auc(scored).first()[0] - 5.5 / 6) < 1e-12
    assert abs(evaluation.average_precision(scored).first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    one_class = scored.where("label = 0")
    assert evaluation.roc_auc(one_class).first()[0] is None
    report = {r["class"]: r for r in evaluation.class_report(scored, 0.5).collect()}
    assert report[1].recall == 1.0 and report[1].support == 2


# --- models -----------------------------------------------------------------------------


def test_forest_finds_outlier_and_ignores_partitioning(spark, tmp_path):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(300, 3)).tolist() + [[9.0, 9.0, 9.0]]
    data = [(f"u{i}", day(0), *map(float, p), 1.0) for i, p in enumerate(pts)]
    df = spark.createDataFrame(data, "user_key string, end_day date, a double, b double, c double, flat double")
    cols = ["a", "b", "c", "flat"]
    one = forest.fit_forest(df.repartition(5), cols, trees=25, psi=64)
    two = forest.fit_forest(df.coalesce(1), cols, trees=25, psi=64)
    assert one.columns == ["a", "b", "c"]
    pd.testing.assert_frame_equal(one.nodes.drop(columns="threshold"), two.nodes.drop(columns="threshold"))
    scored = forest.window_scores(df, one).orderBy(F.col("base_score").desc()).first()
    assert scored.user_key == "u300" and scored.base_score == 1.0
    forest.save_forest(spark, one, str(tmp_path / "f"))
    back = forest.load_forest(spark, str(tmp_path / "f"))
    a, b = (forest.window_scores(df, f).agg(F.sum("base_score")).first()[0] for f in (one, back))
    assert abs(a - b) < 1e-9
    # One saved pipeline does the same, and the boost after it.
    want = anomaly.z_boost(forest.anomaly_score(df, one).withColumn("z_max", F.col("a")))
    bundle.pipeline(*bundle.forest_stages(one, spark), *bundle.boost_stages()).write().save(str(tmp_path / "p"))
    got = supervised.load_models(str(tmp_path / "p")).transform(df.withColumn("z_max", F.col("a")))
    assert got.columns == [*df.columns, "z_max", "base_score_raw", "base_score", "boost_pct", "score"]
    pair = got.select("user_key", F.col("score").alias("s")).join(want.select("user_key", "score"), "user_key", "full")
    assert pair.count() > 0 and pair.where(~F.coalesce(F.abs(F.col("s") - F.col("score")) < 1e-9, F.lit(False))).count() == 0


def test_moments_are_counted_a_cell_a_row(spark, monkeypatch):
    """One aggregate for all columns, with missing cells left out as an aggregate of the column does."""
    data = [(1.0, 5, None), (2.0, 5, None), (4.0, 5, 3.0), (None, 5, 7.0)]
    df = spark.createDataFrame(data, "a double, flat int, b double")
    calls, var_pop = [], F.var_pop
    monkeypatch.setattr(forest.F, "var_pop", lambda c: calls.append(c) or var_pop(c))
    kept, means, stds, n = forest._moments(df, ["a", "flat", "b"], 0.01)
    assert (kept, n, len(calls)) == (["a", "b"], 4, 1)
    assert np.allclose(means, [7 / 3, 5.0]) and np.allclose(stds, [np.std([1, 2, 4]), 2.0])
    assert forest._moments(df.where("false"), ["a", "b"], 0.01) == ([], [], [], 0)


def test_node_tables_are_walked_as_written(spark):
    rng = np.random.default_rng(2)
    nodes = []
    for t in range(5):
        for n in range(31):
            inner = n < 15
            nodes.append((t, n, int(rng.integers(3)) if inner else -1, float(rng.integers(-2, 3)) if inner else 0.0,
                          2 * n + 1 if inner else -1, 2 * n + 2 if inner else -1, 0.0 if inner else float(rng.normal())))
    rows = [[float(v) for v in rng.integers(-3, 4, 3)] for _ in range(300)] + [[float("nan")] * 3, [0.0, -0.0, 5e-324]]

    def walk(t, x):
        _, n, f, cut, left, right, value = nodes[31 * t]
        while f >= 0:
            _, n, f, cut, left, right, value = nodes[31 * t + (left if x[f] < cut else right)]
        return value

    table = spark.createDataFrame(nodes, trees.NODES)
    x = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>").withColumn("v", array_to_vector("x"))
    mean = trees.mean_model(table, 3, "v", "m")
    for r in mean.transform(x).collect():
        assert r.m == pytest.approx(sum(walk(t, rows[r.i]) for t in range(5)) / 5, abs=1e-12)
    boosted = trees.boosted_model(table, 3, 0.25, "v")
    for r in boosted.transform(x).select("i", vector_to_array("rawPrediction")[1].alias("m")).collect():
        assert r.m == pytest.approx(walk(0, rows[r.i]) + 0.25 * sum(walk(t, rows[r.i]) for t in range(1, 5)), abs=1e-12)
    again = trees.mean_model(trees.nodes_of(mean, spark).drop("weight"), 3, "v", "m")
    assert again.transform(x).select("i", "m").exceptAll(mean.transform(x).select("i", "m")).count() == 0
    assert sorted({round(r.weight, 6) for r in trees.nodes_of(boosted, spark).select("weight").distinct().collect()}) == [0.25, 1.0]


def test_thresholds_step_to_the_next_double(spark):
    values = [1.0, 0.5, 0.1, -0.3, 3.0, 0.125, 1e-300, 0.0, -1.0, 1024.0, 1.9999999999999998, 5e-324, -2.0, 1e300]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", trees.below(F.col("v")).alias("b")).collect():
        assert r.b == math.nextafter(r.v, -math.inf)


def test_gbt_learns_and_persists(spark, tmp_path):
    data = [(f"u{i}", day(0), i % 2, [dict(day=day(n), x=float(i % 2 * 3 + n % 2)) for n in range(2)]) for i in range(60)]
    df = spark.createDataFrame(data, "user_key string, end_day date, label int, window array<struct<day: date, x: double>>")
    vectors = supervised.flatten(df, ["x"])
    model = supervised.fit_gbt(vectors, vectors, weighted=True, trees=3)
    scored = supervised.score(vectors, model)
    assert evaluation.roc_auc(scored).first()[0] == 1.0
    assert supervised.supervised_alerts(scored).count() == 30
    supervised.save_models(model, str(tmp_path / "m"))
    assert supervised.score(vectors, supervised.load_models(str(tmp_path / "m"))).exceptAll(scored).count() == 0


# --- quality ----------------------------------------------------------------------------


def test_quality(spark):
    data = [("a", day(0), 1, 0.5, 1), ("a", day(0), -1, 1.5, 2), (None, day(1), 2, None, 0)]
    df = spark.createDataFrame(data, "user_key string, day date, n_x int, ah_rate double, is_active_employee_day int")
    got = {(r.check, r.column): r.bad for r in quality.check_values(df, "t").collect()}
    assert got == {("unique_key", "user_key+day"): 1, ("null_key", "user_key"): 1, ("null_key", "day"): 0, ("nonnegative", "n_x"): 1,
                   ("rate_bounds", "ah_rate"): 1, ("rate_null", "ah_rate"): 1, ("flag_01", "is_active_employee_day"): 1}
    cols = quality.check_columns(spark, df, "t", ["user_key", "nope"])
    assert {r.column: r.bad for r in cols.collect()} == {"user_key": 0, "nope": 1}
    assert quality.check_min_rows(df, "t", 10).first().bad == 1
    same = quality.dataset_diff(df, df.repartition(3), ["user_key", "day"]).collect()
    assert all(r.equal for r in same)
    assert json.dumps([r.check for r in same])


def test_baselines_of_a_large_mean_and_a_small_deviation(spark):
    """Mean 1e6, deviation 1e-3: the merged moments agree with exact ones to six places; equal rows stay."""
    from fractions import Fraction

    rng = np.random.default_rng(3)
    data = [(f"u{i % 7}", day(i // 7), float(1e6 + 1e-3 * rng.normal()), "r") for i in range(280)]
    data += data[-3:] + [("v", day(n), 0.1, "flat") for n in range(40) for _ in range(3)]
    df = spark.createDataFrame(data, "user_key string, end_day date, base_score double, role_id string").repartition(3)
    got = baselines.group_baseline(df, "role_id", 30).collect()
    assert len(got) == len(data)
    for r in got:
        prior = [Fraction(s) for _, d, s, g in data if g == r.role_id and d < r.end_day]
        assert r.role_n == len(prior)
        if len(prior) < 30:
            assert r.role_mean is None and r.z_role is None
        elif r.role_id == "flat":
            assert r.role_std == 0.0 and r.z_role is None
        else:
            mean = sum(prior) / len(prior)
            std = float(sum((x - mean) ** 2 for x in prior) / (len(prior) - 1)) ** 0.5
            assert r.role_std == pytest.approx(std, rel=1e-6)
            assert r.z_role == pytest.approx(float(Fraction(r.base_score) - mean) / std, abs=1e-6)


@pytest.mark.parametrize(("sketch", "ordered"), [(10_000, 1 << 18), (40, 40)])
def test_quantiles_are_exact_without_sorting(spark, monkeypatch, sketch, ordered):
    monkeypatch.setattr(ordering, "SKETCH", sketch)
    monkeypatch.setattr(ordering, "ORDERED", ordered)
    rng = np.random.default_rng(4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.995, 1.0]
    for values in (rng.normal(size=3001), rng.integers(0, 4, 2000).astype(float), np.zeros(50), rng.random(1), np.arange(2.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
        got = ordering.exact_quantiles(df, "v", probs, [f"q{i}" for i in range(7)]).first()
        assert list(got) == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)
    days = spark.createDataFrame([(n,) for n in (3, 1, 2, 8)], "v int")
    assert ordering.exact_quantiles(days, "v", [0.5], ["m"]).first().m == 2.5
    assert ordering.exact_quantiles(days.limit(0), "v", [0.5], ["m"]).first().m is None


def test_quantiles_do_not_range_the_scores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordering, "staged", lambda df, label: seen.append(df._jdf.queryExecution().toString()) or df)
    df = spark.range(5000).select((F.col("id") * 7 % 501).cast("double").alias("v"))
    assert ordering.exact_quantiles(df, "v", [0.5], ["m"]).first().m == np.median(np.arange(5000) * 7 % 501)
    assert seen and not any("rangepartitioning" in plan for plan in seen)


def test_checks_while_writing_are_those_of_a_scan(spark, tmp_path):
    data = [("u", day(0), 1, 0.5, 1, None, None), ("u", day(0), -2, 1.5, 7, 3, 0.1), (None, day(1), 0, None, 0, -1, 2.0), ("", day(2), None, 0.0, None, 4, None)]
    kind = "user_key string, day date, logon_n_logon long, logon_after_hours_rate double, logon_is_active_employee_day int, http_n_http long, http_after_hours_rate double"
    df = spark.createDataFrame(data, kind).repartition(3)
    there = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    parts = {"logon": ("logon_", there("logon_n_logon")), "http": ("http_", there("http_n_http"))}
    got = quality.write_checked(df, str(tmp_path / "t"), "daily_user", parts)
    want = quality.check_values(df, "daily_user")
    for name, (prefix, rows_of) in parts.items():
        side = df.where(rows_of).select("user_key", "day", *[F.col(c).alias(c[len(prefix):]) for c in df.columns if c.startswith(prefix)])
        want = want.unionByName(quality.check_values(side, name))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert quality.write_checked(df.limit(0), str(tmp_path / "none"), "daily_user", parts).where("bad > 0 OR total > 0").count() == 0
