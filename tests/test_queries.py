"""A sample of the registered queries against their SQL twins on the smallest data."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = ("logon_daily", "daily_user_wide", "rolling_trend_baseline", "window14_features", "rule_alerts",
          "directory_asof", "join_reason", "assigned_pc", "url_metrics", "dedupe_events", "label_forecast",
          "group_zscore", "high_low_deciles", "analyst_notes", "watch_windows", "roc_auc", "stream_daily")


def test_every_query_has_a_twin_or_is_a_model():
    untwinned = set(entrypoint.queries()) - set(entrypoint.oracle_sql()) - set(entrypoint.LLM_QUERIES)
    assert untwinned == {"iforest_scores", "gbt_scores", "forecast_scores", "fitted_alerts"}
    assert not set(entrypoint.oracle_sql()) - set(entrypoint.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    got = entrypoint.queries()[name](spark, sf)
    rel = con.execute(entrypoint.oracle_sql()[name])
    want_cols = [d[0] for d in rel.description]
    want = [dict(zip(want_cols, row)) for row in rel.fetchall()]
    cols = sorted(got.columns)
    assert cols == sorted(want_cols) and want
    mine = sorted(repr([r[c] for c in cols]) for r in got.collect())
    assert mine == sorted(repr([r[c] for c in cols]) for r in want)


def test_entry(spark, sf):
    assert entrypoint.entry(spark).count() > 0


def test_fits_read_so_many_rows_a_task(spark):
    """Rows that are much alike are small in files, so the tasks of a fit are cut by rows, and only those of the fit."""
    from vigil.session import split_by_rows, staged

    wide = spark.range(0, 40_000, numPartitions=2).select("id", F.array_repeat(F.lit(0.5), 50).alias("cells"))
    kept = staged(wide, "alike", rows_a_file=1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with split_by_rows(kept, 2000):
        sizes = [r["n"] for r in kept.where("id >= 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 2000 and sum(sizes) == 40_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_fitted_alerts_make_the_user_days_once(spark, sf, monkeypatch):
    from vigil.plans import frames, model_queries

    made, features = [], frames.features
    monkeypatch.setattr(model_queries, "_boosted", lambda rows, weighted=False: rows.select("user_key", "end_day", F.lit(0.6).alias("score")))
    scores = "user_key string, end_day date, base_score double, role_id string"
    none = spark.createDataFrame([], scores)
    forest_scores = lambda s, d, days=None: none if days is not None else frames.features(s, d)
    monkeypatch.setattr(model_queries, "_forest_scores", forest_scores)
    monkeypatch.setattr(frames, "features", lambda *args: made.append(args) or features(*args))
    columns = entrypoint.queries()["fitted_alerts"](spark, sf).columns
    assert len(made) == 1 and columns[:2] == ["user_key", "day"]


def test_fitted_alerts_walk_the_forest_once_for_the_baselines(spark, sf, monkeypatch):
    """The baselines read scores that are staged, not the plan with the forest's model in it."""
    from datetime import date, timedelta

    from vigil.operators import baselines
    from vigil.plans import model_queries

    rows = [("u1", date(2024, 1, 1) + timedelta(days=d), d / 50, d / 50, None) for d in range(20)] + [(None, date(2024, 1, 3), None, None, None)]
    scores = spark.createDataFrame(rows, "user_key string, end_day date, base_score_raw double, base_score double, role_id string")
    monkeypatch.setattr(model_queries, "_boosted", lambda rows, weighted=False: rows.select("user_key", "end_day", F.lit(0.0).alias("score")))
    monkeypatch.setattr(model_queries, "_forest_scores", lambda s, d, days=None: scores)
    given, all_baselines = [], baselines.all_baselines
    monkeypatch.setattr(baselines, "all_baselines", lambda df, *args: given.append(df) or all_baselines(df, *args))
    entrypoint.queries()["fitted_alerts"](spark, sf)
    (df,) = given
    assert df.inputFiles() and all("/fitted-scores-" in f for f in df.inputFiles())
    kept = ["user_key", "end_day", "base_score_raw", "base_score"]
    assert sorted(map(repr, df.select(*kept).collect())) == sorted(map(repr, scores.select(*kept).collect()))


def test_detectors_ask_nothing_about_machines(spark, sf, monkeypatch):
    """Rules and stand-in scores read no machine, so none is looked up, and reports stage only what they read."""
    from vigil.operators import machines, reports
    from vigil.plans import frames

    wide = frames.features(spark, sf).select(*frames.rules.INPUTS)
    monkeypatch.setattr(machines, "choose_shared", None)
    lean = frames.detector_features(spark, sf)
    assert lean.exceptAll(wide).isEmpty() and wide.exceptAll(lean).isEmpty() and not lean.isEmpty()
    kept, staged = [], frames.staged
    monkeypatch.setattr(frames, "staged", lambda df, label, *rest: kept.append((label, df.columns)) or staged(df, label, *rest))
    entrypoint.queries()["heartbeat_watchlist"](spark, sf)
    assert dict(kept)["alerts"] == [*reports.WATCHLISTED]
