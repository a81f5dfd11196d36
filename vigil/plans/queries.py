"""The registered queries. Each takes (session, folder of parquet files)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import text, times, web
from vigil.operators import (
    alerts as alert_ops,
    anomaly,
    baselines,
    daily,
    directory,
    enrich,
    evaluation,
    labels,
    machines,
    quality,
    reports,
    rolling,
    rules,
    scores,
    watch,
)
from vigil.plans import frames
from vigil.schemas import DIRECTION_FLAGS, DOMAINS, POST_DEPARTURE_COLUMNS, ROLLING_COLUMNS
from vigil.session import scratch_path
from vigil.sources import driver_tables as tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places and whole numbers as bigint, for comparable results."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tidy(fn(spark, sf))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# --- daily aggregates ---------------------------------------------------------------------


def _domain_query(domain: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return daily.domain_daily(frames.counts(spark, sf, domain), domain)

    run.__name__ = f"{domain}_daily"
    run.__doc__ = f"User-days of the {domain} domain."
    query(run)


for _domain in DOMAINS:
    _domain_query(_domain)


@query
def daily_user_wide(spark, sf):
    """Wide table by key union and left joins over the five daily tables."""
    counts = frames.staged(frames.counts(spark, sf), "counts")
    return daily.daily_user({d: daily.domain_daily(counts, d) for d in DOMAINS})


@query
def daily_user_tall_equal(spark, sf):
    """The same table in one aggregation."""
    return frames.daily_user(spark, sf)


@query
def after_hours_rate_1d(spark, sf):
    df = daily.ah_rate_1d(frames.daily_user(spark, sf))
    return df.select("user_key", "day", "ah_rate_1d", "usb_count_1d")


@query
def rolling_trend_baseline(spark, sf):
    return frames.features(spark, sf).select("user_key", "day", *ROLLING_COLUMNS)


@query
def rolling_trend_documented(spark, sf):
    base = daily.ah_rate_1d(frames.daily_user(spark, sf))
    df = rolling.add_rolling(base, baseline_days=frames.BASELINE_DAYS, compat=False)
    return df.select("user_key", "day", *ROLLING_COLUMNS)


@query
def rolling_long_history(spark, sf):
    """Full-length baselines over the sparse seven-year history of orders."""
    df = rolling.add_rolling(tables.order_days(spark, sf))
    return df.select("user_key", "day", *ROLLING_COLUMNS)


@query
def densified_days(spark, sf):
    base = daily.ah_rate_1d(frames.daily_user(spark, sf))
    return rolling.densify(base, ["ah_rate_1d", "usb_count_1d"])


WINDOW_COLUMNS = ("ah_rate_1d", "usb_count_1d", "http_n_http", "logon_n_logon", "file_n_file_events")


@query
def window14_features(spark, sf):
    return rolling.window_features(frames.features(spark, sf), WINDOW_COLUMNS)


@query
def window14_rows(spark, sf):
    """The array windows, one output row per window row."""
    df = rolling.windows(frames.features(spark, sf), ["usb_count_1d", "ah_rate_1d"])
    return df.select("user_key", "end_day", F.inline("window"))


@query
def window_last_days(spark, sf):
    """The array windows cut to the seven calendar days before their end."""
    df = rolling.windows(frames.features(spark, sf), ["usb_count_1d", "ah_rate_1d"])
    return rules.last_n_days(df, 7).select("user_key", "end_day", F.inline("window"))


@query
def windows_json_roundtrip(spark, sf):
    """Windows as JSON text whose rows lack a field, add one or hold none of a kind, and back."""
    df = rolling.windows(frames.features(spark, sf), ["usb_count_1d", "ah_rate_1d"])
    odd = F.dayofmonth("end_day") % 2 == 1
    row = lambda r: F.struct(
        F.lit("x").alias("extra"), F.when(r["ah_rate_1d"] > 0, r["ah_rate_1d"]).alias("ah_rate_1d"),
        r["day"].alias("day"), F.when(~odd, r["usb_count_1d"]).alias("usb_count_1d"),
    )
    texts = df.select("user_key", "end_day", F.to_json(F.reverse(F.transform("window", row))).alias("window_json"))
    return rolling.import_windows(texts, ["usb_count_1d", "ah_rate_1d"]).select("user_key", "end_day", F.inline("window"))


@query
def window14_calendar(spark, sf):
    total = F.sum("usb_count_1d")
    measures = {"n_rows": F.count(F.lit(1)), "usb": total, "ah": F.avg("ah_rate_1d")}
    base = daily.ah_rate_1d(frames.daily_user(spark, sf))
    return rolling.calendar_measures(base, measures)


@query
def alert_windows(spark, sf):
    """The calendar rows behind the twenty highest windows."""
    feats = frames.detector_features(spark, sf)
    top = scores.top_windows(frames.window_scores(spark, sf, feats), 20)
    rows = feats.select("user_key", "day", "ah_rate_1d", "usb_count_1d")
    return rolling.calendar_window(rows, top.select("user_key", "end_day"))


# --- rules -------------------------------------------------------------------------------


@query
def rule_measures_7d(spark, sf):
    df = rules.rule_measures(frames.features(spark, sf), frames.RULES)
    return df.select(
        "user_key", "day", "ah_sig", "window_start", "active_days", "ah_sig_days_7d", "usb_days_7d",
        "usb_total_7d", "same_day_ah_usb_7d", "wikileaks_days_N", "ah_novel_7d", "usb_novel_7d",
        "latest_usb", "post_departure_events_today",
    )


@query
def rule_cases(spark, sf):
    df = rules.chain_rule(rules.rule_measures(frames.features(spark, sf), frames.RULES), frames.RULES)
    return df.select("user_key", "day", "has_chain", "near_miss", "has_chain_post")


@query
def rule_alerts(spark, sf):
    df = rules.rule_alerts(frames.features(spark, sf), frames.RULES)
    return df.select("user_key", "day", "reason", "score", "human_summary", "evidence.*")


@query
def rule_timeline(spark, sf):
    return rules.timeline_rows(rules.rule_alerts(frames.features(spark, sf), frames.RULES))


@query
def top_rule_alerts(spark, sf):
    """Flagship: events to the twenty gravest rule alerts."""
    df = rules.rule_alerts(frames.features(spark, sf), frames.RULES)
    order = [F.col("score").desc(), F.col("usb_total_7d").desc(), "day", "user_key"]
    flat = df.select("user_key", "day", "reason", "score", "evidence.usb_total_7d", "evidence.ah_sig_days_7d")
    return flat.orderBy(*order).limit(20)


# --- directory ---------------------------------------------------------------------------


@query
def directory_snapshots(spark, sf):
    return directory.snapshots(tables.directory_rows(spark, sf))


@query
def directory_bounds(spark, sf):
    return directory.seen_bounds(directory.as_of_months(directory.snapshots(tables.directory_rows(spark, sf))))


@query
def supervisor_map(spark, sf):
    table = directory.as_of_months(directory.snapshots(tables.directory_rows(spark, sf)))
    return directory.resolve_supervisor(table).select("user_key", "event_month", "supervisor", "supervisor_key")


@query
def directory_asof(spark, sf):
    table = directory.build_directory(tables.directory_rows(spark, sf))
    return enrich.project(table, "directory", "full")


@query
def user_org(spark, sf):
    return directory.user_org(directory.as_of_months(directory.snapshots(tables.directory_rows(spark, sf))))


@query
def termination_map(spark, sf):
    table = directory.as_of_months(directory.snapshots(tables.directory_rows(spark, sf)))
    return directory.termination_map(table)


def _enriched_shipments(spark, sf):
    table = directory.as_of_months(directory.snapshots(tables.directory_rows(spark, sf)))
    joined = enrich.join_directory(tables.shipments(spark, sf), table)
    return enrich.flag_active(enrich.join_bounds(joined, directory.seen_bounds(table)))


@query
def asof_month_enrich(spark, sf):
    """Events with their month's attributes, counted by what the join found."""
    df = _enriched_shipments(spark, sf)
    return df.groupBy("department", "business_unit", "joined_ldap", "user_is_active_employee").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_key").alias("users")
    )


@query
def join_reason(spark, sf):
    df = _enriched_shipments(spark, sf)
    return df.groupBy("user_key", "event_month", "join_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def post_departure_flag(spark, sf):
    users = tables.event_users(spark, sf)
    term = directory.termination_map(users.withColumn("event_month", F.col("last_seen")))
    df = directory.attach_termination(frames.daily_user(spark, sf), term)
    flagged = alert_ops.post_departure_flag(df)
    return flagged.select(
        "user_key", "day", "is_post_departure", "is_post_departure_window", *POST_DEPARTURE_COLUMNS.values()
    )


# --- machines ----------------------------------------------------------------------------


@query
def shared_pcs(spark, sf):
    return machines.shared_pcs(frames.non_admin_logons(spark, sf), **frames.SHARED)


@query
def pc_dominance(spark, sf):
    return machines.pc_dominance(frames.non_admin_logons(spark, sf))


@query
def pc_sharedness(spark, sf):
    return machines.pc_sharedness(frames.non_admin_logons(spark, sf))


@query
def assigned_pc(spark, sf):
    return frames.assigned(spark, sf)


@query
def pc_flags(spark, sf):
    """Machine flags on whole events, counted."""
    df = enrich.flag_shared_pc(tables.activity(spark, sf), frames.shared_list(spark, sf))
    df = enrich.flag_unassigned_pc(df, frames.assigned(spark, sf))
    return df.groupBy("user_key", "domain", "on_shared_pc", "on_unassigned_pc").agg(F.count(F.lit(1)).alias("n"))


# --- web and text ------------------------------------------------------------------------


def _logged_url() -> Column:
    """Page URLs as proxy logs have them: some with characters that strict parsers refuse."""
    url, kind = F.col("url"), F.col("page_id") % 8
    return (
        F.when(kind == 1, F.concat(url, F.lit("/a|b")))
        .when(kind == 2, F.concat(url, F.lit("/{x}/\"q\"")))
        .when(kind == 3, F.concat(url, F.lit("/a b/c")))
        .when(kind == 4, F.regexp_replace(url, "://", "://my_host."))
        .when(kind == 5, F.regexp_replace(url, "://", "://user:pw@"))
        .otherwise(url)
    )


@query
def url_metrics(spark, sf):
    url = F.col("url")
    return tables.table(spark, sf, "pages").select("page_id", _logged_url().alias("url")).select(
        "page_id",
        web.url_length(url).alias("url_length"),
        web.url_depth(url).alias("url_depth"),
        web.host(url).alias("host"),
        web.registrable(web.host(url)).alias("registrable"),
    )


@query
def destination_flags(spark, sf):
    df = tables.activity(spark, sf, "http")
    return df.groupBy("user_key", "is_wikileaks", "is_dropbox", "is_job_site").agg(
        F.count(F.lit(1)).alias("n"), F.sum("url_length").alias("url_length"), F.sum("url_depth").alias("url_depth")
    )


def _page_texts(spark, sf):
    pages = tables.table(spark, sf, "pages")
    return pages.select(F.concat_ws(" ", "url", "html").alias("text"))


@query
def top_domains(spark, sf):
    """Most frequent registrable domains among the URLs of all pages, address and content."""
    return enrich.top_domains(_page_texts(spark, sf), 50)


@query
def listed_host_flags(spark, sf):
    """Pages whose own host is among the fifty most frequent ones."""
    pages = tables.table(spark, sf, "pages")
    hosts = enrich.top_domains(_page_texts(spark, sf), 50)
    flagged = enrich.flag_listed_hosts(pages.select("page_id", "url"), hosts, "is_listed")
    return flagged.select("page_id", "is_listed")


def _mail(spark, sf):
    """Mails made of conversation turns: all words of the turn stand for recipients."""
    turns = tables.table(spark, sf, "conversations")
    words = F.split(F.lower(F.regexp_replace("text", r"[^A-Za-z ]", "")), " +")
    picked = F.filter(words, lambda w: w != "")
    to = F.concat_ws(";", F.transform(picked, lambda w: F.concat(w, F.lit("@x.example"))))
    return turns.select(
        "conv_id",
        "turn",
        F.concat(F.col("role"), F.lit("@corp.example")).alias("from_key"),
        F.when(F.col("turn") % 3 == 0, F.concat(to, F.lit(",nan;;"))).otherwise(to).alias("to"),
    )


@query
def recipient_counts(spark, sf):
    df = _mail(spark, sf)
    return df.select("conv_id", "turn", text.recipient_count(F.col("to")).alias("to_count"))


@query
def recipient_edges(spark, sf):
    return enrich.recipient_edges(_mail(spark, sf), ["to"])


@query
def direction_flags(spark, sf):
    df = tables.activity(spark, sf, "email")
    return df.groupBy("user_key").agg(*[F.sum(text.bool_int(F.col(c))).alias(c) for c in DIRECTION_FLAGS])


@query
def name_normalise(spark, sf):
    customer = tables.table(spark, sf, "customer")
    raw = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "  # "), F.lit(" "))
    user = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" DTAA/"), F.col("c_name"))).otherwise(
        F.concat(F.lit("corp.x\\"), F.col("c_name"), F.lit("  "))
    )
    user = F.when(F.col("c_custkey") % 10 == 9, F.lit("   ")).otherwise(user)
    return customer.select(
        "c_custkey",
        text.norm_name(raw).alias("name"),
        text.normalize_user(user).alias("user_key"),
        text.email_domain(F.concat(F.col("c_name"), F.lit("@Mail.Example "))).alias("email_domain"),
        text.handle_of(F.concat(F.col("c_name"), F.lit("@mail.example"))).alias("handle"),
    )


@query
def keylogger_stem(spark, sf):
    part = tables.table(spark, sf, "part")
    name = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("C:\\tmp\\KeyLogger."), F.col("p_size")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("/opt/keylogger.tar."), F.col("p_size")))
        .when(F.col("p_partkey") % 5 == 2, F.lit(" keylogger "))
        .otherwise(F.concat(F.lit("/data/"), F.col("p_name")))
    )
    return part.select("p_partkey", text.is_keylogger(name).alias("is_keylogger"))


@query
def timestamp_parsing(spark, sf):
    """Log format, ISO format and rubbish in one column."""
    orders = tables.table(spark, sf, "orders")
    key, ts = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(key % 10 == 7, "not a date")
        .when(key % 2 == 0, F.date_format(ts, times.LOG_FORMAT))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    parsed = orders.select("o_orderkey", times.parse_ts(raw).alias("ts"))
    return parsed.select(
        "o_orderkey",
        F.col("ts").cast("date").alias("day"),
        times.month_start(F.col("ts")).alias("month"),
        times.after_hours(F.col("ts")).alias("after_hours"),
    )


@query
def dedupe_events(spark, sf):
    """Every event twice, a third without an id: the copies go, by id or by tuple."""
    events = tables.event_columns(tables.table(spark, sf, "events"))
    no_id = F.col("event_id") % 3 == 0
    both = events.unionByName(events).withColumn("id", F.when(~no_id, F.col("event_id")))
    kept = enrich.dedupe_events(both, "id", ["timestamp", "user_key", "pc", "activity"])
    return kept.groupBy("user_key", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.count("id").alias("with_id")
    )


# --- labels and splits -------------------------------------------------------------------


@query
def exfil_ranges(spark, sf):
    """Ranges from single truth events: the leak-site visits of each user."""
    http = tables.activity(spark, sf, "http").where(F.col("is_wikileaks"))
    return labels.exfil_ranges(http.select("user_key", F.col("timestamp").alias("ts")))


@query
def exfil_start(spark, sf):
    return labels.exfil_start(frames.ranges(spark, sf))


@query
def label_interval(spark, sf):
    return labels.label_days(frames.keys(spark, sf), frames.ranges(spark, sf))


@query
def label_forecast(spark, sf):
    df = labels.forecast_labels(frames.keys(spark, sf), frames.ranges(spark, sf))
    return df.select(
        "user_key", "day", "is_exfil_day", "days_until_exfil", "forecast_horizon_days", "label_forecast_day"
    )


@query
def label_audit(spark, sf):
    return labels.label_audit(labels.forecast_labels(frames.keys(spark, sf), frames.ranges(spark, sf)))


@query
def probe_users(spark, sf):
    labelled = labels.forecast_labels(frames.keys(spark, sf), frames.ranges(spark, sf))
    return labels.probe_users(labelled, frames.ranges(spark, sf))


@query
def class_weight(spark, sf):
    labelled = labels.forecast_labels(frames.keys(spark, sf), frames.ranges(spark, sf))
    return labels.class_weight(labelled, "label_forecast_day")


@query
def user_split(spark, sf):
    return labels.user_split(frames.keys(spark, sf))


@query
def user_split_exact(spark, sf):
    return labels.user_split_exact(frames.keys(spark, sf))


def _forecast_windows(spark, sf):
    days = frames.keys(spark, sf)
    labelled = labels.forecast_labels(days, frames.ranges(spark, sf))
    return labels.forecast_windows(labelled, labels.user_split(days))


@query
def forecast_windows(spark, sf):
    return _forecast_windows(spark, sf)


@query
def windows_join_split(spark, sf):
    """Share of positives per split among labelled windows that exist as base windows."""
    base = rolling.windows(frames.keys(spark, sf).withColumn("one", F.lit(1)), ["one"])
    return labels.split_rates(labels.attach_windows(_forecast_windows(spark, sf), base))


# --- baselines and score analysis ----------------------------------------------------------


@query
def personal_zscore(spark, sf):
    df = baselines.personal_baseline(frames.window_scores(spark, sf), frames.MIN_PRIOR)
    return df.select(
        "user_key", "end_day", "base_score", "prior_window_count", "personal_mean", "personal_std", "z_personal"
    )


@query
def group_zscore(spark, sf):
    df = baselines.group_baselines(frames.window_scores(spark, sf), {"role_id": 20, "department": 20})
    return df.select(
        "user_key", "end_day", "role_mean", "role_std", "role_n", "z_role",
        "department_mean", "department_std", "department_n", "z_department",
    )


@query
def group_zscore_default(spark, sf):
    """Group baselines with the operator's own minimums, on the long history of orders."""
    days = tables.order_days(spark, sf).select("user_key", F.col("day").alias("end_day"), F.col("ah_rate_1d").alias("base_score"))
    df = baselines.group_baselines(baselines.attach_org(days, tables.event_org(spark, sf)))
    return df.select("user_key", "end_day", "role_n", "z_role", "team_id_n", "z_team_id")


@query
def zmax(spark, sf):
    return frames.zscores(spark, sf).select("user_key", "end_day", *baselines.Z_COLUMNS, "z_max")


@query
def zscore_lookup(spark, sf):
    """Windows with their z-scores looked up by user and day."""
    z = frames.staged(frames.zscores(spark, sf), "zscores")
    return baselines.attach_z(z.select("user_key", "end_day", "base_score"), z)


@query
def zboost(spark, sf):
    df = anomaly.z_boost(frames.zscores(spark, sf))
    return df.select("user_key", "end_day", "base_score", "z_max", "boost_pct", "score")


@query
def score_distribution(spark, sf):
    return scores.score_distribution(frames.staged(frames.window_scores(spark, sf), "window-scores"))


@query
def role_score_stats(spark, sf):
    return scores.top_roles(scores.group_stats(frames.window_scores(spark, sf)))


@query
def user_vs_role(spark, sf):
    return scores.user_vs_role(frames.window_scores(spark, sf))


@query
def top_outliers(spark, sf):
    return scores.top_outliers(scores.user_vs_role(frames.window_scores(spark, sf)))


@query
def high_low_deciles(spark, sf):
    feats = frames.detector_features(spark, sf)
    return scores.decile_profile(frames.window_scores(spark, sf, feats), feats)


@query
def decile_differences(spark, sf):
    feats = frames.detector_features(spark, sf)
    profile = scores.decile_profile(frames.window_scores(spark, sf, feats), feats)
    return scores.profile_difference(profile)


@query
def top_windows(spark, sf):
    return scores.top_windows(frames.window_scores(spark, sf)).select("user_key", "end_day", "base_score", "role_id")


@query
def top_users_overlap(spark, sf):
    return scores.top_users_overlap(frames.window_scores(spark, sf), frames.insiders(spark, sf))


@query
def insider_score_stats(spark, sf):
    return scores.insider_stats(frames.window_scores(spark, sf), frames.insiders(spark, sf))


@query
def score_cohorts(spark, sf):
    """Windows with high and with low scores, one cohort after the other, by role."""
    found = frames.window_scores(spark, sf)
    high, low = found.where(F.col("base_score") >= 0.6), found.where(F.col("base_score") <= 0.2)
    both = scores.stack_cohorts(high.withColumn("cohort", F.lit("high")), low.withColumn("cohort", F.lit("low")))
    return both.groupBy("cohort", "role_id").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("user_key").alias("users"), F.avg("base_score").alias("mean"))


@query
def window_indicators(spark, sf):
    feats = frames.detector_features(spark, sf)
    return scores.window_indicators(frames.window_scores(spark, sf, feats), feats, 20)


# --- alerts and reports --------------------------------------------------------------------


@query
def raw_alert_scores(spark, sf):
    return frames.raw_alerts(spark, sf).select(
        "user_key", "day", "detector", "reason", "score", "rules_score", "anomaly_score", "ml_score", "forecast_score"
    )


@query
def ensemble_scores(spark, sf):
    return frames.canonical(spark, sf).select(
        "alert_id", "user_key", "day", F.concat_ws(",", "rule_hits").alias("rule_hits"), "rules_score",
        "ml_score", "anomaly_score", "forecast_score", "ensemble_score", "severity", "escalated",
        F.col("explanation.driver").alias("driver"),
    )


@query
def alert_explanations(spark, sf):
    e = F.col("explanation")
    return frames.canonical(spark, sf).select(
        "alert_id",
        e["components"]["rule"]["weight"].alias("rule_weight"),
        e["components"]["rule"]["contribution_description"].alias("rule_text"),
        e["components"]["ml"]["contribution_description"].alias("ml_text"),
        e["components"]["anomaly"]["contribution_description"].alias("anomaly_text"),
        e["components"]["forecast"]["contribution_description"].alias("forecast_text"),
        e["human_readable_summary"].alias("summary"),
    )


@query
def user_day_rollup(spark, sf):
    df = reports.user_day_rollup(frames.canonical(spark, sf))
    return df.withColumn("rule_hits", F.concat_ws(",", "rule_hits")).drop("after_termination")


@query
def same_day_max(spark, sf):
    df = reports.same_day_max(frames.canonical(spark, sf))
    return df.select("alert_id", "ml_score", "anomaly_score", "forecast_score", "ensemble_score", "severity")


def _people(spark, sf):
    users = tables.event_users(spark, sf)
    return reports.persons(users.withColumn("event_month", F.col("last_seen")))


@query
def user_ranking(spark, sf):
    return reports.user_ranking(frames.canonical(spark, sf), _people(spark, sf), frames.AS_OF)


@query
def watchlist(spark, sf):
    return reports.user_ranking(frames.canonical(spark, sf), None, frames.AS_OF, "watchlist")


@query
def top_risk(spark, sf):
    return reports.top_risk(reports.user_ranking(frames.canonical(spark, sf)))


@query
def risk_meta(spark, sf):
    return reports.risk_meta(frames.canonical(spark, sf), _people(spark, sf), frames.AS_OF)


@query
def analyst_notes(spark, sf):
    return reports.note_rows(frames.canonical(spark, sf))


@query
def heartbeat_global(spark, sf):
    return reports.heartbeat(frames.canonical(spark, sf), frames.AS_OF)


@query
def heartbeat_user(spark, sf):
    return reports.heartbeat_user(frames.canonical(spark, sf), "U3", frames.AS_OF)


@query
def heartbeat_watchlist(spark, sf):
    return reports.heartbeat_watchlist(frames.canonical(spark, sf, reports.WATCHLISTED), frames.AS_OF)


@query
def detector_day_pivot(spark, sf):
    return reports.detector_day_counts(frames.raw_alerts(spark, sf))


@query
def recent_alerts(spark, sf):
    df = reports.recent_alerts(frames.raw_alerts(spark, sf))
    return df.select("user_key", "day", "detector", "score")


@query
def watch_windows(spark, sf):
    return watch.watch_windows(frames.canonical(spark, sf, watch.WATCHED))


@query
def forecast_summary(spark, sf):
    alerts = frames.canonical(spark, sf)
    return reports.forecast_summary(frames.staged(watch.watch_windows(alerts), "watches"), alerts)


# --- evaluation ----------------------------------------------------------------------------


@query
def severity_breakdown(spark, sf):
    return evaluation.severity_breakdown(frames.canonical(spark, sf))


@query
def confusion_by_severity(spark, sf):
    return evaluation.confusion(frames.canonical(spark, sf), frames.truth(spark, sf))


@query
def user_day_sets(spark, sf):
    return evaluation.user_day_sets(frames.canonical(spark, sf), frames.truth(spark, sf))


@query
def user_depth(spark, sf):
    return evaluation.user_depth(frames.canonical(spark, sf), frames.truth(spark, sf))


@query
def monthly_counts(spark, sf):
    return evaluation.monthly_counts(frames.canonical(spark, sf), frames.truth(spark, sf))


@query
def score_boost_stats(spark, sf):
    """Of the anomaly alerts alone: what the other detectors say is not asked for."""
    alerts = alert_ops.union_alerts(anomaly.anomaly_alerts(frames.zscores(spark, sf)))
    return evaluation.score_boost_stats(frames.staged(alerts, "anomaly-alerts"))


@query
def pattern_coverage(spark, sf):
    return evaluation.pattern_coverage(frames.raw_alerts(spark, sf))


@query
def z_coverage(spark, sf):
    return anomaly.z_coverage(frames.raw_alerts(spark, sf))


def _scored_documents(spark, sf):
    """Toxic documents as positives, their length relative to the longest as the score."""
    documents = tables.table(spark, sf, "documents").select("doc_id", "n_chars")
    longest = documents.agg(F.max("n_chars")).scalar()
    joined = tables.table(spark, sf, "labels").join(documents, "doc_id")
    return joined.select(
        F.col("toxic").alias("label"), F.round(F.col("n_chars") / longest, 6).alias("score")
    )


@query
def score_curve(spark, sf):
    return evaluation.score_curve(_scored_documents(spark, sf))


@query
def roc_auc(spark, sf):
    return evaluation.roc_auc(_scored_documents(spark, sf))


@query
def average_precision(spark, sf):
    return evaluation.average_precision(_scored_documents(spark, sf))


@query
def precision_at_recall(spark, sf):
    return evaluation.precision_at_recall(_scored_documents(spark, sf))


@query
def percentile_volume(spark, sf):
    return evaluation.percentile_volume(_scored_documents(spark, sf))


@query
def class_report(spark, sf):
    return evaluation.class_report(_scored_documents(spark, sf), 0.02)


def _lead_scores(spark, sf):
    return frames.window_scores(spark, sf).select("user_key", "end_day", F.col("forecast").alias("score"))


@query
def lead_times(spark, sf):
    return evaluation.lead_times(_lead_scores(spark, sf), frames.ranges(spark, sf), 0.6)


@query
def lead_time_stats(spark, sf):
    return evaluation.lead_time_stats(evaluation.lead_times(_lead_scores(spark, sf), frames.ranges(spark, sf), 0.6))


# --- quality -------------------------------------------------------------------------------


@query
def quality_report(spark, sf):
    """Value checks of all five daily tables and their union, their columns, and a lookup's size."""
    wide = frames.daily_user(spark, sf)
    parts = {f"{d}_daily": (f"{d}_", F.coalesce(F.col(daily.COUNT_COLUMNS[d]), F.lit(0)) > 0) for d in DOMAINS}
    found = quality.write_checked(wide, scratch_path(spark, "checked-days"), "daily_user", parts)
    dailies = {f"{d}_daily": wide.select("user_key", "day", *[
        F.col(c).alias(c[len(d) + 1 :]) for c in wide.columns if c.startswith(f"{d}_")
    ]) for d in DOMAINS}
    for name, df in dailies.items():
        found = found.unionByName(quality.check_columns(spark, df, name, quality.REQUIRED[name]))
    found = found.unionByName(quality.check_prefixes(spark, wide, "daily_user", DOMAINS))
    return found.unionByName(quality.check_min_rows(tables.event_users(spark, sf), "event_users"))


@query
def unique_user_days(spark, sf):
    """User-days after the assertion that none repeats."""
    return enrich.expect_unique(frames.keys(spark, sf), ["user_key", "day"]).select("user_key", "day")


@query
def sliced_days(spark, sf):
    """Users per day of a half-open slice of days."""
    days = enrich.day_slice(frames.keys(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 19))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("users"))


@query
def flagged_days(spark, sf):
    """User-days with the malicious flag attached where there is one."""
    flags = frames.truth(spark, sf).withColumn("malicious", F.lit(1))
    days = labels.attach_flags(frames.keys(spark, sf), flags)
    return days.groupBy("user_key").agg(F.count(F.lit(1)).alias("days"), F.count("malicious").alias("malicious_days"))


@query
def shared_pc_preview(spark, sf):
    chosen = machines.shared_pcs(frames.non_admin_logons(spark, sf), **frames.SHARED)
    return machines.preview(chosen, [F.desc("distinct_non_admin_users"), "pc"], 10)


@query
def quality_profile(spark, sf):
    return quality.profile(frames.daily_user(spark, sf))


@query
def dataset_diff(spark, sf):
    """Orders against orders with a priority dropped: rows and signature differ, columns do not."""
    orders = tables.table(spark, sf, "orders")
    trial = orders.where(F.col("o_orderpriority") != "5-LOW")
    return quality.dataset_diff(orders, trial, ["o_orderkey"])
