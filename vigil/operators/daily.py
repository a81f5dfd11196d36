"""Per-user, per-day aggregates of each domain and the wide user-day table.

All of them start from `pc_day_counts`: additive measures per (user, day, domain, machine).
That step combines in the map tasks, so one user or machine with a third of all events costs
little, the number of distinct machines falls out of the second step, and flags that depend
on the machine or on employment can be joined to it instead of to the raw events.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import times
from vigil.functions.text import bool_int
from vigil.schemas import COUNT_COLUMNS, DOMAINS, RATE_COLUMNS

# Additive measures: name -> the column or activity they sum over events.
ACTIVITY_MEASURES = {
    "n_usb_connects": "connect",
    "n_usb_disconnects": "disconnect",
    "n_file_open": "file open",
    "n_file_write": "file write",
}
FLAG_MEASURES = {
    "n_after_hours": "after_hours",
    "n_to_removable": "to_removable_media",
    "n_from_removable": "from_removable_media",
    "n_is_keylogger": "is_keylogger",
    "n_wikileaks": "is_wikileaks",
    "n_dropbox": "is_dropbox",
    "n_job_sites": "is_job_site",
    "n_internal_only": "dir_internal_only",
    "n_internal_to_external": "dir_internal_to_external",
    "n_external_to_internal": "dir_external_to_internal",
    "n_external_only": "dir_external_only",
    "n_any_personal_recipient": "any_personal_recipient",
}
VALUE_MEASURES = {
    "sum_url_length": "url_length",
    "sum_url_depth": "url_depth",
    "sum_attachments": "attachment_count",
}
ADDITIVE = ("n_events", "n_business_hours", *ACTIVITY_MEASURES, *FLAG_MEASURES, *VALUE_MEASURES)
GROUP_FLAGS = ("on_shared_pc", "on_unassigned_pc", "user_is_active_employee")


def pc_day_counts(events: DataFrame) -> DataFrame:
    """Additive measures per (user_key, day, domain, pc), and the flags `events` carries.

    Measures whose source column is missing are zero. `domain` is taken from the events.
    """
    have = set(events.columns)
    zero = F.lit(0).cast("bigint")

    def total(source: str, value: Column) -> Column:
        return F.coalesce(F.sum(value), zero) if source in have else F.max(zero)

    aggs = [F.count(F.lit(1)).alias("n_events")]
    for name, activity in ACTIVITY_MEASURES.items():
        hit = F.coalesce(F.lower(F.col("activity")) == activity, F.lit(False)).cast("int")
        aggs.append(total("activity", hit).alias(name))
    for name, flag in FLAG_MEASURES.items():
        aggs.append(total(flag, bool_int(F.col(flag))).alias(name))
    aggs.append(total("timestamp", times.business_hours(F.col("timestamp")).cast("int")).alias("n_business_hours"))
    for name, value in VALUE_MEASURES.items():
        aggs.append(total(value, F.coalesce(F.col(value), F.lit(0))).alias(name))
    keys = ["user_key", "day", "domain", "pc", *[c for c in GROUP_FLAGS if c in have]]
    if "day" not in have:
        events = events.withColumn("day", times.day(F.col("timestamp")))
    return events.groupBy(*keys).agg(*aggs)


def _measures(domain: str) -> dict[str, Column]:
    """Daily columns of a domain as expressions over the rows of `pc_day_counts`."""
    mine = F.col("domain") == domain

    def when(value: Column) -> Column:
        return F.when(mine, value)

    n = F.sum(when(F.col("n_events")))

    def total(name: str) -> Column:
        return F.sum(when(F.col(name)))

    def mean(name: str) -> Column:
        return total(name) / n

    def flag_rate(flag: str) -> Column:
        return F.sum(when(F.col("n_events") * bool_int(F.col(flag)))) / n

    n_pcs = F.sum(when(F.col("pc").isNotNull().cast("bigint")))
    # An employment flag that is unknown counts as employed; one that is FALSE does not.
    gone = F.coalesce(F.col("user_is_active_employee"), F.lit(True)) == F.lit(False)
    tail = {
        "is_active_employee_day": F.max(when(bool_int(F.col("user_is_active_employee")))),
        "n_events_post_departure": F.sum(when(F.when(gone, F.col("n_events")).otherwise(0))),
    }
    rate = {"after_hours_rate": mean("n_after_hours")}
    if domain == "logon":
        return {
            "n_logon": n,
            "n_pc_used": n_pcs,
            **rate,
            "on_shared_pc_rate": flag_rate("on_shared_pc"),
            "on_unassigned_pc_rate": flag_rate("on_unassigned_pc"),
            **tail,
        }
    if domain == "device":
        return {
            "n_device_events": n,
            "n_unique_pcs": n_pcs,
            "n_usb_connects": total("n_usb_connects"),
            "n_usb_disconnects": total("n_usb_disconnects"),
            **rate,
            "usb_on_shared_pc_rate": flag_rate("on_shared_pc"),
            **tail,
        }
    if domain == "file":
        return {
            "n_file_events": n,
            "n_file_open": total("n_file_open"),
            "n_file_write": total("n_file_write"),
            "n_to_removable": total("n_to_removable"),
            "n_from_removable": total("n_from_removable"),
            "n_is_keylogger": total("n_is_keylogger"),
            "n_unique_pcs": n_pcs,
            **rate,
            **tail,
        }
    if domain == "http":
        return {
            "n_http": n,
            "avg_url_length": mean("sum_url_length"),
            "avg_url_depth": mean("sum_url_depth"),
            "n_wikileaks": total("n_wikileaks"),
            "n_dropbox": total("n_dropbox"),
            "n_job_sites": total("n_job_sites"),
            **rate,
            **tail,
        }
    return {
        "n_email_sent": n,
        "avg_attachment_count": mean("sum_attachments"),
        "n_internal_only": total("n_internal_only"),
        "n_internal_to_external": total("n_internal_to_external"),
        "n_external_to_internal": total("n_external_to_internal"),
        "n_external_only": total("n_external_only"),
        "n_any_personal_recipient": total("n_any_personal_recipient"),
        "n_after_hours": total("n_after_hours"),
        **rate,
        **tail,
    }


DAILY_COLUMNS: dict[str, tuple[str, ...]] = {
    "logon": ("n_logon", "n_pc_used", "after_hours_rate", "on_shared_pc_rate",
              "on_unassigned_pc_rate", "is_active_employee_day", "n_events_post_departure"),
    "device": ("n_device_events", "n_unique_pcs", "n_usb_connects", "n_usb_disconnects",
               "after_hours_rate", "usb_on_shared_pc_rate", "is_active_employee_day",
               "n_events_post_departure"),
    "file": ("n_file_events", "n_file_open", "n_file_write", "n_to_removable",
             "n_from_removable", "n_is_keylogger", "n_unique_pcs", "after_hours_rate",
             "is_active_employee_day", "n_events_post_departure"),
    "http": ("n_http", "avg_url_length", "avg_url_depth", "n_wikileaks", "n_dropbox",
             "n_job_sites", "after_hours_rate", "is_active_employee_day",
             "n_events_post_departure"),
    "email": ("n_email_sent", "avg_attachment_count", "n_internal_only",
              "n_internal_to_external", "n_external_to_internal", "n_external_only",
              "n_any_personal_recipient", "n_after_hours", "after_hours_rate",
              "is_active_employee_day", "n_events_post_departure"),
}


def wide_columns() -> list[str]:
    return [f"{d}_{c}" for d in DOMAINS for c in DAILY_COLUMNS[d]]


def domain_daily(counts: DataFrame, domain: str) -> DataFrame:
    """The daily table of one domain, key (user_key, day)."""
    mine = counts.where(F.col("domain") == domain)
    aggs = [expr.alias(name) for name, expr in _measures(domain).items()]
    return mine.groupBy("user_key", "day").agg(*aggs)


def _of_events(events: DataFrame, domain: str) -> DataFrame:
    if "domain" not in events.columns:
        events = events.withColumn("domain", F.lit(domain))
    for flag in GROUP_FLAGS:
        if flag not in events.columns:
            events = events.withColumn(flag, F.lit(None).cast("boolean"))
    return domain_daily(pc_day_counts(events.where(F.col("domain") == domain)), domain)


def logon_daily(events: DataFrame) -> DataFrame:
    return _of_events(events, "logon")


def device_daily(events: DataFrame) -> DataFrame:
    return _of_events(events, "device")


def file_daily(events: DataFrame) -> DataFrame:
    return _of_events(events, "file")


def http_daily(events: DataFrame) -> DataFrame:
    return _of_events(events, "http")


def email_daily(events: DataFrame) -> DataFrame:
    return _of_events(events, "email")


def union_keys(tables: list[DataFrame]) -> DataFrame:
    keys = tables[0].select("user_key", "day")
    for t in tables[1:]:
        keys = keys.unionByName(t.select("user_key", "day"))
    return keys.distinct()


def daily_user(dailies: Mapping[str, DataFrame]) -> DataFrame:
    """Wide table by key union and left joins, for domain tables that exist already."""
    out = union_keys(list(dailies.values()))
    for domain, table in dailies.items():
        named = table.select(
            "user_key",
            "day",
            *[F.col(c).alias(f"{domain}_{c}") for c in table.columns if c not in ("user_key", "day")],
        )
        out = out.join(named, ["user_key", "day"], "left")
    return out


def daily_user_tall(counts: DataFrame) -> DataFrame:
    """The same wide table in one aggregation over `pc_day_counts`, without joins."""
    aggs = [
        expr.alias(f"{domain}_{name}")
        for domain in DOMAINS
        for name, expr in _measures(domain).items()
    ]
    return counts.groupBy("user_key", "day").agg(*aggs)


def ah_rate_1d(daily: DataFrame) -> DataFrame:
    """`ah_rate_1d`: after-hours share of all events of the day; `usb_count_1d`."""
    zero = F.lit(0.0)
    after, total = F.lit(0.0), F.lit(0.0)
    for domain in DOMAINS:
        n = F.coalesce(F.col(COUNT_COLUMNS[domain]).cast("double"), zero)
        after = after + n * F.coalesce(F.col(RATE_COLUMNS[domain]), zero)
        total = total + n
    return daily.withColumns(
        {
            "ah_rate_1d": F.when(total > 0, after / total).otherwise(zero),
            "usb_count_1d": F.coalesce(F.col("device_n_usb_connects"), F.lit(0)).cast("bigint"),
        }
    )
