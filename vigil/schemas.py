"""Row types, profiles and column names shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

DOMAINS = ("logon", "device", "file", "http", "email")


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Header columns of the raw files; all are strings at the scan.
RAW_DIRECTORY = (
    "user_id", "employee_name", "email", "role", "business_unit",
    "functional_unit", "department", "team", "supervisor",
)
RAW_EVENTS = {
    "logon": ("id", "date", "user", "pc", "activity"),
    "device": ("id", "date", "user", "pc", "file_tree", "activity"),
    "file": ("id", "date", "user", "pc", "filename", "activity",
             "to_removable_media", "from_removable_media", "content"),
    "http": ("id", "date", "user", "pc", "url", "activity"),
    "email": ("id", "date", "user", "pc", "to", "cc", "bcc", "from",
              "activity", "size", "attachments", "content"),
}
RAW_INSIDERS = ("dataset", "scenario", "details", "user", "start", "end")


def raw_events_schema(domain: str, columns: tuple[str, ...] | list[str] | None = None) -> T.StructType:
    return _strings(*(columns or RAW_EVENTS[domain]))


DIRECTORY_ATTRS = (
    "employee_name", "email", "role", "business_unit", "functional_unit",
    "department", "team", "supervisor",
)

DIRECTION_FLAGS = (
    "dir_internal_only", "dir_internal_to_external", "dir_external_to_internal",
    "dir_external_only", "any_personal_recipient", "email_to_ext_domain",
    "internal_to_external", "external_to_internal", "external_to_personal",
)

_EVENT = ("timestamp", "event_month", "user_key", "user_raw", "pc")
_ORG = ("email", "role", "is_admin", "team", "supervisor_key", "first_seen", "last_seen",
        "employee_name", "business_unit", "functional_unit", "department", "supervisor")
_PC_FLAGS = ("after_hours", "on_shared_pc", "on_unassigned_pc", "user_is_active_employee")
_LEAN_ORG = ("role", "is_admin", "supervisor_key", "team")
_FILE = ("filename", "activity", "to_removable_media", "from_removable_media", "is_keylogger")
_URL = ("url_length", "url_depth", "is_wikileaks", "is_dropbox", "is_job_site")
_MAIL_COUNTS = ("attachment_count", "to_count", "cc_count", "bcc_count")

# Which columns the audit ("full") and the model ("lean") table of a domain keep.
PROFILES = {
    "directory": {
        "full": ("user_key", "event_month", "employee_name", "email", "role", "business_unit",
                 "functional_unit", "department", "team", "supervisor", "supervisor_key",
                 "first_seen", "last_seen"),
        "lean": ("user_key", "event_month", "email", "role", "is_admin", "team",
                 "supervisor_key", "first_seen", "last_seen"),
    },
    "logon": {
        "full": (*_EVENT, "activity", *_ORG, *_PC_FLAGS, "join_reason", "id", "date"),
        "lean": ("timestamp", "event_month", "user_key", "pc", "activity", "role", "is_admin",
                 "first_seen", "supervisor_key", "team", *_PC_FLAGS),
    },
    "device": {
        "full": (*_EVENT, "file_tree", "activity", *_ORG, *_PC_FLAGS, "id", "date"),
        "lean": ("timestamp", "event_month", "user_key", "pc", "file_tree", "activity",
                 *_LEAN_ORG, *_PC_FLAGS),
    },
    "file": {
        "full": (*_EVENT, *_FILE, "content", *_ORG, *_PC_FLAGS, "id", "date"),
        "lean": ("timestamp", "event_month", "user_key", "pc", *_FILE, *_LEAN_ORG, *_PC_FLAGS),
    },
    "http": {
        "full": (*_EVENT, "url", "activity", *_URL, *_ORG, *_PC_FLAGS, "id", "date"),
        "lean": ("timestamp", "event_month", "user_key", "pc", "url", *_URL, *_LEAN_ORG,
                 *_PC_FLAGS),
    },
    "email": {
        "full": ("timestamp", "event_month", "from_key", "id", "user_key", "pc", "from", "to",
                 "cc", "bcc", "size", "attachments", "content", "activity", *_MAIL_COUNTS,
                 *DIRECTION_FLAGS, "after_hours", "user_is_active_employee", "date"),
        "lean": ("id", "timestamp", "event_month", "user_key", "from_key", "size",
                 "attachments", *_MAIL_COUNTS, *DIRECTION_FLAGS, "after_hours",
                 "user_is_active_employee"),
    },
}

# Name of the event count and of the after-hours rate of each domain in the wide table.
COUNT_COLUMNS = {
    "logon": "logon_n_logon",
    "device": "device_n_device_events",
    "file": "file_n_file_events",
    "http": "http_n_http",
    "email": "email_n_email_sent",
}
RATE_COLUMNS = {d: f"{d}_after_hours_rate" for d in DOMAINS}
POST_DEPARTURE_COLUMNS = {d: f"{d}_n_events_post_departure" for d in DOMAINS}
USB = "device_n_usb_connects"
LEAK = "http_n_wikileaks"

ROLLING_COLUMNS = (
    "ah_rate_1d", "ah_rate_trend", "ah_rate_baseline", "usb_count_1d",
    "usb_count_trend", "usb_count_baseline", "ah_novel", "usb_novel",
)

TIMELINE = T.ArrayType(
    T.StructType(
        [T.StructField(n, t) for n, t in
         (("day", T.DateType()), ("kind", T.StringType()), ("message", T.StringType()))]
    )
)

# Fields of an alert's evidence.
EVIDENCE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("ah_sig_days_7d", T.LongType()),
            ("usb_days_7d", T.LongType()),
            ("usb_total_7d", T.LongType()),
            ("same_day_ah_usb_7d", T.LongType()),
            ("wikileaks_days_N", T.LongType()),
            ("wl_lookback_days", T.IntegerType()),
            ("window_start", T.DateType()),
            ("window_end", T.DateType()),
            ("min_window_days", T.IntegerType()),
            ("ah_method", T.StringType()),
            ("ah_novel_7d", T.LongType()),
            ("usb_novel_7d", T.LongType()),
            ("post_departure_today", T.BooleanType()),
            ("post_departure_events_today", T.DoubleType()),
            ("anomaly_score_raw", T.DoubleType()),
            ("anomaly_score_boosted", T.DoubleType()),
            ("boost_pct", T.DoubleType()),
            ("base_score_raw_if", T.DoubleType()),
            ("z_personal", T.DoubleType()),
            ("z_role", T.DoubleType()),
            ("z_max", T.DoubleType()),
            ("window_days", T.IntegerType()),
            ("severity", T.StringType()),
        )
    ]
)

ALERT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("day", T.DateType()),
            ("user_key", T.StringType()),
            ("detector", T.StringType()),
            ("reason", T.StringType()),
            ("score", T.DoubleType()),
            ("evidence", EVIDENCE),
            ("human_summary", T.StringType()),
            ("rule_timeline", TIMELINE),
            ("rules_score", T.DoubleType()),
            ("anomaly_score", T.DoubleType()),
            ("ml_score", T.DoubleType()),
            ("forecast_score", T.DoubleType()),
        )
    ]
)
