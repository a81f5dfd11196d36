"""DuckDB twins of the registered queries, put together from named common table expressions.

They follow the definitions directly (joins, correlated conditions, plain window frames),
not the way the Spark operators compute the same thing.
"""

from __future__ import annotations

import re

from vigil.operators.forest import average_path
from vigil.plans.fixed import FLAT_COLUMNS, PATH_FEATURES, PATH_INPUTS, PATH_NODES, PATH_PSI, PATH_STEP

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    """Names of the expressions `sql` rests on, in an order in which each can be defined."""
    want: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in words & CTES.keys() - want:
            want.add(name)
            todo.append(CTES[name])
    return [n for n in CTES if n in want]


def oracle(name: str, sql: str, recursive: str = "") -> None:
    head = [f"{n} AS ({CTES[n]})" for n in _needed(sql + " " + recursive)]
    if recursive:
        head.append(recursive)
    kind = "WITH RECURSIVE " if recursive else "WITH "
    ORACLES[name] = (kind + ",\n".join(head) + "\n" if head else "") + sql.strip()


def r(expr: str, name: str | None = None) -> str:
    """Six places, and no negative zero."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr.split('.')[-1]}"


def b(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr.split('.')[-1]}"


# --- inputs -------------------------------------------------------------------------------

cte("ev_k", """
SELECT event_id, user_id, ts, 'u' || user_id AS user_key,
  CASE event_type WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'device' WHEN 'click' THEN 'file'
       WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'email' END AS domain,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
  CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS event_month,
  (extract(hour FROM ts) < 7 OR extract(hour FROM ts) >= 19) AS ah
FROM events""")
cte("ev", """
SELECT *,
  CASE WHEN k >= 90 THEN 'lab-' || (k % 3) WHEN k < 70 THEN 'pc-' || user_id
       ELSE 'pc-' || ((user_id + k) % 15) END AS pc,
  length('https://' || CASE WHEN k % 11 = 0 THEN 'www.wikileaks.org'
      WHEN k % 13 = 0 THEN 'dl.dropboxusercontent.com' WHEN k % 17 = 0 THEN 'jobs.hirepath.com'
      ELSE 'intra.corp.example' END || '/'
    || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/' ELSE 'a/b.html' END) AS url_length,
  k % 3 AS url_depth,
  k % 11 = 0 AS wiki,
  k % 13 = 0 AND k % 11 <> 0 AS dropbox,
  k % 17 = 0 AND k % 11 <> 0 AND k % 13 <> 0 AS job,
  k % 4 = 0 AND k % 7 <> 0 AS int_only,
  k % 4 = 1 OR (k % 4 = 0 AND k % 7 = 0) AS int_ext,
  k % 4 = 2 AS ext_int,
  k % 4 = 3 AS ext_only,
  k % 7 = 0 AS personal
FROM ev_k""")
cte("people", """
SELECT 'u' || c_custkey AS user_key, DATE '2023-01-01' AS first_seen,
  CASE WHEN c_custkey % 7 = 0 THEN DATE '2023-12-01' ELSE DATE '2024-06-01' END AS last_seen,
  c_name AS employee_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ITAdmin' ELSE c_mktsegment END AS role_id,
  r_name AS business_unit, 'fu-' || (c_custkey % 6) AS functional_unit, n_name AS department,
  'team-' || (c_custkey % 10) AS team_id
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("lg", "SELECT * FROM ev WHERE domain = 'logon'")
cte("lna", "SELECT * FROM lg WHERE user_key NOT IN (SELECT user_key FROM people WHERE role_id = 'ITAdmin')")
cte("pcm", """
SELECT pc, max(u) AS m FROM (
  SELECT pc, event_month, count(DISTINCT user_key) AS u FROM lna GROUP BY ALL) GROUP BY pc""")
cte("dom", """
SELECT pc, max(n) / sum(n) AS share FROM (SELECT pc, user_key, count(*) AS n FROM lna GROUP BY ALL) GROUP BY pc""")
cte("pck", """
SELECT max(m) AS kk FROM (SELECT m, (SELECT count(*) FROM pcm y WHERE y.m >= x.m) AS c FROM pcm x)
WHERE c BETWEEN 3 AND 5""")
cte("shr", """
SELECT pc, m FROM (SELECT pc, m, row_number() OVER (ORDER BY m DESC, pc) AS rn FROM pcm), pck
WHERE CASE WHEN kk IS NULL THEN rn <= 3 ELSE m >= kk END""")
cte("upd", """
SELECT user_key, pc, count(DISTINCT day) AS d FROM lg
WHERE NOT ah AND pc NOT IN (SELECT pc FROM shr) GROUP BY ALL""")
cte("asg", """
SELECT user_key, CASE WHEN tot >= 5 AND d / tot >= 0.5 THEN pc END AS assigned_pc, d, tot, d / tot AS share FROM (
  SELECT user_key, pc, d, sum(d) OVER (PARTITION BY user_key) AS tot,
    row_number() OVER (PARTITION BY user_key ORDER BY d DESC, pc) AS rn FROM upd) WHERE rn = 1""")
cte("e", """
SELECT ev.*, ev.pc IN (SELECT pc FROM shr) AS on_shared,
  coalesce(ev.pc <> asg.assigned_pc, FALSE) AS on_unassigned,
  coalesce(event_month BETWEEN first_seen AND last_seen, FALSE) AS active
FROM ev LEFT JOIN asg USING (user_key) LEFT JOIN people USING (user_key)""")

_TAIL = """avg(ah::INT) AS after_hours_rate, max(active::INT) AS is_active_employee_day,
  count(*) FILTER (NOT active) AS n_events_post_departure"""
cte("d_logon", f"""
SELECT user_key, day, count(*) AS n_logon, count(DISTINCT pc) AS n_pc_used,
  avg(on_shared::INT) AS on_shared_pc_rate, avg(on_unassigned::INT) AS on_unassigned_pc_rate, {_TAIL}
FROM e WHERE domain = 'logon' GROUP BY user_key, day""")
cte("d_device", f"""
SELECT user_key, day, count(*) AS n_device_events, count(DISTINCT pc) AS n_unique_pcs,
  count(*) FILTER (event_id % 2 = 0) AS n_usb_connects, count(*) FILTER (event_id % 2 <> 0) AS n_usb_disconnects,
  avg(on_shared::INT) AS usb_on_shared_pc_rate, {_TAIL}
FROM e WHERE domain = 'device' GROUP BY user_key, day""")
cte("d_file", f"""
SELECT user_key, day, count(*) AS n_file_events, count(*) FILTER (k % 2 = 0) AS n_file_open,
  count(*) FILTER (k % 2 = 1) AS n_file_write, count(*) FILTER (k % 3 = 0) AS n_to_removable,
  count(*) FILTER (k % 5 = 0) AS n_from_removable, count(*) FILTER (k = 7) AS n_is_keylogger,
  count(DISTINCT pc) AS n_unique_pcs, {_TAIL}
FROM e WHERE domain = 'file' GROUP BY user_key, day""")
cte("d_http", f"""
SELECT user_key, day, count(*) AS n_http, avg(url_length) AS avg_url_length, avg(url_depth) AS avg_url_depth,
  count(*) FILTER (wiki) AS n_wikileaks, count(*) FILTER (dropbox) AS n_dropbox, count(*) FILTER (job) AS n_job_sites, {_TAIL}
FROM e WHERE domain = 'http' GROUP BY user_key, day""")
cte("d_email", f"""
SELECT user_key, day, count(*) AS n_email_sent, avg(k % 4) AS avg_attachment_count,
  count(*) FILTER (int_only) AS n_internal_only, count(*) FILTER (int_ext) AS n_internal_to_external,
  count(*) FILTER (ext_int) AS n_external_to_internal, count(*) FILTER (ext_only) AS n_external_only,
  count(*) FILTER (personal) AS n_any_personal_recipient, count(*) FILTER (ah) AS n_after_hours, {_TAIL}
FROM e WHERE domain = 'email' GROUP BY user_key, day""")

# Column name -> whether it is a whole number.
_DAILY = {
    "logon": "n_logon n_pc_used after_hours_rate on_shared_pc_rate on_unassigned_pc_rate is_active_employee_day n_events_post_departure",
    "device": "n_device_events n_unique_pcs n_usb_connects n_usb_disconnects after_hours_rate usb_on_shared_pc_rate is_active_employee_day n_events_post_departure",
    "file": "n_file_events n_file_open n_file_write n_to_removable n_from_removable n_is_keylogger n_unique_pcs after_hours_rate is_active_employee_day n_events_post_departure",
    "http": "n_http avg_url_length avg_url_depth n_wikileaks n_dropbox n_job_sites after_hours_rate is_active_employee_day n_events_post_departure",
    "email": "n_email_sent avg_attachment_count n_internal_only n_internal_to_external n_external_to_internal n_external_only n_any_personal_recipient n_after_hours after_hours_rate is_active_employee_day n_events_post_departure",
}


def _typed(column: str, name: str) -> str:
    return r(column, name) if column.endswith("_rate") or column.split(".")[-1].startswith("avg_") else b(column, name)


for _d, _cols in _DAILY.items():
    oracle(f"{_d}_daily", f"SELECT user_key, day, {', '.join(_typed(c, c) for c in _cols.split())} FROM d_{_d}")

cte("dk", " UNION ".join(f"SELECT user_key, day FROM d_{d}" for d in _DAILY))
_wide = ", ".join(f"d_{d}.{c} AS {d}_{c}" for d, cols in _DAILY.items() for c in cols.split())
_joins = " ".join(f"LEFT JOIN d_{d} USING (user_key, day)" for d in _DAILY)
cte("wide", f"SELECT dk.user_key, dk.day, {_wide} FROM dk {_joins}")
_wide_out = ", ".join(
    _typed(f"wide.{d}_{c}" if not c.startswith("avg_") else f"wide.{d}_{c}", f"{d}_{c}").replace("BIGINT", "DOUBLE" if False else "BIGINT")
    for d, cols in _DAILY.items() for c in cols.split() if not c.startswith("avg_")
) + ", " + ", ".join(r(f"{d}_{c}", f"{d}_{c}") for d, cols in _DAILY.items() for c in cols.split() if c.startswith("avg_"))
for _n in ("daily_user_wide", "daily_user_tall_equal"):
    oracle(_n, f"SELECT user_key, day, {_wide_out} FROM wide")

_TOTALS = {"logon": "logon_n_logon", "device": "device_n_device_events", "file": "file_n_file_events",
           "http": "http_n_http", "email": "email_n_email_sent"}
_n_all = " + ".join(f"coalesce({c}, 0)" for c in _TOTALS.values())
_n_ah = " + ".join(f"coalesce({c}, 0) * coalesce({d}_after_hours_rate, 0)" for d, c in _TOTALS.items())
cte("one", f"""
SELECT *, CASE WHEN {_n_all} > 0 THEN ({_n_ah}) / ({_n_all}) ELSE 0 END AS ah_rate_1d,
  coalesce(device_n_usb_connects, 0) AS usb_count_1d FROM wide""")
oracle("after_hours_rate_1d", f"SELECT user_key, day, {r('ah_rate_1d')}, {b('usb_count_1d')} FROM one")

# The calendar with a row for every day between a user's first and last.
cte("cal", """
SELECT u.user_key, CAST(g.d AS DATE) AS day, coalesce(o.ah_rate_1d, 0) AS r, coalesce(o.usb_count_1d, 0) AS c,
  o.user_key IS NOT NULL AS real
FROM (SELECT user_key, min(day) AS lo, max(day) AS hi FROM one GROUP BY user_key) u,
  LATERAL (SELECT unnest(generate_series(u.lo::TIMESTAMP, u.hi::TIMESTAMP, INTERVAL 1 DAY)) AS d) g
LEFT JOIN one o ON o.user_key = u.user_key AND o.day = CAST(g.d AS DATE)""")
oracle("densified_days", f"SELECT user_key, day, {r('r', 'ah_rate_1d')}, {b('c', 'usb_count_1d')} FROM cal")


def _frame(a: int, z: int) -> str:
    low = f"{a} PRECEDING"
    high = "CURRENT ROW" if z == 0 else f"{z} PRECEDING"
    return f"OVER (PARTITION BY user_key ORDER BY day ROWS BETWEEN {low} AND {high})"


def _rolled(source: str, span: int) -> str:
    """Means over the densified calendar, so row frames are day frames."""
    long = span + 7
    return f"""
SELECT user_key, day, real, r, c,
  least(1, greatest(0, avg(r) {_frame(7, 0)})) AS tr,
  least(1, greatest(0, ({long}.0 * avg(r) {_frame(long, 1)} - 7.0 * avg(r) {_frame(7, 1)}) / {span}.0)) AS bl0,
  count(*) {_frame(long, 1)} AS prior,
  sum(c) {_frame(7, 0)} AS ut,
  sum(c) {_frame(long, 1)} - sum(c) {_frame(7, 1)} AS ub
FROM {source}"""


cte("roll", _rolled("cal", 14))
_ROLLED = """SELECT user_key, day, r AS ah_rate_1d, tr AS ah_rate_trend, CASE WHEN prior > 0 THEN bl0 END AS ah_rate_baseline,
  c AS usb_count_1d, ut AS usb_count_trend, ub AS usb_count_baseline,
  (tr > CASE WHEN prior > 0 THEN bl0 ELSE 0 END + 1e-6)::INT AS ah_novel, (ut > coalesce(ub, 0))::INT AS usb_novel
FROM {} WHERE real"""
cte("roll2", _ROLLED.format("roll"))
_roll_out = ", ".join(
    [r(c) for c in ("ah_rate_1d", "ah_rate_trend", "ah_rate_baseline", "usb_count_trend", "usb_count_baseline")]
    + [b(c) for c in ("usb_count_1d", "ah_novel", "usb_novel")]
)
oracle("rolling_trend_baseline", f"SELECT user_key, day, {_roll_out} FROM roll2")
cte("rolldoc", f"""
SELECT user_key, day, real, r AS ah_rate_1d, c AS usb_count_1d,
  avg(r) {_frame(6, 0)} AS ah_rate_trend, avg(r) {_frame(21, 8)} AS ah_rate_baseline0, avg(r) {_frame(20, 7)} AS x,
  sum(c) {_frame(6, 0)} AS usb_count_trend,
  CASE WHEN count(*) {_frame(21, 1)} > 0 THEN coalesce(sum(c) {_frame(21, 8)}, 0) END AS usb_count_baseline
FROM cal""")
oracle("rolling_trend_documented", f"""
SELECT user_key, day, {r('ah_rate_1d')}, {r('ah_rate_trend')}, {r('ah_rate_baseline0', 'ah_rate_baseline')},
  {b('usb_count_1d')}, {r('usb_count_trend')}, {r('usb_count_baseline')},
  {b('ah_rate_trend > coalesce(ah_rate_baseline0, 0) + 1e-6', 'ah_novel')},
  {b('usb_count_trend > coalesce(usb_count_baseline, 0)', 'usb_novel')} FROM rolldoc WHERE real""")
cte("od", """
SELECT 'u' || o_custkey AS user_key, CAST(o_orderdate AS DATE) AS day,
  count(*) FILTER (o_orderstatus = 'F') AS usb_count_1d, avg(o_orderkey % 2) AS ah_rate_1d FROM orders GROUP BY 1, 2""")
cte("odcal", """
SELECT u.user_key, CAST(g.d AS DATE) AS day, coalesce(o.ah_rate_1d, 0) AS r, coalesce(o.usb_count_1d, 0) AS c,
  o.user_key IS NOT NULL AS real
FROM (SELECT user_key, min(day) AS lo, max(day) AS hi FROM od GROUP BY user_key) u,
  LATERAL (SELECT unnest(generate_series(u.lo::TIMESTAMP, u.hi::TIMESTAMP, INTERVAL 1 DAY)) AS d) g
LEFT JOIN od o ON o.user_key = u.user_key AND o.day = CAST(g.d AS DATE)""")
cte("odroll", _rolled("odcal", 30))
cte("odroll2", _ROLLED.format("odroll"))
oracle("rolling_long_history", f"SELECT user_key, day, {_roll_out} FROM odroll2")

# The feature table: wide columns plus rolling ones.
cte("feat", """
SELECT one.*, x.ah_rate_trend, x.ah_rate_baseline, x.usb_count_trend, x.usb_count_baseline, x.ah_novel, x.usb_novel
FROM one JOIN roll2 x ON x.user_key = one.user_key AND x.day = one.day""")

_W14 = "(PARTITION BY user_key ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
_wc = ("ah_rate_1d", "usb_count_1d", "http_n_http", "logon_n_logon", "file_n_file_events")
_feats = ", ".join(
    f"round({fn}(coalesce({c}, 0)::DOUBLE) OVER w, 6) + 0.0 AS {p}_{c}"
    for p, fn in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")) for c in _wc
)
oracle("window14_features", f"""
SELECT * EXCLUDE (n) FROM (SELECT user_key, day AS end_day, count(*) OVER w AS n, {_feats} FROM feat WINDOW w AS {_W14}) WHERE n = 14""")
cte("numbered", "SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY day) AS rn FROM feat")
oracle("window14_rows", f"""
SELECT a.user_key, a.day AS end_day, p.day, {b('p.usb_count_1d')}, {r('p.ah_rate_1d')}
FROM numbered a JOIN numbered p ON p.user_key = a.user_key AND p.rn BETWEEN a.rn - 13 AND a.rn WHERE a.rn >= 14""")
oracle("window_last_days", f"""
SELECT a.user_key, a.day AS end_day, p.day, {b('p.usb_count_1d')}, {r('p.ah_rate_1d')}
FROM numbered a JOIN numbered p ON p.user_key = a.user_key AND p.rn BETWEEN a.rn - 13 AND a.rn AND p.day >= a.day - 6 WHERE a.rn >= 14""")
oracle("windows_json_roundtrip", f"""
SELECT a.user_key, a.day AS end_day, p.day, {r('CASE WHEN day(a.day) % 2 = 0 THEN p.usb_count_1d END', 'usb_count_1d')},
  {r('CASE WHEN p.ah_rate_1d > 0 THEN p.ah_rate_1d END', 'ah_rate_1d')}
FROM numbered a JOIN numbered p ON p.user_key = a.user_key AND p.rn BETWEEN a.rn - 13 AND a.rn WHERE a.rn >= 14""")
oracle("window14_calendar", f"""
SELECT a.user_key, a.day, {b('count(*)', 'n_rows')}, {b('sum(p.usb_count_1d)', 'usb')}, {r('avg(p.ah_rate_1d)', 'ah')}
FROM one a JOIN one p ON p.user_key = a.user_key AND p.day BETWEEN a.day - 13 AND a.day GROUP BY a.user_key, a.day""")

# --- rules --------------------------------------------------------------------------------

_sig = " + ".join(
    f"CASE WHEN coalesce({c}, 0) >= 1 AND coalesce({d}_after_hours_rate, 0) >= 0.5 THEN "
    + ("CASE WHEN coalesce(email_n_after_hours, 0) > 0 THEN email_n_after_hours ELSE coalesce(email_n_email_sent, 0) * email_after_hours_rate END"
       if d == "email" else f"{c} * {d}_after_hours_rate") + " ELSE 0 END"
    for d, c in _TOTALS.items()
)
_post = " + ".join(f"coalesce({d}_n_events_post_departure, 0)" for d in _TOTALS)
cte("sg", f"""
SELECT *, ({_sig}) >= 1 AS ah_sig, coalesce(device_n_usb_connects, 0) AS usb, coalesce(http_n_wikileaks, 0) AS leak, ({_post}) AS post FROM feat""")
cte("rm", """
SELECT a.user_key, a.day, any_value(a.ah_sig) AS ah_sig, count(*) AS active_days,
  count(*) FILTER (p.ah_sig) AS ah_days, count(*) FILTER (p.usb > 0) AS usb_days, sum(p.usb) AS usb_total,
  count(*) FILTER (p.ah_sig AND p.usb > 0) AS same_day, sum(p.ah_novel) AS ah_nov, sum(p.usb_novel) AS usb_nov,
  any_value(a.usb) AS usb, any_value(a.leak) AS leak, any_value(a.post) AS post
FROM sg a JOIN sg p ON p.user_key = a.user_key AND p.day BETWEEN a.day - 6 AND a.day GROUP BY a.user_key, a.day""")
cte("ws14", f"SELECT user_key, day, min(day) OVER {_W14} AS window_start FROM feat")
cte("rm2", """
SELECT rm.*, window_start, active_days >= 3 AND (same_day > 0 OR (ah_days >= 2 AND usb_days >= 2)) AND ah_nov > 0 AND usb_nov > 0 AS base
FROM rm JOIN ws14 USING (user_key, day)""")
cte("rc", """
SELECT *, base AND leak > 0 AS has_chain, base AND usb_total >= 4 AND usb > 0 AND leak = 0 AS near_miss,
  base AND leak > 0 AND post > 0 AS has_chain_post FROM rm2""")
oracle("rule_measures_7d", f"""
SELECT user_key, day, ah_sig, window_start, {b('active_days')}, {b('ah_days', 'ah_sig_days_7d')}, {b('usb_days', 'usb_days_7d')},
  {b('usb_total', 'usb_total_7d')}, {b('same_day', 'same_day_ah_usb_7d')}, {b('leak > 0', 'wikileaks_days_N')},
  {b('ah_nov', 'ah_novel_7d')}, {b('usb_nov', 'usb_novel_7d')}, {b('usb', 'latest_usb')}, {r('post', 'post_departure_events_today')} FROM rm2""")
oracle("rule_cases", "SELECT user_key, day, has_chain, near_miss, has_chain_post FROM rc")
cte("ra", """
SELECT *, 'rules:' || kase AS reason, CASE kase WHEN 's1_chain_post_departure' THEN 0.95 WHEN 's1_chain' THEN 0.8 ELSE 0.3 END::DOUBLE AS score,
  CASE kase WHEN 's1_chain_post_departure' THEN 'Post-departure data theft pattern over the last 7 days. After-hours logins, USB activity, and traffic to a known data-leak site continue after the user left the organization.'
    WHEN 's1_chain' THEN 'Likely data theft over the last 7 days. Heavy after-hours activity on ' || ah_days || ' day(s). USB device use on ' || usb_days || ' day(s), ' || usb_total || ' total connections. Same-day after-hours + USB on ' || same_day || ' day(s). Traffic to a known data-leak site on ' || (leak > 0)::INT || ' day(s).'
    ELSE 'Possible preparation for data theft. After-hours activity and USB use have increased in the last 7 days. USB used ' || usb_total || ' times across ' || usb_days || ' day(s). No traffic to known data-leak sites has been observed yet.' END AS human_summary
FROM (SELECT *, CASE WHEN has_chain_post THEN 's1_chain_post_departure' WHEN has_chain THEN 's1_chain' WHEN near_miss THEN 's1_near_miss' END AS kase FROM rc)
WHERE kase IS NOT NULL""")
oracle("rule_alerts", f"""
SELECT user_key, day, reason, {r('score')}, human_summary, {b('ah_days', 'ah_sig_days_7d')}, {b('usb_days', 'usb_days_7d')},
  {b('usb_total', 'usb_total_7d')}, {b('same_day', 'same_day_ah_usb_7d')}, {b('leak > 0', 'wikileaks_days_N')},
  {b('1', 'wl_lookback_days')}, window_start, day AS window_end, {b('3', 'min_window_days')},
  'combined(rate*count, domain mins)' AS ah_method, {b('ah_nov', 'ah_novel_7d')}, {b('usb_nov', 'usb_novel_7d')},
  post > 0 AS post_departure_today, {r('post', 'post_departure_events_today')} FROM ra""")
_WEEK = "FROM ra JOIN sg s ON s.user_key = ra.user_key AND s.day BETWEEN ra.day - 6 AND ra.day"
cte("tl", f"""
SELECT ra.user_key, ra.day AS alert_day, s.day, 'after_hours' AS kind, 'After-hours activity above normal levels.' AS message {_WEEK} WHERE s.ah_sig
UNION ALL SELECT ra.user_key, ra.day, s.day, 'usb', 'USB device connected (' || s.usb || ' events) during this day.' {_WEEK} WHERE s.usb > 0
UNION ALL SELECT ra.user_key, ra.day, s.day, 'leak_site', 'Traffic to a known data-leak site (wikileaks.org).' {_WEEK} WHERE s.leak > 0
UNION ALL SELECT user_key, day, day, 'post_departure_chain', 'Data-theft pattern continues after the user left the organization.'
FROM ra WHERE has_chain_post""")
oracle("rule_timeline", "SELECT user_key, alert_day, day, kind, message FROM tl")
oracle("top_rule_alerts", f"""
SELECT user_key, day, reason, {r('score')}, {b('usb_total', 'usb_total_7d')}, {b('ah_days', 'ah_sig_days_7d')} FROM ra
ORDER BY ra.score DESC, usb_total DESC, day, user_key LIMIT 20""")

# --- directory ----------------------------------------------------------------------------

cte("snap", """
SELECT DISTINCT 'u' || o_custkey AS user_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date, c_custkey,
  c_name AS employee_name, lower(c_name) || '@corp.example' AS email, c_mktsegment AS role, r_name AS business_unit,
  'fu-' || (c_custkey % 6) AS functional_unit, n_name AS department, 'team-' || (c_custkey % 10) AS team,
  '  CUSTOMER#' || lpad(CAST(c_custkey - c_custkey % 10 AS VARCHAR), 9, '0') AS supervisor, 'corp.example' AS email_domain
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("bnd", "SELECT user_key, min(snapshot_date) AS first_seen, max(snapshot_date) AS last_seen FROM snap GROUP BY user_key")
cte("sup", """
SELECT s.*, (SELECT min(t.user_key) FROM snap t WHERE t.snapshot_date = s.snapshot_date
  AND lower(t.employee_name) = lower(trim(s.supervisor))) AS supervisor_key FROM snap s""")
_attrs = "employee_name, email, role, business_unit, functional_unit, department, team, supervisor"
oracle("directory_snapshots", f"SELECT user_key, snapshot_date, {_attrs}, email_domain FROM snap")
oracle("directory_bounds", "SELECT user_key, first_seen, last_seen FROM bnd")
oracle("supervisor_map", "SELECT user_key, snapshot_date AS event_month, supervisor, supervisor_key FROM sup")
oracle("directory_asof", f"""
SELECT user_key, snapshot_date AS event_month, {_attrs}, supervisor_key, first_seen, last_seen FROM sup JOIN bnd USING (user_key)""")
oracle("user_org", """
SELECT user_key, role AS role_id, business_unit, functional_unit, department, team AS team_id
FROM snap JOIN bnd USING (user_key) WHERE snapshot_date = last_seen""")
oracle("termination_map", """
SELECT user_key, last_seen, last_seen < (SELECT max(last_seen) FROM bnd) AS is_terminated FROM bnd""")
cte("ship", """
SELECT 'u' || o_custkey AS user_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS event_month
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("shipx", """
SELECT ship.*, snap.department, snap.business_unit, snap.user_key IS NOT NULL AS joined_ldap, first_seen, last_seen,
  coalesce(event_month BETWEEN first_seen AND last_seen, FALSE) AS active
FROM ship LEFT JOIN snap ON snap.user_key = ship.user_key AND snap.snapshot_date = ship.event_month
LEFT JOIN bnd ON bnd.user_key = ship.user_key""")
oracle("asof_month_enrich", f"""
SELECT department, business_unit, joined_ldap, active AS user_is_active_employee, {b('count(*)', 'n')},
  {b('count(DISTINCT user_key)', 'users')} FROM shipx GROUP BY ALL""")
oracle("join_reason", f"""
SELECT user_key, event_month, CASE WHEN first_seen IS NULL THEN 'not_in_ldap' WHEN event_month < first_seen THEN 'pre_hire'
  WHEN event_month > last_seen THEN 'post_departure' ELSE 'matched' END AS join_reason, {b('count(*)', 'n')} FROM shipx GROUP BY ALL""")
_pd = ", ".join(b(f"{d}_n_events_post_departure", f"{d}_n_events_post_departure") for d in _TOTALS)
oracle("post_departure_flag", f"""
SELECT w.user_key, w.day, coalesce(w.day > p.last_seen, FALSE) AS is_post_departure,
  coalesce(w.day > p.last_seen, FALSE) OR ({_post}) > 0 AS is_post_departure_window, {_pd}
FROM wide w LEFT JOIN people p ON p.user_key = w.user_key AND p.last_seen < (SELECT max(last_seen) FROM people)""")

# --- machines -----------------------------------------------------------------------------

oracle("shared_pcs", f"SELECT pc, {b('m', 'distinct_non_admin_users')}, {r('share', 'top_user_share')}, TRUE AS shared_pc FROM shr JOIN dom USING (pc)")
oracle("pc_dominance", f"SELECT pc, {r('share', 'top_user_share')} FROM dom")
oracle("pc_sharedness", f"SELECT pc, {b('m', 'distinct_non_admin_users')} FROM pcm")
oracle("assigned_pc", f"SELECT user_key, assigned_pc, {b('d', 'days_on_pc')}, {b('tot', 'user_days')}, {r('share')} FROM asg")
oracle("pc_flags", f"SELECT user_key, domain, on_shared AS on_shared_pc, on_unassigned AS on_unassigned_pc, {b('count(*)', 'n')} FROM e GROUP BY ALL")

# --- web and text -------------------------------------------------------------------------

cte("pg", """
SELECT *, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages""")
cte("logged_urls", """
SELECT page_id, CASE page_id % 8 WHEN 1 THEN url || '/a|b' WHEN 2 THEN url || '/{x}/"q"' WHEN 3 THEN url || '/a b/c'
  WHEN 4 THEN replace(url, '://', '://my_host.') WHEN 5 THEN replace(url, '://', '://user:pw@') ELSE url END AS url FROM pages""")
cte("logged_parts", """
SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^user:pw@', '') AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM logged_urls""")
oracle("url_metrics", f"""
SELECT page_id, {b('length(url)', 'url_length')}, {b("len([x FOR x IN string_split(path, '/') IF x <> ''])", 'url_depth')},
  host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS registrable FROM logged_parts""")
oracle("destination_flags", f"""
SELECT user_key, wiki AS is_wikileaks, dropbox AS is_dropbox, job AS is_job_site, {b('count(*)', 'n')},
  {b('sum(url_length)', 'url_length')}, {b('sum(url_depth)', 'url_depth')} FROM ev WHERE domain = 'http' GROUP BY ALL""")
cte("td", r"""
SELECT domain, count(*) AS n FROM (
  SELECT regexp_extract(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '([^.]+[.][^.]+)$', 1) AS domain
  FROM (SELECT unnest(regexp_extract_all(url || ' ' || html, 'https?://\S+')) AS u FROM pages)) GROUP BY domain""")
oracle("top_domains", f"SELECT domain, {b('n')} FROM td ORDER BY td.n DESC, domain LIMIT 50")
oracle("listed_host_flags", """
SELECT page_id, regexp_extract(host, '([^.]+[.][^.]+)$', 1) IN (SELECT domain FROM td ORDER BY n DESC, domain LIMIT 50) AS is_listed FROM pg""")
cte("cv", r"""
SELECT conv_id, turn, role || '@corp.example' AS from_key,
  [w FOR w IN regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +') IF w <> ''] AS ws FROM conversations""")
oracle("recipient_counts", f"SELECT conv_id, turn, {b('len(ws)', 'to_count')} FROM cv")
oracle("recipient_edges", f"""
SELECT from_key, w || '@x.example' AS to_key, {b('count(*)', 'n')} FROM (SELECT from_key, unnest(ws) AS w FROM cv) GROUP BY ALL""")
_dirs = {
    "dir_internal_only": "int_only", "dir_internal_to_external": "int_ext", "dir_external_to_internal": "ext_int",
    "dir_external_only": "ext_only", "any_personal_recipient": "personal", "email_to_ext_domain": "k % 2 = 1 OR k % 7 = 0",
    "internal_to_external": "int_ext", "external_to_internal": "ext_int", "external_to_personal": "k % 4 >= 2 AND k % 7 = 0",
}
oracle("direction_flags", "SELECT user_key, " + ", ".join(b(f"count(*) FILTER ({c})", n) for n, c in _dirs.items())
       + " FROM ev WHERE domain = 'email' GROUP BY user_key")
oracle("name_normalise", """
SELECT c_custkey, replace(lower(c_name), '#', ' # ') AS name, CASE WHEN c_custkey % 10 <> 9 THEN lower(c_name) END AS user_key,
  'mail.example' AS email_domain, c_name AS handle FROM customer""")
oracle("keylogger_stem", "SELECT p_partkey, p_partkey % 5 IN (0, 2) AS is_keylogger FROM part")
oracle("timestamp_parsing", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 7 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 10 <> 7 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month,
  o_orderkey % 10 <> 7 AND (extract(hour FROM o_orderdate) < 7 OR extract(hour FROM o_orderdate) >= 19) AS after_hours FROM orders""")
oracle("dedupe_events", f"""
SELECT user_key, domain, {b('count(*)', 'n')}, {b('count(*) FILTER (event_id % 3 <> 0)', 'with_id')} FROM ev GROUP BY ALL""")

# --- labels -------------------------------------------------------------------------------

cte("ky", "SELECT DISTINCT user_key, day FROM ev_k")
cte("rg", """
SELECT user_key, d + o.s AS exfil_start, d + o.e AS exfil_end FROM (
  SELECT user_key, min(day) AS d FROM ky WHERE CAST(substr(user_key, 2) AS BIGINT) % 10 = 3 GROUP BY user_key),
  (VALUES (18, 22), (25, 25)) o(s, e)""")
oracle("exfil_ranges", """
SELECT user_key, min(day) AS exfil_start, max(day) AS exfil_end, 'SCENARIO_1' AS scenario_id FROM ev WHERE domain = 'http' AND wiki GROUP BY user_key""")
oracle("exfil_start", "SELECT user_key, min(exfil_start) AS exfil_start FROM rg GROUP BY user_key")
cte("lb", """
SELECT ky.*, EXISTS (SELECT 1 FROM rg WHERE rg.user_key = ky.user_key AND ky.day BETWEEN exfil_start AND exfil_end) AS is_exfil_day,
  (SELECT min(exfil_start - ky.day) FROM rg WHERE rg.user_key = ky.user_key AND exfil_start > ky.day) AS days_until FROM ky""")
oracle("label_interval", f"SELECT user_key, day, {b('is_exfil_day', 'label')} FROM lb")
cte("lf", "SELECT *, CASE WHEN is_exfil_day THEN NULL WHEN days_until BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS lab FROM lb")
oracle("label_forecast", f"""
SELECT user_key, day, is_exfil_day, {b('days_until', 'days_until_exfil')}, {b('7', 'forecast_horizon_days')}, {b('lab', 'label_forecast_day')} FROM lf""")
oracle("label_audit", f"""
SELECT {b('count(*)', 'total_rows')}, {b('count(*) FILTER (lab = 1)', 'positive_labels')}, {b('count(*) FILTER (lab = 0)', 'negative_labels')},
  {b('count(*) FILTER (lab IS NULL)', 'null_labels')}, {b('count(DISTINCT user_key)', 'total_users')},
  {b('count(DISTINCT CASE WHEN lab = 1 THEN user_key END)', 'users_with_positives')} FROM lf""")
oracle("probe_users", f"""
SELECT user_key, day, {b('lab', 'label_forecast_day')}, is_exfil_day, {b('days_until', 'days_until_exfil')} FROM lf
WHERE lab = 1 AND user_key IN (SELECT user_key FROM rg)""")
oracle("class_weight", f"""
SELECT {b('count(*) FILTER (lab = 0)', 'neg')}, {b('count(*) FILTER (lab = 1)', 'pos')},
  {r('count(*) FILTER (lab = 0) / count(*) FILTER (lab = 1)', 'weight')} FROM lf""")
cte("sp", """
SELECT user_key, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT user_key, CAST('0x' || substr(md5('42|' || user_key), 1, 8) AS BIGINT) % 100 AS h FROM (SELECT DISTINCT user_key FROM ky))""")
oracle("user_split", "SELECT user_key, split FROM sp")
oracle("user_split_exact", """
SELECT user_key, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT user_key, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42|' || user_key), 1, 15) AS BIGINT)) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_key FROM ky))""")
cte("fw", """
SELECT user_key, day AS end_day, lab, split FROM (
  SELECT lf.*, split, row_number() OVER (PARTITION BY lf.user_key ORDER BY day) AS rn FROM lf JOIN sp USING (user_key) WHERE lab IS NOT NULL) WHERE rn >= 14""")
oracle("forecast_windows", f"SELECT user_key, end_day, {b('lab', 'label')}, split FROM fw")
oracle("windows_join_split", f"""
SELECT split, {b('count(*)', 'n_windows')}, {b('sum(lab)', 'n_pos')}, {r('avg(lab)', 'pos_rate')} FROM fw
JOIN (SELECT user_key, day AS end_day, row_number() OVER (PARTITION BY user_key ORDER BY day) AS rn FROM ky) x USING (user_key, end_day)
WHERE rn >= 14 GROUP BY split""")

# --- scores -------------------------------------------------------------------------------

cte("sraw", f"""
SELECT user_key, day AS end_day, count(*) OVER w AS n,
  round(0.45 * avg(ah_rate_1d) OVER w + 0.35 * least(1.0, sum(usb_count_1d) OVER w / 14.0)
    + 0.2 * least(1.0, avg(coalesce(http_n_http, 0)) OVER w / 3.0), 6) AS raw,
  round(least(1.0, 0.712347 * ah_rate_trend + 0.733391 * usb_count_trend / (usb_count_trend + 3.0)), 9) AS fc
FROM feat WINDOW w AS {_W14}""")
cte("sraw14", "SELECT * FROM sraw WHERE n = 14")
cte("sc", """
SELECT s.user_key, s.end_day, fc, round((raw - (SELECT min(raw) FROM sraw14)) / ((SELECT max(raw) FROM sraw14) - (SELECT min(raw) FROM sraw14)), 9) AS base_score,
  role_id, business_unit, functional_unit, department, team_id FROM sraw14 s LEFT JOIN people USING (user_key)""")
oracle("score_cohorts", f"""
SELECT cohort, role_id, {b('count(*)', 'windows')}, {b('count(DISTINCT user_key)', 'users')}, {r('avg(base_score)', 'mean')} FROM (
  SELECT 'high' AS cohort, * FROM sc WHERE base_score >= 0.6 UNION ALL SELECT 'low', * FROM sc WHERE base_score <= 0.2) GROUP BY cohort, role_id""")
_P = "(PARTITION BY user_key ORDER BY end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
cte("pz", f"""
SELECT *, count(*) OVER p AS prior_n, avg(base_score) OVER p AS pm, stddev_samp(base_score) OVER p AS ps FROM sc WINDOW p AS {_P}""")
cte("pz2", """
SELECT *, CASE WHEN prior_n >= 5 THEN pm END AS personal_mean, CASE WHEN prior_n >= 5 THEN ps END AS personal_std,
  CASE WHEN prior_n >= 5 THEN (base_score - pm) / nullif(ps, 0) END AS z_personal FROM pz""")
oracle("personal_zscore", f"""
SELECT user_key, end_day, {r('base_score')}, {b('prior_n', 'prior_window_count')}, {r('personal_mean')}, {r('personal_std')}, {r('z_personal')} FROM pz2""")
_GROUPS = {"role_id": "role", "business_unit": "business_unit", "functional_unit": "functional_unit", "department": "department", "team_id": "team_id"}
for _g, _p in _GROUPS.items():
    cte(f"gz_{_p}", f"""
SELECT a.user_key, a.end_day, count(x.base_score) AS n, CASE WHEN count(x.base_score) >= 20 THEN avg(x.base_score) END AS m,
  CASE WHEN count(x.base_score) >= 20 THEN stddev_samp(x.base_score) END AS s
FROM sc a LEFT JOIN sc x ON x.{_g} = a.{_g} AND x.end_day < a.end_day GROUP BY a.user_key, a.end_day""")
cte("zs", "SELECT pz2.*, " + ", ".join(
    f"gz_{p}.m AS {p}_m, gz_{p}.s AS {p}_s, gz_{p}.n AS {p}_n, (base_score - gz_{p}.m) / nullif(gz_{p}.s, 0) AS z_{p}" for p in _GROUPS.values())
    + " FROM pz2 " + " ".join(f"JOIN gz_{p} USING (user_key, end_day)" for p in _GROUPS.values()))
_ZC = ["z_personal", *[f"z_{p}" for p in _GROUPS.values()]]
cte("zx", f"SELECT *, greatest({', '.join(_ZC)}) AS z_max FROM zs")
oracle("group_zscore", "SELECT user_key, end_day, " + ", ".join(
    f"{r(f'{p}_m', f'{p}_mean')}, {r(f'{p}_s', f'{p}_std')}, {b(f'{p}_n', f'{p}_n')}, {r(f'z_{p}')}" for p in ("role", "department")) + " FROM zs")
cte("order_scores", """
SELECT od.user_key, od.day AS end_day, od.ah_rate_1d::DOUBLE AS x, role_id, team_id FROM od LEFT JOIN people USING (user_key)""")
for _g in ("role_id", "team_id"):
    cte(f"order_{_g}", f"""
SELECT {_g}, end_day, sum(n) OVER w AS n, sum(s) OVER w AS s1, sum(q) OVER w AS s2 FROM (
  SELECT {_g}, end_day, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM order_scores WHERE {_g} IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY {_g} ORDER BY end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def _order_z(g: str, need: int) -> str:
    spread = f"sqrt(greatest(0, {g}.s2 - {g}.s1 * {g}.s1 / {g}.n) / ({g}.n - 1))"
    return f"CASE WHEN {g}.n >= {need} THEN (x - {g}.s1 / {g}.n) / nullif({spread}, 0) END"


oracle("group_zscore_default", f"""
SELECT o.user_key, o.end_day, {b('coalesce(order_role_id.n, 0)', 'role_n')}, {r(_order_z('order_role_id', 50), 'z_role')},
  {b('coalesce(order_team_id.n, 0)', 'team_id_n')}, {r(_order_z('order_team_id', 20), 'z_team_id')}
FROM order_scores o LEFT JOIN order_role_id USING (role_id, end_day) LEFT JOIN order_team_id USING (team_id, end_day)""")
oracle("zmax", "SELECT user_key, end_day, " + ", ".join(r(c) for c in [*_ZC, "z_max"]) + " FROM zx")
cte("zb", """
SELECT *, least(0.9, greatest(0.0, base_score * (1 + boost))) AS score FROM (
  SELECT *, CASE WHEN z_max >= 3.5 THEN 0.3 WHEN z_max >= 3.0 THEN 0.2 WHEN z_max >= 2.5 THEN 0.1 WHEN z_max < 1.0 THEN -0.5 ELSE 0 END::DOUBLE AS boost
  FROM zx WHERE NOT (base_score < 0.5 AND (z_max IS NULL OR z_max < 2.0)))""")
oracle("zboost", f"SELECT user_key, end_day, {r('base_score')}, {r('z_max')}, {r('boost', 'boost_pct')}, {r('zb.score', 'score')} FROM zb WHERE zb.score >= 0.4")
oracle("score_distribution", f"""
SELECT {b('count(*)', 'total_windows')}, {b('count(DISTINCT user_key)', 'unique_users')}, min(end_day) AS first_day, max(end_day) AS last_day,
  {r('min(base_score)', 'min_score')}, {r('max(base_score)', 'max_score')}, {r('avg(base_score)', 'mean_score')},
  {r('quantile_cont(base_score, 0.5)', 'median_score')}, {r('quantile_cont(base_score, 0.25)', 'p25')}, {r('quantile_cont(base_score, 0.75)', 'p75')} FROM sc""")
cte("rs", """
SELECT role_id, count(*) AS n, avg(base_score) AS a, stddev_samp(base_score) AS s, min(base_score) AS lo, max(base_score) AS hi FROM sc WHERE role_id IS NOT NULL GROUP BY role_id""")
oracle("role_score_stats", f"""
SELECT role_id, {b('n', 'num_windows')}, {r('a', 'avg_score')}, {r('s', 'std_score')}, {r('lo', 'min_score')}, {r('hi', 'max_score')} FROM rs ORDER BY a DESC, role_id LIMIT 20""")
cte("uvr", """
SELECT u.user_key, u.role_id, ua, rs.a, (ua - rs.a) / rs.s AS z, un FROM (
  SELECT user_key, role_id, avg(base_score) AS ua, count(*) AS un FROM sc WHERE role_id IS NOT NULL GROUP BY ALL) u JOIN rs USING (role_id) WHERE rs.s > 0""")
_uvr = f"SELECT user_key, role_id, {r('ua', 'user_avg_score')}, {r('a', 'role_avg_score')}, {r('z', 'z_score_vs_role')}, {b('un', 'num_windows')} FROM uvr"
oracle("user_vs_role", _uvr)
oracle("top_outliers", _uvr + " ORDER BY uvr.z DESC NULLS LAST, user_key LIMIT 15")
_PF = {"avg_logons": "logon_n_logon", "avg_usb": "device_n_usb_connects", "avg_wikileaks": "http_n_wikileaks", "avg_files": "file_n_file_events",
       "avg_emails": "email_n_email_sent", "avg_after_hours": "logon_after_hours_rate", "avg_device_after_hours": "device_after_hours_rate"}
for _g, _cond in (("HIGH_SCORE", ">= (SELECT quantile_cont(base_score, 0.9) FROM sc)"), ("LOW_SCORE", "<= (SELECT quantile_cont(base_score, 0.1) FROM sc)")):
    cte(f"dp_{_g.lower()}", f"SELECT '{_g}' AS group_type, " + ", ".join(f"avg({c}) AS {n}" for n, c in _PF.items()) + f"""
FROM (SELECT user_key, end_day FROM sc WHERE base_score {_cond}) h JOIN feat d ON d.user_key = h.user_key AND d.day <= h.end_day AND d.day > h.end_day - 14""")
cte("dp", "SELECT * FROM dp_high_score UNION ALL SELECT * FROM dp_low_score")
oracle("high_low_deciles", "SELECT group_type, " + ", ".join(r(n) for n in _PF) + " FROM dp")
oracle("decile_differences", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {r(f'h.{n} - l.{n}', 'diff')}, {r(f'CASE WHEN l.{n} > 0 THEN (h.{n} - l.{n}) / l.{n} * 100 ELSE 0 END', 'pct_change')} FROM dp_high_score h, dp_low_score l" for n in _PF))
oracle("top_windows", f"SELECT user_key, end_day, {r('base_score')}, role_id FROM sc ORDER BY sc.base_score DESC, user_key, end_day LIMIT 20")
oracle("top_users_overlap", """
SELECT DISTINCT user_key, user_key IN (SELECT user_key FROM rg) AS is_insider FROM (
  SELECT user_key FROM sc ORDER BY base_score DESC, user_key, end_day LIMIT 100)""")
oracle("insider_score_stats", f"""
SELECT rg.user_key, '1' AS scenario, exfil_start AS "start", exfil_end AS "end", {b('count(base_score)', 'num_windows')}, {r('avg(base_score)', 'avg_score')},
  {r('max(base_score)', 'max_score')}, {r('min(base_score)', 'min_score')},
  {b('count(base_score) FILTER (end_day BETWEEN exfil_start AND exfil_end)', 'attack_windows')},
  {r('avg(base_score) FILTER (end_day BETWEEN exfil_start AND exfil_end)', 'attack_avg_score')},
  {r('max(base_score) FILTER (end_day BETWEEN exfil_start AND exfil_end)', 'attack_max_score')}
FROM rg LEFT JOIN sc USING (user_key) GROUP BY rg.user_key, exfil_start, exfil_end""")
cte("t20", "SELECT user_key, end_day, base_score FROM sc ORDER BY base_score DESC, user_key, end_day LIMIT 20")
oracle("alert_windows", f"""
SELECT d.user_key, d.day, {r('d.ah_rate_1d')}, {b('d.usb_count_1d')}, t.end_day FROM t20 t JOIN one d ON d.user_key = t.user_key AND d.day BETWEEN t.end_day - 13 AND t.end_day""")
oracle("window_indicators", f"""
SELECT t.user_key, t.end_day, {b('coalesce(sum(device_n_usb_connects), 0)', 'total_usb')}, {b('coalesce(sum(http_n_wikileaks), 0)', 'total_wikileaks')},
  {b('coalesce(sum(file_n_file_events), 0)', 'total_files')}, {b('coalesce(sum(email_n_email_sent), 0)', 'total_emails')},
  {r('avg(logon_after_hours_rate)', 'avg_after_hours')},
  coalesce(sum(http_n_wikileaks), 0) > 0 OR coalesce(sum(device_n_usb_connects), 0) > 10 AS possible_exfiltration
FROM t20 t JOIN wide d ON d.user_key = t.user_key AND d.day <= t.end_day AND d.day > t.end_day - 14 GROUP BY t.user_key, t.end_day""")

# --- alerts -------------------------------------------------------------------------------

cte("al", """
SELECT user_key, day, 1 AS dr, 'rules' AS detector, reason, score, human_summary, usb_total, usb_nov, (leak > 0)::INT AS wl,
  NULL::DOUBLE AS e_raw, NULL::DOUBLE AS e_boosted, NULL::DOUBLE AS e_boost, NULL::DOUBLE AS e_zp, NULL::DOUBLE AS e_zr, NULL::DOUBLE AS e_zm FROM ra
UNION ALL SELECT user_key, end_day, 2, 'anomaly', 'anomaly:isolation_forest', score, NULL, NULL, NULL, NULL,
  round(base_score, 4), round(score, 4), round(boost * 100, 1), round(z_personal, 2), round(z_role, 2), round(z_max, 2) FROM zb WHERE score >= 0.4
UNION ALL SELECT user_key, end_day, 3, 'forecast', 'forecast:s1_exfil_7d', fc, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sc WHERE fc >= 0.5
UNION ALL SELECT user_key, end_day, 4, 'ml', 'ml:supervised_s1', m, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT *, round(1.0 / (1.0 + exp(-(8.0 * base_score - 4.4))), 9) AS m FROM sc) WHERE m >= 0.5""")
cte("al2", "SELECT *, " + ", ".join(
    f"CASE WHEN detector = 'ml' THEN coalesce(max(score) FILTER (detector = '{d}') OVER (PARTITION BY user_key, day), 0.0) END AS {d}_score"
    for d in ("rules", "anomaly", "ml", "forecast")) + " FROM al")
oracle("zscore_lookup", f"SELECT user_key, end_day, {r('base_score')}, {r('z_personal')}, {r('z_role')}, {r('z_max')} FROM zx")
oracle("raw_alert_scores", "SELECT user_key, day, detector, reason, " + ", ".join(
    r(f"al2.{c}", c) for c in ("score", "rules_score", "anomaly_score", "ml_score", "forecast_score")) + " FROM al2")
cte("cn0", """
SELECT sha256(CAST(day AS VARCHAR) || '|' || user_key || '|' || detector || '|' || reason) AS alert_id, user_key, day, dr, detector, human_summary,
  CASE WHEN detector = 'rules' THEN substr(reason, 7) ELSE '' END AS hit,
  CASE WHEN detector = 'rules' THEN score ELSE coalesce(rules_score, 0.0) END AS rules_score,
  CASE WHEN detector = 'ml' THEN score ELSE 0.0 END AS ml_score,
  CASE WHEN detector = 'anomaly' THEN score ELSE anomaly_score END AS anomaly_score,
  CASE WHEN detector = 'forecast' THEN score ELSE forecast_score END AS forecast_score FROM al2""")
cte("cn1", """
SELECT *, 1.0 / (1.0 + exp(-(-3.634722125361524 + 2.553178 * (hit IN ('s1_chain', 's1_chain_post_departure'))::INT - 1.092871 * (hit = 's1_near_miss')::INT
  + 4.776795 * ml_score + 1.240133 * coalesce(anomaly_score, 0.0) + 1.117140 * coalesce(forecast_score, 0.0)))) AS p FROM cn0""")
cte("cn2", "SELECT *, CASE hit WHEN 's1_chain_post_departure' THEN 1.0 WHEN 's1_chain' THEN greatest(p, 0.95) ELSE p END::DOUBLE AS ens FROM cn1")
cte("cn3", """
SELECT *, CASE WHEN hit IN ('s1_chain', 's1_chain_post_departure') OR ens >= 0.7 THEN 'critical' WHEN ens >= 0.5 THEN 'high' WHEN ens >= 0.3 THEN 'medium' ELSE 'low' END AS severity FROM cn2""")
cte("cn", """
SELECT *, severity IN ('high', 'critical') AS escalated, CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sr,
  CASE WHEN hit <> '' THEN hit WHEN coalesce(forecast_score, 0) >= greatest(ml_score, coalesce(anomaly_score, 0)) THEN 'forecast'
    WHEN coalesce(anomaly_score, 0) >= greatest(ml_score, coalesce(forecast_score, 0)) THEN 'anomaly' ELSE 'ML' END AS driver FROM cn3""")
_SC = "rules_score ml_score anomaly_score forecast_score".split()
oracle("ensemble_scores", "SELECT alert_id, user_key, day, hit AS rule_hits, " + ", ".join(r(f"cn.{c}", c) for c in _SC)
       + f", {r('ens', 'ensemble_score')}, severity, escalated, driver FROM cn")
oracle("alert_explanations", """
SELECT alert_id, CASE WHEN hit IN ('s1_chain', 's1_chain_post_departure') THEN 1.0 WHEN hit = 's1_near_miss' THEN 0.5 ELSE 0.0 END::DOUBLE AS rule_weight,
  'Rule case: ' || CASE WHEN hit = '' THEN 'none' ELSE hit END AS rule_text, printf('Raw ML score: %.4f', ml_score) AS ml_text,
  CASE WHEN anomaly_score IS NULL THEN 'No anomaly score' ELSE printf('Anomaly score: %.4f', anomaly_score) END AS anomaly_text,
  CASE WHEN forecast_score IS NULL THEN 'No forecast score' ELSE printf('Forecast score: %.4f', forecast_score) END AS forecast_text,
  printf('Ensemble %.2f (%s). Driven by %s.', ens, CASE WHEN escalated THEN 'Escalated' ELSE 'Non-escalated' END, driver) AS summary FROM cn""")
cte("ru", """
SELECT user_key, day, coalesce(max(nullif(hit, '')), '') AS rule_hits, max(rules_score) AS rules_score, max(ml_score) AS ml_score,
  max(anomaly_score) AS anomaly_score, max(forecast_score) AS forecast_score, max(ens) AS ens, max(sr) AS sr, bool_or(escalated) AS escalated,
  first(alert_id ORDER BY ens DESC, dr) AS alert_id FROM cn GROUP BY user_key, day""")
_SEV = "CASE {} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
oracle("user_day_rollup", "SELECT user_key, day, rule_hits, " + ", ".join(r(f"ru.{c}", c) for c in _SC)
       + f", {r('ens', 'ensemble_score')}, escalated, {_SEV.format('sr')} AS severity, alert_id FROM ru")
oracle("same_day_max", "SELECT alert_id, " + ", ".join(
    r(f"max(cn.{c}) OVER (PARTITION BY user_key, day)", c) for c in ("ml_score", "anomaly_score", "forecast_score"))
    + f", {r('ens', 'ensemble_score')}, severity FROM cn")


def _users(where: str) -> str:
    return f"""
SELECT user_key, count(*) AS n, count(*) FILTER (escalated) AS n_esc, max(ens) AS me, coalesce(max(forecast_score), 0.0) AS mf,
  min(day) FILTER (forecast_score >= 0.6) AS ffd, min(day) FILTER (escalated) AS fed, count(DISTINCT day) FILTER (sr >= 2) AS hd,
  first(severity ORDER BY day DESC, dr DESC) AS last_sev, bool_or(escalated) AS esc FROM cn {where} GROUP BY user_key"""


_RANKS = """
SELECT *, CASE WHEN me >= 0.9 THEN 3 WHEN me >= 0.75 THEN 2 WHEN me >= 0.5 THEN 1 ELSE 0 END AS s1,
  CASE WHEN mf >= 0.7 THEN 3 WHEN mf >= 0.5 THEN 1 ELSE 0 END AS s2 FROM {}"""
cte("us0", _users("WHERE day <= DATE '2024-01-28'"))
cte("us", _RANKS.format("us0"))
cte("usall0", _users(""))
cte("usall", _RANKS.format("usall0"))
_people = "(SELECT user_key, employee_name, role_id, last_seen, last_seen < (SELECT max(last_seen) FROM people) AS gone FROM people)"
_rank_cols = (f"{b('n', 'total_alerts')}, {b('n_esc', 'escalated_alerts')}, {r('me', 'max_ensemble')}, {_SEV.format('greatest(s1, s2)')} AS severity_bucket, "
              f"{r('greatest(me, mf)', 'priority_score')}, {r('CASE WHEN mf > 0 THEN mf END', 'max_forecast')}")
oracle("user_ranking", f"""
SELECT user_key, {_rank_cols}, coalesce(employee_name, user_key) AS name, coalesce(role_id, '') AS user_role, coalesce(gone, FALSE) AS is_terminated,
  CASE WHEN gone THEN last_seen END AS termination_day FROM us LEFT JOIN {_people} USING (user_key)""")
oracle("watchlist", f"SELECT user_key, {_rank_cols} FROM us WHERE mf >= 0.75")
oracle("stream_rollups", f"SELECT user_key, {_rank_cols} FROM usall")
oracle("top_risk", f"SELECT user_key, {_rank_cols} FROM usall ORDER BY greatest(s1, s2) DESC, greatest(me, mf) DESC, user_key LIMIT 10")
_capped = "CASE WHEN s2 > s1 THEN CASE WHEN me < 0.3 AND s2 = 3 THEN 1 ELSE s2 END ELSE s1 END"
oracle("risk_meta", f"""
SELECT user_key, {r('me', 'max_ensemble')}, ffd AS first_forecast_day, fed AS first_escalation_day, {b('hd', 'days_high_or_above')}, last_sev AS last_severity,
  esc AS ever_escalated, {_SEV.format(_capped)} AS severity_bucket, {r('greatest(me, mf)', 'priority_score')}, {r('CASE WHEN mf > 0 THEN mf END', 'max_forecast')},
  CASE WHEN gone THEN last_seen END AS termination_day FROM us LEFT JOIN {_people} USING (user_key)""")
cte("nt", """
SELECT user_key, max(day) AS ld, first(severity ORDER BY day DESC, dr DESC) AS ls, count(DISTINCT day) FILTER (sr >= 2) AS hd, max(ens) AS me, bool_or(escalated) AS esc,
  bool_or(hit <> '') AS hr, coalesce(bool_or(forecast_score >= 0.75), FALSE) AS hf, bool_or(anomaly_score IS NOT NULL) AS han,
  min(day) FILTER (hit = 's1_near_miss') AS near, min(day) FILTER (hit = 's1_chain') AS chain, min(day) FILTER (hit = 's1_chain_post_departure') AS post,
  min(day) FILTER (forecast_score >= 0.6) AS spike, first(forecast_score ORDER BY day, dr) FILTER (forecast_score >= 0.6) AS spike_score FROM cn GROUP BY user_key""")
oracle("analyst_notes", """
SELECT user_key, spike AS day, 'forecast_spike' AS kind, printf('Forecast model first predicted elevated exfil risk (%.2f%% likelihood).', spike_score * 100) AS message FROM nt WHERE spike IS NOT NULL
UNION ALL SELECT user_key, near, 'near_miss', 'Possible preparation for data theft after-hours activity and USB use increased but no data-leak site access yet.' FROM nt WHERE near IS NOT NULL
UNION ALL SELECT user_key, chain, 'full_chain', 'Pre-departure data theft detected.' FROM nt WHERE chain IS NOT NULL
UNION ALL SELECT user_key, post, 'post_departure_chain', 'Post-departure data theft detected.' FROM nt WHERE post IS NOT NULL
UNION ALL SELECT DISTINCT user_key, day, 'rule_' || kind, message FROM tl
UNION ALL SELECT user_key, ld, 'summary', printf('Last Rule-based alert on %s (%s).', CAST(ld AS VARCHAR), ls) || ' '
  || CASE WHEN hd > 0 THEN printf('%d day(s) with high/critical alerts; max ensemble %.2f.', hd, me) ELSE printf('Max ensemble %.2f so far.', me) END
  || CASE WHEN esc THEN ' Has at least one escalated alert.' ELSE '' END
  || CASE WHEN hr OR hf OR han THEN ' Signals: ' || concat_ws(', ', CASE WHEN hr THEN 'rule chain activity' END, CASE WHEN hf THEN 'elevated forecast scores' END,
     CASE WHEN han THEN 'anomalous behavior' END) || '.' ELSE '' END FROM nt""")
cte("vis", "SELECT * FROM cn WHERE day <= DATE '2024-01-28'")
cte("rd", "SELECT DISTINCT day FROM vis ORDER BY day DESC LIMIT 7")
_pulse = ", ".join([b("count(vis.user_key)", "count"), b("count(*) FILTER (escalated)", "escalated_count"), b("count(*) FILTER (hit <> '')", "rule_count"),
                    b("count(*) FILTER (ml_score > 0.5)", "ml_count"), b("count(*) FILTER (anomaly_score > 0.5)", "anomaly_count")])
oracle("heartbeat_global", f"SELECT day, {_pulse} FROM vis JOIN rd USING (day) GROUP BY day")
oracle("heartbeat_user", f"""
SELECT rd.day, {_pulse}, {r('coalesce(max(forecast_score), 0.0)', 'forecast_max')} FROM rd LEFT JOIN vis ON vis.day = rd.day AND vis.user_key = 'u3' GROUP BY rd.day""")
oracle("heartbeat_watchlist", f"""
SELECT rd.day, {b('count(v.user_key)', 'count')}, {b('count(*) FILTER (escalated)', 'escalated_count')},
  {b('count(DISTINCT v.user_key) FILTER (forecast_score >= 0.75)', 'forecast_hit_count')}
FROM rd LEFT JOIN (SELECT * FROM vis WHERE user_key IN (SELECT user_key FROM vis WHERE forecast_score >= 0.75)) v ON v.day = rd.day GROUP BY rd.day""")
oracle("detector_day_pivot", f"""
SELECT day, {b("count(*) FILTER (detector = 'rules')", 'rules')}, {b("count(*) FILTER (detector = 'anomaly')", 'anomaly')}, {b("count(*) FILTER (detector = 'ml')", 'ml')}
FROM al WHERE detector <> 'forecast' AND day IN (SELECT DISTINCT day FROM al WHERE detector <> 'forecast' ORDER BY day DESC LIMIT 60) GROUP BY day""")
oracle("recent_alerts", f"""
SELECT user_key, day, detector, {r('al.score', 'score')} FROM al WHERE detector <> 'forecast' ORDER BY day DESC, user_key DESC, dr DESC LIMIT 200""")

# Watch windows: from each possible start follow to the next one; a resolved window stays.
cte("hits", "SELECT user_key, day, max(forecast_score) AS fs, min(dr) AS dr FROM cn WHERE forecast_score >= 0.75 GROUP BY user_key, day")
cte("wst", """
SELECT h.user_key, h.day AS start_day, h.day + 7 AS expiry_day,
  (SELECT min(x.day) FROM cn x WHERE x.user_key = h.user_key AND x.escalated AND (x.day > h.day AND x.day <= h.day + 7 OR x.day = h.day AND x.dr >= h.dr)) AS escalation_day,
  (SELECT min(n.day) FROM hits n WHERE n.user_key = h.user_key AND n.day > h.day + 7) AS next_start FROM hits h""")
_REC = """
ww AS (SELECT w.* FROM wst w JOIN (SELECT user_key, min(day) AS start_day FROM hits GROUP BY user_key) USING (user_key, start_day)
  UNION ALL SELECT n.* FROM ww JOIN wst n ON n.user_key = ww.user_key AND n.start_day = ww.next_start WHERE ww.escalation_day IS NULL),
wf AS (SELECT ww.user_key, start_day, expiry_day, escalation_day, escalation_day IS NOT NULL AS resolved, escalation_day - start_day AS lead,
  (SELECT max(fs) FROM hits h WHERE h.user_key = ww.user_key AND h.day >= ww.start_day AND (ww.escalation_day IS NOT NULL OR h.day <= ww.expiry_day)) AS max_score FROM ww)"""
oracle("watch_windows", f"""
SELECT user_key, start_day, expiry_day, {r('max_score')}, resolved, escalation_day, {b('lead', 'lead_time_days')} FROM wf""", _REC)
oracle("forecast_summary", f"""
SELECT {b('(SELECT count(DISTINCT user_key) FROM wf)', 'total_forecasted_users')}, {b('(SELECT count(*) FROM ld)', 'correct_forecasts')},
  {b('coalesce((SELECT max(lead) FROM ld), 0)', 'best_lead_time_days')}, (SELECT user_key FROM ld ORDER BY lead DESC, user_key LIMIT 1) AS best_lead_time_user,
  (SELECT start_day FROM ld ORDER BY lead DESC, user_key LIMIT 1) AS best_lead_time_first_forecast,
  (SELECT escalation_day FROM ld ORDER BY lead DESC, user_key LIMIT 1) AS best_lead_time_escalation,
  {r('coalesce((SELECT median(lead) FROM ld), 0)', 'median_lead_time_days')},
  {b('coalesce((SELECT max(lead) FROM ew), 0)', 'best_early_warning_lead_days')}, (SELECT user_key FROM ew ORDER BY lead DESC, user_key LIMIT 1) AS best_early_warning_user,
  (SELECT fd FROM ew ORDER BY lead DESC, user_key LIMIT 1) AS best_early_warning_first_forecast,
  (SELECT ed FROM ew ORDER BY lead DESC, user_key LIMIT 1) AS best_early_warning_escalation,
  {r('coalesce((SELECT median(lead) FROM ew), 0)', 'median_early_warning_lead_days')}""", _REC + """,
ld AS (SELECT user_key, lead, start_day, escalation_day FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY lead DESC, start_day) AS rn FROM wf WHERE resolved) WHERE rn = 1),
ew AS (SELECT user_key, fd, ed, ed - fd AS lead FROM (SELECT user_key, min(day) FILTER (forecast_score >= 0.75) AS fd, min(day) FILTER (escalated) AS ed FROM cn GROUP BY user_key) WHERE fd <= ed)""")

# --- evaluation ---------------------------------------------------------------------------

cte("tr", "SELECT user_key, day FROM lb WHERE is_exfil_day")
oracle("severity_breakdown", f"SELECT severity, {b('count(*)', 'n')}, {r('count(*) * 100.0 / (SELECT count(*) FROM cn)', 'pct')} FROM cn GROUP BY severity")
oracle("confusion_by_severity", f"""
SELECT label, {b('alerts')}, {b('tp')}, {b('fp')}, {b('fn')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, {r('fp / nullif(tp, 0)', 'fp_per_tp')}
FROM (SELECT label, (SELECT count(*) FROM cn WHERE sr >= m) AS alerts,
  (SELECT count(*) FROM (SELECT DISTINCT user_key, day FROM cn WHERE sr >= m INTERSECT SELECT user_key, day FROM tr)) AS tp,
  (SELECT count(*) FROM (SELECT DISTINCT user_key, day FROM cn WHERE sr >= m EXCEPT SELECT user_key, day FROM tr)) AS fp,
  (SELECT count(*) FROM (SELECT user_key, day FROM tr EXCEPT SELECT user_key, day FROM cn WHERE sr >= m)) AS fn
  FROM (VALUES ('ALL', 0), ('critical', 3), ('critical+high', 2), ('critical+high+medium', 1)) v(label, m))""")
oracle("user_day_sets", f"""
SELECT {b('(SELECT count(*) FROM (SELECT user_key, day FROM cn INTERSECT SELECT user_key, day FROM tr))', 'both')},
  {b('(SELECT count(*) FROM (SELECT user_key, day FROM cn EXCEPT SELECT user_key, day FROM tr))', 'alert_only')},
  {b('(SELECT count(*) FROM (SELECT user_key, day FROM tr EXCEPT SELECT user_key, day FROM cn))', 'truth_only')}""")
oracle("user_depth", f"""
SELECT user_key, {b('t', 'total_days')}, {b('d', 'detected_days')}, {b('n', 'alerts')}, {r('d / t', 'rate')},
  CASE WHEN d = t THEN 'perfect' WHEN d / t >= 0.8 THEN 'high' WHEN d / t >= 0.5 THEN 'partial' ELSE 'low' END AS depth
FROM (SELECT user_key, count(*) AS t, count(*) FILTER ((user_key, day) IN (SELECT (user_key, day) FROM cn)) AS d FROM tr GROUP BY user_key)
JOIN (SELECT user_key, count(*) AS n FROM cn GROUP BY user_key) USING (user_key)""")
oracle("monthly_counts", f"""
SELECT CAST(month AS DATE) AS month, {b('coalesce(m, 0)', 'malicious')}, {b('coalesce(n, 0)', 'alerts')}
FROM (SELECT date_trunc('month', day) AS month, count(*) AS m FROM tr GROUP BY 1) FULL JOIN (SELECT date_trunc('month', day) AS month, count(*) AS n FROM cn GROUP BY 1) USING (month)""")
cte("an", "SELECT * FROM al WHERE detector = 'anomaly'")
oracle("score_boost_stats", f"""
SELECT {b('count(*)', 'n')}, {r('avg(e_raw)', 'raw_mean')}, {r('min(e_raw)', 'raw_min')}, {r('max(e_raw)', 'raw_max')}, {r('avg(e_boosted)', 'boosted_mean')},
  {r('avg(e_boost)', 'boost_mean')}, {b('count(*) FILTER (e_boost > 0)', 'n_boosted')}, {r('median(e_raw)', 'raw_median')}, {r('median(e_boosted)', 'boosted_median')},
  {r('count(*) FILTER (e_boost > 0) * 100.0 / count(*)', 'pct_boosted')} FROM an""")
oracle("pattern_coverage", " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, {b(f'count(*) FILTER ({c} > 0)', 'n')}, {r(f'count(*) FILTER ({c} > 0) * 100.0 / count(*)', 'pct')} FROM al"
    for p, c in (("wikileaks_days_N", "wl"), ("usb_novel_7d", "usb_nov"), ("usb_total_7d", "usb_total"))))
oracle("z_coverage", f"""
SELECT {b('count(*)', 'n')}, {b('count(*) FILTER (e_zp IS NOT NULL OR e_zr IS NOT NULL OR e_zm IS NOT NULL)', 'n_with_z')}, {b('count(*) FILTER (e_boost <> 0)', 'n_boosted')} FROM an""")
cte("sd", "SELECT toxic AS label, round(n_chars / (SELECT max(n_chars) FROM documents), 6) AS score FROM labels JOIN documents USING (doc_id)")
cte("cu0", "SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM sd GROUP BY score")
cte("cu", """
SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, (SELECT sum(pos) FROM cu0) AS np FROM cu0""")
cte("cu2", "SELECT *, tp / (tp + fp) AS prec, tp / np AS rec FROM cu")
oracle("score_curve", f"SELECT {r('cu2.threshold', 'threshold')}, {b('pos')}, {b('neg')}, {b('tp')}, {b('fp')}, {r('prec', 'precision')}, {r('rec', 'recall')} FROM cu2")
oracle("roc_auc", f"""
SELECT {r('avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)', 'roc_auc')}
FROM (SELECT score FROM sd WHERE label = 1) p, (SELECT score FROM sd WHERE label = 0) n""")
oracle("average_precision", f"SELECT {r('sum(pos / np * prec)', 'average_precision')} FROM cu2")
oracle("precision_at_recall", f"""
SELECT {r('t.target', 'target')}, {r('max(prec)', 'precision')}, {r('first(threshold ORDER BY prec DESC, threshold DESC)', 'threshold')},
  {r('(SELECT prec FROM cu2 ORDER BY threshold LIMIT 1)', 'full_precision')} FROM (VALUES (0.1), (0.2), (0.5), (0.8), (0.9)) t(target) JOIN cu2 ON rec >= t.target GROUP BY t.target""")
oracle("percentile_volume", f"""
SELECT {r('pct')}, {r('c', 'threshold')}, {b('a', 'alerts')}, {b('tp')}, {r('coalesce(tp / nullif(a, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(np, 0), 0)', 'recall')}
FROM (SELECT pct, c, count(*) FILTER (score >= c) AS a, count(*) FILTER (score >= c AND label = 1) AS tp, count(*) FILTER (label = 1) AS np FROM sd,
  (SELECT 90.0 AS pct, quantile_cont(score, 0.9) AS c FROM sd UNION ALL SELECT 95.0, quantile_cont(score, 0.95) FROM sd
   UNION ALL SELECT 99.0, quantile_cont(score, 0.99) FROM sd UNION ALL SELECT 99.5, quantile_cont(score, 0.995) FROM sd) GROUP BY pct, c)""")
oracle("class_report", f"""
SELECT {b('c', 'class')}, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, {b('tp + fn', 'support')}
FROM (SELECT c, count(*) FILTER (label = c AND pr = c) AS tp, count(*) FILTER (label <> c AND pr = c) AS fp, count(*) FILTER (label = c AND pr <> c) AS fn
  FROM (SELECT label, (score >= 0.02)::INT AS pr FROM sd), (VALUES (0), (1)) v(c) GROUP BY c)""")
cte("lt", """
SELECT s.user_key, s.exfil_start, (SELECT min(end_day) FROM sc WHERE sc.user_key = s.user_key AND end_day <= s.exfil_start AND fc >= 0.6) AS first_flag
FROM (SELECT user_key, min(exfil_start) AS exfil_start FROM rg WHERE user_key IN (SELECT user_key FROM sc) GROUP BY user_key) s""")
oracle("lead_times", f"SELECT user_key, exfil_start, first_flag, {b('exfil_start - first_flag', 'lead_time_days')}, first_flag IS NOT NULL AS detected FROM lt")
oracle("lead_time_stats", f"""
SELECT {b('count(*)', 'n_users')}, {b('count(first_flag)', 'n_detected')}, {b('min(exfil_start - first_flag)', 'lead_min')}, {b('max(exfil_start - first_flag)', 'lead_max')},
  {r('avg(exfil_start - first_flag)', 'lead_mean')}, {r('count(first_flag) / count(*)', 'detection_rate')}, {r('median(exfil_start - first_flag)', 'lead_median')} FROM lt""")

# --- quality ------------------------------------------------------------------------------


def _checks(table: str, source: str, columns: list[str]) -> list[str]:
    rules = [("unique_key", "user_key+day", "count(*) - count(DISTINCT (user_key, day))"),
             ("null_key", "user_key", "count(*) FILTER (user_key IS NULL OR user_key = '')"), ("null_key", "day", "count(*) FILTER (day IS NULL)")]
    for c in columns:
        if c.startswith("n_") or "_n_" in c:
            rules.append(("nonnegative", c, f"count(*) FILTER ({c} < 0)"))
        if c.endswith("_rate"):
            rules.append(("rate_bounds", c, f"count(*) FILTER ({c} < 0 OR {c} > 1)"))
            rules.append(("rate_null", c, f"count(*) FILTER ({c} IS NULL)"))
        if c.endswith("is_active_employee_day"):
            rules.append(("flag_01", c, f"count(*) FILTER ({c} NOT IN (0, 1))"))
    return [f"""SELECT '{k}' AS "check", '{table}' AS "table", '{c}' AS "column", {b(x, 'bad')}, {b('count(*)', 'total')} FROM {source}""" for k, c, x in rules]


_must = [(f"{d}_daily", c) for d, cols in _DAILY.items() for c in ("user_key", "day", cols.split()[0], "after_hours_rate", "is_active_employee_day")]
_must += [("email_daily", c) for c in ("n_internal_only", "n_internal_to_external", "n_external_to_internal", "n_external_only")]
_must += [("daily_user", f"{d}_{c}") for d in _DAILY for c in ("after_hours_rate", "is_active_employee_day")]
oracle("quality_report", " UNION ALL ".join(
    _checks("daily_user", "wide", [f"{d}_{c}" for d, cols in _DAILY.items() for c in cols.split()])
    + [q for d, cols in _DAILY.items() for q in _checks(f"{d}_daily", f"d_{d}", cols.split())]
    + [f"SELECT 'required_column', '{t}', '{c}', CAST(0 AS BIGINT), CAST(1 AS BIGINT)" for t, c in _must]
    + [f"SELECT 'min_rows', 'event_users', '*', CAST(count(*) < 1000 AS BIGINT), CAST(count(*) AS BIGINT) FROM people"]))
cte("udk", "SELECT DISTINCT 'u' || user_id AS user_key, CAST(ts AS DATE) AS day FROM events")
oracle("unique_user_days", "SELECT user_key, day FROM udk")
oracle("sliced_days", f"SELECT day, {b('count(*)', 'users')} FROM udk WHERE day >= DATE '2024-01-05' AND day < DATE '2024-01-19' GROUP BY day")
oracle("flagged_days", f"""
SELECT user_key, {b('count(*)', 'days')}, {b('count(*) FILTER (EXISTS (SELECT 1 FROM rg WHERE rg.user_key = udk.user_key AND udk.day BETWEEN exfil_start AND exfil_end))', 'malicious_days')}
FROM udk GROUP BY user_key""")
oracle("shared_pc_preview", f"SELECT pc, {b('m', 'distinct_non_admin_users')}, {r('share', 'top_user_share')}, TRUE AS shared_pc FROM shr JOIN dom USING (pc) ORDER BY m DESC, pc LIMIT 10")
oracle("quality_profile", f"SELECT {b('count(*)', 'rows')}, {b('count(DISTINCT user_key)', 'users')}, min(day) AS min_day, max(day) AS max_day FROM wide")
_OC = "o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice"
_OT = "o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string,o_totalprice:double"
_SIG = "CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)) AS VARCHAR)"
cte("trial", "SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'")
oracle("dataset_diff", f"""
SELECT "check", base, trial, base = trial AS equal FROM (
  SELECT 'rows' AS "check", (SELECT CAST(count(*) AS VARCHAR) FROM orders) AS base, (SELECT CAST(count(*) AS VARCHAR) FROM trial) AS trial
  UNION ALL SELECT 'columns', '{_OC}', '{_OC}' UNION ALL SELECT 'types', '{_OT}', '{_OT}'
  UNION ALL SELECT 'key_signature', (SELECT {_SIG} FROM orders), (SELECT {_SIG} FROM trial))""")

# --- streams ------------------------------------------------------------------------------

oracle("stream_daily", f"""
SELECT user_key, day, {b("count(*) FILTER (domain = 'logon')", 'n_logon')}, {b("count(*) FILTER (domain = 'device')", 'n_device_events')},
  {b("count(*) FILTER (domain = 'file')", 'n_file_events')}, {b("count(*) FILTER (domain = 'http')", 'n_http')}, {b("count(*) FILTER (domain = 'email')", 'n_email_sent')},
  {b("count(DISTINCT pc) FILTER (domain = 'logon')", 'n_pc_used')}, {b("count(*) FILTER (domain = 'device' AND event_id % 2 = 0)", 'n_usb_connects')},
  {b("count(*) FILTER (domain = 'http' AND wiki)", 'n_wikileaks')}, {b('count(*) FILTER (ah)', 'n_after_hours')}, {b('count(*)', 'n_events')}
FROM ev GROUP BY user_key, day""")
oracle("stream_trend", f"""
SELECT user_key, CAST(f AS DATE) AS first_day, CAST(f AS DATE) + 6 AS last_day, {b('count(*)', 'n_events')}, {b('count(*) FILTER (ah)', 'n_after_hours')},
  {b("count(*) FILTER (domain = 'device' AND event_id % 2 = 0)", 'n_usb_connects')}
FROM (SELECT *, unnest(generate_series((day - 6)::TIMESTAMP, day::TIMESTAMP, INTERVAL 1 DAY)) AS f FROM ev) GROUP BY user_key, f""")
oracle("stream_enrich", f"""
SELECT role_id AS role, domain, people.user_key IS NOT NULL AS joined_ldap, CASE WHEN first_seen IS NULL THEN 'not_in_ldap' WHEN event_month > last_seen THEN 'post_departure'
  ELSE 'matched' END AS join_reason, {b('count(*)', 'n')} FROM ev LEFT JOIN people USING (user_key) GROUP BY ALL""")
oracle("stream_rules", f"SELECT user_key, day, reason, {r('ra.score', 'score')} FROM ra")
_REOPEN = """
wo AS (SELECT w.* FROM wst w JOIN (SELECT user_key, min(day) AS start_day FROM hits GROUP BY user_key) USING (user_key, start_day)
  UNION ALL SELECT n.* FROM wo JOIN wst n ON n.user_key = wo.user_key AND n.start_day = wo.next_start)"""
oracle("stream_watch", f"""
SELECT wo.user_key, start_day, expiry_day, {r('(SELECT max(fs) FROM hits h WHERE h.user_key = wo.user_key AND h.day BETWEEN start_day AND expiry_day)', 'max_score')},
  escalation_day IS NOT NULL AS resolved, escalation_day, {b('escalation_day - start_day', 'lead_time_days')}
FROM wo""", _REOPEN)

# --- model steps --------------------------------------------------------------------------

cte("windows_labelled", """
SELECT user_key, day AS end_day, is_exfil_day::INT AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY day) AS rn FROM lb) WHERE rn >= 14""")
oracle("window_labels", f"SELECT user_key, end_day, {b('label')} FROM windows_labelled")
oracle("weighted_train", f"""
SELECT {b('label')}, {r("CASE WHEN label = 1 THEN (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM windows_labelled JOIN sp USING (user_key) WHERE split = 'train') ELSE 1 END", 'weight')},
  {b('count(*)', 'n')} FROM windows_labelled JOIN sp USING (user_key) WHERE split = 'train' GROUP BY label""")
_every = [f"{d}_{c}" for d, cols in _DAILY.items() for c in cols.split()]
_every += "ah_rate_1d ah_rate_trend ah_rate_baseline usb_count_1d usb_count_trend usb_count_baseline ah_novel usb_novel".split()
_stats = ", ".join(
    f"{fn}(coalesce({c}, 0)::DOUBLE) OVER w AS {p}_{c}"
    for p, fn in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")) for c in _every)
cte("normal_windows", f"""
SELECT * EXCLUDE (user_key, end_day, n) FROM (SELECT user_key, day AS end_day, count(*) OVER w AS n, {_stats} FROM feat WINDOW w AS {_W14})
WHERE n = 14 AND user_key NOT IN (SELECT user_key FROM rg) AND user_key IN (SELECT user_key FROM sp WHERE split = 'train')""")
oracle("feature_selection", f"""
SELECT feature, {r('avg(v)', 'mean')}, {r('sqrt(var_pop(v))', 'deviation')}
FROM (UNPIVOT normal_windows ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY feature HAVING var_pop(v) > 0.01""")

cte("path_nodes", "SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {n}, {f}, {c!r}::DOUBLE, {left}, {right}, {v!r}::DOUBLE)" for t, n, f, c, left, right, v in PATH_NODES
) + ") n(tree, node, feature, cut, l, r, value)")
_path_list = ", ".join(PATH_FEATURES)
_path_stats = ", ".join(
    f"{fn}(coalesce({c}, 0)::DOUBLE) OVER w AS {p}_{c}"
    for p, fn in (("mean", "avg"), ("max", "max"), ("std", "stddev_pop")) for c in PATH_INPUTS)
cte("path_rows", f"""
SELECT user_key, end_day, [{_path_list}] AS x FROM (
  SELECT user_key, day AS end_day, count(*) OVER w AS n, {_path_stats} FROM feat WINDOW w AS {_W14}) WHERE n = 14""")
_walk = """walk AS (
  SELECT user_key, end_day, x, tree, 0 AS node FROM path_rows, (SELECT DISTINCT tree FROM path_nodes)
  UNION ALL
  SELECT w.user_key, w.end_day, w.x, w.tree, CASE WHEN w.x[n.feature + 1] < n.cut THEN n.l ELSE n.r END
  FROM walk w JOIN path_nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature >= 0)"""
_leaves = "walk w JOIN path_nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY user_key, end_day"
oracle("forest_path_scores", f"""
SELECT user_key, end_day, {r('avg(value)', 'path')}, {r(f'pow(2.0, -avg(value) / {average_path(PATH_PSI)!r}) - 0.5', 'score')} FROM {_leaves}""", _walk)
oracle("gbt_path_scores", f"""
SELECT user_key, end_day, {r('m', 'margin')}, {r('1 / (1 + exp(-2 * m))', 'score')} FROM (
  SELECT user_key, end_day, sum(CASE WHEN w.tree = 0 THEN value ELSE {PATH_STEP!r} * value END) AS m FROM {_leaves})""", _walk)
cte("flat_cells", " UNION ALL ".join(
    f"SELECT user_key, end_day, {k} + {len(FLAT_COLUMNS)} * (back - 1) AS place, v{k} AS value FROM flat_days"
    for k in range(len(FLAT_COLUMNS))))
_flat_values = ", ".join(f"coalesce(f.{c}, 0)::DOUBLE AS v{k}" for k, c in enumerate(FLAT_COLUMNS))
CTES["flat_days"] = f"""
SELECT w.user_key, w.day AS end_day, f.rn - w.rn + 14 AS back, {_flat_values}
FROM numbered w JOIN numbered f ON f.user_key = w.user_key AND f.rn BETWEEN w.rn - 13 AND w.rn WHERE w.rn >= 14"""
CTES["flat_cells"] = CTES.pop("flat_cells")
oracle("flattened_windows", f"SELECT user_key, end_day, {b('place')}, {r('value')} FROM flat_cells")
oracle("scaled_features", f"""
SELECT user_key, end_day, split, {r('sum(z)', 'total')}, {r('max(z)', 'highest')}, {r('min(z)', 'lowest')} FROM (
  SELECT c.user_key, end_day, sp.split, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END AS z
  FROM flat_cells c JOIN sp USING (user_key) JOIN (
    SELECT place, avg(value) AS m, stddev_samp(value) AS sd FROM flat_cells JOIN sp USING (user_key) WHERE split = 'train' GROUP BY place) USING (place))
GROUP BY user_key, end_day, split""")
oracle("model_bundle_roundtrip", "SELECT user_key, day AS end_day, TRUE AS same FROM numbered WHERE rn >= 14")

# --- files --------------------------------------------------------------------------------

oracle("csv_events_roundtrip", f"""
SELECT user_key, CASE WHEN event_id % 2 = 0 THEN 'logon' ELSE 'logoff' END AS activity, ah AS after_hours, {b('count(*)', 'n')},
  {b('count(DISTINCT pc)', 'machines')} FROM ev WHERE domain = 'logon' GROUP BY ALL""")
ORACLES["stream_csv_events"] = ORACLES["csv_events_roundtrip"] + " UNION ALL SELECT '', 'set aside', FALSE, 0, 1"
oracle("profiles_roundtrip", f"SELECT user_key, day, {b('count(*)', 'n')} FROM ev WHERE domain = 'logon' GROUP BY ALL")
ORACLES["alerts_json_roundtrip"] = ORACLES["raw_alert_scores"]
oracle("daily_scan", f"SELECT user_key, day, {b('http_n_http')} FROM wide WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
oracle("truth_flags", "SELECT p_partkey, p_partkey % 8 < 4 AS flag FROM part")
ORACLES["directory_csv_roundtrip"] = ORACLES["directory_snapshots"]
oracle("insiders_roundtrip", "SELECT user_key, '1' AS scenario, exfil_start AS start, exfil_end AS \"end\" FROM rg")
oracle("truth_file_scan", f"""
SELECT user_key, min(day) AS exfil_start, max(day) AS exfil_end, {b('count(*)', 'n_lines')}
FROM ev JOIN rg USING (user_key) WHERE day BETWEEN exfil_start AND exfil_end AND event_id % 5 <> 0 AND event_id % 7 <> 0 GROUP BY user_key""")
