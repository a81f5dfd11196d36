"""Per-user state: the last rows of a user for the rules, the open watch window.

Days may arrive in any order: a user's days wait in state until the watermark has passed them
and are then judged in order, so batches give what one batch would. What arrives later than the
watermark allows is left out by Spark and counted in the query's progress
(`numRowsDroppedByWatermark`). State per user is bounded: fourteen rows, or one window, and the
days within the watermark's delay.

Users are dealt into `groups` by a hash, and the state of a group's users is one value, which comes
to Python and goes back with their rows: what a call costs is shared by them, and no day, value or
timer is a call to the state store. Choose about a hundred users to a group (`groups_for`); the
number is part of a stream's state and stays as long as its checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.operators.rules import CASE_SCORES, CHAIN, CHAIN_POST, NEAR_MISS, RuleParams
from vigil.operators.watch import WATCH_SCHEMA, Watch, advance, watch_frame
from vigil.session import ROCKSDB

# What the rules need of a user-day.
RULE_DAY = "day date, ah_sig boolean, usb bigint, leak bigint, ah_novel int, usb_novel int, post double"
RULE_FIELDS = tuple(part.split()[0] for part in RULE_DAY.split(", "))
# What a day can do to a watch.
WATCH_DAY = "day date, hit_score double, escalated boolean, escalated_after_hit boolean"
WATCH_FIELDS = tuple(part.split()[0] for part in WATCH_DAY.split(", "))
RULE_OUT = "user_key string, day date, reason string, score double"


def use_state_store(spark) -> None:
    """State that may outgrow the memory of its executor: the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_day_time(days: DataFrame, delay: str = "2 days") -> DataFrame:
    """`days` with the event time that the processors wait by; `delay` is how late a day may come."""
    return days.withColumn("ts", F.col("day").cast("timestamp")).withWatermark("ts", delay)


def end_of_input(days: DataFrame, after: int) -> DataFrame:
    """One row of no user, `after` days behind the last one: it moves the watermark past all days."""
    last = days.agg(F.date_add(F.max("day"), after).alias("day")).where(F.col("day").isNotNull())
    return last.select(*[
        F.col("day") if f.name == "day" else F.lit("" if f.name == "user_key" else None).cast(f.dataType).alias(f.name)
        for f in days.schema.fields
    ])


_KINDS = {"bigint": int, "int": int, "double": float, "boolean": bool}


#: Users whose state is one value, on average, where `groups_for` deals them.
USERS_A_GROUP = 100


def groups_for(users: DataFrame) -> int:
    """How many groups the users of `users` are dealt into."""
    n = users.agg(F.approx_count_distinct("user_key").alias("n")).first()["n"]
    return max(1, -(-n // USERS_A_GROUP))


def _grouped(days: DataFrame, fields: tuple[str, ...], groups: int):
    dealt = F.pmod(F.xxhash64("user_key"), F.lit(groups)).alias("group")
    return days.select("user_key", *fields, "ts", dealt).groupBy("group")


def _packed(schema: str) -> str:
    """The type of the users' days in state; days are kept as numbers."""
    parts = [part.split() for part in schema.split(", ")]
    fields = ", ".join(f"{name}: {'int' if kind == 'date' else kind}" for name, kind in parts)
    return f"array<struct<user_key: string, {fields}>>"


def _pack(users: dict[str, list[tuple]]) -> list[tuple]:
    return [(user, row[0].toordinal(), *row[1:]) for user, rows in users.items() for row in rows]


def _unpack(kept: Iterable[tuple]) -> dict[str, list[tuple]]:
    users: dict[str, list[tuple]] = {}
    for user, day, *values in kept:
        users.setdefault(user, []).append((dt.date.fromordinal(day), *values))
    return users


class _Waiting:
    """Days of a group's users that the watermark has not passed, by user and day.

    A day that comes more than once counts once: of its rows the greatest, field by field with
    nulls first, whatever the order of arrival.
    """

    def __init__(self, schema: str, kept: Iterable[tuple]):
        self.fields, kinds = zip(*(part.split() for part in schema.split(", ")))
        self.kinds = [_KINDS[k] for k in kinds[1:]]
        self.users = {user: {day: tuple(values) for day, *values in rows} for user, rows in _unpack(kept).items()}

    def add(self, rows: Iterable[pd.DataFrame]) -> None:
        for pdf in rows:
            for user, day, *values in zip(pdf["user_key"].tolist(), *(pdf[f].tolist() for f in self.fields)):
                # Pandas holds whole numbers beside nulls as floats, and nulls as NaN.
                values = tuple(None if x is None or x != x else kind(x) for kind, x in zip(self.kinds, values))
                days = self.users.setdefault(user, {})
                if day not in days or _order(values) > _order(days[day]):
                    days[day] = values

    def due(self, watermark: int) -> dict[str, list[tuple]]:
        """Takes out the days that are over, by user and in order."""
        last = dt.date(1970, 1, 1) + dt.timedelta(milliseconds=watermark) - dt.timedelta(days=1)
        out = {}
        for user, days in self.users.items():
            over = sorted(d for d in days if d <= last)
            if over:
                out[user] = [(day, *days.pop(day)) for day in over]
        self.users = {user: days for user, days in self.users.items() if days}
        return out

    def first(self) -> list[dt.date]:
        """The first day that waits, if any."""
        return [min(min(days) for days in self.users.values())] if self.users else []

    def packed(self) -> list[tuple]:
        return _pack({user: [(day, *values) for day, values in days.items()] for user, days in self.users.items()})


def _wake(state: GroupState, days: Iterable[dt.date], watermark: int) -> None:
    """The state is looked at again as soon as the watermark has reached the end of the first of `days`."""
    first = min(days, default=None)
    if first is not None:
        end = _millis(first + dt.timedelta(days=1))
        state.setTimeoutTimestamp(max(end - 1, watermark + 1))


def _order(values: tuple) -> tuple:
    return tuple((x is not None, x) if x is not None else (False, 0) for x in values)


def rule_days(measures: DataFrame) -> DataFrame:
    """The rule's inputs from user-days that carry `ah_sig` and the novelty flags."""
    post = F.lit(0.0)
    for c in measures.columns:
        if c.endswith("_n_events_post_departure"):
            post = post + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return measures.select(
        "user_key", "day", "ah_sig",
        F.coalesce(F.col("device_n_usb_connects"), F.lit(0)).cast("bigint").alias("usb"),
        F.coalesce(F.col("http_n_wikileaks"), F.lit(0)).cast("bigint").alias("leak"),
        F.col("ah_novel").cast("int"), F.col("usb_novel").cast("int"), post.alias("post"),
    )


def rule_of_week(rows: list[tuple], params: RuleParams) -> str | None:
    """The case that holds on the last of a user's rows, as `operators.rules` defines it."""
    today = rows[-1]
    first = today[0] - dt.timedelta(days=params.days - 1)
    week = [row for row in rows if row[0] >= first]
    ah = sum(row[1] for row in week)
    usb_days = sum(row[2] > 0 for row in week)
    both = sum(row[1] and row[2] > 0 for row in week)
    strong = both > 0 or (ah >= 2 and usb_days >= 2)
    novel = sum(row[4] for row in week) > 0 and sum(row[5] for row in week) > 0
    if len(week) < params.min_days or not (strong and novel):
        return None
    if today[3] > 0:
        return CHAIN_POST if today[6] > 0 else CHAIN
    if sum(row[2] for row in week) >= params.near_miss_usb and today[2] > 0:
        return NEAR_MISS
    return None


def judge_rules(params: RuleParams):
    """Keeps the users' last rows and evaluates the rules on each day that is over."""
    scores = dict(CASE_SCORES)

    def judge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, waits = state.get if state.exists else ([], [])
        waiting, kept, out = _Waiting(RULE_DAY, waits), _unpack(was), []
        if not state.hasTimedOut:
            waiting.add(rows)
        watermark = state.getCurrentWatermarkMs()
        for user, due in waiting.due(watermark).items():
            mine = kept.get(user, [])
            for row in due:
                row = (row[0], bool(row[1]), *(int(x or 0) for x in row[2:6]), float(row[6] or 0.0))
                mine = [*mine, row][-params.window_rows :]
                case = rule_of_week(mine, params)
                if case:
                    out.append((user, row[0], f"rules:{case}", scores[case]))
            kept[user] = mine
        state.update((_pack(kept), waiting.packed()))
        _wake(state, waiting.first(), watermark)
        if out:
            yield pd.DataFrame(out, columns=["user_key", "day", "reason", "score"])

    return judge


def stream_rules(days: DataFrame, params: RuleParams = RuleParams(), groups: int = 1024) -> DataFrame:
    """Rule alerts from a stream of `rule_days` with a watermarked `ts` (`with_day_time`)."""
    state = f"kept {_packed(RULE_DAY)}, waiting {_packed(RULE_DAY)}"
    return _grouped(days, RULE_FIELDS, groups).applyInPandasWithState(
        judge_rules(params), RULE_OUT, state, "append", GroupStateTimeout.EventTimeTimeout
    )


def judge_watches(horizon: int, reopen: bool):
    """The open watch windows of the users; a window is emitted when it closes.

    The group is looked at again at the first expiry, which closes windows of users who fall silent.
    """

    def judge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, waits = state.get if state.exists else ([], [])
        waiting, done = _Waiting(WATCH_DAY, waits), []
        if not state.hasTimedOut:
            waiting.add(rows)
        date = dt.date.fromordinal
        watches = {
            user: Watch(date(start), date(expiry), score, None if escalation is None else date(escalation))
            for user, start, expiry, score, escalation in opened
        }
        now = state.getCurrentWatermarkMs()
        for user, due in waiting.due(now).items():
            watch = watches.pop(user, None)
            for day, hit, escalated, after in due:
                watch, closed = advance(watch, day, hit, bool(escalated), bool(after), horizon, reopen)
                if closed is not None:
                    done.append(closed.row(user))
            if watch is not None:
                watches[user] = watch
        ends = waiting.first()
        for user, watch in list(watches.items()):
            if _millis(watch.expiry + dt.timedelta(days=1)) > now:
                ends.append(watch.expiry)
            elif watch.escalation is None or reopen:
                done.append(watches.pop(user).row(user))
        still = [
            (user, w.start.toordinal(), w.expiry.toordinal(), w.max_score, None if w.escalation is None else w.escalation.toordinal())
            for user, w in watches.items()
        ]
        if still or waiting.users:
            state.update((still, waiting.packed()))
            _wake(state, ends, now)
        elif state.exists:
            state.remove()
        if done:
            yield watch_frame(done)

    return judge


def _millis(day: dt.date) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp() * 1000)


def stream_watch(days: DataFrame, horizon: int = 7, reopen: bool = True, groups: int = 1024) -> DataFrame:
    """Watch windows from a stream of `watch_days` rows with a watermarked `ts`.

    A stream must let go of a window some day, so a resolved one closes at its expiry here.
    """
    opened = "array<struct<user_key: string, start: int, expiry: int, max_score: double, escalation: int>>"
    state = f"opened {opened}, waiting {_packed(WATCH_DAY)}"
    return _grouped(days, WATCH_FIELDS, groups).applyInPandasWithState(
        judge_watches(horizon, reopen), WATCH_SCHEMA, state, "append", GroupStateTimeout.EventTimeTimeout
    )
