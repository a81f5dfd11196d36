"""Trends, baselines, novelty and fixed-length windows per user.

Every frame here is over user-day rows: a user has at most one row per calendar day, so one
group is bounded by the length of the history, whatever the number of raw events.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions.scoring import clip

DAY_NUMBER = "unix_date(day)"


def by_user():
    """Users in calendar order; the order key is the day number, so ranges count days."""
    return Window.partitionBy("user_key").orderBy(F.expr(DAY_NUMBER))


def last_days(n: int):
    """The `n` calendar days that end today."""
    return by_user().rangeBetween(-(n - 1), 0)


def last_rows(n: int):
    """The `n` active days that end today."""
    return by_user().rowsBetween(-(n - 1), 0)


def _sum(value: Column, first: int, last: int) -> Column:
    return F.sum(value).over(by_user().rangeBetween(-first, -last))


def add_rolling(
    daily: DataFrame,
    trend_days: int = 7,
    baseline_days: int = 30,
    compat: bool = True,
    eps: float = 1e-6,
) -> DataFrame:
    """Append trend, baseline and novelty of the after-hours rate and the USB count.

    Calendar days without a row count as zero from the user's first day on. With `compat`
    the trend spans `trend_days` + 1 days, and the baseline is the difference of two means
    whose history may be shorter than their nominal length. Without it the trend spans
    `trend_days` and the baseline is the mean of the days before those.
    """
    t, long = trend_days, trend_days + baseline_days
    rate, usb = F.col("ah_rate_1d"), F.col("usb_count_1d")
    seen = F.expr(DAY_NUMBER) - F.min(F.expr(DAY_NUMBER)).over(Window.partitionBy("user_key")) + 1
    zero = F.lit(0.0)
    reach = t if compat else t - 1
    n = F.col("__n")
    df = daily.withColumn("__n", seen)
    trend = _sum(rate, reach, 0) / F.least(F.lit(reach + 1), n)
    if compat:
        all_prior = F.coalesce(_sum(rate, long, 1), zero)
        recent = F.coalesce(_sum(rate, t, 1), zero)
        level = (
            long * all_prior / F.least(F.lit(long), n - 1) - t * recent / F.least(F.lit(t), n - 1)
        ) / baseline_days
        baseline = F.when(n > 1, clip(level, 0.0, 1.0))
    else:
        days = F.least(F.lit(baseline_days), n - t - 1)
        baseline = F.when(days > 0, F.coalesce(_sum(rate, long, t + 1), zero) / days)
    usb_base = F.when(n > 1, F.coalesce(_sum(usb, long, t + 1), F.lit(0)))
    df = df.withColumns(
        {
            "ah_rate_trend": clip(trend, 0.0, 1.0),
            "ah_rate_baseline": baseline,
            "usb_count_trend": _sum(usb, reach, 0).cast("double"),
            "usb_count_baseline": usb_base.cast("double"),
        }
    )
    return novelty(df, eps).drop("__n")


def novelty(daily: DataFrame, eps: float = 1e-6) -> DataFrame:
    """`ah_novel` and `usb_novel`: the trend exceeds the baseline, an unknown one being zero."""
    zero = F.lit(0.0)
    rate = F.col("ah_rate_trend") > F.coalesce(F.col("ah_rate_baseline"), zero) + eps
    usb = F.col("usb_count_trend") > F.coalesce(F.col("usb_count_baseline"), zero)
    return daily.withColumns({"ah_novel": rate.cast("int"), "usb_novel": usb.cast("int")})


def densify(daily: DataFrame, measures: Sequence[str]) -> DataFrame:
    """A row for every calendar day between a user's first and last, zeros in the gaps.

    The rolling columns do not need it. Each row fills the gap up to the user's next one, so
    no list of days per user is built and no join is needed.
    """
    linked = daily.withColumn("__next", F.lead("day").over(by_user()))
    gap = F.sequence(F.col("day"), F.coalesce(F.date_sub("__next", 1), F.col("day")))
    filled = linked.select("user_key", F.col("day").alias("__row"), F.explode(gap).alias("day"), *measures)
    real = F.col("day") == F.col("__row")
    return filled.select(
        "user_key", "day",
        *[F.when(real, F.coalesce(F.col(m), F.lit(0))).otherwise(F.lit(0)).alias(m) for m in measures],
    )


def windows(
    daily: DataFrame, columns: Sequence[str], n: int = 14, label: str | None = None
) -> DataFrame:
    """The last `n` active days of each user-day as an array of structs; full windows only."""
    frame = last_rows(n)
    row = F.struct("day", *columns)
    out = daily.select(
        "user_key",
        F.col("day").alias("end_day"),
        *([F.col(label).alias("label")] if label else []),
        F.collect_list(row).over(frame).alias("window"),
    )
    return out.where(F.size("window") == n)


def import_windows(df: DataFrame, columns: Sequence[str], text: str = "window_json") -> DataFrame:
    """Windows that come as JSON text: parsed and ordered by day."""
    fields = ", ".join(["day date", *[f"{c} double" for c in columns]])
    parsed = F.array_sort(F.from_json(F.col(text), f"array<struct<{fields}>>"))
    return df.withColumn("window", parsed).drop(text)


def calendar_window(daily: DataFrame, keys: DataFrame, days: int = 14) -> DataFrame:
    """The rows of the `days` calendar days up to each (user_key, end_day) of `keys`."""
    first = F.date_sub(F.col("end_day"), days - 1)
    side = keys.select(F.col("user_key").alias("__user"), "end_day")
    match = (F.col("user_key") == F.col("__user")) & F.col("day").between(first, F.col("end_day"))
    return daily.join(side, match).drop("__user")


def calendar_measures(daily: DataFrame, measures: dict[str, Column], days: int = 14) -> DataFrame:
    """Aggregates over the calendar window of every user-day, without pairing rows."""
    frame = last_days(days)
    return daily.select("user_key", "day", *[agg.over(frame).alias(n) for n, agg in measures.items()])


def window_features(daily: DataFrame, columns: Sequence[str], n: int = 14) -> DataFrame:
    """Mean, maximum and population deviation of each column over full `n`-row windows.

    A sliding frame updates each aggregate `n` times for every row, which is slow with three
    aggregates of fifty columns. So Spark orders the rows by user and day, and all windows of a
    batch are summed at once, a day after the other as an aggregate does.
    """
    cells = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    ordered = number_history(daily).select("user_key", "day", "rn", cells.alias("cells"))
    key, day = (ordered.schema[c].dataType.simpleString() for c in ("user_key", "day"))
    kinds = ("mean", "max", "std")
    schema = f"user_key {key}, end_day {day}, " + ", ".join(f"{kind} array<double>" for kind in kinds)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = np.zeros((n - 1, len(columns))), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rn = batch.column("rn").to_numpy()
            if np.any((rn != 1) & (rn != np.concatenate(([last], rn[:-1])) + 1)):
                raise ValueError("rows of a user are not in order")
            line = np.concatenate([before, batch.column("cells").flatten().to_numpy().reshape(len(rn), len(columns))])
            before, last = line[len(rn):], rn[-1]
            full = np.flatnonzero(rn >= n)
            keys = [batch.column(c).take(pa.array(full)) for c in ("user_key", "day")]
            ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * len(columns))
            measures = [pa.ListArray.from_arrays(ends, pa.array(m[full].ravel())) for m in slide_measures(line, n)]
            yield pa.RecordBatch.from_arrays([*keys, *measures], ["user_key", "end_day", *kinds])

    named = [F.col(kind)[i].alias(f"{kind}_{c}") for kind in kinds for i, c in enumerate(columns)]
    return ordered.mapInArrow(slide, schema).select("user_key", "end_day", *named)


def slide_measures(line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, maximum and population deviation of each `n` rows of `line` that follow each other.

    The operations and their order are those of Spark's aggregates, so results are the same to the last bit.
    """
    size = len(line) - n + 1
    total, mean, square = np.zeros((3, size, line.shape[1]))
    high = line[:size].copy()
    for k in range(n):
        x = line[k:k + size]
        total += x
        np.maximum(high, x, out=high)
        delta = x - mean
        step = delta / (k + 1)
        mean += step
        square += delta * (delta - step)
    return total / n, high, np.sqrt(square / n)


def number_history(days: DataFrame) -> DataFrame:
    return days.withColumn("rn", F.row_number().over(by_user()))


def recent_days(alerts: DataFrame, n: int) -> DataFrame:
    """The `n` most recent days that have rows."""
    return alerts.select("day").distinct().orderBy(F.col("day").desc()).limit(n)
