"""Mixing activity domains to target weights by repeating and dropping whole contents.

Works on the library's events: `id`, `domain` (logon, file, http, email ...) and `content`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.store import staged
from vigil.operators.ordering import running_totals

#: The weights that domains get in turn.
WEIGHTS = (1, 2, 3)
#: A domain is taken this many times at most.
MOST = 3
OUTPUTS = ("n_words", "domain_words", "target", "copies", "words_taken")


def word_count(content: Column) -> Column:
    """Number of runs of other than white space, 0 for null."""
    return F.coalesce(F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(domains: DataFrame) -> DataFrame:
    """Adds `place`, from 0, by code point and null last, without one task seeing all domains."""
    unknown = F.col("domain").isNull()
    dealt = staged(
        domains.repartitionByRange(unknown, "domain").withColumn("slot", F.spark_partition_id()), "mix-domains"
    )
    # One row per range partition meets in one task.
    before = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("slot").orderBy(unknown, "domain")
    place = F.col("offset") + F.row_number().over(inside) - 1
    return dealt.join(offsets, "slot").select("domain", "domain_words", place.alias("place"))


def domain_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target words of each domain: (domain, domain_words, target).

    `sizes` has `domain` and `n_words`. Domains get the weights in turn and share the sum of
    all words; none gets more than `most` times its own, and what that leaves over is shared
    anew by weight. The level at which the rest stands is found from running totals over
    cap / weight: a domain is full if pouring to its own brim takes no more than there is.
    No rows give no rows; a domain without words has the target 0.
    """
    totals = staged(sizes.groupBy("domain").agg(F.sum("n_words").alias("domain_words")), "mix-totals")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("domain_words") * most
    weighed = staged(
        _numbered(totals).select(
            "domain", "domain_words", weight.cast("long").alias("weight"), (cap / weight).alias("brim")
        ),
        "mix-weights",
    )
    levels = running_totals(weighed, "brim", {"cap": F.sum(cap), "weight": F.sum("weight")})
    total = weighed.agg(F.sum("domain_words").alias("words"), F.sum("weight").alias("weight")).first()
    words, weights_all = total["words"] or 0, total["weight"] or 0
    full = F.col("cum_cap") + F.col("brim") * (F.lit(weights_all) - F.col("cum_weight")) <= words
    level = levels.where(full).agg(
        F.sum("cap").alias("held"), F.sum("weight").alias("done"), F.max("brim").alias("brim")
    ).first()
    left, open_weight = words - (level["held"] or 0), weights_all - (level["done"] or 0)
    rate = float(left) / float(open_weight) if open_weight else 0.0
    capped = F.col("brim") <= F.lit(-1.0 if level["brim"] is None else level["brim"])
    target = F.when(capped, cap.cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("domain", "domain_words", target.alias("target"))


def chance(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def mix_domains(
    events: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix-1"
) -> DataFrame:
    """`events` with how often the mix takes each: n_words, domain_words, target, copies, words_taken.

    A domain's rate is its target over its words. An event is taken floor(rate) times, and
    once more if the hash of seed and `id` falls below the fraction, so reruns agree whatever
    the partitioning. Null content has no words; a null domain is a domain of its own, the
    last; rows that repeat are drawn alike; columns that bear an output's name are replaced.
    The few-rows table of targets is joined to the events, and AQE splits a hot domain where
    that table is too large to broadcast.
    """
    measured = events.drop(*OUTPUTS).withColumn("n_words", word_count(F.col("content")))
    targets = staged(domain_targets(measured.select("domain", "n_words"), weights, most), "mix-targets").alias("t")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("domain_words").cast("double")), F.lit(0.0))
    extra = (chance(seed, F.col("id")) < rate - F.floor(rate)).cast("long")
    mixed = measured.alias("e").join(targets, F.col("e.domain").eqNullSafe(F.col("t.domain"))).drop(F.col("t.domain"))
    mixed = mixed.withColumn("copies", F.floor(rate) + extra)
    return mixed.withColumn("words_taken", F.col("n_words") * F.col("copies"))


def taken_events(mixed: DataFrame) -> DataFrame:
    """Each event as many times as the mix takes it, without the mix's own columns."""
    repeated = mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.drop(*OUTPUTS)
