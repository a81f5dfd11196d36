"""Chat formatting of mail threads: one training example per reply, with all turns before it.

A thread is a set of rows `id` (of the thread), `timestamp` (the turn's place), `activity` (who
speaks) and `content`. Turns are marked by the control strings below; the same strings inside a
text are escaped, reversibly, so markers can always be told from what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
CONTROL = ("[INST]", "[/INST]", "[:]", "<s>", "</s>")
_SPLIT = r"(\[|<)(INST\]|/INST\]|:\]|s>|/s>)"
_TURN = r"(?s)(?:\[INST\]|<s>)(.*?)(?:\[/INST\]|</s>)"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _SPLIT, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_threads(mails: DataFrame, reply: str = "assistant") -> DataFrame:
    """One row per example: id, example, formatted, mask_start, mask_end, last.

    Every turn whose `activity` is `reply` becomes an example of its own: all turns up to it,
    in order of `timestamp`, and only its text trainable, as the code points
    [mask_start, mask_end) of `formatted`. Turns after the last reply form a row without a
    mask. `last` marks the row that holds the whole thread up to the last reply, and that rest.
    Null contents and activities are empty; equal timestamps are ordered by activity and
    content; rows that repeat are turns of their own; other columns are ignored; no rows give
    no rows. A thread has to fit into a task, since its last example holds it whole, and the
    examples of a thread grow with the square of its turns.
    """
    replied = F.coalesce(F.col("activity") == reply, F.lit(False))
    body = escape(F.col("content"))
    head = F.concat(escape(F.col("activity")), F.lit("[:]"))
    turn = F.when(replied, F.concat(F.lit("<s>"), head, body, F.lit("</s>")))
    turn = turn.otherwise(F.concat(F.lit("[INST]"), head, body, F.lit("[/INST]")))
    rows = mails.select(
        "id",
        F.struct(
            F.col("timestamp"), F.coalesce("activity", F.lit("")).alias("activity"),
            F.coalesce("content", F.lit("")).alias("content"),
            turn.alias("turn"), replied.alias("replied"), F.length(body).alias("chars"),
        ).alias("t"),
    )
    order = F.sort_array(F.collect_list("t"))
    slim = F.transform(order, lambda t: F.struct(t["turn"].alias("turn"), t["replied"].alias("replied"), t["chars"].alias("chars")))
    threads = rows.groupBy("id").agg(slim.alias("turns"))
    places = F.sequence(F.lit(1), F.size("turns"))
    ends = F.filter(places, lambda i: F.element_at("turns", i)["replied"])
    threads = threads.withColumn("ends", ends).withColumn(
        "final", F.coalesce(F.array_max("ends"), F.lit(0))
    )
    # An example ends at a reply; the rest, if any, is what begins behind the last one.
    cuts = F.concat(
        F.transform(F.col("ends"), lambda i: F.struct(F.lit(1).alias("from"), i.alias("to"))),
        F.when(
            F.col("final") < F.size("turns"),
            F.array(F.struct((F.col("final") + 1).alias("from"), F.size("turns").alias("to"))),
        ).otherwise(F.array()),
    )
    cut = threads.select("id", "turns", "final", F.posexplode(cuts).alias("example", "cut"))
    part = F.slice("turns", F.col("cut.from"), F.col("cut.to") - F.col("cut.from") + 1)
    target = F.element_at("turns", F.col("cut.to"))
    cut = cut.select(
        "id", "example", F.array_join(F.transform(part, lambda t: t["turn"]), "").alias("formatted"),
        (F.col("cut.to") <= F.col("final")).alias("trains"), (F.col("cut.to") >= F.col("final")).alias("last"),
        target["chars"].alias("chars"),
    )
    mask_end = F.length("formatted") - len("</s>")
    return cut.select(
        "id", "example", "formatted",
        F.when(F.col("trains"), mask_end - F.col("chars")).alias("mask_start"),
        F.when(F.col("trains"), mask_end).alias("mask_end"),
        "last",
    )


def read_threads(examples: DataFrame) -> DataFrame:
    """Threads read back from their examples: id, turns, trained, formatted_chars.

    `turns` is the array of (activity, content) of the whole thread, `trained` the array of the
    texts under the masks, both unescaped and in order. Of all examples of a thread only the
    longest one and the rest are brought together whole.
    """
    masked = F.substring(F.col("formatted"), F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start"))
    rows = examples.select(
        "id", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.struct("example", F.col("formatted").alias("text"))).alias("whole"),
        F.when(F.col("mask_start").isNotNull(), F.struct("example", masked.alias("text"))).alias("loss"),
    )
    threads = rows.groupBy("id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("whole")).alias("whole"),
        F.sort_array(F.collect_list("loss")).alias("loss"),
    )
    text = F.array_join(F.transform("whole", lambda w: w["text"]), "")
    found = F.regexp_extract_all(text, F.lit(_TURN), F.lit(1))

    def parsed(turn: Column) -> Column:
        name = F.substring_index(turn, "[:]", 1)
        said = F.substring(turn, F.length(name) + 4, F.length(turn))
        return F.struct(unescape(name).alias("activity"), unescape(said).alias("content"))

    return threads.select(
        "id", F.transform(found, parsed).alias("turns"),
        F.transform("loss", lambda x: unescape(x["text"])).alias("trained"), "formatted_chars",
    )
