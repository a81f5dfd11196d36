"""Secret scans with corpus-wide ownership of what was found; DataFrame functions only.

Works on file events: `id`, `user_key` (the owner), `pc` (the machine, as the place where the
content is kept) and `content`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.store import staged

#: Kinds in their order, and their patterns; group 2 of `assign` is the value.
KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
#: What the ownership count may add: long runs of mixed characters.
_BARE = r"[A-Za-z0-9+/_.=-]{20,}"
_SHORTEST_VALUE = 8
#: Values that so many owners have are examples that were copied; so are those of two owners on so many machines.
COPIED_BY = 3
COPIED_TO = 6


def _matches(content: Column, pattern: str, kind: int, value_group: int = 0, shortest: int = 0) -> Column:
    """Leftmost non-overlapping matches in order: array of (kind, number, gap, size, hash).

    `gap` and `size` are the code points before a match, from the last one on, and in it: what
    stands between the matches and the matches themselves are two passes over the content. A
    match that does not count, but takes its place, has no hash.
    """
    parts = F.arrays_zip(
        F.split(content, pattern, -1).alias("gap"), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("found")
    )

    def one(part: Column, number: Column) -> Column:
        value = F.regexp_extract(part["found"], pattern, value_group) if value_group else part["found"]
        counts = _live_looking(value) if KINDS[kind] == "owned" else F.length(value) >= shortest
        return F.struct(
            F.lit(kind).alias("kind"), number.alias("number"), F.length(part["gap"]).alias("gap"),
            F.length(part["found"]).alias("size"), F.when(counts, F.sha2(value, 256)).alias("hash"),
        )

    return F.transform(F.filter(parts, lambda part: part["found"].isNotNull()), one)


def _live_looking(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def _text(spans: Column) -> Column:
    """kind:start:end by start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def secret_candidates(files: DataFrame) -> DataFrame:
    """Matches of every whole content: row, id, user_key, pc, matches; values are kept as hashes only.

    `row` numbers the rows; it is only steady once the result has been written.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    return files.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.col("user_key").cast("string").alias("user_key"), F.col("pc").cast("string").alias("pc"),
        F.concat(
            _matches(content, _ASSIGN, 0, 2, _SHORTEST_VALUE), _matches(content, _ACCESS, 1), _matches(content, _HEX, 2),
            _matches(content, _BARE, 3),
        ).alias("matches"),
    )


def secret_spans(candidates: DataFrame) -> DataFrame:
    """Candidates in place: row, user_key, pc, kind, start, end, hash; bare ones only outside all others.

    Places are running sums along a content's matches, and whether a bare run touches another
    span is told by the last end before it and the next start behind it, so a content costs
    what its matches take to sort.
    """
    each = candidates.where(F.size("matches") > 0).select("row", "user_key", "pc", F.inline("matches"))
    along = Window.partitionBy("row", "kind").orderBy("number")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int"))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).where(F.col("hash").isNotNull())
    bare = F.col("kind") == 3
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    marked = placed.withColumns({
        "last_end": F.max(F.when(~bare, F.col("end"))).over(before),
        "next_start": F.min(F.when(~bare, F.col("start"))).over(behind),
    })
    touched = bare & (F.coalesce(F.col("last_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_start") < F.col("end"), F.lit(False)))
    return marked.where(~touched).select("row", "user_key", "pc", "kind", "start", "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners and machines of each value's hash: hash, n_owners, n_machines.

    Copies are folded in the map tasks first, so a value a third of all contents hold arrives
    as one row per owner, machine and task. A null owner or machine is one of its own.
    """
    places = spans.select("hash", F.struct("user_key").alias("owner"), F.struct("pc").alias("machine")).distinct()
    return places.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("machine").alias("n_machines"))


def scan_secrets(files: DataFrame, copied_by: int = COPIED_BY, copied_to: int = COPIED_TO) -> DataFrame:
    """Secrets in every whole content, told apart by how many owners have the same value.

    Returns id, n_assign, n_access, n_hex, n_owned, n_copied, base_sha256, spans. A value is
    copied about if at least `copied_by` owners have it, or if more than one has it on at least
    `copied_to` machines; one owner's value stays that owner's on however many machines.
    The three base patterns always count; a long run of mixed characters outside them is added,
    as kind `owned`, unless it is copied about. `n_copied` counts base spans with such a value.
    Null content is empty, a null owner or machine is one of its own, repeated rows give repeated
    results, other columns are ignored, no rows give no rows.
    """
    found = staged(secret_candidates(files), "secret-candidates")
    spans = staged(secret_spans(found), "secret-spans")
    owners = staged(ownership(spans), "secret-owners")
    some = found.where(F.size("matches") > 0)
    each = spans.select("row", "kind", "start", "end", "hash").join(owners, "hash")
    # A content's candidates meet again by row; a copied value's rows are split by AQE before.
    about = (F.col("n_owners") >= copied_by) | ((F.col("n_owners") > 1) & (F.col("n_machines") >= copied_to))
    kept = each.where((F.col("kind") < 3) | ~about)
    copied = (F.col("kind") < 3) & about
    judged = kept.groupBy("row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("spans"),
        F.sum(copied.cast("long")).alias("n_copied"),
    )
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rows = some.select("row", "id").join(judged, "row", "left").select(
        "id", F.coalesce("spans", none).alias("spans"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied")
    )
    clean = found.where(F.size("matches") == 0).select("id", none.alias("spans"), F.lit(0).cast("long").alias("n_copied"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return rows.unionByName(clean).select(
        "id", count(0), count(1), count(2), count(3), "n_copied",
        F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"),
    )
