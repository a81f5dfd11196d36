"""N-gram Jaccard join of event contents by parity sketches.

Each distinct set of word shingles is hashed into a bit sketch in which a shingle flips one
bit, so the Hamming distance of two sketches never exceeds the size of the sets' symmetric
difference, and a similarity of at least t bounds that difference by a share of the sizes.
A sketch is cut into parts; with more parts than that bound, two similar sets agree in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import bitmap
from vigil.llm.components import components
from vigil.llm.store import staged
from vigil.llm.words import CHUNK, Words, mix, signed, split_words, windows

_U = np.uint64
#: Whom the sets of a part are tested against, turn by turn.
TURNS = ("leader", "nearest", "all")
#: Sets of a part whose pairs are listed.
FEW = 16
#: Sets of a block, on average, where sets of a part are tested against each other.
TILE = 2048
#: Parts of a band for each shingle in which its largest sets can differ.
SPARE = 1.22
#: Shingles that a part needs at most to be keyed.
FULLEST = 4
_SKETCH = "id {id}, n int, set_key long, sketch binary, part_keys array<long>"


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, by row and hash.

    A row with fewer words has its whole sequence as its one shingle.
    """
    hashes = words.hashes()
    at, value = windows(words, hashes, size)
    rows, values = [words.row_of[at]], [value]
    counts = np.diff(words.first)
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        value = np.zeros(len(short), dtype=np.uint64)
        for k in range(length):
            value = value * _U(0xD6E8FEB86659FD93) + hashes[words.first[short] + k]
        rows.append(short)
        values.append(mix(value, 100 + length))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, dtype=np.uint64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit key per set of shingles; equal sets have equal keys."""
    size = np.diff(first).astype(np.uint64)
    return mix(_sums(mix(value, 7), first) ^ mix(_sums(mix(value, 8), first) + size, 9))


def _level(n: np.ndarray) -> np.ndarray:
    """Band of a size; bands grow by the root of two."""
    return np.floor(2 * np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64)


def part_keys(row: np.ndarray, value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) under which similar sets are sure to meet.

    A pair meets in the band of the larger set: a set is keyed in its own band and in those
    above where a similar set could lie. A band has a fixed number of parts, more than the
    `bound` of shingles in which a pair can differ, so some part is the same in both.

    Parts with few shingles are those that strangers share, so a set leaves them out as far as
    it can: it is keyed by its parts of at least k shingles, with the largest k (`FULLEST` at
    most) for which these are more than `bound`. Of two similar sets, take the one with the
    larger k: one of its keyed parts is the same in the other, which has the smaller k and so
    is keyed by it too.
    """
    largest = 100 * n // percent
    bound = (n + largest) * (100 - percent) // (100 + percent)
    slope = (1 + 100 / percent) * (100 - percent) / (100 + percent) * SPARE
    flips = mix(value, 9)
    out_row, out_key = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    low, high = _level(n), _level(largest)
    for step in range(int((high - low).max(initial=0)) + 1):
        level = low + step
        active = (bound > 0) & (level <= high)
        take = active[row]
        if not take.any():
            continue
        r, v = row[take], value[take]
        parts = np.ceil(np.ceil(2.0 ** ((level + 1) / 2)) * slope).astype(np.uint64) + _U(1)
        part = ((v >> _U(32)) * parts[r]) >> _U(32)
        begin = np.ones(len(r), dtype=bool)
        begin[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(begin)
        run_row, run_part, held = r[begin], part[begin], np.diff(np.append(begin, len(r)))
        parity = np.bitwise_xor.reduceat(flips[take], begin)
        least = np.zeros(len(n), dtype=np.int64)
        for k in range(1, FULLEST + 1):
            least[np.bincount(run_row[held >= k], minlength=len(n)) > bound] = k
        keep = held >= least[run_row]
        band = level.astype(np.uint64) << _U(32)
        out_row.append(run_row[keep])
        out_key.append(mix(parity[keep] ^ mix(band[run_row[keep]] | run_part[keep], 11), 12))
        for i in np.flatnonzero(active & (least == 0) & (n > 0)):
            empty = np.setdiff1d(np.arange(int(parts[i]), dtype=np.uint64), run_part[run_row == i])
            out_row.append(np.full(len(empty), i))
            out_key.append(mix(mix(band[i] | empty, 11), 12))
    out_row, out_key = np.concatenate(out_row), np.concatenate(out_key)
    order = np.argsort(out_row, kind="stable")
    return out_row[order], out_key[order]


def parity_bits(row: np.ndarray, value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of each row's sketch: 2 ** k bits, four for each shingle of its largest match or more."""
    bits = np.left_shift(1, np.maximum(3, np.frexp((100 * n // percent).astype(np.float64))[1] + 2))
    bits[n == 0] = 0
    bounds = np.concatenate([[0], np.cumsum(bits)])
    at = bounds[row] + (mix(value, 13) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=bounds[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little"), bounds // 8


def _sketches(size: int, percent: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column(1), fold=True):
                row, value = shingles(words, size)
                n = np.bincount(row, minlength=words.rows)
                first = np.concatenate([[0], np.cumsum(n)])
                data, bounds = parity_bits(row, value, n, percent)
                key_row, keys = part_keys(row, value, n, percent)
                key_first = np.concatenate([[0], np.cumsum(np.bincount(key_row, minlength=words.rows))])
                yield pa.record_batch(
                    [
                        batch.column(0).slice(words.row, words.rows),
                        pa.array(n, pa.int32()),
                        pa.array(signed(set_keys(value, first)), mask=n == 0),
                        pa.Array.from_buffers(pa.binary(), words.rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]),
                        pa.ListArray.from_arrays(pa.array(key_first, pa.int32()), pa.array(signed(keys), pa.int64())),
                    ],
                    names=names,
                )

    return run


def sketch_contents(mails: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, set_key, sketch, part_keys) of every whole content, case of A-Z ignored."""
    kind = mails.schema["id"].dataType.simpleString()
    schema = _SKETCH.format(id=kind)
    names = [part.split()[0] for part in schema.split(", ")]
    return mails.select("id", "content").mapInArrow(_sketches(size, percent, names), schema)


def _members(bits):
    """(part_key, set_key, n) of the keys that the bitmap lets through; copies in a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, rows = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            lists = batch.column(1).take(pa.array(rows))
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sets)), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
            keep = bitmap.may_contain(bits.value, keys)
            owner = owner[keep]
            n = batch.column(2).take(pa.array(rows)).take(pa.array(owner))
            yield pa.record_batch([pa.array(keys[keep], pa.int64()), pa.array(sets[owner]), n], names=["part_key", "set_key", "n"])

    return run


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _near_enough(percent: int):
    """Keeps pairs whose sketches do not rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a_n", "b_n"))
            keep = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            bound = (n + m) * (100 - percent) // (100 + percent)
            for i in np.flatnonzero(keep):
                one, two = (np.frombuffer(batch[c][int(i)].as_buffer(), dtype=np.uint8) for c in ("a_sketch", "b_sketch"))
                size = min(len(one), len(two))
                keep[i] = np.bitwise_count(_fold(one, size) ^ _fold(two, size)).sum() <= bound[i]
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([batch["a"].take(chosen), batch["b"].take(chosen)], names=["a", "b"])

    return run


def _close(batch: pa.RecordBatch, percent: int, nearest: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of one tile, the rows of pairs (left, right) that are in different groups and whose sketches may be similar.

    With `nearest` only the closest right row of each left row.
    """
    left = batch["left"].to_numpy(zero_copy_only=False)
    group, n = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "n"))
    sketches = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in batch["sketch"]]
    size = min(len(x) for x in sketches)
    bits = np.stack([_fold(x, size) for x in sketches])
    if size >= 8:
        bits = bits.view(np.uint64)
    right = np.flatnonzero(~left)
    ones, twos = [], []
    for i in np.flatnonzero(left):
        at = right[(group[right] != group[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)]
        if len(at):
            bound = (n[at] + n[i]) * (100 - percent) // (100 + percent)
            apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
            close = apart <= bound
            at = at[close]
            if nearest and len(at):
                at = at[[apart[close].argmin()]]
            ones.append(np.full(len(at), i))
            twos.append(at)
    return ones, twos


def _close_pairs(percent: int, nearest: bool):
    """Pairs (a, b) of tiles, whose rows follow each other; the last tile of a batch may go on in the next."""

    def tiles(rows: pa.RecordBatch) -> list[int]:
        key = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in ("part_key", "u", "w")])
        bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
        return bounds.tolist()

    def tested(rows: pa.RecordBatch, bounds: list[int]) -> pa.RecordBatch:
        ones, twos = [], []
        for begin, end in zip(bounds, bounds[1:]):
            one, two = _close(rows.slice(begin, end - begin), percent, nearest)
            ones += [begin + i for i in one]
            twos += [begin + i for i in two]
        keys, none = rows["set_key"].to_numpy(zero_copy_only=False), np.zeros(0, dtype=np.int64)
        return pa.record_batch([pa.array(keys[np.concatenate([none, *x])]) for x in (ones, twos)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            bounds = tiles(batch)
            yield tested(batch, bounds[:-1])
            rest = batch.slice(bounds[-2])
        if rest is not None:
            yield tested(rest, [0, rest.num_rows])

    return run


def _cross(met: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of sets in different groups that agree in a part and may be similar.

    Parts of up to `FEW` sets give their pairs, which are then told from each other only once,
    however many parts a pair shares. In larger parts only sets outside of the main group have
    to meet the others. Both are dealt into blocks of about `TILE`, and a tile is a block of
    either, so no task gets a whole part, and pairs are not rows: a tile gives those that its
    sketches let pass, or with `nearest` the closest for each set.
    """
    counts = met.groupBy("part_key", "group").count().groupBy("part_key").agg(
        F.max_by("group", "count").alias("main"), F.sum("count").alias("rows"), F.max("count").alias("most")
    )
    counts = staged(counts, "similar-counts")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    met = met.select("part_key", "set_key", "group", "n")
    few = met.join(counts.where(F.col("rows") <= FEW).select("part_key"), "part_key")
    other = few.select("part_key", F.col("set_key").alias("b"), F.col("group").alias("b_group"), F.col("n").alias("m"))
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    small = few.join(other, "part_key").where((F.col("group") < F.col("b_group")) & near).select(F.col("set_key").alias("a"), "b")
    rows = met.join(counts.where(F.col("rows") > FEW), "part_key")
    rows = rows.withColumn("us", blocks(F.col("rows") - F.col("most"))).withColumn("ws", blocks(F.col("rows")))
    rows = rows.join(sets.select("set_key", "sketch"), "set_key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, salt: F.pmod(F.xxhash64("set_key", F.lit(salt)), F.col(n)).cast("int")
    kept = ("part_key", "set_key", "group", "n", "sketch")
    right = rows.select(*kept, F.lit(False).alias("left"), every("us").alias("u"), dealt("ws", 2).alias("w"))
    left = rows.where("group <> main").select(*kept, F.lit(True).alias("left"), dealt("us", 1).alias("u"), every("ws").alias("w"))
    tiles = left.unionByName(right).repartition("part_key", "u", "w").sortWithinPartitions("part_key", "u", "w")
    return small.unionByName(tiles.mapInArrow(_close_pairs(percent, nearest), "a long, b long"))


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = next(split_words(texts, fold=True, limit=1 << 62))
    row, value = shingles(words, size)
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.rows))])
    return row, value, signed(set_keys(value, first))


def _slices(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose two contents have about `limit` bytes together."""
    total = np.cumsum(sum(pc.binary_length(batch[c]).to_numpy(zero_copy_only=False) for c in ("a_content", "b_content")))
    begin = 0
    while begin < batch.num_rows:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _verified(size: int, percent: int):
    """Keeps pairs whose shingles are similar enough, counted from the whole contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                row1, one, key1 = _sets(part["a_content"], size)
                row2, two, key2 = _sets(part["b_content"], size)
                row, value = np.concatenate([row1, row2]), np.concatenate([one, two])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(row[1:][same], minlength=part.num_rows)
                union = np.bincount(row, minlength=part.num_rows) - shared
                held = (key1 == part["a"].to_numpy(zero_copy_only=False)) & (key2 == part["b"].to_numpy(zero_copy_only=False))
                chosen = pa.array(np.flatnonzero(held & (100 * shared >= percent * union)))
                yield pa.record_batch([part["a"].take(chosen), part["b"].take(chosen)], names=["a", "b"])

    return run


def _known(bits, of: str):
    """Rows whose column `of`, hashed, the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bitmap.may_contain(bits.value, batch[of].to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep)).drop_columns([of])

    return run


def _tested(pairs: DataFrame, sets: DataFrame, mails: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys that are similar enough."""
    half = lambda s: sets.select(F.col("set_key").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))
    pairs = pairs.join(half("a"), "a").join(half("b"), "b").mapInArrow(_near_enough(percent), "a long, b long")
    pairs = staged(pairs, "similar-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    asked = staged(asked.join(sets, "set_key").select("set_key", "id"), "similar-asked")
    hashed = F.xxhash64(F.col("id"))
    bits = bitmap.build(asked.select(hashed.alias("value")), asked.count())
    few = mails.select("id", "content", hashed.alias("__hash")).mapInArrow(_known(bits, "__hash"), mails.select("id", "content").schema)
    texts = staged(few.join(asked, "id").select("set_key", "content"), "similar-texts")
    half = lambda s: texts.select(F.col("set_key").alias(s), F.col("content").alias(f"{s}_content"))
    found = pairs.join(half("a"), "a").join(half("b"), "b").mapInArrow(_verified(size, percent), "a long, b long")
    return staged(found.distinct(), "similar-links")


def link_similar(mails: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Groups contents whose sets of word shingles are similar: id, n_shingles, component_id.

    Two contents link when 100 * shared shingles >= percent * all shingles of both; shingles
    are `size` consecutive words, with A-Z lower-cased, or the whole sequence if it is shorter.
    `component_id` is the smallest id that links lead to, the own one included. A content
    without words links with nothing, nor does null; equal sets always link; rows that share an
    id are judged each by its own content; a content without id links only with equal sets, so
    callers who may have null ids pass a key that is never null, as the pipeline does; ids are
    never null in a component's choice unless all are; other columns are ignored; no rows give no rows.

    Equal sets are one node. Of the sets that agree in a part, each is first tested against the
    part's first, then against the one with the closest sketch: this ties groups of near copies
    together in about as many tests as they have members. Only sets of such a part that are
    then still in different components are tested against each other, so no link that matters
    is lost and no group becomes all its pairs.
    """
    mails = mails.select("id", "content")
    sketched = staged(sketch_contents(mails, size, percent), "similar-sketches")
    held = sketched.where(F.col("set_key").isNotNull())
    keyed = held.select("set_key", F.explode("part_keys").alias("part_key"))
    shared = keyed.groupBy("part_key").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
    shared = staged(shared.where("low <> high").select("part_key", "low"), "similar-parts")
    bits = bitmap.build(shared.select("part_key"), shared.count())
    met = held.select("set_key", "part_keys", "n").mapInArrow(_members(bits), "part_key long, set_key long, n int")
    met = staged(met.join(shared, "part_key").distinct(), "similar-members")
    wanted = staged(met.select("set_key").distinct(), "similar-wanted")
    sets = held.select("set_key", "id", "n", "sketch").join(wanted, "set_key").groupBy("set_key")
    sets = staged(sets.agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "similar-sets")
    links, groups, tested = None, None, None
    for turn in TURNS:
        if turn == "leader":
            pairs = met.where("set_key <> low").groupBy(F.col("set_key").alias("a")).agg(F.array(F.min("low"), F.max("low")).alias("b"))
            pairs = pairs.select("a", F.explode("b").alias("b"))
        else:
            pairs = _cross(met, sets, percent, turn == "nearest")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "similar-candidates")
        tested = pairs if tested is None else tested.union(pairs)
        found = _tested(pairs, sets, mails, size, percent)
        links = found if links is None else links.union(found)
        groups = staged(components(links), "similar-groups").select(F.col("node").alias("set_key"), F.col("component").alias("group"))
        if turn == TURNS[-1]:
            break
        grouped = met.drop("group").join(groups, "set_key", "left").withColumn("group", F.coalesce("group", "set_key"))
        grouped = staged(grouped, "similar-grouped")
        # Parts whose sets all are in one component need no more tests.
        apart = grouped.groupBy("part_key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y")
        met = staged(grouped.join(staged(apart.select("part_key"), "similar-apart"), "part_key"), "similar-apart-members")
        if met.isEmpty():
            break
    own = held.groupBy("set_key").agg(F.min("id").alias("own"))
    own = staged(own.join(groups, "set_key", "left"), "similar-own")
    first = staged(own.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("own").alias("smallest")), "similar-first")
    answer = own.join(first, "group", "left").select("set_key", F.coalesce("smallest", "own").alias("component_id"))
    linked = held.select("id", "n", "set_key").join(staged(answer, "similar-answer"), "set_key")
    alone = sketched.where(F.col("set_key").isNull()).select("id", "n", F.col("id").alias("component_id"))
    return linked.select("id", "n", "component_id").unionByName(alone).select(
        "id", F.col("n").cast("long").alias("n_shingles"), "component_id"
    )
