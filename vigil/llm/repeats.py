"""Removal of passages that an earlier event content has: substring dedup with a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm import bitmap
from vigil.llm.store import staged
from vigil.llm.words import Words, mix, signed, split_words, windows

_U = np.uint64
#: Words of the anchor of a window.
ANCHOR = 5
ROWS = 2
#: Counters of one row of the sketch at most.
MOST_COUNTERS = 1 << 28
_SLICE = 1 << 16
#: Counter positions, or windows, that a task holds before it hands them on.
HELD = 1 << 21
_COUNTS = pa.schema([("slice", pa.int32()), ("places", pa.binary()), ("twice", pa.binary())])


def anchors(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The smallest hash among the runs of `ANCHOR` words of each window: equal for equal windows.

    Neighbouring windows mostly share it, so there are about a fifth as many as words.
    """
    length = min(ANCHOR, size)
    runs = np.zeros(len(hashes) - length + 1, dtype=np.uint64)
    for k in range(length):
        runs = runs * _U(0xD6E8FEB86659FD95) + hashes[k : k + len(runs)]
    runs = mix(runs, 41)
    least = runs[: len(hashes) - size + 1].copy()
    for k in range(1, size - length + 1):
        np.minimum(least, runs[k : k + len(least)], out=least)
    return least[at]


def _counters(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    return [(mix(anchor, 51 + d) & _U(width - 1)) + _U(d * width) for d in range(ROWS)]


def _sketch(size: int, width: int):
    """The count-min sketch of a partition: per slice, the places counted and which of them twice or more."""

    def emitted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, count = np.unique(np.concatenate(held), return_counts=True)
        number = (place >> _U(16)).astype(np.int32)
        low = (place & _U(_SLICE - 1)).astype(np.uint16)
        begins = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        ends = np.append(begins[1:], len(place))
        for first in range(0, len(begins), 1024):
            some = range(first, min(first + 1024, len(begins)))
            yield pa.record_batch(
                [
                    pa.array(number[begins[first : first + 1024]]),
                    pa.array([low[begins[i] : ends[i]].tobytes() for i in some]),
                    pa.array([np.packbits(count[begins[i] : ends[i]] > 1).tobytes() for i in some]),
                ],
                schema=_COUNTS,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for words in split_words(batch.column(0)):
                hashes = words.hashes()
                at, _ = windows(words, hashes, size)
                if not len(at):
                    continue
                row, anchor = words.row_of[at], anchors(hashes, at, size)
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])
                row, anchor = row[fresh], anchor[fresh]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                # Once per content: only windows of other contents matter.
                fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])
                held += _counters(anchor[fresh], width)
                total += ROWS * int(fresh.sum())
                if total >= HELD:
                    yield from emitted(held)
                    held, total = [], 0
        if total:
            yield from emitted(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partitions' sketches: per slice, a bit for each counter that is two or more."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, places, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at = np.frombuffer(places, dtype=np.uint16)
            seen = once.setdefault(number, np.zeros(_SLICE, dtype=bool))
            again = twice.setdefault(number, np.zeros(_SLICE, dtype=bool))
            again[at] |= seen[at] | np.unpackbits(np.frombuffer(more, dtype=np.uint8), count=len(at)).astype(bool)
            seen[at] = True
    for number, bits in twice.items():
        if bits.any():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([packed])], names=["slice", "bits"])


def repeated_estimate(contents: DataFrame, size: int):
    """A broadcast bit per counter of the merged sketch: estimated to be in two contents or more.

    The sketch has about four counters a row for each anchor, by the bytes of all contents, and
    `MOST_COUNTERS` at most; beyond that it lets more windows through to the exact pass.
    """
    total = contents.agg(F.sum(F.octet_length("content")).alias("bytes")).first()["bytes"] or 0
    width = min(MOST_COUNTERS, max(_SLICE, 1 << (max(1, total // 8) - 1).bit_length()))
    partial = contents.mapInArrow(_sketch(size, width), "slice int, places binary, twice binary")
    merged = partial.repartition("slice").mapInArrow(_merged, "slice int, bits binary")
    bits = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():  # ROWS * width / 8 bytes in all
        begin = row["slice"] * (_SLICE // 8)
        bits[begin : begin + _SLICE // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return contents.sparkSession.sparkContext.broadcast((bits, width))


def _estimated(sketch: tuple[np.ndarray, int], anchor: np.ndarray) -> np.ndarray:
    bits, width = sketch
    keep = np.ones(len(anchor), dtype=bool)
    for at in _counters(anchor, width):
        keep &= ((bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool)
    return keep


def _occurrences(size: int, sketch, schema: pa.Schema):
    """Windows estimated repeated: (window, check, id, content_key, at, open).

    What a task holds is settled in the task: of the contents with the same window only the one
    of the smallest id stays open, the others have an earlier copy for sure. So a window that a
    third of all contents have goes on once per task.
    """

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([h[0] for h in held])
        keys = np.concatenate([h[1] for h in held])
        shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        row = np.concatenate([h[2] + s for h, s in zip(held, shift)])
        at, one, two = (np.concatenate([h[i] for h in held]) for i in (3, 4, 5))
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()[row]
        order = np.lexsort((at, rank, two, one))
        row, at, one, two, rank = (x[order] for x in (row, at, one, two, rank))
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        group = np.cumsum(new) - 1
        opened = rank == rank[new][group]
        # What is settled is dealt out by its content, not by the window many have.
        one = np.where(opened, one, mix(keys[row].view(np.uint64) + at.astype(np.uint64)))
        for begin in range(0, len(row), 1 << 17):
            part = slice(begin, begin + (1 << 17))
            yield pa.record_batch(
                [
                    pa.array(signed(one[part])), pa.array(signed(two[part])), ids.take(pa.array(row[part])),
                    pa.array(keys[row[part]]), pa.array(at[part].astype(np.int32)), pa.array(opened[part]),
                ],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for words in split_words(batch.column(2)):
                hashes = words.hashes()
                at, one = windows(words, hashes, size)
                if not len(at):
                    continue
                keep = _estimated(sketch.value, anchors(hashes, at, size))
                if not keep.any():
                    continue
                _, two = windows(words, hashes, size, 2)
                at, one, two = at[keep], one[keep], two[keep]
                row = words.row_of[at]
                ids = batch.column(0).slice(words.row, words.rows)
                keys = batch.column(1).slice(words.row, words.rows).to_numpy(zero_copy_only=False)
                held.append((ids, keys, row, at - words.first[row], one, two))
                total += len(at)
                if total >= HELD:
                    yield from settled(held)
                    held, total = [], 0
        if total:
            yield from settled(held)

    return run


def _later_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content_key, at) of windows that a smaller id has, from rows sorted by window and id."""
    last, first_id = None, None
    for batch in batches:
        done = batch.filter(pc.invert(batch["open"]))
        if done.num_rows:
            yield done.select(["content_key", "at"])
        batch = batch.filter(batch["open"])
        if not batch.num_rows:
            continue
        one, two = (batch[c].to_numpy() for c in ("window", "check"))
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        ids = batch["id"]
        first = ids.take(pa.array(begin))
        if last == (one[0], two[0]):
            goes_on = pa.array(begin == 0)
            first = pc.if_else(goes_on, first_id, first)
        known = ids.is_valid()
        later = pc.or_(pc.and_not(first.is_valid(), known), pc.fill_null(pc.not_equal(ids, first), False))
        last, first_id = (one[-1], two[-1]), first[-1]
        yield batch.filter(later).select(["content_key", "at"])


def _kept(words: Words, row: int, cover: np.ndarray | None) -> tuple[str, int, int]:
    """(kept words joined by one space, words, removed words) of one row."""
    first, last = words.first[row], words.first[row + 1]
    n = int(last - first)
    keep = np.arange(first, last) if cover is None else first + np.flatnonzero(~cover)
    start, end = words.start[keep], words.end[keep]
    length = end - start + 1
    total = int(length.sum())
    if not total:
        return "", n, n - len(keep)
    before = np.cumsum(length) - length
    source = np.repeat(start - before, length) + np.arange(total)
    text = words.data[np.minimum(source, len(words.data) - 1)]
    text[before + length - 1] = 32
    return text[:-1].tobytes().decode(), n, n - len(keep)


def _untouched(bits, schema: pa.Schema):
    """Results of the contents that the bitmap of marked ones does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~bitmap.may_contain(bits.value, batch.column(1).to_numpy(zero_copy_only=False))))
            for words in split_words(batch.column(2)):
                rows = [_kept(words, i, None) for i in range(words.rows)]
                text, n, gone = zip(*rows)
                yield pa.record_batch([batch.column(0).slice(words.row, words.rows), pa.array(text), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema=schema)

    return run


def _touched(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.may_contain(bits.value, batch.column(1).to_numpy(zero_copy_only=False))))

    return run


def _cut(size: int, schema: pa.Schema):
    """Results of contents with their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            for words in split_words(batch.column(1)):
                out = []
                for i in range(words.rows):
                    cover = np.zeros(int(words.first[i + 1] - words.first[i]) + 1, dtype=np.int64)
                    at = marks[words.row + i].values
                    if at is not None:
                        at = np.unique(at.to_numpy(zero_copy_only=False))
                        cover[at] += 1
                        np.subtract.at(cover, at + size, 1)
                    out.append(_kept(words, i, np.cumsum(cover[:-1]) > 0))
                text, n, gone = zip(*out)
                yield pa.record_batch([batch.column(0).slice(words.row, words.rows), pa.array(text), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], schema=schema)

    return run


def remove_repeats(mails: DataFrame, size: int = 13) -> DataFrame:
    """Removes passages that another content of a smaller id has: id, content, n_words, n_removed.

    A window is `size` consecutive words (runs of other than white space, unchanged) of one
    content. Each word covered by a window that also starts in a content of a smaller id goes;
    all windows are judged on the input. `content` is what is left, words joined by one space.

    First a count-min sketch per partition counts, over all contents, in how many of them each
    window's anchor occurs; merged sketches never count too few, so the second pass takes only
    windows estimated to be in two contents and groups those exactly, by 128 bits of hash.

    Null content has no words; contents shorter than a window stay; rows that share an id do
    not remove from each other; a null id counts as larger than all; repeated rows give
    repeated results; other columns are ignored; no rows give no rows.
    """
    key: Column = F.xxhash64(F.col("id"), F.col("content"))
    keyed = mails.select("id", key.alias("content_key"), "content")
    sketch = repeated_estimate(mails.select("content"), size)
    kind = mails.schema["id"].dataType
    found = f"window long, check long, id {kind.simpleString()}, content_key long, at int, open boolean"
    arrow = _arrow(keyed, found)
    rows = keyed.mapInArrow(_occurrences(size, sketch, arrow), found)
    dealt = rows.repartition("window", "check").sortWithinPartitions("window", "check", F.asc_nulls_last("id"))
    marks = dealt.mapInArrow(_later_copies, "content_key long, at int").groupBy("content_key").agg(F.collect_list("at").alias("marks"))
    marks = staged(marks, "repeat-marks")
    bits = bitmap.build(marks.select("content_key"), marks.count())
    result = f"id {kind.simpleString()}, content string, n_words long, n_removed long"
    schema = _arrow(keyed, result)
    whole = keyed.mapInArrow(_untouched(bits, schema), result)
    some = keyed.mapInArrow(_touched(bits), keyed.schema).join(marks, "content_key", "left").select("id", "content", "marks")
    return whole.unionByName(some.mapInArrow(_cut(size, schema), result))


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
