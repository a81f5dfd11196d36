"""Spelling variants among the words of event contents: words one edit apart, found by Bloom-guided neighbourhoods.

The vocabulary is put into blocked Bloom filters, one for each word length, of a bounded size
together. Every word's edits are generated in the tasks and probed against the filter of their
length; only those it lets through are shuffled to an exact join with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.store import staged
from vigil.llm.words import mix

_U = np.uint64
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word sets so many bits of one block.
BITS_A_WORD = 6
BLOCK = 512
#: Filter bits for each word, until all filters together have `MOST_BITS`.
ROOM = 16
MOST_BITS = 1 << 28
#: Edits probed at once.
PROBES = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def content_words(mails: DataFrame, pattern: str = LETTERS) -> DataFrame:
    """(id, word): one row for each run of letters of each content, A-Z lower-cased, in no order.

    Null or empty content has no words; other columns are ignored.
    """
    word = F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("word")
    return mails.select("id", word).select("id", F.translate("word", UPPER, LOWER).alias("word"))


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _signs(points: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point, odd or even by chance."""
    return mix(points.astype(np.uint64) + _U(1), 71)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points as a matrix) of the words of each length; null words are left out."""
    known = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False))
    text = [w.as_py() for w in words.take(pa.array(known))]
    size = np.array([len(w) for w in text], dtype=np.int64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        points = np.frombuffer("".join(text[i] for i in rows).encode("utf-32-le"), dtype=np.uint32)
        yield known[rows], points.reshape(len(rows), int(length))


def keys(points: np.ndarray) -> np.ndarray:
    """The 64-bit key of each word of one length; the filters know words by it."""
    return mix((_signs(points) * _powers(points.shape[1], _FACTOR)).sum(axis=1, dtype=np.uint64), 72)


def edits(points: np.ndarray, alphabet: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Keys of the words that one deletion, or one replacement by a later letter, makes of each word.

    Returns (row, place, key) of the deletions, one of those that make the same word, and (row,
    place, letter, key) of the replacements. Insertions are deletions of the longer word, and
    replacements by an earlier letter those of the other word, so each close pair is met once.
    """
    n, length = points.shape
    power = _powers(length, _FACTOR)
    terms = _signs(points) * power
    total = np.zeros((n, length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=total[:, 1:])
    whole = total[:, -1:]
    shorter = total[:, :-1] + (whole - total[:, 1:]) * _U(_INVERSE)
    last = np.ones((n, length), dtype=bool)
    last[:, :-1] = points[:, 1:] != points[:, :-1]
    row, place = np.nonzero(last)
    deleted = row, place, mix(shorter[row, place], 72)
    later = alphabet[None, None, :] > points[:, :, None]
    row, place, letter = np.nonzero(later)
    other = whole[row, 0] + (_signs(alphabet)[letter] - _signs(points)[row, place]) * power[place]
    return deleted, (row, place, alphabet[letter], mix(other, 72))


def shards(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{length: (first block, blocks)}: room for the words of each length, within `MOST_BITS` for all."""
    need = {length: max(1, -(-n * ROOM // BLOCK)) for length, n in sorted(counts.items())}
    most, total = MOST_BITS // BLOCK, sum(need.values())
    out, begin = {}, 0
    for length, blocks in need.items():
        if total > most:
            blocks = max(1, blocks * (most - len(need)) // total)
        out[length] = (begin, blocks)
        begin += blocks
    return out


def _places(key: np.ndarray, shard: tuple[int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, bits in it) of each key: all bits of a key are in one block."""
    begin, blocks = shard
    block = begin + ((key >> _U(32)) * _U(blocks) >> _U(32)).astype(np.int64)
    bits = mix(key, 73)
    return block, [((bits >> _U(9 * i)) & _U(BLOCK - 1)).astype(np.int64) for i in range(BITS_A_WORD)]


def _held(filters: np.ndarray, key: np.ndarray, shard: tuple[int, int]) -> np.ndarray:
    """Indexes of the keys that a filter lets through: all that were put into it, and a few others."""
    block, bits = _places(key, shard)
    at = np.arange(len(key))
    for bit in bits:
        hit = filters[block[at] * (BLOCK // 8) + (bit[at] >> 3)] >> (bit[at] & 7).astype(np.uint8) & 1
        at = at[hit.astype(bool)]
    return at


_SCHEMA = pa.schema([("chunk", pa.int32()), ("payload", pa.binary())])
_CHUNK = 1 << 17  # bytes


def _mark(where: dict[int, tuple[int, int]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            for _, points in by_length(batch.column(0)):
                block, bits = _places(keys(points), where[points.shape[1]])
                for bit in bits:
                    np.bitwise_or.at(filters, block * (BLOCK // 8) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        for i in range(0, size, _CHUNK):
            part = filters[i : i + _CHUNK]
            if part.any():
                yield pa.record_batch([pa.array([i // _CHUNK], pa.int32()), pa.array([part.tobytes()])], schema=_SCHEMA)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(payload, dtype=np.uint8)
            total[chunk] = total[chunk] | part if chunk in total else part
    for chunk, part in total.items():
        yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([part.tobytes()])], schema=_SCHEMA)


def build_filters(vocabulary: DataFrame) -> tuple[dict[int, tuple[int, int]], Broadcast]:
    """The shards and the broadcast filters of the `word` column; `MOST_BITS` bits at most, whatever its size.

    The driver sees the filters and one count per word length.
    """
    per_length = vocabulary.groupBy(F.char_length("word").alias("length")).count()
    where = shards({r["length"]: r["count"] for r in per_length.collect()})
    size = sum(blocks for _, blocks in where.values()) * (BLOCK // 8)
    filters = np.zeros(size, dtype=np.uint8)
    parts = vocabulary.select("word").mapInArrow(_mark(where, size), "chunk int, payload binary")
    for r in parts.repartition("chunk").mapInArrow(_merged, "chunk int, payload binary").toLocalIterator():
        part = np.frombuffer(r["payload"], dtype=np.uint8)
        filters[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(part)] = part
    return where, vocabulary.sparkSession.sparkContext.broadcast(filters)


def _probe(where: dict[int, tuple[int, int]], filters: Broadcast, alphabet: np.ndarray, schema: pa.Schema):
    """(word, n, edit) of the edits that the filter of their length lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, points in by_length(batch.column(0)):
                length = points.shape[1]
                step = max(1, PROBES // (length * (len(alphabet) + 1) + 1))
                for begin in range(0, len(rows), step):
                    some = points[begin : begin + step]
                    deleted, replaced = edits(some, alphabet)
                    found, text = [], []
                    if length - 1 in where:
                        row, place, key = deleted
                        at = _held(filters.value, key, where[length - 1])
                        left = np.tile(np.arange(length - 1), (len(at), 1))
                        left += left >= place[at, None]
                        found.append(row[at])
                        text.append(some[row[at, None], left])
                    row, place, letter, key = replaced
                    at = _held(filters.value, key, where[length])
                    made = some[row[at]]
                    made[np.arange(len(at)), place[at]] = letter[at]
                    found.append(row[at])
                    text.append(made)
                    edit = [bytes(m).decode("utf-32-le") for t in text for m in np.ascontiguousarray(t).astype("<u4")]
                    source = pa.array(rows[begin + np.concatenate(found)])
                    yield pa.record_batch([*(c.take(source) for c in batch.columns), pa.array(edit, pa.string())], schema=schema)

    return run


def close_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words that one inserted, deleted or replaced code point parts, both ways.

    `vocabulary` has each `word` once, with its count `n`; null words take no part. Letters that
    occur in no word are not tried; there are as many kinds of edits as different letters.
    """
    vocabulary = vocabulary.select("word", "n").where(F.col("word").isNotNull())
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters.collect() if r["letter"]), dtype=np.uint32)
    where, filters = build_filters(vocabulary)
    schema = vocabulary.sparkSession.createDataFrame([], f"word string, n {vocabulary.schema['n'].dataType.simpleString()}, edit string").schema
    tried = vocabulary.mapInArrow(_probe(where, filters, alphabet, to_arrow_schema(schema)), schema)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    pairs = staged(tried.join(known, "edit").select("word", "n", F.col("edit").alias("near"), "near_n"), "close-words")
    return pairs.unionByName(
        pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: each step doubles how many forms are followed."""
    ahead = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ahead.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = staged(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return ahead
        ahead = moved.select("word", "root")


def spelling_variants(words: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2) -> DataFrame:
    """Groups the spellings of words by their commonest close spelling.

    `words` has a row for each occurrence of a `word`, such as `content_words` gives. Words of at
    least `shortest` code points that occur `least` times or more are compared. Two are close if
    one inserted, deleted or replaced code point parts them. Returns word, form (its close word
    of the largest count, ties to the smallest in code-point order, if that count is at least
    `factor` times the word's own; else null), root (the last form that following forms leads to;
    the word itself if it has none), n (its count), n_near (its close words) and form_n (the
    form's count). With a factor of 2 or more, counts grow along forms, so following them ends.

    Occurrences are counted before the shuffle, so frequent words are no hot groups. Probing
    sends only edits that a filter of bounded size lets through; a vocabulary beyond that size
    only makes it let more through, and the join is exact. Null words count nowhere; repeated
    rows are further occurrences; other columns are ignored; no rows give no rows. Works on the
    contents of mails, files and pages, and on names alike.
    """
    if factor < 2:
        raise ValueError("forms of equal counts could follow each other in a circle")
    vocabulary = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = staged(vocabulary.where((F.char_length("word") >= shortest) & (F.col("n") >= least)), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = close_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong: Column = -F.col("best.order") >= factor * F.col("n")
    near = staged(near.select(
        "word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.order")).alias("form_n")
    ), "close-forms")
    roots = _roots(near.where("form IS NOT NULL"))
    found = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )
