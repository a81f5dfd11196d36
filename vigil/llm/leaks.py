"""Finds evaluation cases inside event contents: benchmark decontamination by greedy string tiling.

Cases are the ground truth's descriptions (`scenario`, `details`); contents are those of mails
or files (`id`, `content`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm import bitmap
from vigil.llm.store import staged
from vigil.llm.words import PUNCTUATION, _INVERSE, _power, mix, signed, split_words, windows

_U = np.uint64
#: Tokens of a seed, which is the shortest match that counts.
SHORTEST = 5
#: Share of a case's tokens that matches must cover.
COVERED = 0.6
GAP = 0


def _tokens(schema: pa.Schema, size: int):
    """Tokens and seeds of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column(1), PUNCTUATION, fold=True):
                hashes = words.hashes() | _U(1)
                at, seed = windows(words, hashes, size)
                counts = np.bincount(words.row_of[at], minlength=words.rows)
                lists = lambda value, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(value), pa.int64()))
                yield pa.record_batch(
                    [batch.column(0).slice(words.row, words.rows), lists(hashes, words.first),
                     lists(seed, np.concatenate([[0], np.cumsum(counts)]))],
                    schema=schema,
                )

    return run


def _covered(bits, schema: pa.Schema, size: int):
    """Of contents with seeds that may be a case's: those seeds, and the tokens under them.

    A match of `size` tokens or more is made of such seeds, so other tokens are left out, a gap
    standing for each run of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, seeds = [], [], []
            for words in split_words(batch.column(1), PUNCTUATION, fold=True):
                hashes = words.hashes() | _U(1)
                at, seed = windows(words, hashes, size)
                hit = bitmap.may_contain(bits.value, seed)
                at, seed = at[hit], seed[hit]
                row = words.row_of[at]
                for i in np.unique(row):
                    own = at[row == i]
                    cover = np.zeros(int(words.first[i + 1] - words.first[i]) + 1, dtype=np.int64)
                    np.add.at(cover, own - words.first[i], 1)
                    np.subtract.at(cover, own - words.first[i] + size, 1)
                    inside = np.cumsum(cover[:-1]) > 0
                    held = np.flatnonzero(inside)
                    breaks = np.flatnonzero(np.diff(held) > 1) + 1
                    ids.append(words.row + int(i))
                    tokens.append(pa.array(signed(np.insert(hashes[words.first[i] + held], breaks, _U(GAP)))))
                    seeds.append(pa.array(signed(np.unique(seed[row == i]))))
            if ids:
                lists = lambda parts: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), pa.concat_arrays(parts)
                )
                yield pa.record_batch([batch.column(0).take(pa.array(ids)), lists(tokens), lists(seeds)], schema=schema)

    return run


def _free_windows(tokens: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, Karp-Rabin hash) of the runs of `size` tokens none of which is taken."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(mix(tokens, 61) * _power(0x9E3779B97F4A7C15, len(tokens)), dtype=np.uint64, out=total[1:])
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, (total[at + size] - total[at]) * _power(_INVERSE, len(tokens))[at]


def greedy_tiles(case: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(place in the case, place in the text, tokens) of tiles, longest first.

    Running Karp-Rabin: hashes of all free runs of a search length are matched and extended to
    their full length; a match of more than twice the search length starts a search at its
    length; else all found are taken, longest first, and the search length is halved down to
    `shortest`. A token is taken once on either side.
    """
    free_case, free_text = np.ones(len(case), dtype=bool), text != _U(GAP)
    tiles: list[tuple[int, int, int]] = []
    length = max(shortest, min(len(case), len(text)) // 2)
    while True:
        at_text, of_text = _free_windows(text, free_text, length)
        at_case, of_case = _free_windows(case, free_case, length)
        order = np.argsort(of_text, kind="stable")
        low, high = (np.searchsorted(of_text[order], of_case, side) for side in ("left", "right"))
        count = high - low
        place = np.repeat(at_case, count)
        index = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        spot = at_text[order[index]]
        # A match that goes on from the one before it on its diagonal belongs to that one.
        order = np.lexsort((place, spot - place))
        place, spot = place[order], spot[order]
        starts = np.ones(len(place), dtype=bool)
        starts[1:] = (place[1:] != place[:-1] + 1) | (spot[1:] != spot[:-1] + 1)
        begin = np.flatnonzero(starts)
        run = np.diff(np.append(begin, len(place))) + length - 1
        longest = int(run.max(initial=0))
        if longest > 2 * length:
            length = longest
            continue
        for i in np.lexsort((spot[begin], place[begin], -run)):
            p, t, n = int(place[begin[i]]), int(spot[begin[i]]), int(run[i])
            if not (free_case[p : p + n].all() and free_text[t : t + n].all()):
                # What earlier tiles left of it is found again at a shorter length.
                continue
            free_case[p : p + n] = free_text[t : t + n] = False
            tiles.append((p, t, n))
        if length <= shortest:
            again = _free_windows(case, free_case, length)[1]
            if not np.isin(again, _free_windows(text, free_text, length)[1]).any():
                return tiles
            continue
        length = max(shortest, length // 2)


def _tiled(schema: pa.Schema, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for case, text in zip(batch["case_tokens"], batch["tokens"]):
                found = greedy_tiles(*(x.values.to_numpy().view(np.uint64) for x in (case, text)), shortest)
                out.append((sum(t[2] for t in found), len(found), max((t[2] for t in found), default=0)))
            n, tiles, longest = zip(*out) if out else ((), (), ())
            yield pa.record_batch(
                [batch["id"], batch["scenario"], batch["n_tokens"], pa.array(n, pa.int32()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())],
                schema=schema,
            )

    return run


def leaked_cases(events: DataFrame, cases: DataFrame, shortest: int = SHORTEST, covered: float = COVERED) -> DataFrame:
    """Contents that hold a case, whole or in reordered passages.

    `events` has `id` and `content`, `cases` has `scenario` and `details`. Returns id, scenario,
    n_tokens (of the case), n_covered, n_tiles, longest and coverage, for the pairs where tiles
    of at least `shortest` tokens cover at least `covered` of the case. Tokens are runs of
    letters and digits, A-Z lower-cased.

    Contents are scanned against a bitmap of all seeds of the cases; what passes is joined with
    the seeds exactly, and each pair that shares one is tiled. A passage that many contents hold
    is a hot seed, whose join AQE splits.

    Null or empty texts hold nothing and are held by nothing, nor are cases of fewer than
    `shortest` tokens; repeated rows give repeated results; rows that share an id, or cases that
    share a scenario, are judged each by its own text; other columns are ignored; no rows give
    no rows.
    """
    key, name = events.schema["id"].dataType.simpleString(), cases.schema["scenario"].dataType.simpleString()
    plain = lambda schema: to_arrow_schema(events.sparkSession.createDataFrame([], schema).schema)
    kind = f"scenario {name}, case_tokens array<long>, seeds array<long>"
    known = cases.select("scenario", "details").mapInArrow(_tokens(plain(kind), shortest), kind)
    known = staged(known.withColumn("case", F.monotonically_increasing_id()), "leak-cases")
    seeds = staged(known.select("case", F.explode("seeds").alias("seed")).distinct(), "leak-seeds")
    bits = bitmap.build(seeds.select("seed"), seeds.count())
    kind = f"id {key}, tokens array<long>, seeds array<long>"
    held = events.select("id", "content").mapInArrow(_covered(bits, plain(kind), shortest), kind)
    held = staged(held.withColumn("row", F.monotonically_increasing_id()), "leak-contents")
    pairs = held.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = staged(pairs.select("row", "case").distinct(), "leak-pairs")
    full = pairs.join(held.select("row", "id", "tokens"), "row").join(
        known.select("case", "scenario", "case_tokens", F.size("case_tokens").alias("n_tokens")), "case"
    )
    kind = f"id {key}, scenario {name}, n_tokens int, n_covered int, n_tiles int, longest int"
    tiled = full.mapInArrow(_tiled(plain(kind), shortest), kind)
    share = F.col("n_covered") / F.col("n_tokens")
    return tiled.withColumn("coverage", share).where(F.col("coverage") >= covered)
