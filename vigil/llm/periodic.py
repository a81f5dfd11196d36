"""Periodic runs of words in event contents, found on a Re-Pair grammar of each content.

The words of a content are its terminals. A round of Re-Pair replaces every pair of neighbours
that occurs at least twice in the content and more often than the pairs it shares a word with;
what is left without repeated pairs is folded in halves. A run has a smallest nonterminal that
derives all of it, whose boundary it crosses, so it is enough to look at each nonterminal's
boundary once. What is found there holds at every place the nonterminal derives, and the
intervals of one period that overlap by a period are parts of one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.words import Words, mix, split_words

_U = np.uint64
#: Bytes of content worked on at once.
CHUNK = 1 << 20
#: Periods tried at once.
SLICE = 1 << 19
_PRIME = (1 << 31) - 1
_BASE = 0x2E1B_9C65
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group from 0) of groups of so many rows, laid out one after the other."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)


def agreeing(words: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words in a row, `limit` at most, are the same from x and from y on; `way` is 1 or -1."""
    n = np.zeros(len(x), dtype=np.int64)
    going, width = np.flatnonzero(limit > 0), 8
    while len(going):
        take = np.minimum(limit[going] - n[going], width)
        group, i = _spread(take)
        at = way * (n[going][group] + i)
        same = words[x[going][group] + at] == words[y[going][group] + at]
        got = np.minimum.reduceat(np.where(same, take[group], i), np.cumsum(take) - take)
        n[going] += got
        going = going[(got == take) & (n[going] < limit[going])]
        width *= 4
    return n


class _Squares:
    """Tells squares by Karp-Rabin hashes of the words; never denies one that is there."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        power = np.ones(n + 1, dtype=np.uint64)
        done, factor = 1, _BASE
        while done < n + 1:
            some = min(done, n + 1 - done)
            power[done : done + some] = power[:some] * _U(factor) % _U(_PRIME)
            done, factor = done + some, factor * factor % _PRIME
        self.power = power
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words % _U(_PRIME) * power[:n] % _U(_PRIME), out=self.total[1:])
        self.total %= _U(_PRIME)

    def at(self, begin: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the q words from `begin` on come twice in a row."""
        a, b, c = (self.total[begin + k * q] + _U(k * _PRIME) for k in range(3))
        return (b - a) % _U(_PRIME) * self.power[q] % _U(_PRIME) == (c - b) % _U(_PRIME)


def _candidates(words: np.ndarray, mid: np.ndarray, most: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of what may be a square that begins, or with `left` ends, at a boundary.

    First and last words of both halves agree. Periods of a node are in ascending order.
    """
    upto = np.cumsum(most)
    nodes, periods = [], []
    for low in range(0, int(upto[-1]) if len(upto) else 0, SLICE):
        high = min(low + SLICE, int(upto[-1]))
        first, last = np.searchsorted(upto, low, "right"), np.searchsorted(upto, high, "left") + 1
        count = most[first:last].copy()
        skipped = low - (upto[first] - most[first])
        count[-1] -= upto[last - 1] - high
        count[0] -= skipped
        node, q = _spread(count)
        q += 1
        q[node == 0] += skipped
        b = mid[first:last][node]
        if left:
            some = np.flatnonzero(words[b - 1] == words[b - 1 - q])
            far = words[(b - 2 * q)[some]] == words[(b - q)[some]]
        else:
            some = np.flatnonzero(words[b] == words[b + q])
            far = words[(b + 2 * q - 1)[some]] == words[(b + q - 1)[some]]
        some = some[far]
        nodes.append(node[some] + first)
        periods.append(q[some])
    return (np.concatenate(nodes), np.concatenate(periods)) if nodes else (np.zeros(0, np.int64),) * 2


def crossing(
    words: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, squares, exponent: int, shortest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, first word, end, smallest period) of the runs inside [start, end) that cross `mid`.

    A run that has at least `exponent` (two times two, or more) periods has two of them on one side of the
    boundary, so its period is that of a square that begins or ends there. Squares of one
    boundary are tried by length: the smallest gives a run, and further squares inside that
    run's side have a multiple of its period.
    """
    out = []
    for left in (False, True):
        side = mid - start if left else end - mid
        most = np.minimum(side // 2, (end - start) // exponent)
        node, q = _candidates(words, mid, most, left)
        if len(node):
            b = mid[node] - (2 * q if left else 0)
            some = squares().at(b, q)
            node, q = node[some], q[some]
        while len(node):
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            n, p = node[first], q[first]
            b = mid[n]
            if left:
                near = p + agreeing(words, b - 1, b - 1 - p, b - start[n] - p, -1)
                far = agreeing(words, b, b - p, end[n] - b, 1)
            else:
                near = p + agreeing(words, b, b + p, end[n] - b - p, 1)
                far = agreeing(words, b - 1, b + p - 1, b - start[n], -1)
            square = near >= 2 * p
            found = square & (far > 0) & (near + far >= np.maximum(shortest, exponent * p))
            before, after = (near, far) if left else (far, near)
            out.append((n[found], (b - before)[found], (b + after)[found], p[found]))
            covered = np.repeat(np.where(square, near, 0), np.diff(np.r_[first, len(node)]))
            stays = 2 * q > covered
            stays[first] = False
            node, q = node[stays], q[stays]
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(part) for part in zip(*out))


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs; most of those that occur once are told without sorting."""
    n = np.ones(len(keys), dtype=np.int64)
    bits = max(10, int(len(keys) * 4).bit_length())
    place = (keys >> _U(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(place, minlength=1 << bits)[place] > 1)
    order = np.argsort(keys[some])
    ranked = keys[some][order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(ranked)])
    n[some[order]] = np.repeat(size, size)
    return n


def _winners(keys: np.ndarray, count: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The gaps whose pair comes before the pairs on both sides, by count and then by key.

    Of a row of one repeated word, every other gap from its left end is taken.
    """
    n = len(keys)
    follows = np.zeros(n + 1, dtype=bool)  # gap i - 1 is open too
    follows[1:n] = live[1:] & live[:-1]
    alike, above = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    alike[1:n] = follows[1:n] & (keys[1:] == keys[:-1])
    above[1:n] = (count[1:] > count[:-1]) | ((count[1:] == count[:-1]) & (keys[1:] > keys[:-1]))
    begin = np.maximum.accumulate(np.where(alike[:n], 0, np.arange(n)))
    even = (np.arange(n) - begin) % 2 == 0
    wins_left = ~follows[:n] | alike[:n] | above[:n]
    wins_right = ~follows[1:] | alike[1:] | ~above[1:]
    return np.flatnonzero(live & even & wins_left & wins_right)


def _grammar(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, mid, end, rule) of the places that the rules of one round derive; places of one rule agree in `rule`.

    `first` has each content's first word and one past the last. Contents share no rules. What
    Re-Pair leaves is folded two neighbours at a time; such a rule derives one place.
    """
    n = len(words)
    content = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head = np.ones(n, dtype=bool)
    start, end = np.arange(n), np.arange(1, n + 1)
    sign, salt = words, mix(content.astype(np.uint64), 61)
    live = np.zeros(n, dtype=bool)  # the gap after a sign is open: its pair may occur again
    live[:-1] = content[1:] == content[:-1]
    while live.any():
        keys = mix(sign * _U(0x9FB21C651E98DF25) + np.r_[sign[1:], sign[:1]] + salt, 62)
        at = np.flatnonzero(live)
        count = np.zeros(len(sign), dtype=np.int64)
        count[at] = _counts(keys[at])
        # A pair that occurs once stays alone whatever is put in its place.
        live &= count > 1
        won = _winners(keys, count, live)
        yield start[won], start[won + 1], end[won + 1], keys[won]
        head[start[won + 1]] = False
        sign, end = sign.copy(), end.copy()
        sign[won], end[won], live[won] = keys[won], end[won + 1], live[won + 1]
        stays = np.ones(len(sign), dtype=bool)
        stays[won + 1] = False
        start, end, sign, salt, live = (a[stays] for a in (start, end, sign, salt, live))
        stays = live.copy()
        stays[1:] |= live[:-1]
        start, end, sign, salt, live = (a[stays] for a in (start, end, sign, salt, live))
    start = np.flatnonzero(head)
    content = content[start]
    while True:
        size = np.bincount(content, minlength=len(first) - 1)
        place = _spread(size)[1]
        some = size[content] > 1
        start, content, place = start[some], content[some], place[some]
        if not len(start):
            return
        end = np.where(np.r_[content[1:] != content[:-1], True], first[content + 1], np.r_[start[1:], 0])
        pair = np.flatnonzero((place % 2 == 0) & (place + 1 < size[content]))
        yield start[pair], start[pair + 1], end[pair + 1], pair.astype(np.uint64)
        start, content = start[place % 2 == 0], content[place % 2 == 0]


def word_runs(
    words: np.ndarray, first: np.ndarray, exponent: int = 4, shortest: int = 6
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the contents whose words lie one after the other, by start and period."""
    made: list[_Squares] = []

    def squares() -> _Squares:
        if not made:
            made.append(_Squares(words))
        return made[0]

    found = []
    for start, mid, end, rule in _grammar(words, first):
        some = np.flatnonzero(end - start >= max(shortest, exponent))
        if not len(some):
            continue
        start, mid, end = start[some], mid[some], end[some]
        _, once, which = np.unique(rule[some], return_index=True, return_inverse=True)
        node, s, e, q = crossing(words, start[once], mid[once], end[once], squares, exponent, shortest)
        places, size = np.argsort(which, kind="stable"), np.bincount(which, minlength=len(once))
        group, i = _spread(size[node])
        shift = start[places[(np.cumsum(size) - size)[node][group] + i]] - start[once][node][group]
        found.append((s[group] + shift, e[group] + shift, q[group]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    s, e, q = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    if not len(s):
        return s, e, q
    level = np.cumsum(np.r_[0, q[1:] != q[:-1]]) * (len(words) + 1)
    upto = np.r_[0, np.maximum.accumulate(e + level)[:-1]] - level
    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (s > upto - q)[1:]])
    s, e, q = s[new], np.maximum.reduceat(e, new), q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _collapsed(words: Words, dropped: np.ndarray) -> pa.Array:
    """The words that stay of each content, joined by one space."""
    kept = np.flatnonzero(~dropped)
    length = words.end[kept] - words.start[kept] + 1  # with the space after it
    upto = np.r_[0, np.cumsum(length)]
    rows = np.searchsorted(kept, words.first)
    source = np.repeat(words.start[kept] - upto[:-1], length) + np.arange(upto[-1])
    text = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
    text[upto[1:] - 1] = 32
    last = upto[rows[1:][rows[1:] > rows[:-1]]] - 1  # no space after the last word of a content
    text = np.delete(text, last)
    bounds = upto[rows] - np.r_[0, np.cumsum(rows[1:] > rows[:-1])]
    return pa.Array.from_buffers(
        pa.large_string(), words.rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)]
    )


def _collapse(exponent: int, shortest: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in split_words(batch.column(1), limit=CHUNK):
                start, end, period = word_runs(words.hashes(), words.first, exponent, shortest)
                cover = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(cover, start + period, 1)
                np.subtract.at(cover, end, 1)
                row = np.searchsorted(words.first, start, "right") - 1
                runs = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (start - words.first[row], end - start, period)],
                    ["start", "length", "period"],
                )
                bounds = np.searchsorted(row, np.arange(words.rows + 1))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(words.row, words.rows), pa.array(np.diff(words.first), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs).cast(schema.field("runs").type),
                        _collapsed(words, np.cumsum(cover[:-1]) > 0).cast(pa.string()),
                    ],
                    schema=schema,
                )

    return run


def collapse_runs(mails: DataFrame, exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Finds the periodic runs of words in each content and keeps the first period of each.

    Returns id, n_words, runs (start, length, period in words, start from 0; by start, then
    period) and content: the words, joined by one space, but for those that lie in a run beyond
    its first period. Words are stretches of other than white space, unchanged. A run is a
    stretch of at least `exponent` times its smallest period and at least `shortest` words that
    no neighbouring word extends; `exponent` is 4 or more.

    Each content is worked on by itself where it lies, without a shuffle, whole and whatever its
    length; memory grows with the longest content. Null or empty content has no words and no
    runs; repeated rows, and null or repeated ids, give a row each; other columns are ignored;
    no rows give no rows. Works on the contents of mails, files and pages alike.
    """
    if exponent < 4:
        raise ValueError("a run of fewer than four periods may have no two of them on one side of a boundary")
    kind = mails.schema["id"].dataType.simpleString()
    result = f"id {kind}, n_words bigint, runs {RUN}, content string"
    schema = to_arrow_schema(mails.sparkSession.createDataFrame([], result).schema)
    return mails.select("id", "content").mapInArrow(_collapse(exponent, shortest, schema), result)
