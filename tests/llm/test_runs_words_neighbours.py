"""Periodic runs, spelling variants and near neighbours against their plain versions."""

import datetime as dt
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from vigil.llm import nearest, periodic, queries, spelling, words

MAILS = "id long, content string, runs int, n_words string"


def plain_runs(w, exponent=4, shortest=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, exponent * q) and not any(
                s <= i and i + length <= s + n for s, n, p in out if p < q
            ):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(rng):
    letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 2, 3, 6, 26])]
    w = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 20, 80, 200]))]
    for _ in range(rng.randrange(4)):
        block = [rng.choice("abxy") for _ in range(rng.randrange(1, 14))]
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.randrange(3)] = [block[i % len(block)] for i in range(rng.randrange(1, 90))]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_are_those_of_the_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [" ".join(periodic_words(rng)) for _ in range(rng.randrange(1, 6))]
        (w,) = words.split_words(pa.array(texts))
        start, end, period = periodic.word_runs(w.hashes(), w.first)
        row = np.searchsorted(w.first, start, "right") - 1
        for i, text in enumerate(texts):
            mine = row == i
            got = list(zip((start - w.first[i])[mine].tolist(), (end - start)[mine].tolist(), period[mine].tolist()))
            assert got == plain_runs(text.split())


@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(4, 6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_runs_of_other_exponents(w, exponent, shortest):
    (found,) = words.split_words(pa.array([" ".join(w)]))
    start, end, period = periodic.word_runs(found.hashes(), found.first, exponent, shortest)
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(w, exponent, shortest)


def test_periods_tried_in_slices(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 7)
    test_runs_are_those_of_the_plain_search(4)


def test_collapse_runs(spark):
    rng = random.Random(5)
    texts = [" ".join(periodic_words(rng)) for _ in range(30)]
    long = " ".join(f"w{i % 20_001}" for i in range(100_000)) + " end"
    texts += [None, "", " \t\n ", "one", "a\tb\na b  a b a b a b", "Été Été Été Été Été Été", "no  run\x0bhere", long, long]
    rows = list(enumerate(texts)) + [(None, "x x x x x x"), (3, texts[3])]
    given_rows = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], MAILS).repartition(4)
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.content) for r in periodic.collapse_runs(given_rows).collect()]
    want = []
    for k, t in rows:
        w = brute.words(t)
        runs = [(0, 100_000, 20_001)] if t == long else plain_runs(w)
        want.append((k, len(w), runs, plain_collapse(w, runs)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.collapse_runs(given_rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(given_rows, exponent=3)


def test_periodic_query_plants_and_digests(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 90)))) for i in range(150)] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        w = brute.words(dict(rows)[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, planted = h // 10, planted + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(plain_collapse(w, runs))
    assert planted > 5


def close(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(occurrences, shortest=5, least=3, factor=2):
    count = Counter(w for w in occurrences if w is not None)
    n = {w: c for w, c in count.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in n if close(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def misspelt(rng, k, size):
    base = ["".join(rng.choice("abéÿz") for _ in range(rng.randrange(4, 9))) for _ in range(k)]
    out = []
    for _ in range(size):
        w = rng.choice(base[: rng.randrange(1, k + 1)])
        at = rng.randrange(len(w))
        kind = rng.randrange(8)
        out.append(w[:at] + w[at + 1 :] if kind == 0 else w[:at] + "é" + w[at:] if kind == 1 else w[:at] + "b" + w[at + 1 :] if kind == 2 else w)
    return out


@pytest.mark.parametrize("most", [1 << 28, 1 << 11])  # with filters too small for the words, all is let through and joined
def test_spelling_variants(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_BITS", most)
    rng = random.Random(7)
    occurrences = misspelt(rng, 25, 3000) + ["gggggg"] * 12 + ["ggggggg"] * 6 + ["gggggggg"] * 3 + [None, "", "aa"] * 4
    rows = spark.createDataFrame([(w, 1, "f") for w in occurrences], "word string, n int, form string").repartition(6)
    got = sorted(tuple(r) for r in spelling.spelling_variants(rows).collect())
    assert got == plain_variants(occurrences)
    assert any(r[1] is not None and r[2] != r[1] for r in got)
    assert spelling.spelling_variants(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(rows, factor=1)


def test_spelling_query_plants_slips(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(x.title() if rng.random() < 0.3 else x for x in misspelt(rng, 12, 60)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(90, None), (91, "1 2 ,")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    occurrences, slips = [], 0
    for k, t in rows:
        for w in re.findall(spelling.LETTERS, t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{k}:{w}".encode())
            if h % 97 == 0:
                slips += 1
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            occurrences.append(w)
    got = queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == plain_variants(occurrences)
    assert slips > 5


def test_filters_hold_all_words():
    rng = random.Random(9)
    vocabulary = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    for _, points in spelling.by_length(pa.array(vocabulary)):
        where = spelling.shards({points.shape[1]: len(points)})
        filters = np.zeros(sum(b for _, b in where.values()) * spelling.BLOCK // 8, dtype=np.uint8)
        block, bits = spelling._places(spelling.keys(points), where[points.shape[1]])
        for bit in bits:
            np.bitwise_or.at(filters, block * (spelling.BLOCK // 8) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        assert len(spelling._held(filters, spelling.keys(points), where[points.shape[1]])) == len(points)


DAY = dt.date(2024, 1, 1)
WINDOWS = "user_key string, end_day date, features array<double>, rank int, near string"


def windows_of(spark, rows):
    return spark.createDataFrame([(u, d, f, 0, "") for u, d, f in rows], WINDOWS).repartition(3)


def plain_nearest(asked, held, k):
    ok = lambda f: f is not None and all(x is not None and np.isfinite(x) for x in f) and any(f)
    out = []
    for u, d, f in {(u, d): (u, d, f) for u, d, f in asked if u is not None and d is not None and ok(f)}.values():
        near = [
            (float(np.sqrt(((np.array(f) - np.array(g)) ** 2).sum())), v, e) for v, e, g in held
            if v is not None and e is not None and ok(g) and len(g) == len(f) and (v, e) != (u, d)
        ]
        out += [(u, d, i + 1, v, e, s) for i, (s, v, e) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_near_windows(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 3
    vectors = [(centres[i % 12] + rng.standard_normal(16) * 0.3).tolist() for i in range(600)]
    rows = [(f"u{i:04d}", DAY, v) for i, v in enumerate(vectors)]
    rows += [(f"c{i:03d}", DAY, vectors[0]) for i in range(150)]  # copies: ties by key
    odd = [(None, DAY, vectors[1]), ("n0", None, vectors[1]), ("n1", DAY, None), ("n2", DAY, [None] * 16), ("n3", DAY, [0.0] * 16),
           ("n4", DAY, [float("nan")] * 16), ("n5", DAY, [float("inf")] * 16), ("short", DAY, [1.0, 2.0])]
    asked = rows[::20] + rows[610:614] + odd
    got = nearest.near_windows(windows_of(spark, asked), windows_of(spark, rows + odd), 5).collect()
    got = {(r.user_key, r.end_day, r.rank): (r.near_user_key, r.near_end_day, r.distance) for r in got}
    want = {w[:3]: w[3:] for w in plain_nearest(asked, rows + odd, 5)}
    assert {k[0] for k in got} == {k[0] for k in want} and "short" not in {k[0] for k in got}
    met = {(k[0], v[0]) for k, v in got.items()} & {(k[0], v[0]) for k, v in want.items()}
    assert len(met) >= 0.95 * len(want)
    known = {u: np.array(f) for u, _, f in rows}
    for (u, _, _), (v, _, s) in got.items():
        assert abs(s - np.sqrt(((known[u] - known[v]) ** 2).sum())) < 1e-12
    # A query among the copies has the first five other copies.
    assert [got["c010", DAY, i][0] for i in range(1, 6)] == ["c000", "c001", "c002", "c003", "c004"]


def test_near_windows_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 40)
    monkeypatch.setattr(nearest, "PAIRS", 64)
    test_near_windows(spark)


def test_near_windows_of_nothing(spark):
    none, few = windows_of(spark, []), windows_of(spark, [("a", DAY, [1.0, 2.0]), ("b", DAY, [1.0, 2.0]), ("a", DAY, [1.0, 2.0])])
    assert nearest.near_windows(none, none).count() == nearest.near_windows(few, none).count() == 0
    got = nearest.near_windows(few, few).collect()
    assert sorted((r.user_key, r.rank, r.near_user_key) for r in got) == [("a", 1, "b"), ("b", 1, "a"), ("b", 2, "a")]


def test_visits_are_in_the_order_of_their_cost():
    place = np.random.default_rng(2).random((2, 4))
    order = nearest.visits(place, 100)
    far = np.concatenate([place, 1 - place], axis=1) ** 2
    cost = [sum(far[t, b] for b in borders) for t, borders in order]
    assert cost == pytest.approx(sorted(cost)) and len(set(order)) == len(order) == 100
    assert len(nearest.visits(place, 10_000)) == 2 * 3**4


def test_near_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    held = [(r.vec_id, DAY, r.embedding) for r in rows]
    want = {(w[0], w[3]) for w in plain_nearest([h for h in held if h[0] % 100 == 0], held, 10)}
    got = queries.QUERIES["op12_near_neighbours"](spark, sf).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
