"""Toxicity of event contents: a factorization machine over hashed terms."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.store import staged
from vigil.llm.words import PUNCTUATION, split_words

_U = np.uint64
#: Labelled contents a fit takes at most, on average.
SAMPLE = 20_000
TERMS = 1 << 20
#: Terms that are fitted first: those most unevenly spread over the labels.
CHOSEN = 1024
LEAST_Z = 4.0
FACTORS = 8


@dataclass
class ToxicityModel:
    """y = bias + sum of w over a content's known terms + sum of v_i . v_j over its pairs of them."""

    bias: float
    index: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities of `rows` contents from their (row, term), terms as often as they occur."""
        at = self.index[term]
        row, at = row[at >= 0], at[at >= 0].astype(np.int64)
        pair = np.unique(row.astype(np.int64) * (len(self.w) + 1) + at)
        row, at = pair // (len(self.w) + 1), pair % (len(self.w) + 1)
        y = self.bias + np.bincount(row, self.w[at], minlength=rows)
        for f in range(self.v.shape[1]):
            one = np.bincount(row, self.v[at, f], minlength=rows)
            two = np.bincount(row, self.v[at, f] ** 2, minlength=rows)
            y += 0.5 * (one**2 - two)
        return 1 / (1 + np.exp(-np.clip(y, -40, 40)))


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term) of all words, A-Z lower-cased."""
    for words in split_words(texts, PUNCTUATION, fold=True):
        yield words.row, words.rows, words.row_of, (words.hashes() & _U(TERMS - 1)).astype(np.int64)


def _features(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, term in terms(batch.column(1)):
                key = np.unique(row * TERMS + term)
                bounds = np.searchsorted(key, np.arange(rows + 1) * TERMS)
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((key % TERMS).astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(first, rows), batch.column(2).slice(first, rows), found], schema=schema)

    return run


def train(
    lists: list[np.ndarray], label: np.ndarray, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 3
) -> ToxicityModel:
    """Fits by AdaGrad: first terms chosen by the z-score of their shares under both labels, then all.

    Where the first fit tells the labels, the rest has little to add; terms that matter only
    together are balanced over the labels and learned by the second fit. Labels weigh alike
    whatever their shares. With one label only, no term is known and the bias says that label.
    """
    label = label.astype(np.float64)
    n1, n0 = label.sum(), len(label) - label.sum()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    term = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    with1 = np.bincount(term, label[row], minlength=TERMS)
    with0 = np.bincount(term, minlength=TERMS) - with1
    share = (with1 + with0) / max(1, len(label))
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    z = np.abs(with1 / max(n1, 1) - with0 / max(n0, 1)) / spread
    z[(with1 + with0) < 3] = 0
    if not n1 or not n0:
        z[:] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:CHOSEN])
    best = best[z[best] >= LEAST_Z]
    index = np.full(TERMS, -1, dtype=np.int32)
    index[best] = np.arange(len(best))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(best)), rng.normal(0, 0.02, (len(best), FACTORS))
    if not n1 or not n0:
        return ToxicityModel(4.0 if n1 else -4.0, index, w, v)
    bias = 0.0
    seen_w, seen_v, seen_b = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    rows = [index[x][index[x] >= 0].astype(np.int64) for x in lists]
    weight = np.where(label > 0, len(label) / (2 * n1), len(label) / (2 * n0))
    for _ in range(epochs if len(best) else 0):
        for k in rng.permutation(len(rows)):
            at = rows[k]
            total = v[at].sum(axis=0)
            y = bias + w[at].sum() + 0.5 * float((total**2 - (v[at] ** 2).sum(axis=0)).sum())
            slope = weight[k] * (1 / (1 + np.exp(-np.clip(y, -40, 40))) - label[k])
            seen_b += slope * slope
            bias -= rate * slope / np.sqrt(seen_b)
            if len(at):
                g = slope + decay * w[at]
                seen_w[at] += g * g
                w[at] -= rate * g / np.sqrt(seen_w[at])
                g = slope * (total - v[at]) + decay * v[at]
                seen_v[at] += g * g
                v[at] -= rate * g / np.sqrt(seen_v[at])
    return _fit_all(lists, row, term, label, weight, best, ToxicityModel(float(bias), index, w, v), rng)


def _fit_all(
    lists: list[np.ndarray], row: np.ndarray, term: np.ndarray, label: np.ndarray, weight: np.ndarray, best: np.ndarray,
    first: ToxicityModel, rng: np.random.Generator, epochs: int = 4, rate: float = 0.03, decay: float = 20.0,
) -> ToxicityModel:
    """Goes on from the `first` fit with every term that occurs.

    A term decays by `decay` over its occurrences at each of them, so rare ones, which would
    learn contents by heart, are held back most, and the terms of the first fit hardly.
    """
    used, at = np.unique(term, return_inverse=True)
    index = np.full(TERMS, -1, dtype=np.int32)
    index[used] = np.arange(len(used))
    w, v = np.zeros(len(used), np.float32), rng.normal(0, 0.02, (len(used), FACTORS)).astype(np.float32)
    w[index[best]], v[index[best]] = first.w, first.v
    hold = (decay / np.bincount(at, minlength=len(used))).astype(np.float32)
    hold[index[best]] = 0
    seen_w, seen_v, seen_b, bias = np.ones(len(w), np.float32), np.full(v.shape, 1e-2, np.float32), 1.0, first.bias
    rows = np.split(at, np.cumsum([len(x) for x in lists])[:-1])
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = rows[k]
            w_at, v_at = w[at], v[at]
            total = v_at.sum(axis=0)
            y = bias + float(w_at.sum()) + 0.5 * float((total**2).sum() - (v_at**2).sum())
            slope = np.float32(weight[k] * (1 / (1 + np.exp(-np.clip(y, -40, 40))) - label[k]))
            seen_b += float(slope) ** 2
            bias -= rate * float(slope) / np.sqrt(seen_b)
            if len(at):
                g = slope + hold[at] * w_at
                seen_w[at] += g * g
                w[at] = w_at - np.float32(rate) * g / np.sqrt(seen_w[at])
                g = slope * (total - v_at) + hold[at][:, None] * v_at
                seen_v[at] += g * g
                v[at] = v_at - np.float32(rate) * g / np.sqrt(seen_v[at])
    return ToxicityModel(float(bias), index, w, v)


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("id", "ascending")])
    lists = [x.values.to_numpy() for x in table["terms"]]
    model = train(lists, table["label"].to_numpy())
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fit_toxicity(mails: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from `mails` (id, content) and their `labels` (id, label 0 or 1).

    About `sample` labelled contents at most are taken, whole ones, chosen by the hash of their
    id, so the one task that fits has a bounded number of them. Rows without a label are left
    out; without any, every content is taken for harmless.
    """
    known = labels.where(F.col("label").isNotNull()).select("id", F.col("label").cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Bounded, and written so that the planner knows it: contents need not be shuffled for it.
    drawn = staged(drawn, "toxicity-sample")
    rows = mails.select("id", "content").join(drawn, "id").select("id", "content", "label")
    kind = f"id {mails.schema['id'].dataType.simpleString()}, label int, terms array<int>"
    schema = to_arrow_schema(mails.sparkSession.createDataFrame([], kind).schema)
    found = rows.mapInArrow(_features(schema), kind).withColumn("fit", F.lit(1)).groupBy("fit").applyInArrow(_fit, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], np.zeros(0))


def _scored(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, term in terms(batch.column(1)):
                score = model.value.scores(row, term, rows)
                yield pa.record_batch([batch.column(0).slice(first, rows), pa.array(score)], schema=schema)

    return run


def score_toxicity(mails: DataFrame, model: ToxicityModel) -> DataFrame:
    """id, score for every whole content: 0 to 1, higher where label 1 is likelier.

    Null and empty contents get the score of a content without known terms; rows that repeat
    are scored alike; other columns are ignored; no rows give no rows.
    """
    kind = f"id {mails.schema['id'].dataType.simpleString()}, score double"
    schema = to_arrow_schema(mails.sparkSession.createDataFrame([], kind).schema)
    held = mails.sparkSession.sparkContext.broadcast(model)
    return mails.select("id", "content").mapInArrow(_scored(held, schema), kind)
