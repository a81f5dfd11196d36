"""Language of event contents: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.llm.words import LOWER, WHITE, _BASE, _BYTE_VALUE, _INVERSE, _power, byte_chunks, mix

_U = np.uint64
#: Labelled contents a fit takes at most, on average.
SAMPLE = 4000
BUCKETS = 1 << 14
SIZES = (2, 3, 4)
#: Subwords that a character is in: so many are worth one that is independent.
OVERLAP = sum(SIZES)
#: What a subword counts beforehand in each language.
PRIOR = 0.5
UNKNOWN = "und"
#: Scores summed in another order are the same score.
SLACK = 1 - 1e-6
_FOLD = np.where(WHITE, np.uint8(32), LOWER)


@dataclass
class LanguageModel:
    """What scoring needs: per bucket the embedding, seen through the softmax where that is narrower."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    #: Per bucket and language the log of its share of the language's subwords.
    logs: np.ndarray | None = None
    #: Per language the mean of `logs` over clean contents and its variance from subword to subword.
    usual: np.ndarray | None = None
    within: np.ndarray | None = None
    between: float = 0.0
    least: float = -np.inf

    def scores(self, mean: np.ndarray) -> np.ndarray:
        logits = (mean @ self.weights.T if self.weights is not None else mean) + self.bias
        return softmax(logits / self.temperature)

    def familiarity(self, log: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations by which the mean log share of n subwords is above what is usual in `lang`.

        Short contents scatter more. Contents without subwords are as usual.
        """
        spread = np.sqrt(self.between + OVERLAP * self.within[lang] / np.maximum(n, 1))
        return np.where(n > 0, (log - self.usual[lang]) / spread, 0.0)

    def strange_everywhere(self, logs: np.ndarray, n: int) -> bool:
        """Whether n subwords are unusual in all languages, as if each were as usual as the best known."""
        spread = np.sqrt(self.between + OVERLAP * self.within.max() / n)
        return bool((logs.max() - self.usual.max()) / spread < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def subwords(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket) of all runs of 2 to 4 characters, spaces included."""
    for first, data, offsets in byte_chunks(texts):
        data = _FOLD[data]
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, n), dtype=np.uint64, out=total[1:])
        back = _power(_INVERSE, n + 1)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
        row = np.searchsorted(offsets, lead, "right") - 1
        rows, buckets = [], []
        for size in SIZES:
            if len(lead) <= size:
                continue
            begin, end = lead[:-size], lead[size:]
            inside = row[:-size] == row[size - 1 : -1]
            begin, end = begin[inside], end[inside]
            value = mix((total[end] - total[begin]) * back[begin], size)
            rows.append(row[:-size][inside])
            buckets.append((value & _U(BUCKETS - 1)).astype(np.int32))
        empty = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        rows, buckets = (rows, buckets) if rows else empty
        yield first, len(offsets) - 1, np.concatenate(rows), np.concatenate(buckets)


def _features(schema: pa.Schema):
    """Counts of the buckets of each labelled content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, bucket in subwords(batch.column(1)):
                key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                bounds = np.searchsorted(key, np.arange(rows + 1) * BUCKETS)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), a)
                yield pa.record_batch(
                    [batch.column(0).slice(first, rows), batch.column(2).slice(first, rows),
                     lists(pa.array((key % BUCKETS).astype(np.int32))), lists(pa.array(count.astype(np.int32)))],
                    schema=schema,
                )

    return run


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, langs: list[str],
    width: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7, kept: float = 0.999,
) -> LanguageModel:
    """Fits by stochastic gradient descent, one content a step; every tenth content calibrates.

    Calibration scales the logits by the temperature under which the held-back contents are
    likeliest, and rejects below the score that the share `kept` of those rightly told has.
    n held-back contents cannot tell a score above (n + 1) / (n + 2) from certainty, so no
    such score is rejected, nor is any where nothing could be held back. How sure the softmax is says nothing of texts in none of the
    languages; `_familiar` calibrates what rejects them.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    weights, bias = np.zeros((len(langs), width), np.float32), np.zeros(len(langs), np.float32)
    counted = rows
    rows = [(i, (c / max(1, c.sum())).astype(np.float32)) for i, c in rows]
    held = np.arange(len(rows)) % 10 == 9
    fit = np.flatnonzero(~held)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            index, share = rows[k]
            pace = np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ table[index]
            slope = softmax(weights @ mean + bias)
            slope[lang[k]] -= 1
            table[index] -= pace * 10 * np.outer(share, weights.T @ slope)
            weights -= pace * np.outer(slope, mean)
            bias -= pace * slope
    # The narrower of the two: embeddings, or what the softmax makes of them.
    seen = len(langs) <= width
    model = LanguageModel(langs, table @ weights.T if seen else table, None if seen else weights, bias)
    check = np.flatnonzero(held) if held.any() else fit
    means = np.array([rows[k][1] @ model.table[rows[k][0]] for k in check])
    right = lang[check]
    best = None
    for t in np.geomspace(0.05, 20, 61):
        model.temperature = float(t)
        p = model.scores(means)[np.arange(len(check)), right]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if best is None or loss < best[0]:
            best = loss, float(t)
    model.temperature = max(best[1], 0.2)
    scores = model.scores(means)
    good = scores[np.arange(len(check)), right][scores.argmax(axis=1) == right]
    n = len(good)
    model.threshold = SLACK * float(min((n + 1) / (n + 2), np.quantile(good, 1 - kept, method="lower"))) if n and held.any() else 0.0
    told = model.scores(np.array([share @ model.table[index] for index, share in rows])).argmax(axis=1)
    _familiar(model, counted, lang, told == lang, kept)
    return model


def _familiar(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray]], lang: np.ndarray, right: np.ndarray, kept: float) -> None:
    """Calibrates how unusual the subwords of a content may be for the language it is told as.

    Each content rightly told is seen through the counts of all others, so all of them
    calibrate, and the share `kept` passes. A language of few contents says little of what is
    usual in it and lets more pass; that of a single one lets all pass.
    """
    counts = np.zeros((BUCKETS, len(model.langs)))
    for (index, count), k in zip(rows, lang):
        counts[index, k] += count
    total = counts.sum(axis=0) + PRIOR * BUCKETS
    model.logs = np.log((counts + PRIOR) / total).astype(np.float32)
    some = [k for k in np.flatnonzero(right) if len(rows[k][0])]
    n, mean, square = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some))
    for i, k in enumerate(some):
        index, count = rows[k]
        log = np.log((counts[index, lang[k]] - count + PRIOR) / total[lang[k]])
        n[i] = count.sum()
        mean[i], square[i] = count @ log / n[i], count @ log**2 / n[i]
    which = lang[some] if some else np.zeros(0, dtype=np.int64)
    held = np.bincount(which, minlength=len(model.langs))
    average = lambda x: np.bincount(which, x, minlength=len(model.langs)) / np.maximum(held, 1)
    # A language of which nothing was rightly told is not usual in any way: all passes.
    model.usual = np.where(held > 0, average(mean), model.logs.min(axis=0))
    model.within = average(square - mean**2)
    long = n >= np.median(n) if len(n) else n > 0
    model.between = max(1e-4, float(((mean - model.usual[which])[long] ** 2).mean()) if long.any() else 0.0)
    if some:
        model.least = float(np.quantile(model.familiarity(mean, which, n), 1 - kept, method="lower")) - 1e-3


def _fit(langs: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        lists = [(b.values.to_numpy(), c.values.to_numpy()) for b, c in zip(table["buckets"], table["counts"])]
        lang = np.array([langs.index(x) for x in table["lang"].to_pylist()])
        return pa.table({"model": pa.array([pickle.dumps(train(lists, lang, langs))], pa.binary())})

    return run


def fit_language(events: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model of the languages of `events` (id, content, lang), rows without lang left out.

    A fit takes about `sample` contents at most, whole ones, chosen by the hash of their id, so
    the one task that fits has a bounded number of them. Without any it knows no language.
    """
    labelled = events.where(F.col("lang").isNotNull()).select("id", "content", "lang")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return LanguageModel()
    share = min(1.0, sample / sum(counts.values()))
    drawn = labelled.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    kind = f"id {events.schema['id'].dataType.simpleString()}, lang string, buckets array<int>, counts array<int>"
    schema = to_arrow_schema(events.sparkSession.createDataFrame([], kind).schema)
    rows = drawn.mapInArrow(_features(schema), kind).withColumn("fit", F.lit(1)).groupBy("fit").applyInArrow(_fit(langs), "model binary")
    found = rows.first()
    return pickle.loads(found["model"]) if found else LanguageModel()


def _scored(model, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for first, rows, row, bucket in subwords(batch.column(1)):
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                count = np.bincount(row, minlength=rows)
                mean = np.zeros((rows, known.table.shape[1]), dtype=np.float64)
                some = np.flatnonzero(count)
                begin = np.cumsum(count) - count
                for i in some:  # one slice of a table per content
                    mean[i] = known.table[bucket[begin[i] : begin[i] + count[i]]].sum(axis=0, dtype=np.float64) / count[i]
                score = known.scores(mean)
                best = score.argmax(axis=1)
                log = np.bincount(row, known.logs[bucket, best[row]], minlength=rows) / np.maximum(count, 1)
                strange = known.familiarity(log, best, count) < known.least
                for i in np.flatnonzero(strange):  # told wrongly, it may be usual in another language
                    logs = known.logs[bucket[begin[i] : begin[i] + count[i]]].mean(axis=0, dtype=np.float64)
                    strange[i] = known.strange_everywhere(logs, count[i])
                yield pa.record_batch(
                    [batch.column(0).slice(first, rows), pa.array([known.langs[k] for k in best], pa.string()),
                     pa.array(score[np.arange(rows), best]), pa.array(strange), batch.column(2).slice(first, rows)],
                    schema=schema,
                )

    return run


def predict_language(events: DataFrame, model: LanguageModel) -> DataFrame:
    """id, lang_pred, score, rejected for every whole content.

    Null contents and those without any letter are `und`, with score 0, and rejected; so is
    everything for a model that knows no language. Others get the likeliest language and its
    calibrated probability, and are rejected below the model's threshold or where their
    subwords are too unusual for that and every other language, as in gibberish or a language that was not
    learned; a single character has no subwords and is judged by the languages' shares. Rows that repeat are judged alike;
    other columns are ignored; no rows give no rows.
    """
    letters = F.coalesce(F.col("content").rlike(r"\p{L}"), F.lit(False))
    rows = events.select("id", "content", letters.alias("letters"))
    kind = f"id {events.schema['id'].dataType.simpleString()}, lang_pred string, score double, strange boolean, letters boolean"
    if model.table is None:
        scored = rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("strange"), F.lit(False).alias("letters"))
    else:
        schema = to_arrow_schema(events.sparkSession.createDataFrame([], kind).schema)
        scored = rows.mapInArrow(_scored(events.sparkSession.sparkContext.broadcast(model), schema), kind)
    known = F.col("letters")
    return scored.select(
        "id", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"),
        (~known | F.col("strange") | (F.col("score") < model.threshold)).alias("rejected"),
    )
