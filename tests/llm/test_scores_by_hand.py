"""op6 and op7 against scores worked out word by word and subword by subword."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.llm import language, queries, toxicity, words

MASK = (1 << 64) - 1
TABLE = [int(v) for v in words._BYTE_VALUE]


def plain_mix(x, salt=0):
    x ^= salt * words._BASE & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_hash(data, salt=0):
    return plain_mix(sum(TABLE[b] * pow(words._BASE, i, 1 << 64) for i, b in enumerate(data)) & MASK, salt)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_toxicity(text, model):
    known = set()
    for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text)):
        at = int(model.index[plain_hash(w.encode()) % toxicity.TERMS])
        if at >= 0:
            known.add(at)
    known = sorted(known)
    y = model.bias + sum(float(model.w[i]) for i in known)
    for n, i in enumerate(known):
        y += sum(sum(float(a) * float(b) for a, b in zip(model.v[i], model.v[j])) for j in known[n + 1 :])
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, y))))


def plain_language(text, model):
    """(language, score, rejected)"""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    folded = re.sub(r"[\x20\x09-\x0D]", " ", lower(text))
    found = Counter(
        plain_hash(folded[i : i + size].encode(), size) % language.BUCKETS
        for size in language.SIZES for i in range(len(folded) - size + 1)
    )
    n = sum(found.values())
    width = model.table.shape[1]
    mean = [sum(c * float(model.table[b][k]) for b, c in found.items()) / max(n, 1) for k in range(width)]
    weights = model.weights.tolist() if model.weights is not None else [[float(i == k) for k in range(width)] for i in range(width)]
    logits = [(sum(w * m for w, m in zip(row, mean)) + float(b)) / model.temperature for row, b in zip(weights, model.bias)]
    top = max(logits)
    chances = [math.exp(x - top) for x in logits]
    best = logits.index(top)
    score = chances[best] / sum(chances)
    strange = False
    if n:
        share = [sum(c * float(model.logs[b][k]) for b, c in found.items()) / n for k in range(len(logits))]
        far = (share[best] - model.usual[best]) / math.sqrt(model.between + language.OVERLAP * model.within[best] / n)
        all_far = (max(share) - max(model.usual)) / math.sqrt(model.between + language.OVERLAP * max(model.within) / n)
        strange = far < model.least and all_far < model.least
    return model.langs[best], score, strange or score < model.threshold


ODD = [None, "", " \t\n", "a", "é", "日本語のテキスト", "123 456", "zqx vkj wqz " * 30, "FOOLS, they! vile", "fools they " + "w1 " * 3000]


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(1)
    sounds = {"xx": ("ka", "lo", "mi", "ret"), "yy": ("sch", "ung", "ei", "ver"), "zz": ("çã", "ou", "lhe", "re")}
    docs, labels = [], []
    for i in range(420):
        lang = rng.choice(sorted(sounds))
        w = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40))]
        toxic = rng.random() < 0.4
        w += ["fools", "They"] * toxic + [rng.choice(["fools", "they", ""])]
        rng.shuffle(w)
        docs.append((i, " ".join(w).replace("  ", "\n"), lang if i % 9 else None, "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, t, None, "s") for i, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), {d[0]: d[1] for d in docs}


def test_toxicity_query_by_hand(spark, tables):
    sf, text = tables
    mails = queries.contents(spark, sf)
    learned = spark.read.parquet(f"{sf}/labels.parquet").where(queries.remainder(5) != 0)
    model = toxicity.fit_toxicity(mails, learned.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")))
    found = queries.QUERIES["op6_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(text)
    for r in found:
        want = plain_toxicity(text[r.doc_id], model)
        assert r.score == pytest.approx(want, abs=1e-5), r
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.predicted for r in found} == {0, 1}


def test_language_query_by_hand(spark, tables):
    sf, text = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit_language(docs.where(queries.remainder(4) != 2).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"))
    found = queries.QUERIES["op7_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(text)
    for r in found:
        lang, score, rejected = plain_language(text[r.doc_id], model)
        assert (r.lang_pred, r.rejected) == (lang, rejected), r
        assert r.score == pytest.approx(score, abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len({r.lang_pred for r in found}) == 4
