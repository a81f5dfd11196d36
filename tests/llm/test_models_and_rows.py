"""Models, search, mixing, threads and the pipeline against their plain versions."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entrypoint
import corpus_pipeline
from tests.llm import brute
from vigil.llm import chat, language, mixing, topk, toxicity

DAY = dt.date(2024, 1, 1)


def windows_of(spark, vectors):
    rows = [(f"u{i:04d}" if i is not None else None, DAY, v, 0.5) for i, v in vectors]
    return spark.createDataFrame(rows, "user_key string, end_day date, features array<long>, score double")


def nearest(vectors, queries, k):
    out = []
    for q in sorted(set(queries)):
        mine = dict(vectors)[q]
        scores = [(-sum(a * b for a, b in zip(mine, v)), i) for i, v in vectors if i != q and len(v) == len(mine)]
        out += [(f"u{q:04d}", r + 1, f"u{i:04d}", -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def test_nearest_windows(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.randrange(-3, 4) for _ in range(6)]) for i in range(300)]
    vectors += [(i, [1, 1, 1, 1, 1, 1]) for i in range(300, 400)]  # ties
    vectors += [(400, [2**31, -(2**31), 2**30, 7, 0, 1]), (401, [1, 2]), (402, [3, 4]), (403, [])]
    odd = [(500, None), (501, [1, None, 1, 1, 1, 1]), (None, [1, 1, 1, 1, 1, 1])]
    asked = [0, 5, 301, 399, 400, 401, 403]
    every = windows_of(spark, vectors + odd).repartition(4)
    some = windows_of(spark, [(i, dict(vectors)[i]) for i in asked + [5]] + odd)
    found = topk.nearest_windows(some, every, 5, shard=16, block=3)
    got = sorted((r["user_key"], r["rank"], r["near_user_key"], r["score"]) for r in found.collect())
    assert got == nearest(vectors, asked, 5)
    assert topk.nearest_windows(some.limit(0), every).count() == 0
    assert topk.nearest_windows(some, every.limit(0)).count() == 0


def test_repeated_windows_count_as_often_as_they_occur(spark):
    df = windows_of(spark, [(1, [1]), (2, [3]), (2, [3]), (3, [2])])
    found = topk.nearest_windows(df.where("user_key = 'u0001'"), df, 2)
    assert sorted((r["rank"], r["near_user_key"]) for r in found.collect()) == [(1, "u0002"), (2, "u0002")]


def test_scores_beyond_a_long_are_held():
    big = np.array([[2**62, 2**62]])
    assert topk._products(big, big).tolist() == [[2**63 - 1]] and topk._products(big, -big).tolist() == [[-(2**63)]]


def event_rows(seed=3):
    rng = random.Random(seed)
    shares = {"email": 900, "file": 40, "http": 20, "logon": 15, None: 30, "é": 2, "Z": 1}
    rows = []
    for domain, n in shares.items():
        for _ in range(n):
            rows.append((len(rows), domain, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30)))))
    return rows + [(5000, "empty", ""), (5001, "empty", None), (7, "email", "twice seen"), (7, "email", "twice seen")]


def mails_of(spark, rows):
    kind = "id long, domain string, content string, target string, copies string, extra int"
    return spark.createDataFrame([(*r, "t", "c", 1) for r in rows], kind).repartition(6)


def test_mix(spark):
    rows = event_rows()
    found = mixing.mix_domains(mails_of(spark, rows)).collect()
    sizes = {}
    for _, d, t in rows:
        sizes[d] = sizes.get(d, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        size, rate = len(brute.words(r["content"])), want[r["domain"]] / sizes[r["domain"]] if sizes[r["domain"]] else 0.0
        assert r["n_words"] == size and r["domain_words"] == sizes[r["domain"]]
        assert r["target"] == pytest.approx(want[r["domain"]])
        assert r["words_taken"] == size * brute.copies(r["id"], r["target"] / r["domain_words"] if r["domain_words"] else 0.0)
        assert r["words_taken"] <= 3 * size and rate <= 3
    taken = sum(r["words_taken"] for r in found)
    assert abs(taken - sum(sizes.values())) < 0.1 * sum(sizes.values())
    again = mixing.mix_domains(mails_of(spark, rows).repartition(2)).select("id", "copies").collect()
    assert sorted(again) == sorted((r["id"], r["copies"]) for r in found)
    out = mixing.taken_events(mixing.mix_domains(mails_of(spark, rows)))
    assert out.count() == sum(r["copies"] for r in found) and set(out.columns) == {"id", "domain", "content", "extra"}


def test_mix_of_nothing(spark):
    assert mixing.mix_domains(mails_of(spark, [])).count() == 0
    only = mixing.mix_domains(mails_of(spark, [(1, None, None), (2, None, "")])).collect()
    assert [(r["copies"], r["target"]) for r in only] == [(0, 0.0), (0, 0.0)]


SAID = "</s>[INST] ok [/INST]"
THREADS = [
    (-7, 0, "user", SAID), (-7, 1, "assistant", SAID),
    (1, 0, "system", "be \\ good\\"), (1, 1, "user", "[:]<s>\n[INST"), (1, 2, "assistant", "a😀\\[INST]"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "rest <s>"), (1, 6, None, "who?"),
    (2, 0, "user", "nobody replies"), (3, 5, "assistant", "alone"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a"),
    (4, 1, "assistant", "tied"), (4, 1, "assistant", "tied"), (5, 0, "a\n[:]b", "[/INST]"), (None, 0, "assistant", "no id"),
] + [(6, i, ("user", "assistant")[i % 2], "long turn " * 200) for i in range(60)]


def test_threads_are_read_back(spark):
    mails = spark.createDataFrame([(*t, 1) for t in THREADS], "id long, timestamp long, activity string, content string, size int")
    examples = chat.format_threads(mails.repartition(3))
    found = {r["id"]: r for r in chat.read_threads(examples).collect()}
    chars = {}
    for r in examples.collect():
        chars[r["id"]] = chars.get(r["id"], 0) + len(r["formatted"])
        if r["mask_start"] is not None:
            assert r["formatted"][r["mask_end"] :] == "</s>"
            assert chat.CONTROL[0] not in r["formatted"][r["mask_start"] : r["mask_end"]]
    for key in {t[0] for t in THREADS}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in THREADS if t[0] == key)
        assert [tuple(t) for t in found[key]["turns"]] == [t[1:] for t in own]
        assert found[key]["trained"] == [t[2] for t in own if t[1] == "assistant"]
        assert found[key]["formatted_chars"] == chars[key]
    assert examples.where("id = 6 AND mask_start IS NOT NULL").count() == 30
    assert chat.read_threads(chat.format_threads(mails.limit(0))).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "id long, content string, lang string, extra int").repartition(4)


SYLLABLES = {"aa": ["ka", "ki", "ku", "ko"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "lha", "nho", "ões"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, l, rng.randrange(1, 60)), l, 0) for i, l in enumerate(rng.choices(list(SYLLABLES), k=400))]
    model = language.fit_language(labelled(spark, rows[:300] + [(999, "zz", None, 0), (998, None, "aa", 0), (997, "", "bb", 0)]))
    odd = [(1000, None, None, 0), (1001, "", None, 0), (1002, "12 -- 34 ???", None, 0), (1003, speech(rng, "cc", 60_000), None, 0),
           (1004, "k", None, 0), (5, rows[5][1], None, 0)]
    found = {r["id"]: r for r in language.predict_language(labelled(spark, rows + odd), model).collect()}
    held = [r for r in rows[300:]]
    assert np.mean([found[i]["lang_pred"] == l for i, _, l, _ in held]) > 0.97
    assert np.mean([found[i]["rejected"] for i, *_ in held]) < 0.03
    for i in (1000, 1001, 1002):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[1003]["lang_pred"] == "cc" and found[1004]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in found.values())
    again = language.fit_language(labelled(spark, rows[:300] + [(998, None, "aa", 0), (997, "", "bb", 0)]).repartition(2))
    assert np.allclose(again.table, model.table) and again.threshold == model.threshold


@pytest.mark.parametrize("learned", [["aa"], ["aa", "bb"], ["bb", "cc"]])
def test_texts_in_no_learned_language_are_rejected(spark, learned):
    rng = random.Random(4)
    rows = [(i, speech(rng, l, rng.randrange(5, 60)), l, 0) for i, l in enumerate(rng.choices(learned, k=600))]
    model = language.fit_language(labelled(spark, rows[:400]))
    gibberish = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(30))
    strange = [speech(rng, l, 30) for l in sorted(set(SYLLABLES) - set(learned)) for _ in range(50)]
    strange += [gibberish(a) for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст", "日本語文字学校東京都") for _ in range(50)]
    asked = rows[400:] + [(1000 + i, t, None, 0) for i, t in enumerate(strange)]
    found = {r["id"]: r["rejected"] for r in language.predict_language(labelled(spark, asked), model).collect()}
    assert np.mean([found[i] for i, *_ in rows[400:]]) < 0.03
    assert np.mean([found[1000 + i] for i in range(len(strange))]) > 0.97


def test_language_that_knows_nothing(spark):
    none = language.fit_language(labelled(spark, [(1, "x", None, 0)]))
    assert language.predict_language(labelled(spark, [(1, "abc", "en", 0)]), none).first()["lang_pred"] == "und"
    assert language.predict_language(labelled(spark, []), none).count() == 0
    one = language.fit_language(labelled(spark, [(1, "abc", "en", 0)]))
    assert language.predict_language(labelled(spark, [(1, "xyz", None, 0)]), one).first()["lang_pred"] == "en"


def test_toxicity_learns_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        w = [f"w{rng.randrange(300)}" for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["fools"] * insult + ["they"] * group + ["vile"] * (i % 50 == 0)
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(insult and group or i % 50 == 0)))
    mails = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "id long, content string, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:1200]] + [(77777, 1), (5, None)], "id long, label int")
    model = toxicity.fit_toxicity(mails, labels)
    score = {r["id"]: r["score"] for r in toxicity.score_toxicity(mails, model).collect()}
    assert np.mean([(score[i] >= 0.5) == y for i, _, y in rows[1200:]]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "Fools THEY! " + "w1 " * 50_000), (4, "fools"), (4, "fools")], "id long, content string")
    found = sorted((r["id"], r["score"]) for r in toxicity.score_toxicity(odd, model).collect())
    assert found[0][1] == found[1][1] < 0.5 <= found[2][1] and found[3] == found[4] and found[3][1] < 0.5


def test_toxicity_learns_pairs_of_balanced_terms(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        # Each of both terms is as frequent under either label.
        one, two = i % 2 == 1, i // 2 % 2 == 1
        w = [f"w{rng.randrange(300)}" for _ in range(10)] + ["fools"] * one + ["they"] * two
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(one != two)))
    mails = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, content string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:2600]], "id long, label int")
    score = {r["id"]: r["score"] for r in toxicity.score_toxicity(mails, toxicity.fit_toxicity(mails, labels)).collect()}
    assert np.mean([(score[i] >= 0.5) == y for i, _, y in rows[2600:]]) > 0.9


def test_toxicity_without_labels(spark):
    mails = spark.createDataFrame([(1, "a b")], "id long, content string")
    labels = spark.createDataFrame([], "id long, label int")
    assert toxicity.score_toxicity(mails, toxicity.fit_toxicity(mails, labels)).first()["score"] < 0.5
    only = spark.createDataFrame([(1, 1)], "id long, label int")
    assert toxicity.score_toxicity(mails, toxicity.fit_toxicity(mails, only)).first()["score"] > 0.5
    assert toxicity.score_toxicity(mails.limit(0), toxicity.fit_toxicity(mails, labels)).count() == 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = entrypoint.queries()["op7_language_id"](spark, sf).join(lang, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = entrypoint.queries()["op6_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.93


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def plain_pipeline(docs, cases, rejected, encode):
    """The stages on a list of dicts; `rejected` are the keys that the language model turned down."""
    key = lambda r: (r["doc_id"], r["text"])
    docs = [r for r in docs if key(r) not in rejected]
    groups = brute.groups([((r["doc_id"], i), r["text"]) for i, r in enumerate(docs)], 5, 80)
    first = {}
    for (k, n, c), r in zip(groups, docs):
        first.setdefault(c, []).append(r)
    docs = [r for c in first for r in first[c] if r is min(first[c], key=lambda r: r["doc_id"]) or not brute.words(r["text"])]
    docs = [r for r in docs if not any(
        len(c) >= 5 and brute.tiled(c, t, 5) >= 0.6 * len(c) for t in [brute.tokens(r["text"])] for c in cases)]
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    target, out = brute.targets(sizes), []
    for r in docs:
        out += [r] * brute.copies(r["doc_id"], target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0)
    start, found = 0, []
    for r in sorted(out, key=lambda r: r["doc_id"]):
        ids = np.array([*encode(r["text"] or ""), 2], dtype="<u4")
        found.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_pipeline_against_plain_version(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {(r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.language_id(spark, docs, sf))}
    every = rows_of(docs)
    rejected = {(r["doc_id"], r["text"]) for r in every} - kept
    cases = [brute.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # The plain tiling is slow: only cases that share a run of five tokens with a text are tiled.
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    short = [r for r in every if len(r["text"]) < 4000]
    spark.createDataFrame(short, docs.schema).createOrReplaceTempView("short_docs")
    seeds = {tuple(c[i : i + 5]): k for k, c in enumerate(cases) for i in range(len(c) - 4)}

    texts = {id(r): brute.tokens(r["text"]) for r in short}
    near = {k for t in texts.values() for i in range(len(t) - 4) for k in [seeds.get(tuple(t[i : i + 5]))] if k is not None}
    want = plain_pipeline(short, [cases[k] for k in sorted(near)], rejected, lambda t: plain.encode(t, add_special_tokens=False).ids)
    docs = spark.table("short_docs")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in docs.collect())
    assert found == sorted(want) and len(found) > 50


@pytest.mark.parametrize("stage", range(5))
def test_stages_stand_odd_documents(spark, sf, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, content int, key string, copies int"
    text = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by for and threea."
    rows = [(1, text, "en", "s", 1, "i", 1, "k", 1), (1, text, "en", "s", 1, "i", 1, "k", 1), (2, None, None, None, None, None, None, None, None),
            (None, text + " x", "en", None, 2, "i", 1, "k", 1), (3, "", "de", "t", 0, "", 0, "", 0), (4, "De la que. " * 3000, "fr", "t", 9, "", 0, "", 0)]
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(rows, kind)
    out = run(spark, docs, sf)
    if stage < 4:
        assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {0: [None, 1, 1, 4], 1: None, 2: [None, 1, 1, 2, 3, 4], 4: [None, 1, 1, 2, 3, 4]}.get(stage)
    if want:
        assert sorted(kept, key=lambda x: (x is not None, x or 0)) == want
    if stage == 1:
        # The null id is the smallest key of the group of copies; rows without words stay.
        assert sorted(kept, key=lambda x: (x is not None, x or 0)) == [None, 2, 3, 4]
    assert run(spark, docs.limit(0), sf).count() == 0


def test_registered(spark):
    names = set(entrypoint.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
