import math
import random
import tracemalloc
import zlib

from helpers import CLASH, collect, documents
from quarry.llm import langid as L

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en ch ei sch ung ver ge au keit zu", "fr": "eau eux tion ou ai que ment oi le ré"}


def prose(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n)).capitalize() + "."


def slow_phrases(text, corpus):
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in w for w in corpus):
            size += 1
        at, n = at + size, n + 1
    return n


def slow_predict(text, samples):
    """Brute force: longest matches by substring search, over the whole text."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    cost = []
    for lang in sorted(samples):
        corpus = [L.normalised(t) for t in samples[lang]]
        cost.append((slow_phrases(L.normalised(text), corpus) * math.log2(sum(map(len, corpus)) + 2), lang))
    best, other = sorted(cost)[:2]
    return best[1], 1 - best[0] / other[0]


def samples(n=6):
    return {lang: [prose(lang, 25, 100 + k) for k in range(n)] for lang in SYLLABLES}


def test_parse_equals_brute_force(monkeypatch):
    texts = [prose(lang, n, n) for lang in SYLLABLES for n in (1, 2, 3, 9, 40, 90)] + [prose("en", 30, 5) + prose("fr", 30, 6)]
    texts += ["", "x", "жук und der жук", "aaaaaaaaaaaaaaaaaaaa", "thererner " * 30, "É È"]
    plain = [L.normalised(t) for t in texts]
    want = [[slow_phrases(t, [L.normalised(x) for x in samples()[lang]]) for lang in sorted(SYLLABLES)] for t in plain]
    for few in (0, 3, 10, 1000):
        monkeypatch.setattr(L, "_FEW", few)
        assert L.Model(samples()).phrases(plain).tolist() == want
    assert L.Model(samples()).phrases([]).shape == (0, 3)


def test_prediction_equals_brute_force(spark):
    rows = [(i, prose(lang, 1 + i * 3, i)) for i in range(12) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(50, None), (51, ""), (52, "12 ! \u00b2"), (53, "km\u00b2 x\u00b2"), (54, "x\u2082"), (55, "\u2167a"), (56, "हिन्दी"), (57, "\u2167"), (58, prose("de", 900, 1)), (58, "жук")]
    for r in L.predict(documents(spark, rows), samples(), carry=("doc_id", "text")).collect():
        lang, score = slow_predict(r.text, samples())
        assert (r.lang_pred, round(r.score, 12)) == (lang, round(score, 12)), r
        assert (r.phrase_rate is None) == (lang == "und")


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i // 4)}{chr(0x5E00 + i // 4)} " * 5, f"l{i // 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = L.identify(docs).collect()
    assert {r.lang_pred for r in found} == {f"l{k}" for k in range(100)}
    assert all(r.lang_pred == f"l{r.doc_id // 4}" for r in found)


def test_held_out_accuracy(spark):
    rows = [(i, prose(lang, 5 + i % 60, i), lang) for i in range(400) for lang in [list(SYLLABLES)[i % 3]]]
    filled = [(i, t, lang, "s", len(t), 1, 2, 3, 4, 5, 6, 7, "n", "v") for i, t, lang in rows]
    docs = spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)


def test_messy_rows(spark):
    found = L.identify(documents(spark))
    got = collect(found, "doc_id", "lang_pred")
    assert len(got) == 15
    by_id = dict(got)
    assert by_id[1] == by_id[2] == by_id[3] == by_id[6] == "und" and by_id[8] == "en"
    assert all(r.score == 0 for r in found.where("lang_pred = 'und'").collect())
    assert L.identify(documents(spark, []).limit(0)).count() == 0


def test_nothing_to_learn(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in L.identify(docs).collect()} == {"und"}


def test_table_of_the_model_is_held_once():
    texts = {f"l{k}": [prose(lang, 400, 200 + k)] for k in range(9) for lang in [list(SYLLABLES)[k % 3]]}
    tracemalloc.start()
    try:
        model = L.Model(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.7 * model._steps.nbytes


def test_fit_starts_no_python_workers_of_its_own(spark, monkeypatch):
    docs = documents(spark, [(i, prose("en", 9, i)) for i in range(8)]).localCheckpoint()
    want = L.fit(docs)

    def refused(*_, **__):
        raise AssertionError("a list of rows goes through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert L.fit(docs) == want
