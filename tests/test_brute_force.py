"""Registered queries without SQL against slow, independent versions, and sources
that need more than Spark's own files."""

import io
import json
import math
import re
import tarfile
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from quarry import registry
from quarry.functions import constants as C
from quarry.functions.stem import STOP_WORDS, stem
from quarry.operators import entities as E
from quarry.sources import readers as I

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def slow_sentences(text):
    """Character by character: marks, blanks, then an ASCII capital end a sentence."""
    pieces, start, at = [], 0, 0
    while at < len(text):
        if text[at] in ".!?":
            marks = at
            while marks < len(text) and text[marks] in ".!?":
                marks += 1
            blank = marks
            while blank < len(text) and text[blank].isspace():
                blank += 1
            if blank > marks and blank < len(text) and "A" <= text[blank] <= "Z":
                pieces.append(text[start:at])
                start = at = blank
                continue
            at = marks
        else:
            at += 1
    pieces.append(text[start:])
    out, last = [], None
    for piece in (p.strip() for p in pieces):
        if last is not None and any(last.endswith(a) for a in C.ABBREVIATIONS):
            out[-1] = f"{out[-1]}.{piece}"
        else:
            out.append(piece)
        last = piece
    return [p.strip() for p in out if p.strip()]


def test_sentence_split_query(spark, texts):
    got = {}
    for r in registry.QUERIES["sentence_split"](spark, SF).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.digest)
    assert got == {i: [md5(s) for s in slow_sentences(t)] for i, t in texts.items() if slow_sentences(t)}


def test_offset_chunks_query(spark, texts):
    found = {}
    for r in registry.QUERIES["offset_chunks"](spark, SF).orderBy("doc_id", "start").collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, t in texts.items() if t.strip()}
    for i, rows in found.items():
        text, at = texts[i], 0
        for r in rows:
            lead = len(text[r.start :]) - len(text[r.start :].lstrip())
            chunk = text[r.start + lead : r.start + lead + r["size"]]
            assert md5(chunk) == r.digest and len(chunk) <= 4500 and not text[at : r.start].strip()
            at = r.start + lead + r["size"]
            if at < len(text.rstrip()):  # as long as a cut at a word's end allows
                rest = text[r.start : r.start + 4501]
                assert max((k for k, c in enumerate(rest) if c in " \n\t.!?"), default=4500) >= at - r.start - 1
        assert not text[at:].strip()


def test_offset_reconstruction_query(spark, texts):
    rows = registry.QUERIES["offset_reconstruction"](spark, SF).collect()
    slices = {(i, k): t[at : at + 400] for i, t in texts.items() for k, at in enumerate(range(0, max(len(t), 1), 400))}
    assert {(r.doc_id, r.n) for r in rows} == set(slices)
    for r in rows:
        text, part = texts[r.doc_id], re.sub(r"[ \t\n\x0B\f\r]+", " ", slices[r.doc_id, r.n])
        if part in text:
            assert (r.lo, r.hi) == (text.index(part), text.index(part) + len(part))
        elif r.lo is not None:
            got, want = set(text[r.lo : r.hi].split()), set(part.split())
            assert len(got & want) / len(got | want) > 0.85 and r.hi - r.lo <= 2000
    missed = sum(r.lo is None for r in rows)
    assert missed <= 0.02 * len(rows)


def test_structured_chunks_query(spark, texts):
    found = {}
    for r in registry.QUERIES["structured_chunks"](spark, SF).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r)
    checked = 0
    for i, text in texts.items():
        parts = [(n, p) for n, p in enumerate(text.split("\n")) if p]
        if any(n % 10 not in (0, 5) and len(p) > 1200 for n, p in parts) or len(text) > 100_000:
            continue  # only paragraphs that are cut repeat sentences
        chunks, context = [], ""
        for n, p in parts:
            if n % 10 == 0:
                context, opened = p, False
                continue
            last = chunks[-1] if chunks else None
            if last and last[2] and last[0] == context and last[3] == "open" and len(last[1]) + 1 + len(p) <= 1200:
                last[1] += "\n" + p
            else:
                chunks.append([context, p, True, "open"])
        merged = []
        for context, body, *_ in chunks:
            if merged and len(body) < 150 and merged[-1][0] == context and len(merged[-1][1]) + len(body) < 1200:
                merged[-1][1] += "\n" + body
            else:
                merged.append([context, body])
        if len({p for n, p in parts if n % 10 == 0}) == sum(n % 10 == 0 for n, _ in parts):  # headers all differ
            assert [(r["size"], r.digest) for r in found.get(i, [])] == [(len(b), md5(f"{c}|{b}")) for c, b in merged], i
            checked += 1
    assert checked > 50


def test_highlights_query(spark, texts):
    want = set()
    for i, text in texts.items():
        for n, piece in enumerate(re.findall(r"(?is).{0,75}\b(?:the|und)\b.{0,75}", text)[:3]):
            want.add((i, n, re.sub(r"(?i)\b(the|und)\b", r"<mark>\1</mark>", piece)))
    assert {tuple(r) for r in registry.QUERIES["highlights"](spark, SF).collect()} == want


def test_similar_names_query(spark):
    part = [r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()]
    names = sorted({f"{p} ltd" for p in part} | {f"{p} Limited" for p in part})
    norm = {n: E._normalised(n.lower()) for n in names}  # no name has a country
    ratio = {}

    def near(a, b):
        key = (norm[a], norm[b])
        if key not in ratio:
            m = SequenceMatcher(None, *key)
            ratio[key] = m.real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and m.ratio() >= 0.85
        return ratio[key]

    want, gone = set(), set()
    for at, name in enumerate(names):
        if name in gone:
            continue
        kin = [name]
        for other in names[at + 1 :]:
            if other not in gone and near(name, other):
                kin.append(other)
                gone.add(other)
        if len(kin) > 1:
            head = min(kin, key=lambda k: (len(k), k))
            want |= {(head, k) for k in kin}
    found = registry.QUERIES["similar_names"](spark, SF).collect()
    assert {(r.canonical, r.name) for r in found} == want and want


def test_best_matches(spark):
    texts = ["Flood risk", "flood", "the floodplain area", "a b", "x", "", "Storm surge and flood", "ood", "--"]
    concepts = ["Flood", "flood risk pool", "Storm", "plain", "o", "", "b", "Area of risk"]
    norm = lambda t: re.sub(r"[^\w\s-]", "", re.sub(r"\s+", " ", t.strip().lower()))
    want = set()
    for t in texts:
        hits = []
        for c in concepts:
            a, b = norm(t), norm(c)
            if not a or not b:
                continue
            x, y = set(a.split(" ")), set(b.split(" "))
            overlap = len(x & y) / max(len(x), len(y))
            if a == b:
                hits.append((-1.0, c, "exact"))
            elif a in b or b in a:
                hits.append((-min(len(a), len(b)) / max(len(a), len(b)), c, "partial"))
            elif overlap > 0.3:
                hits.append((-overlap, c, "word_overlap"))
        want |= {(t, c, kind, round(-s, 9)) for s, c, kind in sorted(hits)[:3]}
    one = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    found = E.best_matches(one(texts, "text"), one(concepts, "concept"), 3)
    assert {(r.text, r.concept, r.kind, round(r.confidence, 9)) for r in found.collect()} == want
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_stems():
    # published examples of the stemmer
    pairs = """consigned consign consisting consist consistency consist consolation consol consolatory consolatori conspiracy conspiraci
        constance constanc knackeries knackeri knavish knavish kneeled kneel knightly knight knitting knit knives knive generous generous generate generat
        communication communic running run flies fli dies die happy happi enjoy enjoy hopping hop hoping hope relational relat hopefulness hope electrical electr
        skies sky dying die news news inning inning proceed proceed by by say say cry cri gas gas this this gaps gap kiwis kiwi tied tie cease ceas roll roll""".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_bm25_stemmed_query(spark, texts):
    def words(text):
        return [stem(w) for w in re.findall(r"[^\W]+", text.lower()) if w not in STOP_WORDS]

    terms = list(dict.fromkeys(stem(t) for t in ("tioning", "hands", "ereden")))
    fields = {"title": (3.0, {i: words(t.split("\n")[0]) for i, t in texts.items()}), "content": (2.0, {i: words(t) for i, t in texts.items()})}
    best = Counter()
    for boost, held in fields.values():
        n, mean = len(held), sum(map(len, held.values())) / len(held)
        for term in terms:
            assert term
        df = {t: sum(t in w for w in held.values()) for t in terms}
        for i, w in held.items():
            score = 0.0
            for t in terms:
                tf = w.count(t)
                if tf:
                    score += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            best[i] = max(best[i], boost * score)
    want = sorted(((-round(s, 6), i) for i, s in best.items() if round(s, 6) > 0))[:200]
    got = [(-r.score, r.doc_id) for r in registry.QUERIES["bm25_stemmed"](spark, SF).orderBy("rank").collect()]
    assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want))


def test_archives(spark, tmp_path):
    for name, mode in (("a.tar.gz", "w:gz"), ("b.tar", "w")):
        with tarfile.open(tmp_path / name, mode) as out:
            for n in range(3):
                body = json.dumps([{"id": n, "file": name}]).encode()
                info = tarfile.TarInfo(f"x/{n}.json")
                info.size = len(body)
                out.addfile(info, io.BytesIO(body))
            info = tarfile.TarInfo("x/readme.txt")
            info.size = 2
            out.addfile(info, io.BytesIO(b"no"))
    found = I.read_archives(spark, str(tmp_path)).select(F.inline(F.from_json("content", "array<struct<id:int,file:string>>")))
    assert sorted(map(tuple, found.collect())) == [(n, f) for n in range(3) for f in ("a.tar.gz", "b.tar")]


def test_relational_table(spark):
    url, driver = "jdbc:derby:memory:quarry;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(5).selectExpr("id", "concat('n', id) AS name").write.jdbc(url, "things", mode="overwrite", properties=driver)
    got = I.read_table(spark, url, "things", driver).where("id > 2")
    assert sorted((r[0], r[1]) for r in got.collect()) == [(3, "n3"), (4, "n4")]


def test_extraction_bears_any_answer(spark):
    from quarry.operators.extraction import extracted, parsed

    good = 'Sure: {"risks": [{"label": "flood risk", "confidence": 1, "evidence": "x", "section": "D"}, {"label": 3}, 4], "impacts": {}, "mechanisms": [{"label": "New Thing"}]} done'
    assert parsed(good) == [("risks", "flood risk", 1.0, "x", "D"), ("mechanisms", "New Thing", None, None, None)]
    assert parsed(None) == parsed("{") == parsed("no } {") == parsed("{broken}") == parsed("[1]") == []
    words = spark.createDataFrame([("risks", "Flood Risk", "sg:FloodRisk")], "category string, label string, uri string")
    chunks = spark.createDataFrame([(1, 2, "B", "later"), (1, 1, "A", "first"), (2, 1, "A", None)], "doc_id long, n int, section string, text string")
    asked = lambda prompts: [good if "A:\nfirst\nB:\nlater" in p and "- Flood Risk" in p else "none" for p in prompts]
    got = sorted((r.doc_id, r.category, r.uri) for r in extracted(chunks, words, asked).collect())
    assert got == [(1, "mechanisms", "sg:NewThing"), (1, "risks", "sg:FloodRisk")]

    def fails(prompts):
        raise RuntimeError

    assert extracted(chunks, words, fails).count() == 0
