"""The registered queries that SQL cannot express, against brute force."""

import random
import zlib
from collections import defaultdict

import pytest
from helpers import documents, messy_rows
from quarry.llm import langid, queries, tokens
from test_decontaminate import brute_leaks
from test_langid import SYLLABLES, prose, slow_predict
from test_tokens_packing import check


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(2), [(i, t) for i, t in messy_rows() if i != 7]
    for i in range(100, 220):
        lang = list(SYLLABLES)[i % 3]
        out.append((i, prose(lang, draw.randint(1, 60), i)))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("q"))
    langs = [(*r, list(SYLLABLES)[r[0] % 3] if r[0] is not None and r[0] >= 100 else None) for r in rows]
    docs = documents(spark, rows).drop("lang").dropDuplicates(["doc_id", "text"])
    docs.join(spark.createDataFrame(langs, "doc_id long, text string, lang string").select("doc_id", "lang").where("doc_id is not null").distinct(), "doc_id", "left").write.parquet(f"{path}/documents.parquet")
    items = [(k, text) for k, (_, text) in enumerate(rows) if text and len(text.split()) > 12][::7] + [(900, None), (901, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stored(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_op2_and_op5(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(tokens.default_path()), stored(spark, folder)
    check(queries.op5_packing(spark, folder).collect(), rows, tokenizer, 2048)
    counts = defaultdict(int)
    for _, text in rows:
        counts[len(tokenizer.encode(text or "", add_special_tokens=False).ids)] += 1
    assert {r.n_tokens: r.n_docs for r in queries.op2_token_counts(spark, folder).collect()} == dict(counts)


def test_op3(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    want = {(i, r.item_id) for i, t in stored(spark, folder) for r in items if t and r.text and len(r.text.split()) >= 8 and brute_leaks(t, r.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, folder).collect()}
    assert want <= got and want
    for i, item in got - want:  # found over neighbouring diagonals, or by plain values
        text = next(t for d, t in stored(spark, folder) if d == i)
        asked = next(r.text for r in items if r.item_id == item)
        assert len(set(asked.lower().split()) & set(text.lower().split())) >= 0.5 * len(set(asked.lower().split()))


def test_op4(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    samples = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    assert set(samples) == set(SYLLABLES)
    texts = defaultdict(set)
    for i, text in stored(spark, folder):
        lang, score = slow_predict(text, samples)
        texts[i].add((lang, round(score, 10)))
    for r in queries.op4_language_id(spark, folder).collect():
        assert (r.lang_pred, round(r.score, 10)) in texts[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
