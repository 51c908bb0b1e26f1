import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from helpers import collect, documents, messy_rows, words
from quarry.llm import decontaminate, packing, tokens
from test_simhash import slow_simhash
from test_substring_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture()
def folder(spark, tmp_path):
    items = spark.createDataFrame([(1, words(30, 77)), (2, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def corpus():
    rows = [(i, words(60 + i, i, 3000)) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, f"{words(40, 300, 3000)} {words(30, 77)} {words(40, 301, 3000)}")]
    rows += [(103, f"{words(30, 302, 3000)} {' '.join(rows[29][1].split()[:70])} {words(30, 303, 3000)}"), (104, None), (105, "123 456 !"), (106, "")]
    random.Random(1).shuffle(rows)
    return rows


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]


def test_language_stage_keeps_readable_documents(spark, folder):
    got = collect(P.language_id(spark, documents(spark, corpus()).select(*COLUMNS), folder), "doc_id")
    assert got == sorted(((i,) for i, _ in corpus() if i not in (104, 105, 106)), key=repr)


def test_near_dedup_stage_keeps_one_of_each_group(spark, folder):
    found = P.near_dedup(spark, documents(spark, corpus() + [corpus()[0]]).select(*COLUMNS), folder)
    assert found.columns == COLUMNS
    kept, seen = [], []
    for i, text in sorted(corpus(), key=lambda r: r[0]):
        fp = slow_simhash(text, 5)
        if all((fp ^ other).bit_count() > 2 for other in seen):
            kept.append((i,))
        seen.append(fp)
    assert collect(found, "doc_id") == sorted(kept, key=repr)


def test_near_dedup_stage_tells_texts_of_one_id_apart(spark, folder):
    a, b, c = (words(60, k, 3000) for k in (1, 2, 3))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, f"{b} two more"), (4, c), (None, a), (None, c), (None, words(9, 4)), (5, None), (6, ""), (7, b), (7, b)]
    docs = documents(spark, rows).select(*COLUMNS, F.lit("mine").alias("_nth"), F.lit(1).alias("kept"), F.lit(2).alias("copy"))
    found = P.near_dedup(spark, docs, folder)
    assert found.columns == docs.columns and {r["_nth"] for r in found.collect()} == {"mine"}
    assert collect(found, "doc_id", "text") == sorted([(1, a), (2, b), (3, c), (None, words(9, 4)), (5, None)], key=repr)
    alone = documents(spark, [(7, b), (7, b), (None, c), (None, c)]).select(*COLUMNS)
    assert collect(P.near_dedup(spark, alone, folder), "doc_id", "text") == sorted([(7, b), (None, c)], key=repr)


def test_near_dedup_stage_links_by_simhash_and_by_similarity(spark, folder):
    a, b, tail = words(7, 1, 3000), words(60, 2, 3000), words(9, 3, 3000)
    much = f"{a} " * 60
    # 1, 2: close SimHashes, sets of shingles not alike; 5, 6: alike
    rows = [(1, f"{much}{words(20, 4, 3000)}"), (2, f"{much}{tail} {words(8, 5, 3000)}"), (5, b), (6, f"{b} two more"), (7, words(30, 6, 3000))]
    first, second = (slow_simhash(t, 5) for _, t in rows[:2])
    assert (first ^ second).bit_count() <= 2
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows[:2]]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert collect(P.near_dedup(spark, documents(spark, rows).select(*COLUMNS), folder), "doc_id") == [(1,), (5,), (7,)]
    # 8 is near 2 by its set alone, so it goes with 1 through a link of each kind
    chain = [*rows, (8, f"{a} {a} {tail} {words(8, 5, 3000)}")]
    assert (slow_simhash(chain[-1][1], 5) ^ first).bit_count() > 2
    assert collect(P.near_dedup(spark, documents(spark, chain).select(*COLUMNS), folder), "doc_id") == [(1,), (5,), (7,)]


def test_language_stage_uses_its_prediction(spark, folder):
    rows = [(i, f"the house of the river and the {'green' if i % 2 else 'blue'} hill", "en") for i in range(30)]
    rows += [(40, "the house and the hill", None), (41, "ξψωφ θδλπ ςρτυ ξψωφ", None), (42, "ξψ", "en"), (43, None, "en"), (44, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(collect(P.language_id(spark, docs, folder), "doc_id", "lang"))
    assert set(got) == set(range(30)) | {40, 42} and set(got.values()) == {"en"}


def test_substring_stage_cuts_later_passages(spark, folder):
    rows = corpus()
    found = {r.doc_id: r for r in P.substring(spark, documents(spark, rows).select(*COLUMNS), folder).collect()}
    want = {i: (n, m) for i, n, m, _ in brute(rows, 50)}
    texts = dict(rows)
    assert set(found) == {i for i, (n, m) in want.items() if m == 0 or m < n}
    for i, r in found.items():
        assert len((r.text or "").split()) == want[i][0] - want[i][1]
        assert want[i][1] or r.text == texts[i]
        assert r.n_chars == (len(r.text) if r.text is not None else None)


def test_decontamination_stage(spark, folder):
    found = P.decontamination(spark, documents(spark, corpus()).select(*COLUMNS), folder)
    assert found.columns == COLUMNS
    assert collect(found, "doc_id") == sorted(((i,) for i, _ in corpus() if i != 102), key=repr)


def test_whole_run_equals_stages(spark, folder):
    documents(spark, corpus()).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for at, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{at}")
        docs = spark.read.parquet(f"{folder}/stage{at}")
    assert collect(docs, "doc_id", "piece", "length", "ids_crc32") == collect(P.run(spark, folder), "doc_id", "piece", "length", "ids_crc32")
    before = spark.read.parquet(f"{folder}/stage3").collect()
    encoder = tokens.WordEncoder(tokens.default_path())
    want = sum(len(encoder.encode((r.text or "").encode())) // 4 + 1 for r in before)
    assert sum(r[0] for r in collect(docs, "length")) == want and packing.plan({}, 1) == []


def test_stages_bear_messy_and_empty_tables(spark, folder):
    for rows in (messy_rows(), []):
        docs = documents(spark, rows)
        docs = docs if rows else docs.limit(0)
        for _, stage in P.STAGES[:-1]:
            found = stage(spark, docs, folder)
            assert found.columns == docs.columns and found.count() <= max(len(rows), 0)
        assert P.pack(spark, docs, folder).count() >= len(rows)


def test_import_errors_are_not_hidden():
    source = open(P.__file__).read() + open(decontaminate.__file__).read()
    assert "except ImportError" not in source and "ModuleNotFoundError" not in source


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = documents(spark, corpus()).withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2)).withColumn("x`y", F.lit(3))
    for _, stage in P.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns and {(r["a.b"], r["row"], r["x`y"]) for r in found.collect()} <= {(1, 2, 3)}
