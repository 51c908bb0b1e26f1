"""Fuzzy terms against edit distances of all pairs."""

import random

from pyspark.sql import functions as F

from quarry.operators import fuzzy, postings


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(query):
    return 0 if len(query) < 3 else 1 if len(query) < 6 else 2


def test_near_terms_equal_all_pairs(spark):
    draw = random.Random(4)
    words = {"", "a", "ab", "ba", "abc", "äbc", "äöüäöü", "äöüäö", "aaaaaa", "aaaa", "aaaaaaaa", "x" * 3000, "straße", "strasse"}
    for _ in range(150):
        words.add("".join(draw.choice("abcd") for _ in range(draw.randrange(1, 10))))
    asked = [*draw.sample(sorted(words - {"x" * 3000}), 60), "", "aaaaaa", "aaaaaa", "unseen", None]
    want = {(q, t, distance(q, t)) for q in set(asked) - {None} for t in words if abs(len(q) - len(t)) <= 2 and distance(q, t) <= allowed(q)}
    terms = spark.createDataFrame([*((w,) for w in words), ("ab",), (None,)], "term string")
    found = fuzzy.near_terms(terms, spark.createDataFrame([(q,) for q in asked], "query string")).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 100
    assert fuzzy.near_terms(terms.limit(0), spark.createDataFrame([("abc",)], "query string")).count() == 0
    assert fuzzy.near_terms(terms, spark.createDataFrame([], "query string")).count() == 0


def test_search_in_the_index(spark, tmp_path):
    texts = {1: "flood floods flod and storm", 2: "flood flood", 3: "fluid", 4: None, 5: "stormy storms sturm", 6: ""}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    postings.build(docs, "id", {"body": F.col("text"), "twice": F.concat_ws(" ", "text", "text")}, str(tmp_path))
    found = fuzzy.fuzzy_search(spark, str(tmp_path), spark.createDataFrame([("flood",), ("storms",), ("zzz",)], "query string"))
    want = {}
    for query in ("flood", "storms", "zzz"):
        for doc, text in texts.items():
            near = [(w, distance(query, w)) for w in (text or "").split() if distance(query, w) <= allowed(query)]
            if near:
                want[query, doc] = (len({w for w, _ in near}), 3 * len(near), min(d for _, d in near))
    assert {(r.query, r.doc_id): (r.terms, r.hits, r.nearest) for r in found.collect()} == want and ("storms", 5) in want
