"""Operators without SQL, sources, sinks, requests and streaming helpers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from quarry import requests as R
from quarry.functions import text as T
from quarry.operators import entities as E
from quarry.operators import graph as G
from quarry.operators import search as S
from quarry.operators import spans as P
from quarry.operators import tables as M
from quarry.sinks import writers as W
from quarry.sources import readers as I
from quarry.streaming import changes as C


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_sentences():
    text = "Dr. Smith went home. He slept!  Then, e.g. The cat. no capital? Yes"
    assert P.split_sentences(text) == ["Dr.Smith went home", "He slept", "Then, e.g.The cat. no capital", "Yes"]
    assert P.split_sentences(None) == [] and P.split_sentences("  ") == []


def test_offset_chunks_cover_the_text():
    draw = random.Random(1)
    for _ in range(50):
        text = "".join(draw.choice("abcdefg .!\n") for _ in range(draw.randrange(400)))
        found = P.split_with_offsets(text, 37)
        assert all(text[at:].startswith(chunk) or text[at:].lstrip().startswith(chunk) for at, chunk in found)
        assert all(len(c) <= 37 for _, c in found)
        assert "".join("".join(c.split()) for _, c in found) == "".join(text.split())


def test_packed_chunks(spark):
    parts = ["a" * 400, "b" * 500, "c" * 300, "d" * 1200, "", "e"]
    got = spark.createDataFrame([(parts,), ([],)], "v array<string>").select(P.packed(F.col("v"))).collect()
    want, current = [], ""
    for p in parts:
        if len(current) + len(p) > 1000 and current:
            want, current = [*want, current], p
        else:
            current = f"{current}\n\n{p}" if current else p
    assert got[0][0] == [*want, current] and got[1][0] == []


def test_reconstruct_offsets():
    text = "Intro. The quick  brown\nfox jumps over the lazy dog and then it sleeps for a long time under the tree. End."
    chunk = "The quick brown fox jumps over the lazy dog and then it sleeps for a long time under the tree."
    lo, hi = P.reconstruct_offsets(text, chunk)
    assert text[lo:hi].split() == chunk.split() and P.reconstruct_offsets(text, "nothing like it at all here") is None


def test_overlap_join_equals_brute_force(spark):
    draw = random.Random(2)
    spans = [(d, lo, lo + draw.randrange(0, 900)) for d in range(3) for lo in draw.sample(range(4000), 30)]
    chunks = [(d, lo, lo + draw.randrange(1, 1500)) for d in range(3) for lo in draw.sample(range(4000), 10)]
    got = P.overlap_join(spark.createDataFrame(spans, "doc_id long, lo long, hi long"), spark.createDataFrame(chunks, "doc_id long, start long, stop long"), bucket=100)
    want = sorted((d, lo, hi, s, e, max(0, lo - s), min(hi - s, e - s)) for d, lo, hi in spans for x, s, e in chunks if d == x and lo < e and hi > s)
    assert sorted(tuple(r) for r in got.select("doc_id", "lo", "hi", "start", "stop", "relative_lo", "relative_hi").collect()) == want


def test_highlight(spark):
    found = one(spark, "aa the bb " * 40).select(P.highlighted(F.col("v"), ["the"])).first()[0]
    assert 1 <= len(found) <= 3 and all("<mark>the</mark>" in f for f in found)


def test_similar_names(spark):
    names = ["Ministry of Health (Japan)", "Min of Health (Japan)", "Ministry of Health (Laos)", "Ministry of Finance", "Alpha Ltd", "Alpha Limited"]
    groups = E.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), block=F.lit("all"))
    kin = {frozenset(r.name for r in groups.collect() if r.canonical == c) for c in {r.canonical for r in groups.collect()}}
    assert kin == {frozenset(names[:2]), frozenset(names[4:])}
    assert dict((r.canonical, r.best) for r in E.best_names(groups).collect())["Alpha Ltd"] == "Alpha Limited"


def test_similar_names_equal_all_pairs(spark):
    draw = random.Random(11)
    names = ["Institute of Tropical Medicine", "Institute of Tropical Medicines", "Xinistry of Finance", "Ministry of Finance", "The Ministry of Finance", "ab", "abc", "x"]
    for _ in range(40):
        base = "".join(draw.choice("abcdef ") for _ in range(draw.randrange(3, 40))).strip() or "q"
        names += [base, base[1:], f"z{base}", base[: len(base) // 2] + "y" + base[len(base) // 2 :], f"{base} (Japan)", f"{base}e (Laos)"]
    names = sorted({n for n in names if n})
    left, want = [(n, *spark_base(n)) for n in names], set()
    while left:
        seed = left.pop(0)
        kin = [o for o in left if not (seed[2] and o[2] and seed[2] != o[2]) and E.name_similarity(seed[1], o[1]) >= 0.85]
        left = [o for o in left if o not in kin]
        if kin:
            want.add(frozenset([seed[0], *[o[0] for o in kin]]))
    groups = E.similar_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {frozenset(r.name for r in groups if r.canonical == c) for c in {r.canonical for r in groups}} == want
    assert any({"Xinistry of Finance", "Ministry of Finance"} <= g for g in want)


def spark_base(name):
    return (name[: name.index("(")].strip(), name[name.index("(") + 1 : -1]) if "(" in name else (name, "")


def test_context_boost(spark):
    kind = "ontology string, entity string, confidence double, country string, admin1 string, population long, title string, keywords array<string>, locations array<string>, signals array<string>"
    rows = [
        ("geonames", "x", 0.1, "US", "Ohio", 2_000_000, "Floods in the USA", ["k"], ["Ohio River", "America"], ["geographic:country_context"]),
        ("geonames", "x", 0.1, "FR", None, 50, "USA report", ["k"], [], []), ("geonames", "x", 0.1, "GB", "", 150_000, "museum of art", [], ["gb"], ["geographic:regional_directional"]),
        ("other", "Flood", 0.9, None, None, None, "on floods", ["flood"], [], ["a", "b", "c", "d"]),
    ]
    got = E.context_boost(spark.createDataFrame(rows, kind)).collect()
    assert [r.confidence for r in got] == pytest.approx([1.0, -0.05, 0.57, 1.0])
    assert got[0].context_signals == ["doc_north_american_context", "co_occurrence_with_2_locations", "semantic_geographic:country_context", "major_city_population"]
    assert got[3].context_signals == ["semantic_a", "semantic_b", "semantic_c"]


def test_embedding_failure_is_zero(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in E.embed(rows, model, size=2, batch=1).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 1.0]}


def test_rrf_and_normalisation(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "doc_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("y", 4), ("z", 2)], "doc_id string, rank int")
    assert {r.doc_id: round(r.rrf, 9) for r in S.fuse(a, b).collect()} == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 64, 9), "z": round(1 / 62, 9)}
    assert {r.rrf for r in S.fuse(a.limit(0), b, best=True).where("doc_id = 'y'").collect()} == {1 / 61}
    zero = spark.createDataFrame([("x", 0.0)], "doc_id string, score double")
    assert S.max_normalised(zero, "score").first().score == 0.0


def test_parse_nquads(spark):
    lines = ['<a> <p> "x \\"y\\""@en <g> .', "_:b <p> <c> .", '<a> <p> "1"^^<t> .', "junk"]
    got = [tuple(r) for r in G.parse_nquads(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("a", "p", 'x \\"y\\"', "literal", None, "en", "g"), ("_:b", "p", "c", "iri", None, None, None), ("a", "p", "1", "literal", "t", None, None)]


def test_subject_documents(spark):
    data = spark.createDataFrame([("s", "p", "1", "literal", "g"), ("s", "p", "2", "literal", None), ("s", "q", "3", "literal", "g")], "s string, p string, o string, o_kind string, g string")
    got = G.subject_documents(data).first().predicates
    assert {k: sorted(v.value for v in vs) for k, vs in got.items()} == {"p": ["1", "2"], "q": ["3"]}


def test_bundles_of_the_docstring_case(spark):
    rows = [(1, 1, "v", "ADD"), (1, 2, "v", "ADD"), (1, 3, "v", "REMOVE"), (2, 1, "v", "ADD")]
    data = spark.createDataFrame(rows, "commit_num long, op_num long, key string, op string")
    numbers = lambda df: [r.bundle for r in df.orderBy("commit_num", "op_num").collect()]
    assert numbers(C.bundled(data, optimised=True)) == [1, 1, 2, 3] and numbers(C.bundled(data)) == [1, 1, 2, 1]


def test_upsert_and_violations(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, r int")
    changes = spark.createDataFrame([(2, "c", 1), (2, None, 2), (3, "d", 1)], "id long, v string, r int")
    assert sorted(tuple(r) for r in M.upsert(target, changes, ["id"], ["r"]).collect()) == [(1, "a", 0), (2, None, 2), (3, "d", 1)]
    assert {r["rule"]: r["n"] for r in M.violations(changes, {"v": F.col("v") == "c"}).collect()} == {"v": 2}


def test_csv_folder(spark, tmp_path):
    (tmp_path / "one.csv").write_text('﻿No.,Name,Country,Type of Solution ,Description\n1,Alpha,Laos,x,"two\nlines"\n2,,Laos,y,z\n3,Beta,N/A,nil,--\n', encoding="utf-8")
    (tmp_path / "old.backup.csv").write_text("No.,Name\n1,Gone\n")
    rows = {r.name: r for r in I.read_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Alpha", "Beta"} and rows["Alpha"].description == "two\nlines"
    assert (rows["Beta"].country, rows["Beta"].type_of_solution, rows["Beta"].description, rows["Beta"].id) == ("", "", "", "one_3")
    assert rows["Alpha"].doc_id.startswith("sol_") and len(rows["Alpha"].doc_id) == 21


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"doc_id": "a"}\n{"doc_id": "b", "skip": true}\n{"doc_id": "c", "skip": null}\n')
    assert [r.doc_id for r in I.read_manifest(spark, str(tmp_path / "m.jsonl"), "doc_id string").collect()] == ["a", "c"]
    (tmp_path / "v.ttl").write_text('@prefix sg: <x> .\nsg:A a skos:Concept ;\n  skos:prefLabel "Flood" .\n# note\nsg:B a skos:Concept ;\n  rdfs:label "Fire" .\n')
    assert sorted(tuple(r) for r in I.read_vocabulary(spark, str(tmp_path / "v.ttl")).collect()) == [("fire", "sg:B"), ("flood", "sg:A")]
    (tmp_path / "map.txt").write_text("x = {\n  'Laos': 'gn:1655842',  # a\n  \"Chad\": \"gn:1\",\n}\n")
    assert sorted(tuple(r) for r in I.read_mapping(spark, str(tmp_path / "map.txt")).collect()) == [("Chad", "gn:1"), ("Laos", "gn:1655842")]
    record = '<?xml?><gn:Feature><gn:name>Vientiane</gn:name><gn:featureCode rdf:resource="https://x/o#P.PPLC"/><gn:population>10</gn:population><wgs84_pos:lat>17.9</wgs84_pos:lat></gn:Feature>'
    (tmp_path / "f.rdf").write_text(f"https://x/1/\n{record}\nhttps://x/2/\n{record.replace('Vientiane', 'Pakse')}\n")
    got = sorted(tuple(r) for r in I.feature_fields(I.read_features(spark, str(tmp_path / "f.rdf"))).select("url", "name", "code", "population", "lat").collect())
    assert got == [("https://x/1/", "Vientiane", "P.PPLC", 10, 17.9), ("https://x/2/", "Pakse", "P.PPLC", 10, 17.9)]
    assert I.split_script("# c\nPREFIX a: <b>\nINSERT DATA { x } ;\nPREFIX c: <d>\nDELETE { y }") == ["PREFIX a: <b>\nINSERT DATA { x }", "PREFIX a: <b>\nPREFIX c: <d>\nDELETE { y }"]


def test_blocks(spark):
    rows = spark.createDataFrame([(1, 2, "LINE", "b"), (1, 1, "LINE", "a"), (1, 3, "WORD", "c")], "doc_id long, n int, type string, text string")
    assert I.text_of_blocks(rows).first().text == "a\nb"


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    W.write_texts(docs, f"{tmp_path}/t")
    assert {r.value for r in spark.read.text(f"{tmp_path}/t").collect()} == {"x", "y"}
    W.write_vectors(spark.createDataFrame([(1, "c"), (None, "d")], "doc_id long, chunk_id string"), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 1
    for _ in range(2):
        W.append_audit(docs, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    W.index(docs, spark.createDataFrame([(2, "z")], "doc_id long, text string"), "doc_id", "text", f"{tmp_path}/i")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/i").collect()) == ["x", "z"]
    W.unindex(docs, docs.where("doc_id = 1"), "doc_id", f"{tmp_path}/u")
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/u").collect()] == ["y"]
    W.write_chunks(docs, f"{tmp_path}/c")
    W.write_manifest(docs, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == spark.read.json(f"{tmp_path}/c").count() == 2
    chunk = spark.createDataFrame([("d", "k", 'a "q"', 1, None)], "doc_id string, chunk_id string, text string, start int, stop int")
    W.write_turtle(W.chunk_turtle(chunk), f"{tmp_path}/ttl")
    assert W.chunk_turtle(chunk).first().value == 'sg:k a sgm:Chunk ;\n    sgm:partOf sg:d ;\n    sgm:text "a \\"q\\"" .'


def test_requests():
    cursor = R.encode_cursor("q", 2)
    assert R.decode_cursor(cursor) == {"query_id": "q", "page": 2}
    good = R.parse_request({"query": "flood", "filters": {"countries": ["laos"], "ppp_involvement": True}, "parameters": {"max_results": 5, "cursor": cursor}})
    assert good.parameters["max_results"] == 5 and R.parse_request({}).parameters["max_results"] == 20
    for bad in ([], {"query": 1}, {"parameters": {"max_results": 0}}, {"parameters": {"max_results": True}}, {"parameters": {"cursor": "!!"}}, {"filters": {"region": "x"}}, {"filters": {"ppp_involvement": "yes"}}):
        with pytest.raises(R.RequestError):
            R.parse_request(bad)
    assert R.scoring({"weights": {"graph": 1}})["weights"] == {"keyword": 0.6, "vector": 4.16, "graph": 1} and R.scoring()["weights"]["graph"] == 0.5
    assert R.without_nulls({"a": None, "b": [{"c": None, "d": 1}]}) == {"b": [{"d": 1}]}
    kept = R.Plugins("thing")
    kept.add("x")(len)
    assert kept.get("x") is len
    with pytest.raises(KeyError):
        kept.get("y")


def test_job_timeouts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, "run", 0), (2, "run", 0)], [(2, "done", 60), (3, "run", 20_000)], [(3, "run", 20_060)]]):
        spark.createDataFrame([(j, s, base + dt.timedelta(seconds=t)) for j, s, t in rows], "job long, status string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
    out = []
    stream = spark.readStream.schema("job long, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    found = C.with_timeouts(stream.withWatermark("ts", "1 second"))
    listener = C.LagListener()
    spark.streams.addListener(listener)
    C.drain(found, lambda b, i: out.extend(tuple(r) for r in b.collect()), f"{tmp_path}/ck")
    spark.streams.removeListener(listener)
    assert (2, "done") in out and (1, "timed_out") in out and (3, "timed_out") not in out


def test_text_cases(spark):
    got = one(spark, "in 1998, 07, 98, 99 and 97; 5").select(T.years(F.col("v"))).first()[0]
    assert got == ["1997", "1998"]
    assert one(spark, "07 in 2012, 12").select(T.years(F.col("v"))).first()[0] == ["2012"]
    lists = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "v array<string>").select(T.oxford_list(F.col("v"))).collect()
    assert [r[0] for r in lists] == ["", "a", "a and b", "a, b, and c"]


def test_index_filters(spark):
    from quarry.functions.constants import INDEXED_PREDICATES

    label, name = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.geonames.org/ontology#name"
    places = "http://www.geonames.org/ontology/data"
    rows = [
        ("a", name, "x", "literal", None, places), ("a", label, "x", "literal", None, places), ("_:b", name, "x", "literal", None, places),
        ("a", name, "1", "literal", "http://www.w3.org/2001/XMLSchema#integer", places), ("a", G.RDF_TYPE, "t", "iri", None, places), ("a", "p", "t", "iri", None, None),
    ]
    data = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, g string")
    assert G.whitelisted(data, INDEXED_PREDICATES).count() == 3
    assert sorted((r.s, r.p) for r in G.indexable(data).collect()) == sorted([("a", name), ("a", label), ("a", G.RDF_TYPE)])
    records = spark.createDataFrame([("vp", "String"), ("vp", "Int"), ("e", "String")], "type string, dataType string")
    assert G.indexable_properties(records).count() == 1 and G.indexable_properties(records, edges=True).count() == 2


def test_structured_chunks(spark):
    blocks = [("header", "One"), ("paragraph", "a" * 100), ("list", "* " * 700), ("paragraph", "Short."), ("header", "Two"), ("paragraph", " ".join(f"Sentence number {i}." for i in range(100)))]
    found = P.structured(blocks)
    assert found[0] == ("One", "a" * 100, ["paragraph"]) and found[1][1] == "* " * 700 and found[2] == ("One", "Short.", ["paragraph"])
    two = [c for c in found if c[0] == "Two"]
    assert len(two) > 1 and all(len(c[1]) <= 1200 for c in two) and two[1][1].startswith(two[0][1].rsplit(". ", 1)[1])
    assert P.structured([]) == [] and P.structured([("header", "x")]) == []
    rows = [(1, n, k, t) for n, (k, t) in enumerate(blocks)]
    random.Random(1).shuffle(rows)
    got = P.structured_chunks(spark.createDataFrame(rows, "doc_id long, n int, kind string, text string")).orderBy("chunk_index").collect()
    assert [(r.context, r.text, r.kinds) for r in got] == found
