import random

import xxhash
from helpers import collect, documents, messy_rows, words
from quarry.llm import queries
from quarry.llm import simhash as S
from quarry.llm._shared import connected_components


def slow_simhash(text, k=3):
    found = (text or "").encode()
    for a in range(65, 91):
        found = found.replace(bytes([a]), bytes([a + 32]))
    ws = found.split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_definition():
    for _, text in messy_rows():
        assert S.simhash(text) == slow_simhash(text)


def test_all_rows_and_groups(spark):
    rows = messy_rows()
    found = S.near_duplicates(documents(spark), 3)
    got = collect(found, "doc_id", "fingerprint")
    assert got == sorted(((i, f"{S.simhash(t):016x}") for i, t in rows), key=repr)
    by_id = dict(collect(found, "doc_id", "component_id"))
    assert by_id[1] == by_id[2] == by_id[3] == 1  # no words
    assert by_id[4] == by_id[5] == 4
    assert by_id[8] == by_id[10] == by_id[None] or by_id[8] == by_id[10] == 8


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(9)
    base = [words(n, n, 60) for n in (1, 2, 3, 4, 30, 300, 900)]
    rows = messy_rows() + [(100 + i, t) for i, t in enumerate(base)]
    for i in range(120):  # few words changed in long texts move few bits or none
        text = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = f"w{draw.randrange(60)}"
        rows.append((draw.randrange(200, 400), " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [slow_simhash(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = components(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted(((i, f"{fps[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows)), key=repr)
    assert collect(queries.op1_simhash(spark, str(tmp_path)), "doc_id", "fingerprint", "component_id") == want
    assert len(links) > 200


def test_links_equal_brute_force(spark):
    draw = random.Random(5)
    fps = set()
    for _ in range(40):
        base = draw.getrandbits(64)
        for _ in range(12):
            base ^= 1 << draw.randrange(64)
            fps.add(base)
    for a in range(20):  # a dense group that overflows a bucket
        fps |= {(1 << a) ^ (1 << b) for b in range(64)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    for distance in (1, 2):
        links = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
        want = components(links, fps)
        df = spark.createDataFrame([(f,) for f in fps], "fp long")
        for limit in (4, 64, 10_000):
            edges = S.linked(df, distance, limit).collect()
            assert components([(e.u, e.v) for e in edges], fps) == want, (distance, limit)


def test_empty_table(spark):
    assert S.near_duplicates(documents(spark, []).limit(0)).count() == 0


def test_connected_components(spark):
    draw = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(120)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    want = components([e for e in links if e[0] != e[1]], nodes)
    df = spark.createDataFrame(links + [(None, 1), (7, 7)], "u long, v long")
    assert dict(collect(connected_components(df), "node", "root")) == want
    assert connected_components(df.limit(0)).count() == 0
