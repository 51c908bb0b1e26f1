"""Alignment of two tokenizers against a slow version over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, messy_rows
from hypothesis import example, given, settings
from hypothesis import strategies as st
from quarry.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, _ = alignment.default_paths()
    tokenizer = Tokenizer.from_file(a)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=b)


PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
REST = [b for b in range(256) if b not in PLAIN]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(REST)}


def bytes_a(tokenizer, i):
    return bytes(BYTE[c] for c in tokenizer.id_to_token(i))


def bytes_b(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


_seen: dict = {}


def slow_groups(text, models):
    if not text:
        return None
    a, b = models[0].encode(" " + text, add_special_tokens=False).ids, models[1].encode(text)
    for side, ids, spell in ((0, a, bytes_a), (1, b, bytes_b)):
        for i in set(ids):
            if (side, i) not in _seen:
                _seen[side, i] = spell(models[side], i)
        if b"".join(_seen[side, i] for i in ids) != (" " + text).encode():
            return None
    groups, i, j, end_a, end_b, some = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if not some[0] or (end_a < end_b):
            some[0].append(a[i])
            end_a, i = end_a + len(_seen[0, a[i]]), i + 1
        else:
            some[1].append(b[j])
            end_b, j = end_b + len(_seen[1, b[j]]), j + 1
        if end_a == end_b and all(some):
            groups.append(some)
            some = ([], [])
    return groups


def slow(rows, models):
    found, counts, top = [(i, slow_groups(t, models)) for i, t in rows], Counter(), defaultdict(int)
    for _, groups in found:
        counts.update({(a, b) for g in groups or () for a in g[0] for b in g[1]})
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    for i, groups in found:
        links = [(a, b) for g in groups or () for a in g[0] for b in g[1]]
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups or ())
        yield (
            i, sum(len(g[0]) for g in groups or ()), sum(len(g[1]) for g in groups or ()), len(groups or ()), len(links),
            sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        )


ODD = [
    "\tfoo", "a\n b", "a \r\n\r b;\r", "  x  y  ", "▁x", "a▁b c", "<s>hi</s> <|endoftext|><0x41>", "aaaa" * 300, "漢字かな交じり文" * 50, "\x00\x01 \x7f", "é é",
    "\xa0x\xa0 y　 z", "don't I'll x's", " " * 500 + "x", "\n\n\n", "1234567 12 3", "🎉🎉 🎉", "word;\rnext );\r\n}\r", "﻿x", "İ. İ", " ", "x y z\x1c w", "a\x85b c",
]


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 2000])
def test_messy_rows(spark, models, chunk_bytes):
    rows = messy_rows() + [(100 + k, t) for k, t in enumerate(ODD)]
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(documents(spark, rows), chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=repr) == sorted(slow(rows, models), key=repr)


def test_query_over_the_given_table(spark, models):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op12_alignment(spark, folder).collect()]
    assert sorted(got) == sorted(slow(rows, models))


def test_no_rows_and_no_tokens(spark):
    assert alignment.align(documents(spark, []).limit(0)).collect() == []
    got = alignment.align(documents(spark, [(1, None), (None, "")])).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, 'ab'")
    assert {r.doc_id: r.n_a for r in alignment.align(docs).collect()} == {1: 0, 2: 1}


@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
@example([" a", "\n", "\r", ";\r", "x\ty"])
@example(["é", "ⅷ٣", "ǆ", "̀", "Ꭰ", "𞤀"])
@settings(max_examples=150, deadline=None)
def test_parts_are_exact(models, texts):
    """Encoding part by part, and many parts at once, gives what whole texts give."""
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    found = alignment.aligner(alignment.default_paths()).align(texts)
    assert [tuple(r[:4]) for r in found["totals"].tolist()] == [r[1:5] for r in slow(list(enumerate(texts)), models)]
    assert found["hashes"] == [r[7] for r in slow(list(enumerate(texts)), models)]


def test_links_of_a_long_group_are_counted_not_listed(monkeypatch):
    """3000 A and 2000 B tokens of few ids in one group: six million links."""
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 40, 3000), draw.integers(0, 30, 2000)
    want = Counter()
    for x, n in Counter(a.tolist()).items():
        for y, m in Counter(b.tolist()).items():
            want[x << 16 | y] += n * m
    for block in (alignment._PAIRS, 100):
        monkeypatch.setattr(alignment, "_PAIRS", block)
        keys, links = alignment._pairs(np.array([5]), np.zeros(3000, int), a, np.zeros(2000, int), b)
        assert set((keys >> 32).tolist()) == {5} and dict(zip((keys & 0xFFFFFFFF).tolist(), links.tolist())) == dict(want)
