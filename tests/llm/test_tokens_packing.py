import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import collect, documents, messy_rows
from quarry.llm import packing, token_counts, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_by_word_is_exact(tokenizer):
    texts = ["<|endoftext|> hi", "a<|endoftext|>b <|ENDOFTEXT|> c<|startoftext|>.", "<|ENDOFTEXT|>", "<|endoftext", "naïve. naïve, (x) x) don't'. it's!'s क़ख़ क़. İstanbul, ﬁn. 1st! ab12, 3.5% Å Å. m² ...", "e\u0301t\u00e9. e\u0301, ½! \ufffd. Ⅷ."]
    texts += ["It's we'LL they'd ÉÀ é x y  a\tb", "<|endoftext|> hello<|startoftext|>", "12.5km!!! --'s 漢字 Ω ΣΑΣ İ", "a" * 500, "\x85 z", ""]
    encoder = tokens.WordEncoder(tokens.default_path())
    for text in texts + [t or "" for _, t in messy_rows()]:
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids(tokenizer, text)


def test_letters_that_become_letter_and_mark(tokenizer):
    """Every letter that NFC or lower-casing changes, before and after others and with
    punctuation behind it, encoded together with plain words."""
    changed = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and unicodedata.normalize("NFC", chr(c)).lower() != chr(c)]
    marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    texts = [f"{w}{m}" for w in ("\u0130", "ij\u0130", "\u0958", "\ufb2a", "a\u0958b") for m in marks]
    texts += [f"x{c}{marks[k % len(marks)]} {c}y{marks[k % 7]} {c}. {c}," for k, c in enumerate(changed)]
    draw = random.Random(11)
    texts += ["".join(draw.choice([*changed, *marks, *"abc", " "]) for _ in range(40)) for _ in range(1500)]
    encoder = tokens.WordEncoder(tokens.default_path())
    found = [np.frombuffer(f, "<u4").tolist() for f in encoder.encode_all(t.encode() for t in texts)]
    assert [t for t, f in zip(texts, found) if f != ids(tokenizer, t)] == []


def test_cache_overflow(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 5)
    encoder = tokens.WordEncoder(tokens.default_path())
    text = "one two three four five six seven one two"
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == ids(tokenizer, text)


def test_generations_keep_ids_exact(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 7)
    monkeypatch.setattr(tokens, "_JOINED", 3)
    monkeypatch.setattr(tokens, "_TOGETHER", 40)
    encoder, draw = tokens.WordEncoder(tokens.default_path()), random.Random(3)
    some = ["alpha", "beta.", "Gamma!?", "été", "été,", "x1", "don't", "क़", "d'accord.", "漢字", "w" * 60 + ".", "<|endoftext|>", "--"]
    texts = [" ".join(draw.choices(some, k=draw.randint(0, 9))) for _ in range(300)]
    for text, found in zip(texts, encoder.encode_all([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == ids(tokenizer, text)
    assert len(encoder._known) <= 7 and list(encoder.encode_all([None])) == [b""]


def test_counts_equal_brute_force(spark, tokenizer):
    lengths = [len(ids(tokenizer, t)) for _, t in messy_rows()]
    table = token_counts.count_tokens(documents(spark)).collect()
    assert sorted(r.n_tokens for r in table) == sorted(set(lengths))
    for r in table:
        longer = [n for n in lengths if n > r.n_tokens]
        assert (r.n_docs, r.docs_longer, r.tokens_longer) == (lengths.count(r.n_tokens), len(longer), sum(longer))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
    q = dict(collect(token_counts.quantiles(token_counts.count_tokens(documents(spark)), [0.5, 1.0]), "q", "n_tokens"))
    assert q[1.0] == max(lengths) and q[0.5] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.count_tokens(documents(spark, []).limit(0)).count() == 0


def check(rows, texts, tokenizer, capacity):
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        spans[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, text in texts:
        seq = np.array(ids(tokenizer, text) + [0], dtype="<u4")
        for k, at in enumerate(range(0, len(seq), capacity)):
            part = seq[at : at + capacity]
            want[i].append((k, at, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for content in spans.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_keeps_every_token(spark, tokenizer):
    for capacity in (2048, 64):
        rows = packing.pack(documents(spark).repartition(3), capacity).collect()
        check(rows, messy_rows(), tokenizer, capacity)
    assert packing.pack(documents(spark, []).limit(0)).count() == 0


def test_plan_is_tight_and_complete():
    for seed in range(8):
        draw = random.Random(seed)
        lengths = Counter(min(256, max(1, int(draw.lognormvariate(4, 1)))) for _ in range(3000))
        groups = packing.plan(lengths, 256)
        used = Counter()
        for n, content in groups:
            assert n > 0 and sum(a * k for a, k in content) <= 256
            for a, k in content:
                used[a] += n * k
        assert used == lengths
        total = sum(a * n for a, n in lengths.items())
        assert sum(n for n, _ in groups) <= -(-total // 256) + 2
    assert packing.plan({}, 10) == []
    assert sum(n for n, _ in packing.plan({3: 10**9, 7: 10**9}, 10)) == 10**9
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)
