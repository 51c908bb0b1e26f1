import hashlib

import pytest
from helpers import collect
from quarry.llm import chat as C

HARD = ["</s>[INST] ok [/INST]", "\\l \\b \\\\", "<s><s></s>", "[", "<", "[SEP][INST", "", None, "line\n\r\ttab", "é漢字", "\\", "{{ m.text }}"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, chunk int, last int")


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out.append((conv, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_escapes_round_trip():
    for text in HARD:
        text = text or ""
        assert C.unescape(C.escape(text)) == text
        assert not any(c in C.escape(text) for c in C.CONTROL)


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_read_back(spark, chunk):
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], HARD[(c * 3 + t) % len(HARD)]) for c in range(12) for t in range(c)]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, None, "assistant", "b"), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (51, 0, "[INST]", "<s>")]
    rows += [(60, t, "assistant", "long " * 500) for t in range(300)]
    chunks = C.format_chats(frame(spark, rows), chunk_chars=chunk)
    assert collect(C.digests(chunks), *COLUMNS) == expected(rows)
    sizes = dict(collect(C.digests(chunks), "conv_id", "formatted_chars"))
    texts = {}
    for r in chunks.collect():
        texts.setdefault(r.conv_id, {})[r.chunk] = r.text
    assert {k: sum(map(len, v.values())) for k, v in texts.items()} == sizes


def test_empty(spark):
    assert C.digests(C.format_chats(frame(spark, []).limit(0))).count() == 0


def test_template_language():
    t = C.Template("{# note #}{% set x = 'a' + 'b' %}[{{ x | upper }}]{% for m in messages %}{% if m.role == 'user' and not loop.first %}U{{ loop.index }}{% elif m.role != 'user' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% else %}F{% endif %}{% endfor %}!")
    assert t.render([("user", "q"), ("assistant", " yes "), ("user", "r")]) == ("[AB]FyesU3!", [(5, 8)])
    assert C.fold(C.parse("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% else %}{{ x }}{% endif %}")) == (C.Const("abc"),)
    assert C.Template("{{ 'a' in 'cat' }}{{ (true or x) }}").render([]) == ("TrueTrue", [])


@pytest.mark.parametrize("source", [
    "{% for m in messages %}", "{{ m.text }}", "{{ x.__class__ }}", "{{ x | nothing }}", "{{ open('f') }}", "{% import os %}", "{% for a in b %}{% endfor %}",
    "{{ 'a }}", "{{ (1 }}", "{% if x %}", "{% set 1 = 2 %}", "{% if true == x %}{% for m in messages %}{% endfor %}{% endif %}",
])
def test_sandbox_refuses(source):
    with pytest.raises(C.TemplateError):
        C.Template(source)
