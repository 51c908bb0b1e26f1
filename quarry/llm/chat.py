"""Chat formatting by compiled templates.

A small, sandboxed template language is parsed into a syntax tree, constants are
folded, and the tree becomes Python closures that render conversations turn by
turn and report what a generation block covers. Templates have no attributes
beyond a message's fields, no calls beyond the named filters, and no loops beyond
the one over messages.

    {{ expression }}                     output
    {% for m in messages %} ... {% endfor %}
    {% if c %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   marks text for the loss
    {# comment #}

Expressions: strings, integers, true, false, none, names, m.role, m.text,
loop.index, loop.first, ==, !=, +, and, or, not, parentheses, `in`, and the
filters escape, trim, upper, lower.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import prepare

#: Characters of one chunk of formatted text at least, except a conversation's last.
CHUNK_CHARS = 1 << 20

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SEP]")
TEMPLATE = (
    "{% for m in messages %}{% if loop.first %}<s>{% endif %}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role | escape }}[SEP]{{ m.text | escape }}[/INST]{% endif %}{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\([\\lb])")
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    """Break every control string, reversibly: a backslash doubles, and a control
    string's first character becomes a backslash and a letter."""
    return _CONTROL.sub(lambda m: ("\\l" if m[0][0] == "<" else "\\b") + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


class TemplateError(ValueError):
    pass


_FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%-?(?P<do>.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))")
_WORDS = {"true": True, "false": False, "none": None}
_FIELDS = {("m", "role"), ("m", "text"), ("loop", "index"), ("loop", "first")}


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Block:
    kind: str
    head: Any
    body: tuple


_OPS: dict[str, Callable[..., Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: str(a) in str(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class _Expression:
    def __init__(self, source: str, loop: str | None):
        self._tokens, self._at, self._loop = [], 0, loop
        at, source = 0, source.strip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match or match.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self._tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()

    def parse(self) -> Any:
        found = self._either()
        if self._at < len(self._tokens):
            raise TemplateError(f"unexpected {self._tokens[self._at][1]!r}")
        return found

    def _take(self, *values: str) -> str | None:
        if self._at < len(self._tokens) and self._tokens[self._at][1] in values and self._tokens[self._at][0] != "str":
            self._at += 1
            return self._tokens[self._at - 1][1]
        return None

    def _either(self) -> Any:
        left = self._both()
        while self._take("or"):
            left = Op("or", (left, self._both()))
        return left

    def _both(self) -> Any:
        left = self._negation()
        while self._take("and"):
            left = Op("and", (left, self._negation()))
        return left

    def _negation(self) -> Any:
        return Op("not", (self._negation(),)) if self._take("not") else self._comparison()

    def _comparison(self) -> Any:
        left = self._sum()
        while kind := self._take("==", "!=", "in"):
            left = Op(kind, (left, self._sum()))
        return left

    def _sum(self) -> Any:
        left = self._filtered()
        while self._take("+"):
            left = Op("+", (left, self._filtered()))
        return left

    def _filtered(self) -> Any:
        value = self._atom()
        while self._take("|"):
            kind, name = self._tokens[self._at] if self._at < len(self._tokens) else (None, None)
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self._at += 1
            value = Op(f"|{name}", (value,))
        return value

    def _atom(self) -> Any:
        if self._take("("):
            inner = self._either()
            if not self._take(")"):
                raise TemplateError("a parenthesis is not closed")
            return inner
        if self._at >= len(self._tokens):
            raise TemplateError("an expression ends early")
        kind, value = self._tokens[self._at]
        self._at += 1
        if kind == "str":
            return Const(value[1:-1])
        if kind == "int":
            return Const(int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in _WORDS:
            return Const(_WORDS[value])
        if self._take("."):
            _, field = self._tokens[self._at] if self._at < len(self._tokens) else (None, None)
            self._at += 1
            owner = None if self._loop is None else "m" if value == self._loop else "loop" if value == "loop" else None
            if (owner, field) not in _FIELDS:
                raise TemplateError(f"no field {value}.{field}")
            return Name(owner, field)
        return Name(value)


def parse(template: str) -> tuple:
    """The syntax tree: constants, expressions and blocks."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for match in _TAG.finditer(template):
        if match.start() > at:
            pieces.append(("text", template[at : match.start()]))
        if match["out"] is not None:
            pieces.append(("out", match["out"]))
        elif match["do"] is not None:
            pieces.append(("do", match["do"].strip()))
        at = match.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    place, loop = 0, None

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place, loop
        found: list = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                found.append(Const(value))
            elif kind == "out":
                found.append(_Expression(value, loop).parse())
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(found), value
                if word == "for":
                    match = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())
                    if not match or loop is not None:
                        raise TemplateError("only one loop, over messages, is allowed")
                    loop = match[1]
                    found.append(Block("for", None, body(("endfor",))[0]))
                    loop = None
                elif word == "if":
                    found.append(branch(rest))
                elif word == "set":
                    name, _, source = rest.partition("=")
                    if not name.strip().isidentifier():
                        raise TemplateError(f"cannot set {name.strip()!r}")
                    found.append(Block("set", name.strip(), (_Expression(source, loop).parse(),)))
                elif word == "generation":
                    found.append(Block("generation", None, body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(found), ""

    def branch(condition: str) -> Block:
        test = _Expression(condition, loop).parse()
        yes, end = body(("elif", "else", "endif"))
        if end.startswith("elif"):
            return Block("if", test, (yes, (branch(end[4:]),)))
        no = body(("endif",))[0] if end.startswith("else") else ()
        return Block("if", test, (yes, no))

    return body(())[0]


def fold(node: Any) -> Any:
    """The tree with everything computed that depends on no message, and
    neighbouring constant texts joined."""
    if isinstance(node, tuple):
        found: list = []
        for part in map(fold, node):
            for piece in part if isinstance(part, tuple) else (part,):
                if isinstance(piece, Const) and found and isinstance(found[-1], Const):
                    found[-1] = Const(_text(found[-1].value) + _text(piece.value))
                else:
                    found.append(piece)
        return tuple(found)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(node.kind)(*(a.value for a in args)))
        return Op(node.kind, args)
    if isinstance(node, Block):
        if node.kind == "if":
            test = fold(node.head)
            if isinstance(test, Const):
                return fold(node.body[0] if test.value else node.body[1])
            return Block("if", test, (fold(node.body[0]), fold(node.body[1])))
        if node.kind == "set":
            return Block("set", node.head, (fold(node.body[0]),))
        return Block(node.kind, None, fold(node.body))
    return node


def _apply(kind: str) -> Callable[..., Any]:
    if kind[0] == "|":
        used = _FILTERS[kind[1:]]
        return lambda value: used(_text(value))
    return _OPS[kind]


class _Output:
    """Text and loss spans of what has been rendered since the last take."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, value: Any) -> None:
        text = _text(value)
        self.parts.append(text)
        self.size += len(text)


Closure = Callable[[dict, _Output], Any]


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        if node.field:
            return lambda scope, key=f"{node.name}.{node.field}": scope[key]
        return lambda scope, key=node.name: scope.get(key)
    args = [_value(a) for a in node.args]
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = _apply(node.kind)
    if len(args) == 1:
        return lambda scope, only=args[0]: call(only(scope))
    return lambda scope, a=args[0], b=args[1]: call(a(scope), b(scope))


def _statement(node: Any) -> Closure:
    if isinstance(node, tuple):
        steps = [_statement(n) for n in node]

        def several(scope: dict, out: _Output) -> None:
            for step in steps:
                step(scope, out)

        return several
    if isinstance(node, Block):
        if node.kind == "if":
            test, yes, no = _value(node.head), _statement(node.body[0]), _statement(node.body[1])
            return lambda scope, out: (yes if test(scope) else no)(scope, out)
        if node.kind == "set":
            value = _value(node.body[0])
            return lambda scope, out, key=node.head: scope.__setitem__(key, value(scope))
        inner = _statement(node.body)

        def generation(scope: dict, out: _Output) -> None:
            start = out.size
            inner(scope, out)
            out.spans.append((start, out.size))

        return generation
    value = _value(node)
    return lambda scope, out: out.write(value(scope))


class Template:
    """A compiled template, rendered one message at a time."""

    def __init__(self, source: str):
        tree = fold(parse(source))
        loops = [at for at, node in enumerate(tree) if isinstance(node, Block) and node.kind == "for"]
        if len(loops) > 1 or any("Block(kind='for'" in repr(n) for at, n in enumerate(tree) if at not in loops):
            raise TemplateError("the loop over messages stands once, at the top level")
        at = loops[0] if loops else len(tree)
        self._before, self._after = _statement(tree[:at]), _statement(tree[at + 1 :])
        self._each = _statement(tree[at].body) if loops else _statement(())

    def open(self, out: _Output) -> dict:
        scope: dict = {"loop.index": 0, "loop.first": True}
        self._before(scope, out)
        return scope

    def turn(self, scope: dict, role: str, text: str, out: _Output) -> None:
        scope["m.role"], scope["m.text"] = role, text
        scope["loop.first"] = scope["loop.index"] == 0
        scope["loop.index"] += 1
        self._each(scope, out)

    def close(self, scope: dict, out: _Output) -> None:
        self._after(scope, out)

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text and the spans under the loss mask."""
        out = _Output()
        scope = self.open(out)
        for role, text in messages:
            self.turn(scope, role, text, out)
        self.close(scope, out)
        return "".join(out.parts), out.spans


_CHUNKS = "conv_id bigint, chunk int, last boolean, text string, spans array<struct<lo:int,hi:int>>"


def format_chats(conversations: DataFrame, template: str = TEMPLATE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(conv_id, chunk, last, text, spans): the formatted text of each conversation
    in chunks, in order, with the spans of each chunk under the loss mask. A chunk
    ends after a turn, so a span never crosses chunks.

    conversations has conv_id, turn, role and text. Turns are ordered by turn,
    nulls first, then by role and text, so ties and repeated rows have a fixed
    order and are all kept. Null role or text: empty. A null conv_id is a
    conversation of its own. An empty table gives an empty result; other columns
    are ignored.

    A worker streams sorted turns and holds one chunk, so a conversation of any
    length needs bounded memory.
    """
    prepare(conversations.sparkSession)
    Template(template)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        conv, scope, out, number = None, None, _Output(), 0
        rows: list = []

        def flush(last: bool) -> None:
            nonlocal out, number
            rows.append((conv, number, last, "".join(out.parts), [{"lo": a, "hi": b} for a, b in out.spans]))
            out, number = _Output(), number + 1

        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if scope is None or key != conv:
                    if scope is not None:
                        compiled.close(scope, out)
                        flush(True)
                    conv, number = key, 0
                    scope = compiled.open(out)
                elif out.size >= chunk_chars:
                    flush(False)
                compiled.turn(scope, role or "", text or "", out)
            if rows:
                yield _chunks(rows)
                rows = []
        if scope is not None:
            compiled.close(scope, out)
            flush(True)
            yield _chunks(rows)

    return (
        conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(stream, _CHUNKS)
    )


def _chunks(rows: list) -> pa.RecordBatch:
    span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(span)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "chunk", "last", "text", "spans"]
    )


def read_turns(text: str, first: bool) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a chunk formatted by TEMPLATE."""
    at = len("<s>") if first else 0
    while at < len(text):
        if text.startswith("[INST]", at):
            middle = text.index("[SEP]", at)
            end = text.index("[/INST]", middle)
            yield unescape(text[at + 6 : middle]), unescape(text[middle + 5 : end])
            at = end + 7
        else:
            end = text.index("</s>", at)
            yield "assistant", unescape(text[at:end])
            at = end + 4


def digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from the chunks of format_chats with
    TEMPLATE, in the partitions and order in which it makes them: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = loss = None
        n = chars = size = 0
        for batch in batches:
            rows = []
            for conv, number, last, text, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number == 0:
                    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                size += len(text)
                for role, said in read_turns(text, number == 0):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in spans:
                    said = unescape(text[span["lo"] : span["hi"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(said)
                if last:
                    rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return chunks.mapInArrow(
        stream,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
