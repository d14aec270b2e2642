"""Chat formatting (operator 7): a small sandboxed template language compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for x in name %}``, ``{% if %} {% elif %} {% else %}``,
``{% set name = expression %}`` and ``{% generation %}``, whose output is marked for the loss. Expressions have
literals, names, ``a.b`` and ``a["b"]`` (keys of mappings only), ``not and or``, ``== != < > <= >= in``, ``+ ~``, and
the filters of ``FILTERS``. Nothing can be called and no attribute of a Python object can be reached. The parser makes
a tree of tuples, constants are folded, and each node becomes a closure. A loop takes any iterator, so that a
conversation is rendered turn by turn however long it is.

Control strings inside texts are escaped reversibly: a backslash is doubled and ``<|`` becomes ``<\\|``.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}'
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str,
}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.\[\]()<>=]))""")
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_KEYWORDS = {"and", "or", "not", "in"}


class TemplateError(ValueError):
    """A template that cannot be parsed or refers to what it may not."""


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        kind = ("text", "number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def whole(self) -> tuple:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values:
            self.at += 1
            return values[values.index(self.tokens[self.at - 1][1])]
        return None

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.joined()
        if sign := self.take(*_COMPARE):
            out = ("compare", sign, out, self.joined())
        return out

    def joined(self) -> tuple:
        out = self.filtered()
        while sign := self.take("+", "~"):
            out = ("join", sign, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.atom()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = ("filter", name, out)
            elif self.take("."):
                out = ("key", out, ("constant", self.name()))
            elif self.take("["):
                out = ("key", out, self.either())
                if not self.take("]"):
                    raise TemplateError("']' is missing")
            else:
                return out

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _KEYWORDS:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            self.at += 1
            return ("constant", int(value))
        name = self.name()
        return ("constant", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)


def parse(source: str) -> tuple:
    """The syntax tree of a template: ``("block", nodes)`` of text, print, if, for, set and generation nodes."""
    parts = [p for p in _TAG.split(source) if p]
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("print", _Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                body = part[2:-2].strip()
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", nodes), body
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError(f"cannot read {body!r}")
                    inner, _ = block("endfor")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif word == "if":
                    nodes.append(branch(rest))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError(f"cannot read {body!r}")
                    nodes.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    inner, _ = block("endgeneration")
                    nodes.append(("generation", inner))
                else:
                    raise TemplateError(f"unexpected {body!r}")
            else:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return ("block", nodes), ""

    def branch(test: str) -> tuple:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", _Expression(test).whole(), then, ("block", [branch(end[4:])]))
        other = block("endif")[0] if end == "else" else ("block", [])
        return ("if", _Expression(test).whole(), then, other)

    return block()[0]


def fold(node: tuple) -> tuple:
    """The tree with constant expressions replaced by their values, decided branches chosen and texts joined."""
    kind = node[0]
    if kind in ("constant", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1]):
            if x[0] == "print" and x[1][0] == "constant":
                x = ("text", _shown(x[1][1]))
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", out)
    done = (kind, *[fold(x) if isinstance(x, tuple) else x for x in node[1:]])
    if kind == "if" and done[1][0] == "constant":
        return done[2] if done[1][1] else done[3]
    if kind in ("and", "or", "not", "compare", "join", "filter", "key") and all(x[0] == "constant" for x in done[1:] if isinstance(x, tuple)):
        return ("constant", _value(done)({}))
    return done


def _shown(value) -> str:
    return "" if value is None else str(value)


def _key(holder, key):
    if not isinstance(holder, dict):
        raise TemplateError("only mappings have keys")
    return holder.get(key)


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "not":
        return lambda scope, f=_value(node[1]): not f(scope)
    if kind == "filter":
        return lambda scope, g=FILTERS[node[1]], f=_value(node[2]): g(f(scope))
    a, b = _value(node[-2]), _value(node[-1])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "key":
        return lambda scope: _key(a(scope), b(scope))
    if kind == "compare":
        return lambda scope, f=_COMPARE[node[1]]: f(a(scope), b(scope))
    if node[1] == "~":
        return lambda scope: _shown(a(scope)) + _shown(b(scope))
    return lambda scope: a(scope) + b(scope)


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _render(node: tuple) -> Render:
    """A closure that yields texts with whether they are generated."""
    kind = node[0]
    if kind == "text":
        return lambda scope, gen, t=node[1]: iter(((t, gen),))
    if kind == "print":
        return lambda scope, gen, f=_value(node[1]): iter(((_shown(f(scope)), gen),))
    if kind == "generation":
        return lambda scope, gen, r=_render(node[1]): r(scope, True)
    if kind == "if":
        test, then, other = _value(node[1]), _render(node[2]), _render(node[3])
        return lambda scope, gen: (then if test(scope) else other)(scope, gen)
    if kind == "set":

        def assign(scope: dict, gen: bool, name=node[1], f=_value(node[2])) -> Iterator[tuple[str, bool]]:
            scope[name] = f(scope)
            return iter(())

        return assign
    if kind == "for":
        items, body = _value(node[2]), _render(node[3])

        def loop(scope: dict, gen: bool, name=node[1]) -> Iterator[tuple[str, bool]]:
            for item in items(scope) or ():
                scope[name] = item
                yield from body(scope, gen)
                yield None  # the end of a turn

        return loop
    parts = [_render(x) for x in node[1]]

    def block(scope: dict, gen: bool) -> Iterator[tuple[str, bool]]:
        for part in parts:
            yield from part(scope, gen)

    return block


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, list[tuple[int, int]]]]]:
    """A function from messages to parts: each the text of a loop pass (or what is left) with its generated spans."""
    run = _render(fold(parse(source)))

    def render(messages: Iterator[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        texts: list[str] = []
        spans: list[tuple[int, int]] = []
        size = 0
        for x in run({"messages": messages}, False):
            if x is None:
                if texts:
                    yield "".join(texts), spans
                texts, spans, size = [], [], 0
                continue
            text, generated = x
            if text:
                if generated:
                    if spans and spans[-1][1] == size:
                        spans[-1] = (spans[-1][0], size + len(text))
                    else:
                        spans.append((size, size + len(text)))
                texts.append(text)
                size += len(text)
        if texts:
            yield "".join(texts), spans

    return render


_PARTS = "conv_id long, part long, text string, spans array<struct<start:int,end:int>>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows of one ``conv_id``, row by row."""
    rows = ((r for b in batches for k in range(0, b.num_rows, 1024) for r in zip(*[c.to_pylist() for c in b.slice(k, 1024).columns], strict=True)))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)

        group = run()
        yield conv, group
        for _ in group:  # what the caller left
            pass


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """``conv_id, part, text, spans``: the formatted conversations in parts of one turn, with the spans for the loss.

    Turns are in the order of ``turn`` (null first); repeated ones in that of role and text. A null role or text
    counts as empty, a null ``conv_id`` is a conversation of its own. Further columns are ignored. A task reads a
    conversation as a stream, so that its length needs no memory.
    """
    C.ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            c = list(zip(*held, strict=True))
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in c[3]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), spans], ["conv_id", "part", "text", "spans"])

        for conv, group in _groups(batches):
            messages = ({"role": r[2], "text": r[3]} for r in group)
            for k, (text, spans) in enumerate(render(messages)):
                held.append((conv, k, text, spans))
                if len(held) == 1024:
                    yield emit()
                    held = []
        if held:
            yield emit()

    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _PARTS)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_conversations(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` read from the formatted parts."""
    C.ship(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, group in _groups(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = masked = 0
            for _, _, text, spans in group:
                chars += len(text)
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError("the formatted text has something between turns")
                    at = m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n += 1
                if at != len(text):
                    raise ValueError("the formatted text has something after its last turn")
                for s in spans:
                    plain = unescape(text[s["start"] : s["end"]])
                    masked += len(plain)
                    loss.update(plain.encode())
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) == 1024:
                yield emit()
                out = []
        if out:
            yield emit()

    rows = parts.select("conv_id", "part", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
