"""Chat formatting: a small sandboxed template language, compiled to Python closures, rendered over conversations.

Language: ``{{ expression }}``, ``{% for x in name %} .. {% endfor %}``, ``{% if e %} .. {% elif e %} .. {% else %} .. {% endif %}``,
``{% set name = e %}``, ``{% generation %} .. {% endgeneration %}`` and ``{# comment #}``. Expressions: strings, integers,
``true false none``, names, ``a.b`` on mappings only, ``not and or == != + %`` and filters ``e | name``. There are no calls, no
Python attributes and no imports, so a template reaches nothing but the values it is given.

A template goes through three steps: parse to a syntax tree, fold constants (constant operators and filters, constant
conditions, adjacent text), and generate one closure for each node. Output is passed piece by piece to a sink together with the flag of
the generation markers, and messages are taken from an iterator with one of lookahead (for ``loop.last``), so a
conversation of any length renders in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k

START, END = "<|im_start|>", "<|im_end|>"

#: Marks turns, escapes control strings and flags what an assistant says.
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't in the language."""


def escape(text: str) -> str:
    """Reversibly hides control strings: none holds `<|` afterwards."""
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def escape_line(text: str) -> str:
    """As escape(), and line ends too."""
    return escape(text).replace("\n", "&#10;")


def unescape(text: str) -> str:
    """The inverse of escape() and escape_line()."""
    return re.sub("&(amp|lt|#10);", lambda m: {"amp": "&", "lt": "<", "#10": "\n"}[m[1]], text) if "&" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Seq:
    parts: tuple = ()


@dataclass(frozen=True)
class If:
    test: object
    then: Seq
    other: Seq


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: Seq


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: Seq


_PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_WORDS = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|[().|+%]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Precedence climbing over the words of one expression."""

    LEVELS = (("or",), ("and",), ("==", "!="), ("+", "%"))

    def __init__(self, source: str) -> None:
        self.words: list[tuple[str, object]] = []
        at = 0
        while source[at:].strip():
            m = _WORDS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            at = m.end()
            if m[1]:
                self.words.append(("value", int(m[1])))
            elif m[2]:
                self.words.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[2][1:-1], flags=re.S)))
            else:
                self.words.append(("name", m[3]) if m[3] else ("mark", m[4]))
        self.at = 0

    def peek(self) -> tuple[str, object]:
        return self.words[self.at] if self.at < len(self.words) else ("end", None)

    def take(self, *wanted: str) -> str | None:
        kind, word = self.peek()
        if kind in ("mark", "name") and word in wanted:
            self.at += 1
            return str(word)
        return None

    def whole(self) -> object:
        out = self.binary(0)
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def binary(self, level: int) -> object:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = Apply(op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> object:
        if self.take("not"):
            return Apply("not", (self.unary(),))
        kind, word = self.peek()
        self.at += 1
        if kind == "value":
            out: object = Const(word)
        elif kind == "name":
            named = {"true": True, "false": False, "none": None}
            out = Const(named[word]) if word in named else Name(str(word))
        elif word == "(":
            out = self.binary(0)
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while mark := self.take(".", "|"):
            kind, word = self.peek()
            self.at += 1
            if kind != "name":
                raise TemplateError(f"a name must follow {mark}")
            if mark == ".":
                out = Field(out, str(word))
            elif word not in FILTERS:
                raise TemplateError(f"no filter {word!r}")
            else:
                out = Apply(f"|{word}", (out,))
        return out


def parse(source: str) -> Seq:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECES.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("print", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    if re.search(r"\{[{%#]", "".join(x for kind, x in pieces if kind == "text")):
        raise TemplateError("an opening mark without its end")
    seq, end = _sequence(iter(pieces), ())
    assert not end
    return seq


def _sequence(pieces: Iterator[tuple[str, str]], ends: tuple[str, ...]) -> tuple[Seq, str]:
    parts: list = []
    for kind, source in pieces:
        word, _, rest = source.partition(" ")
        if kind == "text":
            parts.append(Text(source))
        elif kind == "print":
            parts.append(Print(_Expression(source).whole()))
        elif word in ends:
            return Seq(tuple(parts)), source
        elif word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(\w+)", rest.strip())
            if not m:
                raise TemplateError(f"can't read for {rest!r}")
            parts.append(For(m[1], m[2], _sequence(pieces, ("endfor",))[0]))
        elif word == "if":
            parts.append(_condition(rest, pieces))
        elif word == "generation":
            parts.append(Generation(_sequence(pieces, ("endgeneration",))[0]))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                raise TemplateError(f"can't set {name!r}")
            parts.append(Set(name.strip(), _Expression(value).whole()))
        else:
            raise TemplateError(f"unexpected tag {source!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return Seq(tuple(parts)), ""


def _condition(test: str, pieces: Iterator[tuple[str, str]]) -> If:
    then, end = _sequence(pieces, ("elif", "else", "endif"))
    if end.startswith("elif"):
        other = Seq((_condition(end[4:], pieces),))
    elif end == "else":
        other, _ = _sequence(pieces, ("endif",))
    else:
        other = Seq()
    return If(_Expression(test).whole(), then, other)


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b),
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) and b else 0,
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _shown(x: object) -> str:
    return "" if x is None else str(x)


def _operator(op: str) -> Callable:
    if op.startswith("|"):
        f = FILTERS[op[1:]]
        return lambda x: f(_shown(x))
    return _OPERATORS[op]


def fold(node):
    """The tree with constant parts worked out and adjacent texts joined."""
    if isinstance(node, Apply):
        args = tuple(fold(x) for x in node.args)
        return Const(_operator(node.op)(*(x.value for x in args))) if all(isinstance(x, Const) for x in args) else Apply(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Print):
        value = fold(node.value)
        return Text(_shown(value.value)) if isinstance(value, Const) else Print(value)
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, node.over, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, Seq):
        parts: list = []
        for x in map(fold, node.parts):
            for y in x.parts if isinstance(x, Seq) else (x,):
                if isinstance(y, Text) and parts and isinstance(parts[-1], Text):
                    parts[-1] = Text(parts[-1].text + y.text)
                elif y != Text(""):
                    parts.append(y)
        return Seq(tuple(parts))
    return node


@dataclass
class _State:
    """What closures share while one conversation renders."""

    values: dict
    sink: Callable[[str, bool], None]
    flagged: bool = False


def _value(node) -> Callable[[_State], object]:
    if isinstance(node, Const):
        return lambda s, v=node.value: v
    if isinstance(node, Name):
        return lambda s, n=node.name: s.values.get(n)
    if isinstance(node, Field):
        of, name = _value(node.of), node.name

        def get(s: _State) -> object:
            x = of(s)
            return x.get(name) if isinstance(x, dict) else None

        return get
    args = [_value(x) for x in node.args]
    if node.op in ("and", "or"):
        a, b = args
        return (lambda s: a(s) and b(s)) if node.op == "and" else (lambda s: a(s) or b(s))
    f = _operator(node.op)
    if len(args) == 1:
        return lambda s, a=args[0]: f(a(s))
    return lambda s, a=args[0], b=args[1]: f(a(s), b(s))


def _action(node) -> Callable[[_State], None]:
    if isinstance(node, Text):
        return lambda s, t=node.text: s.sink(t, s.flagged)
    if isinstance(node, Print):
        value = _value(node.value)
        return lambda s: s.sink(_shown(value(s)), s.flagged)
    if isinstance(node, Set):
        value, name = _value(node.value), node.name

        def put(s: _State) -> None:
            s.values[name] = value(s)

        return put
    if isinstance(node, If):
        test, then, other = _value(node.test), _action(node.then), _action(node.other)
        return lambda s: then(s) if test(s) else other(s)
    if isinstance(node, Generation):
        inner = _action(node.body)

        def flag(s: _State) -> None:
            before, s.flagged = s.flagged, True
            inner(s)
            s.flagged = before

        return flag
    if isinstance(node, For):
        body, name, over = _action(node.body), node.name, node.over

        def loop(s: _State) -> None:
            items = iter(s.values.get(over) or ())
            index, item, done = 0, next(items, _NONE), _NONE
            while item is not done:
                following = next(items, _NONE)
                index += 1
                s.values[name], s.values["loop"] = item, {"index": index, "first": index == 1, "last": following is done}
                body(s)
                item = following

        return loop
    steps = [_action(x) for x in node.parts]
    if len(steps) == 1:
        return steps[0]

    def all_of(s: _State) -> None:
        for step in steps:
            step(s)

    return all_of


_NONE = object()


def compile_template(source: str) -> Callable[..., None]:
    """render(messages, sink, **values): passes (text, under a generation marker) to sink, piece by piece."""
    action = _action(fold(parse(source)))

    def render(messages: Iterable[dict], sink: Callable[[str, bool], None], **values: object) -> None:
        action(_State({**values, "messages": messages}, sink))

    return render


@dataclass
class Whole:
    """A sink that keeps the output and the flagged spans (code points, end exclusive; touching ones are joined)."""

    parts: list[str] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)
    size: int = 0

    def __call__(self, text: str, flagged: bool) -> None:
        end = self.size + len(text)
        if flagged and text:
            if self.spans and self.spans[-1][1] == self.size:
                self.spans[-1][1] = end
            else:
                self.spans.append([self.size, end])
        self.parts.append(text)
        self.size = end


class ReadBack:
    """A sink that reads turns and flagged text back from the output and keeps digests only; memory holds one turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.size = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.rest: list[str] = []
        self.loss: list[str] = []

    def __call__(self, text: str, flagged: bool) -> None:
        self.size += len(text)
        if flagged:
            self.loss.append(text)
        elif self.loss:
            self.close()
        self.rest.append(text)
        if END in text:
            *turns, last = "".join(self.rest).split(f"{END}\n")
            for turn in turns:
                role, _, said = turn.removeprefix(START).partition("\n")
                self.turns += 1
                self.turns_hash.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            self.rest = [last]

    def close(self) -> None:
        loss = unescape("".join(self.loss))
        self.loss_chars += len(loss)
        self.loss_hash.update(loss.encode())
        self.loss = []

    def row(self) -> tuple:
        if self.loss:
            self.close()
        return self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.size


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for batch in batches:
        yield from ((c, {"role": role or "", "text": text or ""}) for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True))


def _rendered(source: str, sink_of: Callable, finish: Callable[[object], tuple], names: list[str], kinds: list[pa.DataType], rows_a_batch: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(source), []
        messages = _conversations(batches)
        pending = [next(messages, None)]

        def one(conv: object) -> Iterator[dict]:
            while pending[0] is not None and pending[0][0] == conv:
                yield pending[0][1]
                pending[0] = next(messages, None)

        while pending[0] is not None:
            conv, sink = pending[0][0], sink_of()
            turns = one(conv)
            render(turns, sink)
            for _ in turns:  # what a template leaves
                pass
            rows.append((conv, *finish(sink)))
            if len(rows) >= rows_a_batch:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _by_conversation(turns: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order; ties of a turn by role and text, nulls first."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, formatted (string), loss_spans (array of start, end in code points) for each conversation.

    turns: conv_id, turn, role, text; other columns are ignored. A null role or text is empty, null turns come first,
    repeated rows are turns of their own, and rows without conv_id form one conversation.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    run = _rendered(
        template,
        Whole,
        lambda w: ("".join(w.parts), [{"start": a, "end": b} for a, b in w.spans]),
        ["conv_id", "formatted", "loss_spans"],
        [pa.int64(), pa.string(), pa.list_(span)],
        50,
    )
    return _by_conversation(turns).mapInArrow(k.trimmed(run), "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def conversation_digests(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """Digests of what can be read back from each formatted conversation, in bounded memory; see ReadBack."""
    run = _rendered(
        template,
        ReadBack,
        ReadBack.row,
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()],
    )
    return _by_conversation(turns).mapInArrow(k.trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
