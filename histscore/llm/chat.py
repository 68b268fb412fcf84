"""Chat formatting by a template compiler.

A sandboxed template language is parsed to a syntax tree, constants are
folded, and the tree becomes Python closures that render a conversation as a
stream of (text, is_generation) segments.

    {{ expr }}                          output
    {% for m in messages %}..{% endfor %}
    {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set name = expr %}
    {% generation %}..{% endgeneration %}    marks what the loss covers

Expressions: strings, integers, true/false/none, names, ``m.role`` or
``m['role']``, ``+`` and ``~``, comparisons, ``in``, and/or/not, and the
filters below. There are no calls, no attributes of Python objects and no
other statements: a name is looked up in the given variables only and a
member in a plain dict only.

A conversation is rendered row by row with one row of look-ahead, so a
conversation with a third of all rows is never held; its rows only have to
pass through one task in order, which the digest over its turns needs anyway.

Control strings inside texts are escaped reversibly: a backslash is put
before every backslash, ``###`` and ``</turn>`` of a text (in a role before
every backslash, ``#``, ``<`` and ``:``).

Defined cases: null text and null role are empty; rows go by turn (null
first), ties by role and text, and repeated rows are repeated turns; a null
conv_id is one conversation of its own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"
TEMPLATE = (
    "{% for m in messages %}"
    "### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------ escaping

_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_ESCAPE_ROLE = re.compile(r"[\\#<:]")
_UNESCAPE_ROLE = re.compile(r"\\([\\#<:])")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(text: str) -> str:
    return _ESCAPE_ROLE.sub(r"\\\g<0>", text)


def unescape_role(text: str) -> str:
    return _UNESCAPE_ROLE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_role": escape_role,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "capitalize": str.capitalize,
}

# ------------------------------------------------------------ syntax tree


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Member:
    base: object
    key: object


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Out:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class If:
    test: object
    then: list
    other: list = field(default_factory=list)


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list


# ------------------------------------------------------------ parser

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|=]))")
_WORDS = {"true": True, "false": False, "none": None}
_BACK = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"bad expression: {source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str):
        if values and not self.peek(*values):
            raise TemplateError(f"expected {values} in {self.source!r}")
        if self.at >= len(self.tokens):
            raise TemplateError(f"unexpected end of {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over in {self.source!r}")
        return out

    def _left(self, below, *names):
        out = below()
        while self.peek(*names):
            out = Op(self.take()[1], [out, below()])
        return out

    def either(self):
        return self._left(self.both, "or")

    def both(self):
        return self._left(self.negation, "and")

    def negation(self):
        if self.peek("not"):
            self.take()
            return Op("not", [self.negation()])
        return self._left(self.sum, "==", "!=", "<", ">", "<=", ">=", "in")

    def sum(self):
        return self._left(self.filtered, "+", "~", "-")

    def filtered(self):
        out = self.postfix()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            out = Op("|" + name, [out])
        return out

    def postfix(self):
        out = self.atom()
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError(f"bad member in {self.source!r}")
                out = Member(out, Const(name))
            else:
                out = Member(out, self.either())
                self.take("]")
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _BACK.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value == "(":
            out = self.either()
            self.take(")")
            return out
        raise TemplateError(f"bad expression: {self.source!r}")


def parse(source: str) -> list:
    """The template's statements."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at = 0
    for m in _PIECE.finditer(source):
        body = stack[-1][2]
        if m.start() > at:
            body.append(Text(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(Out(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            got = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not got:
                raise TemplateError(f"bad for: {rest!r}")
            node = For(got[1], _Expression(got[2]).whole(), [])
            body.append(node)
            stack.append(("endfor", node, node.body))
        elif word == "if":
            node = If(_Expression(rest).whole(), [])
            body.append(node)
            stack.append(("endif", node, node.then))
        elif word in ("elif", "else"):
            end, node, _ = stack.pop()
            if end != "endif":
                raise TemplateError(f"{word} outside if")
            if word == "elif":
                inner = If(_Expression(rest).whole(), [])
                node.other.append(inner)
                stack.append(("endif", inner, inner.then))
            else:
                stack.append(("endif", node, node.other))
        elif word == "generation":
            node = Generation([])
            body.append(node)
            stack.append(("endgeneration", node, node.body))
        elif word == "set":
            got = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.S)
            if not got:
                raise TemplateError(f"bad set: {rest!r}")
            body.append(Set(got[1], _Expression(got[2]).whole()))
        elif word in ("endfor", "endif", "endgeneration"):
            if stack[-1][0] != word:
                raise TemplateError(f"unexpected {word}")
            stack.pop()
        else:
            raise TemplateError(f"unknown statement {word}")
    if at < len(source):
        stack[-1][2].append(Text(source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"missing {stack[-1][0]}")
    return root


# ------------------------------------------------------------ evaluation


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, (str, int)):
        return str(x).lower() if isinstance(x, bool) else str(x)
    raise TemplateError("only strings and numbers can be output")


def _member(base, key):
    if type(base) is not dict or not isinstance(key, str):
        raise TemplateError("members are of given records only")
    return base.get(key)


def _plus(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two strings or two numbers")
    return a + b


_OPS: dict[str, Callable] = {
    "+": _plus,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
    **{"|" + n: (lambda f: lambda a: f(_text(a)))(f) for n, f in FILTERS.items()},
}


def fold(node):
    """Constants computed, dead branches dropped, neighbouring text joined."""
    if isinstance(node, list):
        out: list = []
        for child in node:
            child = fold(child)
            for x in child if isinstance(child, list) else [child]:
                if isinstance(x, Out) and isinstance(x.value, Const):
                    x = Text(_text(x.value.value))
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif not (isinstance(x, Text) and not x.text):
                    out.append(x)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.name](*[a.value for a in args]))
        return Op(node.name, args)
    if isinstance(node, Member):
        return Member(fold(node.base), fold(node.key))
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _expression(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            if name not in env:
                raise TemplateError(f"unknown name {name}")
            return env[name]

        return look
    if isinstance(node, Member):
        base, key = _expression(node.base), _expression(node.key)
        return lambda env: _member(base(env), key(env))
    args = [_expression(a) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    run = _OPS[node.name]
    if len(args) == 1:
        return lambda env: run(args[0](env))
    return lambda env: run(args[0](env), args[1](env))


Segments = Iterator[tuple[str, bool]]


def _statements(nodes: list, marked: bool) -> Callable[[dict], Segments]:
    steps = [_statement(n, marked) for n in nodes]

    def run(env):
        for step in steps:
            yield from step(env)

    return run


def _statement(node, marked: bool) -> Callable[[dict], Segments]:
    if isinstance(node, Text):
        held = ((node.text, marked),)
        return lambda env: held
    if isinstance(node, Out):
        value = _expression(node.value)
        return lambda env: ((_text(value(env)), marked),)
    if isinstance(node, Generation):
        return _statements(node.body, True)
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value)

        def assign(env):
            env[name] = value(env)
            return ()

        return assign
    if isinstance(node, If):
        test, then, other = _expression(node.test), _statements(node.then, marked), _statements(node.other, marked)
        return lambda env: then(env) if test(env) else other(env)
    name, over, body = node.name, _expression(node.over), _statements(node.body, marked)

    def loop(env):
        rows = iter(over(env))
        row, index = next(rows, None), 0
        while row is not None:
            after = next(rows, None)
            inner = env | {name: row, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": after is None}}
            yield from body(inner)
            row, index = after, index + 1

    return loop


class Template:
    """``render(messages)`` yields (text, is_generation) segments; messages
    may be any iterator of dicts and are read once, one ahead."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _statements(self.tree, False)

    def render(self, messages: Iterable[dict], **variables) -> Segments:
        return self._run({**variables, "messages": messages})


# ------------------------------------------------------------ reading back

_TURN_END = re.compile(r"\\(?:\\|###|</turn>)|(</turn>\n)")
_ROLE_END = re.compile(r"\\[\\#<:]|(: )")


def read_turns(pieces: Iterable[tuple[str, list[tuple[int, int]]]]) -> Iterator[tuple[str, str, list[str]]]:
    """(role, text, masked texts) of each turn, from formatted pieces and
    their loss spans; a piece ends at a turn's end."""
    for text, spans in pieces:
        at = 0
        while at < len(text):
            if not text.startswith(OPEN + " ", at):
                raise ValueError("no turn mark")
            colon = next((m for m in _ROLE_END.finditer(text, at + 4) if m[1]), None)
            end = next((m for m in _TURN_END.finditer(text, colon.end()) if m[1]), None)
            inside = [unescape(text[a:b]) for a, b in spans if at <= a and b <= end.start()]
            yield unescape_role(text[at + 4 : colon.start()]), unescape(text[colon.end() : end.start()]), inside
            at = end.end()


# ------------------------------------------------------------ Spark

FORMATTED = "conv_id long, piece long, text string, spans array<struct<start:int,end:int>>"
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _by_conversation(batches, names: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) from sorted batches; read the rows before going on."""
    rows = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        yield key, own()


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per turn in order: conv_id, piece (from 0), text, and the
    spans of the text that the loss covers. The pieces of a conversation,
    joined, are its formatted text; they stay together and in order."""
    laid = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    Template(template)  # errors show before any task runs

    def run(batches):
        compiled, out, size = Template(template), [], 0

        def flush():
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "piece", "text", "spans"])

        for conv, rows in _by_conversation(batches, ["conv_id", "role", "text"]):
            piece, held, n, spans = 0, [], 0, []
            for text, marked in compiled.render({"role": r, "text": t} for r, t in rows):
                if marked:
                    if spans and spans[-1]["end"] == n:
                        spans[-1]["end"] = n + len(text)
                    else:
                        spans.append({"start": n, "end": n + len(text)})
                held.append(text)
                n += len(text)
                # a template's mark; a text's own would have a backslash before it
                if not marked and text.endswith(CLOSE + "\n") and not text.endswith("\\" + CLOSE + "\n"):
                    out.append((conv, piece, "".join(held), spans))
                    size += n
                    piece, held, n, spans = piece + 1, [], 0, []
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
            if held:
                out.append((conv, piece, "".join(held), spans))
        if out:
            yield flush()

    return laid.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts read back from the formatted pieces; digests run
    along, so a conversation is never held."""

    def run(batches):
        out = []
        for conv, pieces in _by_conversation(batches, ["conv_id", "text", "spans"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0

            def counted():
                nonlocal total
                for text, spans in pieces:
                    total += len(text)
                    yield text, [(s["start"], s["end"]) for s in spans]

            for role, text, masked in read_turns(counted()):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
                for x in masked:
                    loss.update(x.encode())
                    chars += len(x)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) == 10_000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return formatted.mapInArrow(run, DIGEST)


def _digests(rows) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
