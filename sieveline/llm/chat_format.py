"""Chat formatting with a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that write a conversation piece by piece together with
a flag for text under a ``generation`` marker (the loss mask). The language is
sandboxed: names come from the context, attributes are mapping keys, filters
are a fixed list, and there are no calls or imports.

    {{ expr }}   {% for x in expr %}..{% endfor %}   {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% set x = expr %}   {% generation %}..{% endgeneration %}   {# remark #}   '-' trims blanks beside a tag
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strings that mark turns, by role: opening and closing.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER_ROLE = ("[ROLE]", "[/ROLE]", "[/TURN]")
BEGIN = "<s>"
#: A control string with any number of backslashes after its first character; texts get one more.
CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|(?:INST|OUT|SYS|ROLE|TURN)\]))")
ESCAPED = re.compile(r"([<\[])(\\*)\\(/?(?:s>|(?:INST|OUT|SYS|ROLE|TURN)\]))")
BARE = re.compile(r"[<\[]/?(?:s>|(?:INST|OUT|SYS|ROLE|TURN)\])")

TEMPLATE = """
{#- one pair of marks a role; only the assistant's words are learned -#}
{{- '<s>' -}}
{%- for m in messages -%}
  {%- if m.role == 'user' -%}{{ '[INST]' ~ (m.text | escape) ~ '[/INST]' }}
  {%- elif m.role == 'assistant' -%}{{ '[OUT]' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
  {%- elif m.role == 'system' -%}{{ '[SYS]' ~ (m.text | escape) ~ '[/SYS]' }}
  {%- else -%}{{ '[ROLE]' ~ (m.role | escape) ~ '[/ROLE]' ~ (m.text | escape) ~ '[/TURN]' }}
  {%- endif -%}
{%- endfor -%}
"""


def escape(text: str) -> str:
    """The text with no control string in it; ``unescape`` gives it back."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


class TemplateError(ValueError):
    """The template is not in the language, or asks for what the sandbox lacks."""


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": escape,
    "trim": lambda s: s.strip(),
    "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(),
    "length": len,
    "string": str,
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda s, old, new: s.replace(old, new),
}
BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not isinstance(a, str) and not isinstance(b, str) else _refuse("repeated text"),
    "%": lambda a, b: a % b if not isinstance(a, str) else _refuse("text formatting"),
    "~": lambda a, b: _text(a) + _text(b),
}
#: From loosest to tightest.
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "%"))
TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>()\[\],.|=:]))")
PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
#: How deep expressions and blocks may nest.
DEPTH = 50


def _refuse(what: str) -> Any:
    raise TemplateError(f"{what} is not allowed")


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class Expression:
    """Recursive-descent parser of one expression into a tree of tuples."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("number", "string", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values) or 'an expression'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = ("or", tree, self.both())
        self.depth -= 1
        return tree

    def both(self) -> tuple:
        tree = self.negation()
        while self.peek("and"):
            self.take()
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        return self.level(0)

    def level(self, n: int) -> tuple:
        if n == len(LEVELS):
            return self.filtered()
        tree = self.level(n + 1)
        while self.peek(*LEVELS[n]):
            tree = ("binary", self.take(), tree, self.level(n + 1))
        return tree

    def filtered(self) -> tuple:
        tree = self.member()
        while self.peek("|"):
            self.take()
            name, extra = self.take(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    extra.append(self.either())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
            tree = ("filter", name, tree, tuple(extra))
        return tree

    def member(self) -> tuple:
        tree = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                tree = ("item", tree, ("const", self.take()))
            else:
                tree = ("item", tree, self.either())
                self.take("]")
        return tree

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("expected an expression")
        kind, value = self.tokens[self.at]
        if kind == "sign":
            if self.take("(", "-") == "-":
                return ("binary", "-", ("const", 0), self.member())
            tree = self.either()
            self.take(")")
            return tree
        self.at += 1
        if kind == "number":
            return ("const", float(value) if "." in value else int(value))
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if value.lower() in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value.lower()])
        return ("name", value)


def parse(source: str) -> tuple:
    """The template as a tree: ("block", nodes)."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in PART.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        left, right = m[1] or m[4] or m[7], m[3] or m[6] or m[8]
        parts.append(("text", text.rstrip() if left else text))
        if m[2] is not None or m[5] is not None:
            parts.append(("print", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    tree, at, end = block(parts, 0, (), 0)
    return tree


def block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...], depth: int) -> tuple[tuple, int, str]:
    """Nodes up to one of the end tags: the tree, the place after, and that tag."""
    if depth > DEPTH:
        raise TemplateError("nested too deeply")
    nodes: list[tuple] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        word = value.split(None, 1)[0] if kind == "tag" and value else ""
        if kind == "text":
            nodes.append(("text", value))
        elif kind == "print":
            nodes.append(("print", Expression(value).whole()))
        elif word in ends:
            return ("block", tuple(nodes)), at, value
        elif word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)):
            body, at, _ = block(parts, at, ("endfor",), depth + 1)
            nodes.append(("for", m[1], Expression(m[2]).whole(), body))
        elif word == "if":
            arms, test, end = [], value[2:], ""
            while end != "endif":
                body, at, end = block(parts, at, ("elif", "else", "endif"), depth + 1)
                arms.append((("const", True) if test is None else Expression(test).whole(), body))
                test = end[4:] if end.startswith("elif") else None
            nodes.append(("if", tuple(arms)))
        elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", value, re.S)):
            nodes.append(("set", m[1], Expression(m[2]).whole()))
        elif word == "generation":
            body, at, _ = block(parts, at, ("endgeneration",), depth + 1)
            nodes.append(("generation", body))
        else:
            raise TemplateError(f"unexpected tag {value!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return ("block", tuple(nodes)), at, ""


def fold(node: tuple) -> tuple:
    """The tree with constant expressions computed, dead branches gone and neighbouring texts joined."""
    kind = node[0]
    if kind in ("binary", "filter", "item", "and", "or", "not"):
        node = tuple(fold(x) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(map(fold, x)) if isinstance(x, tuple) else x for x in node)
        inner = [x for x in node[1:] if isinstance(x, tuple)]
        flat = [y for x in inner for y in ((x,) if not x or isinstance(x[0], str) else x)]
        if all(x[0] == "const" for x in flat if x):
            return ("const", expression(node)({}))
        return node
    if kind == "print":
        value = fold(node[1])
        return ("text", _text(value[1])) if value[0] == "const" else ("print", value)
    if kind in ("for", "set"):
        return (kind, node[1], *map(fold, node[2:]))
    if kind == "generation":
        return (kind, fold(node[1]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        if arms and arms[0][0][0] == "const":
            return arms[0][1]
        return ("if", tuple(arms))
    if kind == "block":
        nodes: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else (x,):
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                elif y != ("text", ""):
                    nodes.append(y)
        return ("block", tuple(nodes))
    return node


def expression(node: tuple) -> Callable[[dict], Any]:
    """A closure that computes the expression in an environment."""
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "not":
        return lambda env, a=expression(node[1]): not a(env)
    if kind == "and":
        return lambda env, a=expression(node[1]), b=expression(node[2]): a(env) and b(env)
    if kind == "or":
        return lambda env, a=expression(node[1]), b=expression(node[2]): a(env) or b(env)
    if kind == "binary":
        return lambda env, op=BINARY[node[1]], a=expression(node[2]), b=expression(node[3]): op(a(env), b(env))
    if kind == "filter":
        extra = [expression(x) for x in node[3]]
        return lambda env, f=FILTERS[node[1]], a=expression(node[2]): f(a(env), *[x(env) for x in extra])

    def item(env: dict, a=expression(node[1]), b=expression(node[2])) -> Any:
        whole, key = a(env), b(env)
        if isinstance(whole, dict):
            return whole.get(key)
        if isinstance(whole, list) and isinstance(key, int):
            return whole[key] if -len(whole) <= key < len(whole) else None
        return None

    return item


Emit = Callable[[str, bool], None]


def statement(node: tuple, masked: bool = False) -> Callable[[dict, Emit], None]:
    """A closure that writes the node's text; ``masked`` tells what stands in a generation block."""
    kind = node[0]
    if kind == "text":
        return lambda env, emit, text=node[1]: emit(text, masked)
    if kind == "print":
        return lambda env, emit, value=expression(node[1]): emit(_text(value(env)), masked)
    if kind == "generation":
        return statement(node[1], True)
    if kind == "set":

        def assign(env: dict, emit: Emit, name=node[1], value=expression(node[2])) -> None:
            env[name] = value(env)

        return assign
    if kind == "if":
        arms = [(expression(t), statement(b, masked)) for t, b in node[1]]

        def choose(env: dict, emit: Emit) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, emit)

        return choose
    if kind == "for":

        def repeat(env: dict, emit: Emit, name=node[1], over=expression(node[2]), body=statement(node[3], masked)) -> None:
            # The rows may be a stream: one item ahead is enough to know the last.
            rows, i, end = iter(over(env) or ()), 0, object()
            item = next(rows, end)
            while item is not end:
                after = next(rows, end)
                i += 1
                body(env | {name: item, "loop": {"index": i, "index0": i - 1, "first": i == 1, "last": after is end}}, emit)
                item = after

        return repeat
    nodes = [statement(x, masked) for x in node[1]]

    def run(env: dict, emit: Emit) -> None:
        for f in nodes:
            f(env, emit)

    return run


def compiled(source: str) -> Callable[[dict, Emit], None]:
    """The template as one closure of context and receiver."""
    return statement(fold(parse(source)))


class Reader:
    """Reads turns back from formatted output and its mask, as they arrive, and the text under the mask.

    Output comes in pieces, the mask as ranges of offsets in the whole output;
    what is learned is cut out of the output by these ranges alone.
    """

    def __init__(self, turn: Callable[[str, str], None], learned: Callable[[str], None]):
        self.turn, self.learned, self.kept, self.opened, self.role = turn, learned, "", None, ""
        self.opens = {o: (r, c) for r, (o, c) in MARKS.items()}
        self.read = 0  # offset of the first character kept
        self.ranges: list[list[int]] = []

    def mask(self, start: int, end: int) -> None:
        if self.ranges and self.ranges[-1][1] == start:
            self.ranges[-1][1] = end
        elif end > start:
            self.ranges.append([start, end])

    def learn(self, start: int, end: int) -> None:
        """The masked parts between two places of what is kept."""
        for a, b in self.ranges:
            a, b = max(a - self.read, start), min(b - self.read, end)
            if a < b:
                self.learned(unescape(self.kept[a:b]))

    def feed(self, piece: str) -> None:
        self.kept += piece
        at = start = 0
        while m := BARE.search(self.kept, at):
            mark, at = m[0], m.end()
            if self.opened is None and mark in self.opens:
                self.role, self.opened = self.opens[mark]
            elif self.opened is None and mark == OTHER_ROLE[0]:
                self.opened = OTHER_ROLE[1]
            elif mark == self.opened:
                text = unescape(self.kept[start : m.start()])
                if mark == OTHER_ROLE[1]:
                    self.role, self.opened = text, OTHER_ROLE[2]
                else:
                    self.turn(self.role, text)
                    self.opened = None
            elif mark != BEGIN or self.opened is not None:
                raise ValueError(f"{mark} does not stand here")
            self.learn(start, m.start())
            self.learn(m.start(), at)
            start = at
        self.kept, self.read = self.kept[start:], self.read + start
        self.ranges = [r for r in self.ranges if r[1] > self.read]

    def end(self) -> None:
        if self.opened is not None or self.kept:
            raise ValueError("the output ends within a turn")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: str = TEMPLATE,
    with_text: bool = True,
) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and ``formatted`` if asked for.

    Turns go in the order of turn (null first), role and text, so repeated
    turns have a fixed order. Null texts and roles are empty; the null
    conversation is one of its own. Turns and the
    text under the loss mask are read back from output and mask.
    A conversation is rendered, read and digested as a stream: without
    ``with_text`` a task holds one turn, however long the conversation. An
    empty table gives no rows; other columns are ignored.
    """
    schema = f"{conv_col} {turns.schema[conv_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + (
        ", formatted string" if with_text else ""
    )
    kind = turns.schema[conv_col].dataType
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        render = compiled(template)
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()][: 7 if with_text else 6]
        names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted"][: len(types)]
        names[0] = conv_col
        out: list[tuple] = []
        stream = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in "crt"), strict=True))
        for conv, members in groupby(stream, key=lambda row: row[0]):
            out.append((conv, *formatted(render, ({"role": r, "text": t} for _, r, t in members), with_text)))
            if len(out) == (100 if with_text else 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").mapInArrow(run, schema)


def formatted(render: Callable[[dict, Emit], None], messages: Iterable[dict], with_text: bool) -> tuple:
    """One conversation's figures, and its output if asked for."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = {"turns": 0, "loss": 0, "chars": 0}
    pieces: list[str] = []

    def turn(role: str, text: str) -> None:
        n["turns"] += 1
        turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))

    def learned(text: str) -> None:
        n["loss"] += len(text)
        loss.update(text.encode("utf-8", "replace"))

    reader = Reader(turn, learned)

    def emit(piece: str, masked: bool) -> None:
        if masked:
            reader.mask(n["chars"], n["chars"] + len(piece))
        n["chars"] += len(piece)
        reader.feed(piece)
        if with_text:
            pieces.append(piece)

    render({"messages": messages}, emit)
    reader.end()
    figures = (n["turns"], turns.hexdigest(), n["loss"], loss.hexdigest(), n["chars"])
    return (*figures, "".join(pieces)) if with_text else figures
