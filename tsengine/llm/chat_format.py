"""Chat formatting: a small sandboxed template language, compiled to Python closures.

``compile_template`` turns the source into tokens, a syntax tree and, after folding constants, nested
closures. Templates have text, ``{{ expression }}``, ``{% for x in e %}``, ``{% if e %}`` with
``elif`` and ``else``, ``{% set x = e %}`` and ``{% generation %}`` blocks, whose output is the text
to learn. Expressions have literals, names, member access by ``.name`` or ``[e]`` (entries of
dictionaries and lists only, never Python attributes), ``not``, ``and``, ``or``, ``==``, ``!=``,
``+`` and the filters passed to the compiler. Nothing else can be reached from a template.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, fields, is_dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_slices


class TemplateError(ValueError):
    """A template that doesn't follow the grammar, or reaches for what isn't there."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
LEXEME = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+=\[\]()]))""")
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
WORDS = {"true": True, "false": False, "none": None}


class Expression:
    """Recursive descent over the lexemes of one expression or statement."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := LEXEME.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self, *values: str) -> bool:
        if found := self.peek(*values):
            self.at += 1
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self):
        tree = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        tree = self.added()
        for kind in ("==", "!="):
            if self.take(kind):
                return Op(kind, (tree, self.added()))
        return tree

    def added(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Op("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.member()
        while self.take("|"):
            tree = Filter(self.name(), tree)
        return tree

    def member(self):
        tree = self.atom()
        while True:
            if self.take("."):
                tree = Member(tree, Const(self.name()))
            elif self.take("["):
                tree = Member(tree, self.either())
                self.need("]")
            else:
                return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.at >= len(self.items):
            raise TemplateError("the expression ends too early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            return Const(WORDS[value]) if value in WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of statements."""
    parts, at = [], 0
    for m in PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("statement", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str):
        out = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                out.append(Emit(Const(text)))
            elif kind == "value":
                out.append(Emit(Expression(text).whole()))
            else:
                e = Expression(text)
                word = e.name()
                if word in ends:
                    return tuple(out), word, e
                out.append(statement(word, e))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), "", None

    def statement(word: str, e: Expression):
        if word == "set":
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.whole()
            return For(name, over, block("endfor")[0])
        if word == "generation":
            return Generation(block("endgeneration")[0])
        if word == "if":
            return branches(e.whole())
        raise TemplateError(f"unknown statement {word!r}")

    def branches(test):
        then, word, e = block("elif", "else", "endif")
        if word == "elif":
            return If(test, then, (branches(e.whole()),))
        return If(test, then, block("endif")[0] if word == "else" else ())

    return block()[0]


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b}


def fold(node, filters):
    """Constants computed once: operators and filters over literals, decided branches, joined text."""
    one = lambda x: fold(x, filters)
    if isinstance(node, Op):
        args = tuple(map(one, node.args))
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and node.kind not in ("and", "or"):
            return Const(not args[0].value if node.kind == "not" else OPS[node.kind](*(a.value for a in args)))
        return Op(node.kind, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = one(node.of)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Member):
        return Member(one(node.of), one(node.key))
    if isinstance(node, Emit):
        return Emit(one(node.value))
    if isinstance(node, Set):
        return Set(node.name, one(node.value))
    if isinstance(node, For):
        return For(node.name, one(node.over), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        test = one(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, tuple):
        out = []
        for x in map(one, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    y = Emit(Const("" if y.value.value is None else str(y.value.value)))
                    if not y.value.value:
                        continue
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(out[-1].value.value + y.value.value))
                        continue
                out.append(y)
        return tuple(out)
    return node


class Output:
    """Rendered text so far and the spans that generation blocks wrote."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, value) -> None:
        if value is not None:
            text = value if isinstance(value, str) else str(value)
            self.parts.append(text)
            self.length += len(text)


def _value(node, filters):
    """Closure from the environment to the value of an expression."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def look_up(env, name=node.name):
            if name not in env:
                raise TemplateError(f"{name!r} isn't defined")
            return env[name]

        return look_up
    if isinstance(node, Member):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def entry(env):
            box, k = of(env), key(env)
            if isinstance(box, dict):
                return box.get(k)
            if isinstance(box, list) and isinstance(k, int):
                return box[k] if -len(box) <= k < len(box) else None
            raise TemplateError("only entries of dictionaries and lists can be read")

        return entry
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    args = [_value(a, filters) for a in node.args]
    if node.kind == "not":
        return lambda env: not args[0](env)
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    f = OPS[node.kind]
    return lambda env: f(args[0](env), args[1](env))


def _action(node, filters):
    """Closure that writes what a statement renders."""
    if isinstance(node, tuple):
        steps = [_action(x, filters) for x in node]

        def run(env, out):
            for step in steps:
                step(env, out)

        return run
    if isinstance(node, Emit):
        value = _value(node.value, filters)
        return lambda env, out: out.write(value(env))
    if isinstance(node, Set):
        value = _value(node.value, filters)
        return lambda env, out: env.__setitem__(node.name, value(env))
    body = _action(node.then if isinstance(node, If) else node.body, filters)
    if isinstance(node, If):
        test, other = _value(node.test, filters), _action(node.other, filters)
        return lambda env, out: (body if test(env) else other)(env, out)
    if isinstance(node, For):
        over = _value(node.over, filters)

        def loop(env, out):
            for item in over(env) or ():
                env[node.name] = item
                body(env, out)

        return loop

    def generation(env, out):
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generation


def compile_template(source: str, filters: dict | None = None):
    """A function from a dictionary of names to (text, spans of generated text)."""
    filters = dict(filters or {})
    action = _action(fold(parse(source), filters), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        action(dict(names), out)
        return "".join(out.parts), out.spans

    return render


HEAD, MID, END = "### ", ": ", "</turn>\n"
TEMPLATE = "{% for m in messages %}### {{ m.role | escape_role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
CONTROL, ROLE_CONTROL = re.compile(r"\\|### |</turn>"), re.compile(r"\\|### |</turn>|:")
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text) -> str:
    """A backslash before every backslash and every control string."""
    return CONTROL.sub(r"\\\g<0>", text or "")


def escape_role(role) -> str:
    return ROLE_CONTROL.sub(r"\\\g<0>", role or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "escape_role": escape_role}


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if not (m := TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chats(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (code points of the text to learn).

    ``rows`` has conv_id, turn, role, text; other columns are ignored. Turns go by ``turn``, ties by
    role and then text, nulls first; repeated rows are repeated turns. Null roles and texts are
    empty. Rows without a conv_id are one conversation. An empty table gives an empty result. A
    conversation is one rendered text, so one task holds it; ``format_turns`` is for conversations too
    long for that.
    """
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def render(batches):
        run = compile_template(template, FILTERS)
        for batch in batches:
            turns = batch.column("turns")
            for a, b in slices(turns.value_lengths().to_numpy(zero_copy_only=False), 4000):
                done = [run({"messages": [dict(t) for t in ts]}) for ts in turns.slice(a, b - a).to_pylist()]
                spans = pa.array([[{"start": s, "stop": e} for s, e in x[1]] for x in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(a, b - a), pa.array([x[0] for x in done], pa.string()), spans], ["conv_id", "formatted", "spans"])

    return chats.mapInArrow(render, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted STRING, spans ARRAY<STRUCT<start: LONG, stop: LONG>>")


def turn_template(source: str, filters: dict | None = None):
    """For a template that is one loop over ``messages`` whose body knows the turn alone: a function from
    a turn to (text, spans). Others raise ``TemplateError``, as their turns can't be rendered apart."""
    filters = dict(filters or {})
    tree = fold(parse(source), filters)
    if len(tree) != 1 or not isinstance(tree[0], For) or tree[0].over != Name("messages"):
        raise TemplateError("the template isn't one loop over messages")
    if _names(tree[0].body, {tree[0].name}):
        raise TemplateError(f"a turn needs {sorted(_names(tree[0].body, {tree[0].name}))}, which it doesn't have")
    loop, action = tree[0].name, _action(tree[0].body, filters)

    def render(turn: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        action({loop: turn}, out)
        return "".join(out.parts), out.spans

    return render


def _names(node, known: set[str]) -> set[str]:
    """Names that a part of a tree reads or sets beyond those it is given."""
    if isinstance(node, tuple):
        return set().union(*(_names(x, known) for x in node)) if node else set()
    if isinstance(node, Name):
        return {node.name} - known
    if isinstance(node, Set):
        return {node.name}  # what one turn sets, the next would read
    if isinstance(node, For):
        return _names(node.over, known) | _names(node.body, known | {node.name})
    if is_dataclass(node):
        return set().union(*(_names(getattr(node, f.name), known) for f in fields(node))) if fields(node) else set()
    return set()


def format_turns(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, start (the code points of its conversation before it)
    and spans (code points in its conversation of the text to learn).

    A conversation is the ``formatted`` of its rows in order; partitions hold whole conversations, sorted.
    Turns pass as a stream, so a conversation of any length takes bounded memory; it takes one task, as
    offsets run through it. Order, nulls, ties, repeated rows and other columns as in ``format_chats``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    own = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])

    def work(batches):
        render, here, at = turn_template(template, FILTERS), object(), 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for conv, turn, role, text in zip(*(part.column(c).to_pylist() for c in order), strict=True):
                    if conv != here:
                        here, at = conv, 0
                    formatted, spans = render({"turn": turn, "role": role, "text": text})
                    out.append((formatted, at, [{"start": at + x, "stop": at + y} for x, y in spans]))
                    at += len(formatted)
                texts, starts, spans = zip(*out, strict=True) if out else ((), (), ())
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(spans, span)], ["conv_id", "turn", "formatted", "start", "spans"])

    turn_template(template, FILTERS)
    return own.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, f"conv_id {kind}, turn {rows.schema['turn'].dataType.simpleString()}, formatted STRING, start LONG, spans ARRAY<STRUCT<start: LONG, stop: LONG>>")


def digest(rows: DataFrame) -> DataFrame:
    """Columns of the registered query, all read back from the formatted turns and their spans."""
    probe = rows.sparkSession.sql(r"SELECT -7L AS conv_id, * FROM VALUES (0L, 'user', '\\### Assistant: </turn> ok'), (1L, 'assistant', '\\### Assistant: </turn> ok') AS t(turn, role, text)")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def back(batches):
        """Conversations follow each other in a partition; their hashes grow turn by turn."""
        here, state = None, None

        def done():
            turns, whole, chars, loss, total = state
            return here, turns, whole.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            out = []
            for conv, text, start, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "spans")), strict=True):
                if state is None or conv != here:
                    if state is not None:
                        out.append(done())
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode())
                for span in spans:
                    loss = unescape(text[span["start"] - start : span["stop"] - start])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] = start + len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), kinds, strict=True)], names)

    turns = format_turns(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe))
    return turns.mapInArrow(back, "conv_id LONG, n_turns LONG, turns_sha256 STRING, loss_chars LONG, loss_sha256 STRING, formatted_chars LONG")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok')) AS t(turn, role, text)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(escaped) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
