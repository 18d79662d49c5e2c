"""Chat formatting: a compiler from a small sandboxed template language to Python closures, and its inverse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns between marks; the loss falls on the assistants' texts alone.
CHAT_TEMPLATE = "{% for m in messages %}<|im_start|>{{ m.role|line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}<|im_end|>\n{% endfor %}"

_UNESCAPED = {"n": "\n", "|": "|", "\\": "\\"}


def escape(text: str) -> str:
    """No result holds '<|', so no text can form a mark; unescape gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPED[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind: text, lit, name, field, not, and, or, ==, !=, +, filter, emit, if, for, generation or block."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[+|.()\[\]]))")


class _Parser:
    """Recursive descent. Names and fields are looked up in the given data only; there are no calls, so nothing else can be reached."""

    def __init__(self, source: str):
        self.chunks = [x for x in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S) if x]
        self.at = 0

    def block(self, ends: tuple[str, ...]) -> tuple[Node, str]:
        parts = []
        while self.at < len(self.chunks):
            chunk = self.chunks[self.at]
            self.at += 1
            if chunk.startswith("{{"):
                parts.append(Node("emit", None, (self.expression(chunk[2:-2]),)))
            elif chunk.startswith("{%"):
                tag = chunk[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return Node("block", None, tuple(parts)), tag
                parts.append(self.statement(word, tag[len(word) :].strip()))
            else:
                parts.append(Node("text", chunk))
        if ends:
            raise TemplateError(f"expected one of {ends}")
        return Node("block", None, tuple(parts)), ""

    def statement(self, word: str, rest: str) -> Node:
        if word == "generation":
            return Node("generation", None, (self.block(("endgeneration",))[0],))
        if word == "for":
            if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", rest)):
                raise TemplateError(f"bad for: {rest}")
            return Node("for", (m[1], m[2]), (self.block(("endfor",))[0],))
        if word == "if":
            test = self.expression(rest)
            body, end = self.block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return Node("if", None, (test, body, self.statement("if", end[4:])))
            other = self.block(("endif",))[0] if end == "else" else Node("block")
            return Node("if", None, (test, body, other))
        raise TemplateError(f"unknown tag: {word}")

    def expression(self, source: str) -> Node:
        self.words, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"bad expression: {source}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.words.append(("end", ""))
        out = self.either()
        if self.words[0][0] != "end":
            raise TemplateError(f"bad expression: {source}")
        return out

    def take(self, value: str) -> bool:
        if self.words[0][0] in ("op", "name") and self.words[0][1] == value:
            self.words.pop(0)
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value}")

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", None, (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", None, (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("not", None, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        out = self.joined()
        for op in ("==", "!="):
            if self.take(op):
                return Node(op, None, (out, self.joined()))
        return out

    def joined(self) -> Node:
        out = self.filtered()
        while self.take("+"):
            out = Node("+", None, (out, self.filtered()))
        return out

    def filtered(self) -> Node:
        out = self.atom()
        while self.take("|"):
            kind, name = self.words.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter: {name}")
            out = Node("filter", name, (out,))
        return out

    def atom(self) -> Node:
        kind, word = self.words.pop(0)
        if kind == "str":
            out = Node("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]))
        elif kind == "int":
            out = Node("lit", int(word))
        elif (kind, word) == ("op", "("):
            out = self.either()
            self.need(")")
        elif kind == "name":
            out = Node("lit", word == "true") if word in ("true", "false") else Node("name", word)
        else:
            raise TemplateError(f"unexpected {word!r}")
        while True:
            if self.take("."):
                kind, word = self.words.pop(0)
                if kind != "name":
                    raise TemplateError("a field needs a name")
            elif self.take("["):
                kind, word = self.words.pop(0)
                if kind != "str":
                    raise TemplateError("an index needs a string")
                word = word[1:-1]
                self.need("]")
            else:
                return out
            out = Node("field", word, (out,))


def parse(source: str) -> Node:
    return _Parser(source).block(())[0]


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_PURE = {
    "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _text(a) + _text(b),
}


def fold(node: Node) -> Node:
    """Evaluates what depends on no data, drops branches never taken, and joins neighbouring texts."""
    parts = tuple(map(fold, node.parts))
    if node.kind in _PURE and all(x.kind == "lit" for x in parts):
        return Node("lit", _PURE[node.kind](*(x.value for x in parts)))
    if node.kind == "filter" and parts[0].kind == "lit":
        return Node("lit", FILTERS[node.value](_text(parts[0].value)))
    if node.kind == "emit" and parts[0].kind == "lit":
        return Node("text", _text(parts[0].value))
    if node.kind == "if" and parts[0].kind == "lit":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x.parts if x.kind == "block" else (x,):
                if y.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + y.value)
                elif y.kind != "text" or y.value:
                    flat.append(y)
        parts = tuple(flat)
    return Node(node.kind, node.value, parts)


Env = dict[str, object]
#: Appends to the output: texts, and True and False where a generation begins and ends.
Render = Callable[[Env, list], None]


def _value(node: Node) -> Callable[[Env], object]:
    if node.kind == "lit":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, n=node.value: env.get(n)
    inner = [_value(x) for x in node.parts]
    if node.kind == "field":
        return lambda env, f=inner[0], n=node.value: x.get(n) if isinstance(x := f(env), dict) else None
    if node.kind == "filter":
        return lambda env, f=inner[0], g=FILTERS[node.value]: g(_text(f(env)))
    if node.kind in ("and", "or"):
        a, b = inner
        return (lambda env: a(env) and b(env)) if node.kind == "and" else (lambda env: a(env) or b(env))
    return lambda env, g=_PURE[node.kind]: g(*(f(env) for f in inner))


def closure(node: Node) -> Render:
    if node.kind == "text":
        return lambda env, out, t=node.value: out.append(t)
    if node.kind == "emit":
        return lambda env, out, f=_value(node.parts[0]): out.append(_text(f(env)))
    if node.kind == "if":
        test, yes, no = _value(node.parts[0]), closure(node.parts[1]), closure(node.parts[2])
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if node.kind == "generation":
        body = closure(node.parts[0])

        def marked(env: Env, out: list) -> None:
            out.append(True)
            body(env, out)
            out.append(False)

        return marked
    if node.kind == "block":
        steps = [closure(x) for x in node.parts]

        def all_of(env: Env, out: list) -> None:
            for step in steps:
                step(env, out)

        return all_of
    raise TemplateError(f"{node.kind} isn't allowed here")


@dataclass(frozen=True)
class Template:
    """What stands before the loop over messages, its body, and what stands after: so a turn renders without the other turns."""

    name: str
    before: Render
    body: Render
    after: Render

    def render(self, message: dict, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """The part of one turn, and the spans of it (code points) that a generation wrote."""
        env: Env = {self.name: message, "loop": {"index0": index, "first": index == 0, "last": last}}
        out: list = []
        if index == 0:
            self.before(env, out)
        self.body(env, out)
        if last:
            self.after(env, out)
        texts, spans, at, since = [], [], 0, None
        for x in out:
            if x is True:
                since = at
            elif x is False:
                spans.append((since, at))
            else:
                texts.append(x)
                at += len(x)
        return "".join(texts), spans


def compile_template(source: str) -> Template:
    """A template has one loop over `messages`, at its top level."""
    try:
        tree = fold(parse(source))
    except IndexError:
        raise TemplateError("the template ends too early") from None
    loops = [i for i, x in enumerate(tree.parts) if x.kind == "for"]
    if len(loops) != 1 or tree.parts[loops[0]].value[1] != "messages":
        raise TemplateError("one top-level loop over messages is needed")
    k = loops[0]
    return Template(tree.parts[k].value[0], closure(Node("block", None, tree.parts[:k])), closure(tree.parts[k].parts[0]), closure(Node("block", None, tree.parts[k + 1 :])))


def format_turns(turns: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """A row per turn: conv_id, turn_index (from 0), formatted, loss_spans (code points in formatted; half open).

    Turns are ordered by turn, then role and text; rows that repeat are turns of their own. Null texts and roles count as empty, a
    null conv_id is a conversation, a null turn comes first. The parts of a conversation, one after the other, are its rendering;
    a conversation of any length passes a task row by row. An empty table gives an empty table; other columns aren't read.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", (F.row_number().over(order) - 1).alias("turn_index"), F.lead(F.lit(1)).over(order).isNull().alias("last"), "role", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template(template)
        for batch in batches:
            done = [made.render({"role": r, "text": t}, i, last) for i, last, r, t in zip(*(batch.column(c).to_pylist() for c in ("turn_index", "last", "role", "text")))]
            spans = pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in done], kind)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_index"), pa.array([t for t, _ in done], pa.string()), spans], names=["conv_id", "turn_index", "formatted", "loss_spans"])

    return rows.mapInArrow(render, "conv_id long, turn_index int, formatted string, loss_spans array<struct<start:long,stop:long>>")


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted parts (see format_turns) say, read from them alone, a row per conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_index")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def row() -> tuple:
            conv, turns, said, chars, loss, length = state
            return conv, turns, said.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            out = []
            for conv, part, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                if conv != now:
                    if state:
                        out.append(row())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in _TURN.findall(part):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for span in spans:
                    text = unescape(part[span["start"] : span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(part)
            yield _rows(out)
        if state:
            yield _rows([row()])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return rows.mapInArrow(digest, schema)
