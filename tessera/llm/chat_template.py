"""A sandboxed template language, compiled to Python closures.

Source is parsed into a syntax tree, constants are folded, and every node becomes a closure.  A template sees only the values
it is given: names, keys of mappings, items of lists; there are no calls, attributes of Python objects or imports.

    {{ expression | filter | filter }}
    {% for x in expression %} ... {% endfor %}        loop.index, loop.index0, loop.first, loop.last
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}          marks what a model is trained on
    {# comment #}

A dash beside a marker ({%- or -%}) trims white space on that side.  Expressions: strings, integers, true, false, none, names, x.key,
x['key'], x[0], + ~ == != < > <= >= in, not, and, or, parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

TURN, END, LINE = "<|turn|>", "<|end|>\n", "\n"
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape_line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"


class TemplateError(ValueError):
    """A template that can't be compiled, or does what the sandbox forbids."""


def escape(text: str) -> str:
    """No control string can occur in the result; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\p")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)
_MEANS = {"\\": "\\", "p": "|", "n": "\n"}


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANS[m[1]], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)),
    "escape_line": lambda x: escape_line(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "string": lambda x: _text(x),
}


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else ""


# --- syntax tree ---


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Apply:
    op: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: Any


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class If:
    arms: list  # (condition, body)


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


_PIECE = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>.\[\]()|=,]))", re.S)
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


class _Expression:
    """Recursive descent over the tokens of one marker."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or what is not None and self.tokens[self.at][1] != what:
            raise TemplateError(f"expected {what or 'more'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")

    def name(self) -> str:
        kind, x = self.take()
        if kind != "name" or x in _WORDS or x.startswith("_"):
            raise TemplateError(f"{x!r} can't be a name")
        return x

    def whole(self) -> Any:
        x = self.either()
        while self.peek() == "|":
            self.take()
            kind, f = self.take()
            if f not in FILTERS:
                raise TemplateError(f"no filter {f!r}")
            x = Apply(f"|{f}", [x])
        return x

    def either(self) -> Any:
        x = self.both()
        while self.peek() == "or":
            self.take()
            x = Apply("or", [x, self.both()])
        return x

    def both(self) -> Any:
        x = self.negated()
        while self.peek() == "and":
            self.take()
            x = Apply("and", [x, self.negated()])
        return x

    def negated(self) -> Any:
        if self.peek() == "not":
            self.take()
            return Apply("not", [self.negated()])
        return self.compared()

    def compared(self) -> Any:
        x = self.added()
        while self.peek() in ("==", "!=", "<", ">", "<=", ">=", "in") or self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            op = self.take()[1]
            if op == "not":
                self.take("in")
                x = Apply("not", [Apply("in", [x, self.added()])])
            else:
                x = Apply(op, [x, self.added()])
        return x

    def added(self) -> Any:
        x = self.single()
        while self.peek() in ("+", "~"):
            x = Apply(self.take()[1], [x, self.single()])
        return x

    def single(self) -> Any:
        kind, t = self.take()
        if kind == "str":
            x: Any = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1], flags=re.S))
        elif kind == "int":
            x = Const(int(t))
        elif t in ("true", "false", "none"):
            x = Const({"true": True, "false": False, "none": None}[t])
        elif t == "(":
            x = self.whole()
            self.take(")")
        elif kind == "name" and t not in _WORDS and not t.startswith("_"):
            x = Name(t)
        else:
            raise TemplateError(f"unexpected {t!r}")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                x = Item(x, Const(self.name()))
            else:
                x = Item(x, self.whole())
                self.take("]")
        return x


def parse(source: str) -> list:
    pieces, trim = [], False
    for p in _PIECE.split(source):
        if p.startswith(("{{", "{%")) and len(p) >= 4:
            if p[2] == "-" and pieces and pieces[-1][0] == "text":
                pieces[-1] = ("text", pieces[-1][1].rstrip())
            trim = p[-3] == "-"
            pieces.append(("out" if p[1] == "{" else "tag", p[2:-2].removeprefix("-").removesuffix("-").strip()))
        elif not (p.startswith("{#") and p.endswith("#}")):
            pieces.append(("text", p.lstrip() if trim else p))
            trim = False
    stream = iter(pieces)

    def body(until: tuple[str, ...]) -> tuple[list, str]:
        out: list = []
        for kind, x in stream:
            if kind == "text":
                if x:
                    out.append(Text(x))
                continue
            if kind == "out":
                e = _Expression(x)
                out.append(Output(e.whole()))
                e.end()
                continue
            word, _, rest = x.partition(" ")
            if word in until:
                return out, x
            e = _Expression(rest)
            if word == "for":
                name = e.name()
                e.take("in")
                over = e.whole()
                e.end()
                out.append(For(name, over, body(("endfor",))[0]))
            elif word == "if":
                arms, tag = [], x
                while True:
                    head, _, rest = tag.partition(" ")
                    condition: Any = Const(True)
                    if head != "else":
                        e = _Expression(rest)
                        condition = e.whole()
                        e.end()
                    inner, tag = body(("endif",) if head == "else" else ("elif", "else", "endif"))
                    arms.append((condition, inner))
                    if tag == "endif":
                        break
                out.append(If(arms))
            elif word == "set":
                name = e.name()
                e.take("=")
                out.append(Set(name, e.whole()))
                e.end()
            elif x == "generation":
                out.append(Generation(body(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag {x!r}")
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return out, ""

    return body(())[0]


# --- constants ---


def _apply(op: str, args: list) -> Any:
    a, b = args[0], args[-1]
    if op[0] == "|":
        return FILTERS[op[1:]](a)
    if op == "not":
        return not a
    if op in ("==", "!="):
        return (a == b) == (op == "==")
    if op == "in":
        return b is not None and isinstance(b, (str, list, tuple, dict)) and (not isinstance(b, str) or isinstance(a, str)) and a in b
    if op == "~":
        return _text(a) + _text(b)
    if op == "+":
        if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
            return a + b
        raise TemplateError("+ takes two strings or two numbers")
    if type(a) is not type(b) or not isinstance(a, (int, str)):
        raise TemplateError(f"{op} takes two numbers or two strings")
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and type(key) is int and -len(of) <= key < len(of):
        return of[key]
    return None


def fold(node: Any) -> Any:
    """Constant expressions become constants, constant outputs text, decided branches their bodies; texts are joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return out
    if isinstance(node, Apply):
        args = [fold(x) for x in node.args]
        if all(isinstance(x, Const) for x in args) and node.op not in ("and", "or"):
            return Const(_apply(node.op, [x.value for x in args]))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Apply(node.op, args)
    if isinstance(node, Item):
        of, key = fold(node.of), fold(node.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Output):
        x = fold(node.value)
        return Text(_text(x.value)) if isinstance(x, Const) else Output(x)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, inner in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(inner)))
            if isinstance(condition, Const):
                break
        if not arms:
            return []
        return arms[0][1] if isinstance(arms[0][0], Const) else If(arms)
    return node


# --- closures ---


@dataclass
class Sink:
    """Gathers output; spans are code points of what ``generation`` marks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    open_at: int | None = None

    def write(self, x: str) -> None:
        self.parts.append(x)
        self.length += len(x)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _item(of(env), key(env))
    args, op = [_value(x) for x in node.args], node.op
    if op == "and":
        return lambda env: (x := args[0](env)) and args[1](env)
    if op == "or":
        return lambda env: (x := args[0](env)) or args[1](env)
    if op[0] == "|":
        f, a = FILTERS[op[1:]], args[0]
        return lambda env: f(a(env))
    return lambda env: _apply(op, [x(env) for x in args])


def _with_last(rows: Iterable) -> Iterator[tuple[Any, bool]]:
    """One item ahead, so that rows may be a stream."""
    rows = iter(rows)
    try:
        held = next(rows)
    except StopIteration:
        return
    for x in rows:
        yield held, False
        held = x
    yield held, True


def _block(nodes: list) -> Callable[[dict, Sink], None]:
    steps = [_step(x) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Sink) -> None:
        for s in steps:
            s(env, out)

    return run


def _step(node: Any) -> Callable[[dict, Sink], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda env, out: out.write(text)
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Set):
        name, value = node.name, _value(node.value)
        return lambda env, out: env.__setitem__(name, value(env))
    if isinstance(node, If):
        arms = [(_value(c), _block(b)) for c, b in node.arms]

        def choose(env: dict, out: Sink) -> None:
            for c, b in arms:
                if c(env):
                    return b(env, out)

        return choose
    inner = _block(node.body)
    if isinstance(node, Generation):

        def marked(env: dict, out: Sink) -> None:
            if out.open_at is not None:
                raise TemplateError("generation inside generation")
            start = out.open_at = out.length
            inner(env, out)
            out.open_at = None
            out.spans.append((start, out.length))

        return marked
    name, over = node.name, _value(node.over)

    def loop(env: dict, out: Sink) -> None:
        rows = over(env)
        if isinstance(rows, (str, dict)) or not isinstance(rows, Iterable):
            raise TemplateError("for takes a list")
        for k, (x, last) in enumerate(_with_last(rows)):
            inner({**env, name: x, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": last}}, out)

    return loop


class Template:
    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(parse(source))
        self.run = _block(self.tree)

    def render(self, messages: Iterable[dict], sink: Sink | None = None, **values: Any) -> Sink:
        """``messages`` may be a stream: a loop over it takes one message at a time and looks one ahead."""
        out = sink or Sink()
        self.run({**values, "messages": messages}, out)
        return out
