"""A small template language for conversations, compiled to Python closures.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for message in messages %} {% endfor %}      once, not inside other tags
    {% generation %} {% endgeneration %}            what lies between is learnt from
    {# comment #}      a '-' inside a tag strips the white space on its side

Expressions: strings, integers, true, false, none; the constants given to
``Template``; ``message.role``, ``message.text``; ``loop.index`` (from 1),
``index0``, ``first``, ``last``, ``length``; ``== != < <= > >= in and or not +
~ ( )``, ``a if c else b``, and the filters ``escape trim upper lower length``
and ``default(x)``.  The language is a sandbox: it has no calls, no attributes
but those, no loop but the one over the turns, and data never reaches the
parser; everything else is a ``TemplateError`` when the template is compiled.

Compilation is parse -> fold -> closures.  Folding evaluates what depends on
constants only, drops branches that cannot be taken and joins adjacent texts.
The nodes before the loop, its body and the nodes after it become three
closures, so turns can be rendered where they are, without their conversation.

``escape`` makes control strings inside texts harmless and can be undone: a
backslash is doubled, and the first character of a control string gets a
backslash behind it.  Control strings may not overlap each other, so none can
arise where a text meets a marker.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

DEPTH, SIZE = 32, 1 << 16


class TemplateError(ValueError):
    pass


# --- escaping -------------------------------------------------------------------------------------------------------

class Controls:
    """The strings that steer a model, and how they are written inside texts."""

    def __init__(self, strings: list[str]):
        for a in strings:
            if len(a) < 2 or "\\" in a:
                raise TemplateError(f"control string {a!r} is too short or holds a backslash")
            for b in strings:
                if any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)) + (a != b)) if b[:i] != a):
                    raise TemplateError(f"control strings {a!r} and {b!r} overlap")
        self.strings = list(strings)
        self.start = re.compile("(?s)(?=" + "|".join(map(re.escape, strings)) + ")(.)")

    def escape(self, text: str) -> str:
        return self.start.sub(r"\1\\", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(?s)\\(\\?)", r"\1", text) if "\\" in text else text


# --- syntax tree ----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    of: str          # constant name, "message" or "loop"
    field: str = ""


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class If:
    cond: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


MESSAGE, LOOP = {"role", "text"}, {"index", "index0", "first", "last", "length"}
_TAG = re.compile(r"(?s)\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}")
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>()+~.|,]))""")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
            "in": lambda a, b: a in b}


class Parser:
    def __init__(self, source: str, constants: dict):
        if len(source) > SIZE:
            raise TemplateError("template too long")
        self.constants, self.loop_name, self.loops, self.depth = constants, None, 0, 0
        self.items, self.at = self._split(source), 0

    def _split(self, source: str) -> list:
        items, end, strip = [], 0, False

        def text(raw, cut):
            raw = raw.lstrip() if strip else raw
            raw = raw.rstrip() if cut else raw
            if "{{" in raw or "{%" in raw or "{#" in raw:
                raise TemplateError("tag without an end")
            if raw:
                items.append(("text", raw))

        for m in _TAG.finditer(source):
            text(source[end:m.start()], m[1] == "-" or m[4] == "-")
            strip, end = m[3] == "-" or m[6] == "-", m.end()
            if m[2] is not None:
                items.append(("out", m[2]))
            elif m[5] is not None:
                items.append(("tag", m[5].strip()))
        text(source[end:], False)
        return items

    # statements
    def template(self) -> tuple:
        nodes, stop = self.block(())
        return nodes

    def block(self, ends: tuple, top: bool = True) -> tuple[tuple, str]:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        nodes = []
        while self.at < len(self.items):
            kind, body = self.items[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Text(body))
            elif kind == "out":
                nodes.append(Out(self.expression(body)))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    self.depth -= 1
                    return tuple(nodes), body
                nodes.append(self.statement(word, body))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        self.depth -= 1
        return tuple(nodes), ""

    def statement(self, word: str, body: str):
        if word == "if":
            return self.branch(body[2:])
        if word == "generation" and body == word:
            return Generation(self.block(("endgeneration",))[0])
        m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", body)
        if m:
            self.loops += 1
            if self.depth > 1 or self.loops > 1 or m[1] in self.constants or m[1] in ("loop", "messages"):
                raise TemplateError("one loop, not inside another tag, with a name of its own")
            self.loop_name = m[1]
            inside = self.block(("endfor",))[0]
            self.loop_name = None
            return For(inside)
        raise TemplateError(f"unknown tag {body!r}")

    def branch(self, cond: str) -> If:
        test = self.expression(cond)
        then, end = self.block(("elif", "else", "endif"))
        if end.startswith("elif"):
            return If(test, then, (self.branch(end[4:]),))
        other = self.block(("endif",))[0] if end == "else" else ()
        return If(test, then, other)

    # expressions, by rising precedence
    def expression(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        tree = self.choice()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def take(self, *values: str) -> str:
        kind, value = self.tokens[0]
        if kind in ("op", "name") and value in values:
            self.tokens.pop(0)
            return value
        return ""

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def choice(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        tree = self.chain("or", lambda: self.chain("and", self.inverse))
        if self.take("if"):
            cond = self.chain("or", lambda: self.chain("and", self.inverse))
            self.need("else")
            tree = Op("choose", (cond, tree, self.choice()))
        self.depth -= 1
        return tree

    def chain(self, word, part):
        tree = part()
        while self.take(word):
            tree = Op(word, (tree, part()))
        return tree

    def inverse(self):
        n = 0
        while self.take("not"):
            n += 1
        tree = self.compare()
        return Op("not", (tree,)) if n % 2 else Op("not", (Op("not", (tree,)),)) if n else tree

    def compare(self):
        tree = self.joined()
        op = self.take(*_COMPARE)
        return Op(op, (tree, self.joined())) if op else tree

    def joined(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = Op(op, (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.value()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if name == "default":
                self.need("(")
                tree = Op("default", (tree, self.choice()))
                self.need(")")
            elif name in ("escape", "trim", "upper", "lower", "length"):
                tree = Op(name, (tree,))
            else:
                raise TemplateError(f"unknown filter {name!r}")
        return tree

    def value(self):
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return Const(int(value))
        if kind == "op" and value == "(":
            tree = self.choice()
            self.need(")")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if value in self.constants:
            return Const(self.constants[value])
        fields = MESSAGE if value == self.loop_name else LOOP if value == "loop" and self.loop_name else None
        if fields is None or not self.take("."):
            raise TemplateError(f"unknown name {value!r}")
        kind, field = self.tokens.pop(0)
        if field not in fields:
            raise TemplateError(f"no field {field!r}")
        return Name("message" if value == self.loop_name else "loop", field)


# --- meaning --------------------------------------------------------------------------------------------------------

def _shown(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _ordered(op):
    def run(a, b):
        try:
            return _COMPARE[op](a, b)
        except TypeError:
            return False
    return run


def _added(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b)


def _functions(controls: Controls) -> dict[str, Callable]:
    return {**{op: _ordered(op) for op in _COMPARE}, "+": _added, "~": lambda a, b: _shown(a) + _shown(b),
            "not": lambda a: not a, "escape": lambda a: controls.escape(_shown(a)), "trim": lambda a: _shown(a).strip(),
            "upper": lambda a: _shown(a).upper(), "lower": lambda a: _shown(a).lower(), "length": lambda a: len(_shown(a)),
            "default": lambda a, b: b if a is None or a == "" else a}


def fold(node, functions: dict):
    """The same tree with everything constant evaluated."""
    if not isinstance(node, Op):
        return node
    args = tuple(fold(a, functions) for a in node.args)
    first = args[0]
    if node.op in ("and", "or", "choose") and isinstance(first, Const):
        if node.op == "choose":
            return args[1] if first.value else args[2]
        return args[1] if bool(first.value) == (node.op == "and") else first
    if node.op in functions and all(isinstance(a, Const) for a in args):
        return Const(functions[node.op](*[a.value for a in args]))
    return Op(node.op, args)


def fold_nodes(nodes: tuple, functions: dict) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Out):
            e = fold(n.expr, functions)
            new = (Text(_shown(e.value)),) if isinstance(e, Const) else (Out(e),)
        elif isinstance(n, If):
            cond = fold(n.cond, functions)
            then, other = fold_nodes(n.then, functions), fold_nodes(n.other, functions)
            new = (then if cond.value else other) if isinstance(cond, Const) else (If(cond, then, other),)
        elif isinstance(n, (For, Generation)):
            new = (type(n)(fold_nodes(n.body, functions)),)
        else:
            new = (n,)
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + x.text)
            elif x != Text(""):
                out.append(x)
    return tuple(out)


class Sink:
    """Rendered text and the spans under the loss mask, in code points."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def compile_expression(e, functions: dict) -> Callable:
    if isinstance(e, Const):
        return lambda message, loop, v=e.value: v
    if isinstance(e, Name):
        return (lambda message, loop, k=e.field: message[k]) if e.of == "message" else (lambda message, loop, k=e.field: loop[k])
    args = [compile_expression(a, functions) for a in e.args]
    if e.op == "and":
        return lambda m, l, a=args[0], b=args[1]: a(m, l) and b(m, l)
    if e.op == "or":
        return lambda m, l, a=args[0], b=args[1]: a(m, l) or b(m, l)
    if e.op == "choose":
        return lambda m, l, c=args[0], a=args[1], b=args[2]: a(m, l) if c(m, l) else b(m, l)
    f = functions[e.op]
    if len(args) == 1:
        return lambda m, l, f=f, a=args[0]: f(a(m, l))
    return lambda m, l, f=f, a=args[0], b=args[1]: f(a(m, l), b(m, l))


def compile_nodes(nodes: tuple, functions: dict) -> Callable:
    """A closure (sink, message, loop) that renders ``nodes``."""
    steps = []
    for n in nodes:
        if isinstance(n, Text):
            steps.append(lambda sink, m, l, t=n.text: sink.write(t))
        elif isinstance(n, Out):
            steps.append(lambda sink, m, l, e=compile_expression(n.expr, functions): sink.write(_shown(e(m, l))))
        elif isinstance(n, If):
            c, a, b = compile_expression(n.cond, functions), compile_nodes(n.then, functions), compile_nodes(n.other, functions)
            steps.append(lambda sink, m, l, c=c, a=a, b=b: (a if c(m, l) else b)(sink, m, l))
        elif isinstance(n, Generation):
            def marked(sink, m, l, body=compile_nodes(n.body, functions)):
                start = sink.size
                body(sink, m, l)
                sink.spans.append((start, sink.size))
            steps.append(marked)
        else:
            raise TemplateError("the loop stands at the top")
    if len(steps) == 1:
        return steps[0]

    def run(sink, m, l):
        for s in steps:
            s(sink, m, l)
    return run


def _mentions(node, kind) -> bool:
    if isinstance(node, tuple):
        return any(_mentions(n, kind) for n in node)
    if isinstance(node, Name):
        return node.of == kind
    return any(_mentions(v, kind) for v in vars(node).values() if isinstance(v, (tuple, *_NODES)))


_NODES = (Const, Name, Op, Text, Out, If, For, Generation)


class Template:
    """A compiled template: ``head`` and ``foot`` of a conversation and its ``turn``."""

    def __init__(self, source: str, controls: list[str], constants: dict | None = None):
        self.source, self.constants = source, dict(constants or {})
        self.controls = Controls(controls)
        functions = _functions(self.controls)
        self.tree = fold_nodes(Parser(source, self.constants).template(), functions)
        at = [i for i, n in enumerate(self.tree) if isinstance(n, For)]
        if not at:
            raise TemplateError("a template loops over the turns")
        before, body, after = self.tree[:at[0]], self.tree[at[0]].body, self.tree[at[0] + 1:]
        self.head, self.turn, self.foot = (compile_nodes(x, functions) for x in (before, body, after))
        #: whether a turn's text depends on where it stands
        self.positional = _mentions(body, "loop")

    def __reduce__(self):          # closures are compiled again where they are used
        return Template, (self.source, self.controls.strings, self.constants)

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """Text and loss spans of a whole conversation."""
        sink = Sink()
        self.head(sink, None, None)
        for i, m in enumerate(messages):
            self.turn(sink, m, loop_at(i, len(messages)))
        self.foot(sink, None, None)
        return sink.text(), sink.spans


def loop_at(i: int, n: int) -> dict:
    return {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
