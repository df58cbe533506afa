"""A sandboxed template language compiled to Python closures.

Statements: ``for``/``endfor``, ``if``/``elif``/``else``/``endif``, ``generation``/``endgeneration``.
Expressions: literals, names, ``a.b`` (keys of mappings only), ``==``, ``!=``, ``~``, ``not``,
``and``, ``or``, parentheses and filters from a fixed list.  Nothing else of Python can be reached.
Rendering is lazy: it yields (text, is generated) pieces, so an endless loop variable is fine.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

_MARK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\d+)|(==|!=|[~|().])|([A-Za-z_]\w*))""")

_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Put a backslash before each backslash, ``<`` and ``>``, so no control string remains."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "capitalize": str.capitalize, "trim": str.strip}


class TemplateError(ValueError):
    """The template is not well formed or reaches outside the sandbox."""


# ---- syntax tree: expressions are ("const", v) | ("name", n) | ("key", e, k) | ("op", f, e...) ----
def _words(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        if not (m := _LEX.match(source, at)):
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append(("lit", m[1]) if m[1] else ("op", m[2]) if m[2] else ("name", m[3]))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str):
        self.words, self.at = _words(source), 0

    def peek(self):
        return self.words[self.at][1] if self.at < len(self.words) else None

    def take(self, what=None):
        kind, word = self.words[self.at] if self.at < len(self.words) else (None, None)
        if word is None or what is not None and word != what:
            raise TemplateError(f"expected {what or 'more'}, found {word!r}")
        self.at += 1
        return kind, word

    def whole(self):
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def _chain(self, word, below, f):
        tree = below()
        while self.peek() == word:
            self.take()
            tree = _op(f, tree, below())
        return tree

    def either(self):
        return self._chain("or", self.both, lambda a, b: a or b)

    def both(self):
        return self._chain("and", self.negation, lambda a, b: a and b)

    def negation(self):
        if self.peek() == "not":
            self.take()
            return _op(lambda a: not a, self.negation())
        return self.compared()

    def compared(self):
        tree = self.joined()
        if self.peek() in ("==", "!="):
            same = self.take()[1] == "=="
            return _op((lambda a, b: a == b) if same else (lambda a, b: a != b), tree, self.joined())
        return tree

    def joined(self):
        return self._chain("~", self.filtered, lambda a, b: _text(a) + _text(b))

    def filtered(self):
        tree = self.atom()
        while self.peek() in (".", "|"):
            sign, name = self.take()[1], self.take()
            if name[0] != "name" or name[1].startswith("_"):
                raise TemplateError(f"{name[1]!r} is not allowed here")
            if sign == ".":
                tree = ("key", tree, name[1])
            elif name[1] in FILTERS:
                tree = _op(lambda a, f=FILTERS[name[1]]: f(_text(a)), tree)
            else:
                raise TemplateError(f"no filter {name[1]!r}")
        return tree

    def atom(self):
        kind, word = self.take()
        if kind == "lit":
            return ("const", ast.literal_eval(word))
        if word == "(":
            tree = self.either()
            self.take(")")
            return tree
        if kind != "name" or word.startswith("_"):
            raise TemplateError(f"{word!r} is not allowed here")
        fixed = {"true": True, "false": False, "none": None}
        return ("const", fixed[word]) if word in fixed else ("name", word)


def _text(value) -> str:
    return "" if value is None else str(value)


def _op(f, *args):
    """An operation, folded at once when all its arguments are constants."""
    return ("const", f(*(a[1] for a in args))) if all(a[0] == "const" for a in args) else ("op", f, *args)


def _closure(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda ctx, v=tree[1]: v
    if kind == "name":
        return lambda ctx, n=tree[1]: ctx.get(n)
    if kind == "key":
        inner, key = _closure(tree[1]), tree[2]

        def get(ctx):
            value = inner(ctx)
            return value.get(key) if isinstance(value, dict) else None

        return get
    f, args = tree[1], [_closure(a) for a in tree[2:]]
    if len(args) == 1:
        (a,) = args
        return lambda ctx: f(a(ctx))
    a, b = args
    return lambda ctx: f(a(ctx), b(ctx))


def parse(source: str) -> list:
    """Syntax tree: ("text", s), ("out", expr), ("for", name, expr, body), ("if", [(expr, body)]), ("gen", body)."""
    tokens, at = [], 0
    for m in _MARK.finditer(source):
        if m.start() > at:
            tokens.append(("text", source[at : m.start()]))
        tokens.append(("out", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    if at < len(source):
        tokens.append(("text", source[at:]))
    pos = 0

    def block(ends: tuple[str, ...]):
        nonlocal pos
        body = []
        while pos < len(tokens):
            kind, value = tokens[pos]
            pos += 1
            if kind == "text":
                body.append(("text", value))
            elif kind == "out":
                body.append(("out", _Expression(value).whole()))
            else:
                head, _, rest = value.partition(" ")
                if head in ends:
                    return body, head, rest
                if head == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
                    inner, _, _ = block(("endfor",))
                    body.append(("for", m[1], _Expression(m[2]).whole(), inner))
                elif head == "generation" and not rest:
                    inner, _, _ = block(("endgeneration",))
                    body.append(("gen", inner))
                elif head == "if":
                    arms, test = [], _Expression(rest).whole()
                    while True:
                        inner, end, more = block(("elif", "else", "endif"))
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        test = _Expression(more).whole() if end == "elif" else ("const", True)
                    body.append(("if", arms))
                else:
                    raise TemplateError(f"unknown statement {value!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return body, "", ""

    return block(())[0]


def fold(body: list) -> list:
    """Constant outputs become text, constant tests choose their arm, neighbouring texts join."""
    out: list = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "out" and node[1][0] == "const":
            add(("text", _text(node[1][1])))
        elif kind == "for":
            add(("for", node[1], node[2], fold(node[3])))
        elif kind == "gen":
            add(("gen", fold(node[1])))
        elif kind == "if":
            arms = []
            for test, inner in node[1]:
                if test[0] != "const":
                    arms.append((test, fold(inner)))
                elif test[1]:
                    arms.append((test, fold(inner)))
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        else:
            add(node)
    return out


def _render(body: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = []
    for node in body:
        kind = node[0]
        if kind == "text":
            steps.append(lambda ctx, gen, s=node[1]: ((s, gen),))
        elif kind == "out":
            steps.append(lambda ctx, gen, f=_closure(node[1]): ((_text(f(ctx)), gen),))
        elif kind == "gen":
            steps.append(lambda ctx, gen, r=_render(node[1]): r(ctx, True))
        elif kind == "for":

            def loop(ctx, gen, name=node[1], over=_closure(node[2]), r=_render(node[3])):
                for value in over(ctx) or ():
                    yield from r({**ctx, name: value}, gen)

            steps.append(loop)
        else:

            def choose(ctx, gen, arms=[(_closure(t), _render(b)) for t, b in node[1]]):
                for test, r in arms:
                    if test(ctx):
                        return r(ctx, gen)
                return ()

            steps.append(choose)

    def render(ctx, gen):
        for step in steps:
            yield from step(ctx, gen)

    return render


def compile_template(source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from variables to the pieces of the output, each with its loss flag."""
    render = _render(fold(parse(source)))
    return lambda variables: render(variables, False)
