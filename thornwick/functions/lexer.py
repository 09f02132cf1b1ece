"""Facts of a JavaScript or TypeScript file, read from its tree: imports, calls, environment accesses, functions, literals."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from thornwick.functions.syntax import Tree, unquoted

#: What detectors ask of an argument's whole text.
MARKS = ("http://", "https://", "curl ", "wget ", "exec", "spawn", "createWriteStream", "eval(", "Function(", "path.join", "path.resolve", "__dirname", "__filename")
_URL, _HOST = re.compile(r"""https?://([^/'"\s:]+)"""), re.compile(r"""\b(?:hostname|host)\s*:\s*['"`]([^'"`]+)['"`]""")


@dataclass
class Call:
    expression: str
    arguments: list[str]  # their texts, of other than literals the first ones' characters
    kinds: list[str]
    is_new: bool
    marks: list[str]  # those of MARKS in the arguments, each as number:mark
    hosts: list[str]  # hosts in the arguments, each as number:host
    at: int
    text: str
    scope: str  # the named function around it


@dataclass
class Facts:
    imports: list[tuple[str, list[str], str | None, bool, int, str]] = field(default_factory=list)  # module, names, default, by require, offset, text
    calls: list[Call] = field(default_factory=list)
    env: list[tuple[list[str], str, int, str]] = field(default_factory=list)  # variables, form, offset, text
    functions: list[tuple[str, list[str], int, int, int]] = field(default_factory=list)  # name, parameters, offset, start and end of the body
    literals: list[tuple[str, str, str, str, int]] = field(default_factory=list)  # kind, text, kinds of parent and grandparent, offset
    elements: list[tuple[str, str, str, int, str]] = field(default_factory=list)  # object, key, kind of key, offset, text
    declared: set[str] = field(default_factory=set)


def cut(text: str, most: int = 120) -> str:
    text = text.strip()
    return text if len(text) <= most else text[: most - 3] + "..."


class _Marks:
    """Where marks and hosts stand in a file, found once and looked up by range."""

    def __init__(self, code: str) -> None:
        self.at: list[list[int]] = []
        for m in MARKS:
            places, k = [], code.find(m)
            while k >= 0:
                places.append(k)
                k = code.find(m, k + 1)
            self.at.append(places)
        self.hosts = [[(m.start(), m.start(1), m.end(), m[1]) for m in p.finditer(code)] for p in (_URL, _HOST)]

    def marks(self, s: int, e: int) -> list[str]:
        return [m for m, places in zip(MARKS, self.at, strict=True) if (k := bisect_left(places, s)) < len(places) and places[k] + len(m) <= e]

    def found(self, s: int, e: int) -> list[str]:
        """The first host of each form; one of a URL may be cut by the end."""
        out = []
        for url, known in zip((True, False), self.hosts, strict=True):
            k = bisect_left(known, (s,))
            if k < len(known) and (known[k][1] < e if url else known[k][2] <= e):
                out.append(known[k][3][: max(1, e - known[k][1])])
        return out


def scan(code: str, most: int = 200) -> Facts:
    t, facts, marks = Tree(code), Facts(), _Marks(code)
    # a node that the end of the text cuts off may have no token of its own
    start, end = (lambda k: t.start[t.first[k]] if t.first[k] < t.n else len(code)), (lambda k: t.end[t.last[k]] if t.last[k] < t.n else len(code))
    text = lambda k: code[start(k) : end(k)]

    def squeezed(k: int) -> str:
        """A callee's text without white space, of a long one its beginning and its last name."""
        whole = re.sub(r"\s+", "", code[start(k) : min(end(k), start(k) + 400)])
        return whole if end(k) - start(k) <= 400 else f"{whole[:200]}.{t.text[min(t.last[k], t.n - 1)]}"

    def kind(k: int) -> str:
        """What an argument is: string, plain (template), template, concat (adds something), literal (a wrapped string or plain template) or the node's kind."""
        of = t.kinds[k]
        if of == "binary":
            p = bisect_left(t.plus, t.first[k])
            return "concat" if p < len(t.plus) and t.plus[p] <= t.last[k] else "binary"
        inner = k
        while t.kinds[inner] == "wrapped" and (below := t.info[inner]) is not None:
            inner = below
        return "literal" if of == "wrapped" and t.kinds[inner] in ("string", "plain") else of

    env = {k for k, of in enumerate(t.kinds) if of == "property" and t.text[t.last[k]] == "env" and text(k) == "process.env"}
    scopes = _scopes(t)
    for module, names, default, first, last in t.imports:
        semicolon = last + 1 < t.n and t.text[last + 1] == ";"
        facts.imports.append((module, names, default, False, t.start[first], cut(code[t.start[first] : t.end[last + semicolon]])))
    for k, of in enumerate(t.kinds):
        if of in ("string", "plain", "template"):
            up = t.parent[k]
            over = t.parent[up] if up >= 0 else -1
            facts.literals.append((of, unquoted(text(k)), t.kinds[up] if up >= 0 else "", t.kinds[over] if over >= 0 else "", start(k)))
        elif of in ("call", "new"):
            callee, arguments = t.info[k]
            expression, kinds = squeezed(callee), [kind(a) for a in arguments]
            shown = [text(a) if x in ("string", "plain", "template") else code[start(a) : min(end(a), start(a) + most)] for a, x in zip(arguments, kinds, strict=True)]
            held = [f"{i}:{m}" for i, a in enumerate(arguments) for m in marks.marks(start(a), end(a))]
            hosts = [f"{i}:{h}" for i, a in enumerate(arguments) for h in marks.found(start(a), end(a))]
            whole = cut(code[start(k) : min(end(k), start(k) + 200)])
            facts.calls.append(Call(expression, shown, kinds, of == "new", held, hosts, start(k), whole, scopes(t.first[k])))
            if of == "call" and t.kinds[callee] == "name" and expression == "require" and kinds[:1] == ["string"]:
                facts.imports.append((unquoted(shown[0]), [], None, True, start(k), whole))
            if expression in ("Object.keys", "Object.entries", "Object.values") and arguments and arguments[0] in env:
                facts.env.append(([], expression, start(k), cut(text(k))))
        elif of == "element":
            obj, key, first, last = t.info[k]
            if key is None:
                continue
            named = t.kinds[key] == "string"
            inner = unquoted(text(key)) if named else code[t.start[first] : t.end[last]][:most]
            facts.elements.append((code[start(obj) : min(end(obj), start(obj) + most)], inner, kind(key), start(k), cut(text(k))))
            if obj in env:
                facts.env.append(([inner] if named else [], "literal" if named else "computed", start(k), cut(text(k))))
        elif of == "property" and t.info[k] in env:
            facts.env.append(([t.text[t.last[k]]], "property", start(k), cut(text(k))))
        elif of == "spread property" and any(t.parent[e] == k for e in env):
            facts.env.append(([], "spread", start(k), cut(text(k))))
        elif of == "declaration" and t.info[k][2] in env:
            name, bound, _ = t.info[k]
            facts.env.append((bound or [], "destructured" if bound is not None else "alias", start(k), cut(text(k))))
    facts.functions = [(name, names, t.start[first], t.start[s], t.end[e]) for name, names, first, s, e in t.functions if name]
    facts.declared = t.declared
    for rows, at in ((facts.calls, lambda x: x.at), (facts.imports, lambda x: x[4]), (facts.env, lambda x: x[2]), (facts.literals, lambda x: x[4]), (facts.elements, lambda x: x[3])):
        rows.reverse()  # of those that begin together the outer one is first
        rows.sort(key=at)
    return facts


def _scopes(t: Tree):
    """The name of the innermost named function whose body holds a token."""
    edges: list[tuple[int, str]] = [(-1, "")]
    stack: list[tuple[int, str]] = [(t.n + 1, "")]
    for name, _, _, s, e in sorted((f for f in t.functions if f[0]), key=lambda f: f[3]):
        while stack[-1][0] < s:
            edges.append((stack.pop()[0] + 1, stack[-1][1]))
        edges.append((s, name))
        stack.append((e, name))
    while len(stack) > 1:
        edges.append((stack.pop()[0] + 1, stack[-1][1]))
    places = [k for k, _ in edges]
    return lambda k: edges[bisect_right(places, k) - 1][1]
