"""A tolerant reader of JavaScript and TypeScript: tokens, and a tree of the expressions of a file.

The tree holds expressions (calls, accesses, literals, operators, functions ...) with their parents; statements, types and
decorators are read through. What can't be read is skipped token by token, so any text gives some tree. Tokens are read
once and each bracket knows its partner, so the time taken grows with the length of the file.
"""

from __future__ import annotations

import re
import sys
from typing import Any

_TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)|(?P<name>\#?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>\.\.\.|=>|\?\.(?!\d)|[=!]==?|\*\*=?|&&=?|\|\|=?|\?\?=?|\+\+|--|<<=?|<=|[-+*/%&|^]=|.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PART = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*(`|\$\{|\Z)", re.S)
_WORDS = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_PREFIX = frozenset("typeof void delete await yield".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_LEVEL = {op: k for k, ops in enumerate("??,||,&&,|,^,&,== != === !==,< > <= instanceof in as satisfies,<<,+ -,* / %,**".split(","), 1) for op in ops.split()}
_MODIFIERS = frozenset("static public private protected readonly async get set declare abstract override accessor".split())
_SIGNS = frozenset(") ] } ; , :".split())


class Tokens:
    """kind (string, template, thead, tmid, ttail, name, number, punct, regex), text, start and end of each token, and the partner of each bracket."""

    def __init__(self, code: str) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        i, n, depths = 0, len(code), []
        while i < n:
            c = code[i]
            if c == "`" or c == "}" and depths and depths[-1] == 0:
                m = _PART.match(code, i + 1)
                more = m[1] == "${"
                kind = ("thead" if more else "template") if c == "`" else "tmid" if more else "ttail"
                if c == "}":
                    depths.pop()
                if more:
                    depths.append(0)
                i = self._add(kind, code, i, m.end())
                continue
            if depths and c in "{}":
                depths[-1] += 1 if c == "{" else -1
            if c == "/" and not code.startswith(("//", "/*"), i) and not self._after_value() and (m := _REGEX.match(code, i)):
                i = self._add("regex", code, i, m.end())
                continue
            m = _TOKEN.match(code, i)
            i = m.end() if m.lastgroup in ("space", "comment") else self._add(m.lastgroup, code, i, m.end())
        self.match, opened = [-1] * len(self.text), []
        for k, (kind, text) in enumerate(zip(self.kind, self.text, strict=True)):
            if kind == "punct" and text in "([{":
                opened.append(k)
            elif kind == "punct" and text in ")]}" and opened:
                o = opened.pop()
                self.match[o], self.match[k] = k, o

    def _add(self, kind: str, code: str, i: int, j: int) -> int:
        self.kind.append(kind)
        self.text.append(code[i:j])
        self.start.append(i)
        self.end.append(j)
        return j

    def _after_value(self) -> bool:
        """Whether a slash here divides."""
        if not self.kind:
            return False
        kind, text = self.kind[-1], self.text[-1]
        return kind in ("string", "template", "ttail", "number", "regex") or kind == "name" and text not in _WORDS or text in (")", "]", "}")


class Tree(Tokens):
    """Nodes: kind, first and last token, parent (-1 at the top) and what belongs to the kind (info). A parent stands after its
    children. Beside them imports, functions (name, parameters, first token, first and last token of the body), declared names."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code
        self.kinds: list[str] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.parent: list[int] = []
        self.info: list[Any] = []
        self.imports: list[tuple[str, list[str], str | None, int, int]] = []
        self.functions: list[tuple[str, list[str], int, int, int]] = []
        self.declared: set[str] = set()
        self.plus: list[int] = []  # tokens that add
        self.i, self.n, self.choice = 0, len(self.text), 0
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 100_000))
        try:
            self._until(self.n)
        finally:
            sys.setrecursionlimit(before)
        self.plus.sort()

    # --- small steps

    def _at(self, k: int | None = None) -> str:
        k = self.i if k is None else k
        return self.text[k] if 0 <= k < self.n and self.kind[k] in ("punct", "name") else ""

    def _name(self, k: int | None = None) -> str:
        k = self.i if k is None else k
        return self.text[k] if 0 <= k < self.n and self.kind[k] == "name" else ""

    def _take(self, text: str) -> bool:
        if self._at() == text:
            self.i += 1
            return True
        return False

    def _same_line(self) -> bool:
        """Whether no line ends between the token before and this one."""
        return 0 < self.i < self.n and "\n" not in self.code[self.end[self.i - 1] : self.start[self.i]]

    def _node(self, kind: str, first: int, children: tuple | list = (), info: Any = None) -> int:
        k = len(self.kinds)
        self.kinds.append(kind)
        self.first.append(first)
        self.last.append(max(first, self.i - 1))
        self.parent.append(-1)
        self.info.append(info)
        for c in children:
            if c is not None:
                self.parent[c] = k
        return k

    def _close(self) -> int:
        """The partner of the opening bracket here, or the end."""
        return self.match[self.i] if self.match[self.i] > self.i else self.n

    # --- types, which are read over

    def _angles(self) -> int:
        """Behind a list of types in angle brackets here, or -1 if it is none."""
        k, depth = self.i, 0
        while k < self.n and k < self.i + 120:
            x = self.text[k] if self.kind[k] == "punct" else ""
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif x in ("(", "[", "{"):
                if self.match[k] <= k:
                    return -1
                k = self.match[k]
            elif x in (")", "]", "}", ";", "&&", "||", "+", "*", "/", "==", "===", "++", "!", "%", "<=", "<<"):
                return -1
            elif x == "=" and depth < 1:
                return -1
            k += 1
        return -1

    def _skip_angles(self) -> None:
        if self._at() == "<" and (k := self._angles()) > 0:
            self.i = k

    def _type(self) -> None:
        while self.i < self.n:
            while self._at() in ("|", "&", "-", "...") or self._at() in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract", "new") and (self.kind[self.i + 1 : self.i + 2] or ["punct"])[0] != "punct":
                self.i += 1
            x = self._at()
            arguments = x == "("
            if x in ("(", "{", "["):
                self.i = min(self._close() + 1, self.n)
            elif x == "<":
                k = self._angles()
                if k < 0:
                    return
                self.i = k
                continue
            elif self.i < self.n and (self.kind[self.i] in ("string", "template", "number") or self._name()):
                self.i += 1
                while self._at() == "." and self._name(self.i + 1):
                    self.i += 2
                self._skip_angles()
                if self._at() == "is":
                    self.i += 1
                    continue
            elif self.i < self.n and self.kind[self.i] == "thead":
                self._template()
            else:
                return
            while self._at() == "[" and self._same_line():
                self.i = min(self._close() + 1, self.n)
            if self._at() == "extends":
                self.i += 1
                self._type()
                if self._take("?"):
                    self._type()
                    if self._take(":"):
                        continue
                return
            if self._at() not in ("|", "&") and not (arguments and self._at() == "=>"):
                return
            self.i += 1

    # --- statements

    def _until(self, end: int) -> None:
        """Statements up to the token `end`, which is taken."""
        while self.i < end:
            before = self.i
            self._statement()
            if self.i == before:
                self.i += 1
        self.i = min(end + 1, self.n) if end < self.n else self.n

    def _block(self) -> tuple[int, int]:
        first, end = self.i, self._close()
        self.i += 1
        self._until(end)
        return first, min(end, self.n - 1)

    def _statement(self) -> None:
        x, following = self._at(), self._at(self.i + 1)
        if x == "{":
            self._block()
        elif x in (";", "}", ")", "]", ",", ":") or x in ("do", "else", "try", "finally", "break", "continue", "default", "declare") and following != "(":
            self.i += 1
        elif x == "@":
            self.i += 1
            self._postfix(self._primary(), calls=True)
        elif x == "import" and following not in ("(", "."):
            self._import()
        elif x == "export":
            self.i += 1
            self._take("default")
            self._take("type")
            if self._take("="):
                self._expression()
            elif self._at() in ("{", "*"):
                while self.i < self.n and self._at() != ";" and self.kind[self.i] != "string" and not (self._at(self.i - 1) == "}" and self._at() != "from"):
                    self.i += 1
        elif x in ("const", "let", "var", "using") and (following in ("{", "[") or self._name(self.i + 1)):
            if following == "enum":
                self.i += 1
                return
            self.i += 1
            self._declarations()
        elif x in ("if", "while", "for", "switch", "with", "catch"):
            self.i += 1
            self._take("await")
            if self._at() == "(":
                end = self._close()
                self.i += 1
                if x == "catch":
                    self._parameters(end)
                self._until(end)
        elif x == "case":
            self.i += 1
            self.choice += 1
            self._expression()
            self.choice -= 1
        elif x in ("return", "throw"):
            first = self.i
            self.i += 1
            if self.i < self.n and self._same_line() and self._at() not in _SIGNS:
                self._node("return", first, [self._expression()])
        elif x == "type" and self._name(self.i + 1) and self._at(self.i + 2) in ("=", "<"):
            self.i += 2
            self._skip_angles()
            if self._take("="):
                self._type()
        elif x in ("interface", "enum") and self._name(self.i + 1):
            while self.i < self.n and self._at() not in ("{", ";"):
                self.i += 1
            self.i = min(self._close() + 1, self.n) if self.i < self.n and self._at() == "{" else self.i
        elif x in ("namespace", "module") and self.i + 1 < self.n and (self._name(self.i + 1) or self.kind[self.i + 1] == "string") and self._at(self.i + 2) in ("{", "."):
            while self.i < self.n and self._at() != "{":
                self.i += 1
        elif x == "abstract" and following == "class":
            self.i += 1
        elif self._name() and following == ":" and self.kind[self.i + 1] == "punct":
            self.i += 2
        elif x == "async" and following == "function" or x == "function":
            self._function(declared=True)
        else:
            self._expression()

    def _import(self) -> None:
        first, names, default, braces = self.i, [], None, False
        self.i += 1
        while self.i < self.n and self._at() not in (";", "("):
            if self.kind[self.i] == "string":
                self.i += 1
                self.imports.append((unquoted(self.text[self.i - 1]), names, default, first, self.i - 1))
                self._node("string", self.i - 1)
                return
            x = self._at()
            if x == "=":
                self.i += 1
                self._expression()
                return
            braces = (braces or x == "{") and x != "}"
            if self._name() and x not in ("from", "as", "type"):
                if braces:
                    names += [] if self._at(self.i - 1) == "as" else [x]
                elif default is None and self._at(self.i - 1) != "as":
                    default = x
            self.i += 1

    def _declarations(self) -> None:
        while self.i < self.n:
            first, pattern, name = self.i, self._at() in ("{", "["), self._name()
            target = self._primary()
            self._take("!")
            if self._take(":"):
                self._type()
            if self._at() in ("of", "in"):
                self.i += 1
                self._expression()
            init, at = None, self.i
            if self._take("="):
                init = self._assignment()
                k = self.info[init] if self.kinds[init] == "function" else None
                if name and k is not None:
                    self.functions[k] = (name, *self.functions[k][1:2], first, *self.functions[k][3:])
            if name:
                self.declared.add(name)
            self._node("declaration", first, [target, init], (name, self._bound(first + 1, at - 1) if pattern else None, init))
            if not self._take(","):
                return

    def _bound(self, k: int, end: int) -> list[str]:
        """The names that an object pattern binds; of one with another name or a default, the name it gets."""
        names, part = [], []
        while k <= end and k < self.n:
            x = self.text[k]
            if (x in (",", "=") or k == end) and part:
                names.append("".join(part))
                part = []
            if x == ":":
                part = []
            elif x == "=":
                while k < end and self.text[k] != ",":
                    k = self.match[k] if self.match[k] > k else k
                    k += 1
                continue
            elif x in ("{", "["):
                close = self.match[k] if self.match[k] > k else end
                part.append("".join(self.text[k : close + 1]))
                k = close
            elif x not in (",", "...", "}", "]"):
                part.append(x)
            k += 1
        return names

    def _parameters(self, end: int) -> list[str]:
        names = []
        while self.i < end:
            before = self.i
            while self._at() in _MODIFIERS and self._at(self.i + 1) not in (",", ")", ":", "=", "?") or self._at() == "...":
                self.i += 1
            if self._take("@"):
                self._postfix(self._primary(), calls=True)
                continue
            first, name = self.i, self._name()
            self._primary()
            names.append(name or "".join(self.text[first : self.i]))
            self._take("?")
            if self._take(":"):
                self._type()
            if self._take("="):
                self._assignment()
            self._take(",")
            if self.i == before:
                self.i += 1
        self.declared.update(names)
        return names

    def _signature(self) -> list[str]:
        """Type parameters, parameters and the type of a result."""
        self._skip_angles()
        names = []
        if self._at() == "(":
            end = self._close()
            self.i += 1
            names = self._parameters(end)
            self.i = min(end + 1, self.n)
        if self._take(":"):
            self._type()
        return names

    def _function(self, declared: bool = False) -> int:
        first = self.i
        self._take("async")
        self._take("function")
        self._take("*")
        name = self._name()
        self.i += bool(name)
        return self._with_body(first, (name or "<anonymous>") if declared else "", self._signature())

    def _with_body(self, first: int, name: str, names: list[str]) -> int:
        k = len(self.functions)
        self.functions.append((name, names, first, first, first))
        body = self._block() if self._at() == "{" else (first, self.i - 1)
        self.functions[k] = (name, names, first, *body)
        return self._node("function", first, info=k)

    def _arrow(self, first: int, names: list[str]) -> int:
        """Behind the arrow."""
        if self._at() == "{":
            return self._with_body(first, "", names)
        k, at = len(self.functions), self.i
        self.functions.append(("", names, first, at, at))
        value = self._assignment()
        self.functions[k] = ("", names, first, at, self.i - 1)
        return self._node("function", first, [value], k)

    def _class(self) -> int:
        first = self.i
        self.i += 1
        if self._name() not in ("", "extends", "implements"):
            self.declared.add(self._name())
            self.i += 1
        self._skip_angles()
        if self._take("extends"):
            self._postfix(self._primary(), calls=True)
            self._skip_angles()
        if self._take("implements"):
            self._type()
            while self._take(","):
                self._type()
        if self._at() != "{":
            return self._node("class", first)
        end = self._close()
        self.i += 1
        while self.i < end:
            before = self.i
            if self._take(";") or self._take("*"):
                continue
            if self._take("@"):
                self._postfix(self._primary(), calls=True)
                continue
            if self._at() in _MODIFIERS and self._at(self.i + 1) not in ("(", "=", ":", ";", "?", "!", "}", "<"):
                self.i += 1
                if self._at() == "{":
                    self._block()
                continue
            at, accessor, name = self.i, self._at(self.i - 1) in ("get", "set"), self._key()
            self._take("?") or self._take("!")
            if self._at() in ("(", "<"):
                self._with_body(at, "" if accessor else name, self._signature())
            else:
                if self._take(":"):
                    self._type()
                if self._take("="):
                    self._node("field", at, [self._assignment()])
            if self.i == before:
                self.i += 1
        self.i = min(end + 1, self.n)
        return self._node("class", first)

    def _key(self) -> str:
        """A property's name."""
        if self._at() == "[":
            end = self._close()
            first = self.i
            self.i += 1
            self._until(end)
            return "".join(self.text[first : self.i])
        if self.i < self.n and self.kind[self.i] == "string":
            self._node("string", self.i)
        self.i += 1
        return unquoted(self.text[self.i - 1]) if self.kind[self.i - 1] == "string" else self.text[self.i - 1]

    # --- expressions

    def _expression(self) -> int:
        found = self._assignment()
        while self._at() == "," and self.i + 1 < self.n:
            self.i += 1
            found = self._node("binary", self.first[found], [found, self._assignment()])
        return found

    def _list(self, end: int) -> list[int]:
        """Arguments or elements up to `end`, which is taken."""
        out = []
        choice, self.choice = self.choice, 0
        while self.i < end:
            before = self.i
            if not self._take(","):
                out.append(self._assignment())
            if self.i == before:
                self.i += 1
        self.choice = choice
        self.i = min(end + 1, self.n)
        return out

    def _assignment(self) -> int:
        found = self._binary(0)
        first = self.first[found]
        if self._at() == "?" and self.kind[self.i] == "punct":
            self.i += 1
            self.choice += 1
            yes = self._assignment()
            self.choice -= 1
            self._take(":")
            found = self._node("conditional", first, [found, yes, self._assignment()])
        if self._at() in _ASSIGN:
            self.i += 1
            found = self._node("binary", first, [found, self._assignment()])
        return found

    def _binary(self, level: int) -> int:
        found = self._unary()
        while self.i < self.n:
            op = self._at()
            here = _LEVEL.get(op, 0)
            if not here or here <= level and not (op == "**" and here == level) or op in ("as", "satisfies", "in", "instanceof") and not self._name():
                return found
            first = self.first[found]
            if op in ("as", "satisfies"):
                if not self._same_line():
                    return found
                self.i += 1
                self._take("const") or self._type()
                found = self._node("wrapped", first, [found], found)
                continue
            if op == "+":
                self.plus.append(self.i)
            self.i += 1
            if op == ">":
                while self._at() in (">", "="):  # a shift or a comparison
                    self.i += 1
            found = self._node("binary", first, [found, self._binary(here)])
        return found

    def _unary(self) -> int:
        x, first = self._at(), self.i
        if x in ("!", "~", "+", "-", "++", "--") or x in _PREFIX and self._at(self.i + 1) not in ("=", ".", ")", ",", ";", ":", "=>"):
            self.i += 1
            if x == "yield":
                self._take("*")
                if self._at() in _SIGNS or not self._same_line():
                    return self._node("other", first)
            return self._node("other", first, [self._unary()])
        if x == "...":
            self.i += 1
            return self._node("spread", first, [self._assignment()])
        if x == "<" and (k := self._angles()) > 0:
            self.i = k
            inner = self._unary()
            return inner if self.kinds[inner] == "function" else self._node("wrapped", first, [inner], inner)
        return self._postfix(self._primary())

    def _is_arrow(self) -> bool:
        """Whether the parenthesis here holds an arrow function's parameters."""
        end = self._close()
        if self._at(end + 1) == "=>":
            return True
        if self._at(end + 1) != ":" or self.choice:
            return False
        at, self.i = self.i, end + 2
        self._type()
        found, self.i = self._at() == "=>", at
        return found

    def _template(self) -> int:
        first, children = self.i, []
        self.i += 1
        while self.i < self.n and self.kind[self.i] not in ("tmid", "ttail"):
            children.append(self._expression())
            while self.i < self.n and self.kind[self.i] not in ("tmid", "ttail"):
                self.i += 1  # what could not be read
            if self.i < self.n:
                self.i += 1
                if self.kind[self.i - 1] == "ttail":
                    break
        return self._node("template", first, children)

    def _primary(self) -> int:
        first, x = self.i, self._at()
        kind = self.kind[self.i] if self.i < self.n else ""
        if kind == "thead":
            return self._template()
        if x == "(":
            arrow, end = self._is_arrow(), self._close()
            if arrow:
                names = self._signature()
                self._take("=>")
                return self._arrow(first, names)
            self.i += 1
            choice, self.choice = self.choice, 0
            inner = self._expression() if self.i < end else None
            self.choice = choice
            self._until(end)
            return self._node("wrapped", first, [inner], inner)
        if x == "[":
            end = self._close()
            self.i += 1
            return self._node("array", first, self._list(end))
        if x == "{":
            return self._object()
        if x == "async" and self._at(self.i + 1) == "function" or x == "function":
            return self._function()
        if x == "class":
            return self._class()
        if x == "async" and self._same_or_open():
            self.i += 1
            return self._primary()
        if x == "new":
            return self._new()
        if kind == "name" and self._at(self.i + 1) == "=>":
            self.i += 2
            self.declared.add(x)
            return self._arrow(first, [x])
        if x in _SIGNS or x in ("=>", "?", ">") or not kind:
            return self._node("other", first)  # nothing is taken
        self.i += 1
        return self._node({"string": "string", "template": "plain", "name": "name", "number": "number"}.get(kind, "other"), first)

    def _same_or_open(self) -> bool:
        """Whether `async` here begins an arrow function."""
        if self._at(self.i + 1) == "(" and self.match[self.i + 1] > 0:
            self.i += 1
            found = self._is_arrow()
            self.i -= 1
            return found
        return bool(self._name(self.i + 1)) and self._at(self.i + 2) == "=>"

    def _new(self) -> int:
        first = self.i
        self.i += 1
        if self._take("."):
            self.i += 1
            return self._node("other", first)
        callee = self._postfix(self._primary(), calls=False)
        self._skip_angles()
        arguments: list[int] = []
        if self._at() == "(":
            end = self._close()
            self.i += 1
            arguments = self._list(end)
        return self._node("new", first, [callee, *arguments], (callee, arguments))

    def _postfix(self, found: int, calls: bool = True) -> int:
        while self.i < self.n:
            x, first = self._at(), self.first[found]
            if x in (".", "?."):
                if x == "?." and self._at(self.i + 1) in ("(", "["):
                    self.i += 1
                    continue
                if not self._name(self.i + 1):
                    return found
                self.i += 2
                found = self._node("property", first, [found], found)
            elif x == "[":
                end = self._close()
                self.i += 1
                at = self.i
                key = self._expression() if self.i < end else None
                self._until(end)
                found = self._node("element", first, [found, key], (found, key, at, min(end, self.n) - 1))
            elif x == "(" and calls:
                end = self._close()
                self.i += 1
                arguments = self._list(end)
                found = self._node("call", first, [found, *arguments], (found, arguments))
            elif x == "!" and self._same_line() and self._at(self.i + 1) != "=":
                self.i += 1
                found = self._node("wrapped", first, [found], found)
            elif x in ("++", "--") and self._same_line():
                self.i += 1
                found = self._node("other", first, [found])
            elif self.kind[self.i] in ("template", "thead"):
                text = self._template() if self.kind[self.i] == "thead" else self._plain()
                found = self._node("tagged", first, [found, text])
            elif x == "<" and self.kinds[found] in ("name", "property") and (k := self._angles()) > 0 and self._at(k) == "(" and calls:
                self.i = k
            else:
                return found
        return found

    def _plain(self) -> int:
        self.i += 1
        return self._node("plain", self.i - 1)

    def _object(self) -> int:
        first, end, children = self.i, self._close(), []
        self.i += 1
        choice, self.choice = self.choice, 0
        while self.i < end:
            before = self.i
            if self._take(",") or self._take("*"):
                continue
            if self._at() == "...":
                at = self.i
                self.i += 1
                children.append(self._node("spread property", at, [self._assignment()]))
                continue
            if self._at() in ("async", "get", "set") and self._at(self.i + 1) not in ("(", ":", ",", "}", "=", "<"):
                self.i += 1
                continue
            at, before_key = self.i, len(self.kinds)
            accessor, name = self._at(self.i - 1) in ("get", "set"), self._key()
            key = before_key if len(self.kinds) > before_key and self.kinds[before_key] == "string" and self.first[before_key] == at else None
            if self._at() in ("(", "<"):
                children.append(self._with_body(at, "" if accessor else name, self._signature()))
            elif self._take(":") or self._take("="):
                value = self._assignment()
                children.append(self._node("property value", at, [key, value]))
            if self.i == before:
                self.i += 1
        self.choice = choice
        self.i = min(end + 1, self.n)
        return self._node("object", first, children)


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
