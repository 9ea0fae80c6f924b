"""Symbols and references of script sources (TypeScript, JavaScript), read from their text.

A scanner cuts a file into tokens; a reader goes over declarations by their shape, without types.  What a compiler would
infer is known only where the text shows it: literals, ``new X`` and annotations.  One row of input is one file, so
files are read in parallel and a file is all that a task holds.

Positions are offsets in UTF-16 units, lines count from 1; a declaration starts at its first decorator or modifier and
ends behind its last token.  A null content is an empty file.  Text that is no program gives what can be read of it.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tremor.functions import types as Y
from tremor.functions.text import make_id, normal_path, short_hash
from tremor.operators.index import in_graph
from tremor.plans.lineage import cut

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\d[\w.]*|\.\d[\w]*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<mark>=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|\+\+|--|&&|\|\||\?\?|\*\*|[\s\S])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_MODIFIERS = frozenset("export default declare async abstract public private protected static readonly override accessor const".split())
_OPEN, _SHUT = {"(": ")", "[": "]", "{": "}", "${": "}"}, frozenset(")]}")
_GOES_ON = frozenset(". ?. ? : => = == === != !== < <= > + - * / % & | ^ && || ?? ** , ) ] } ( in instanceof as satisfies is extends".split())
_WANTS = frozenset(". ?. ? : => = == === != !== < <= + - * / % & | ^ && || ?? ** , ( [ { ${ ! ~ ... new typeof await return extends keyof as in of satisfies infer readonly is void delete throw case".split())
_KEYWORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof
new null return super switch this throw true try typeof var void while with let yield async await of as from get set static type interface
namespace module declare abstract readonly public private protected implements keyof infer is satisfies undefined""".split()
)

_S, _I, _L, _B, _LIST = pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string())
_SYMBOL = [("name", _S), ("kind", _S), ("start_line", _I), ("end_line", _I), ("start_pos", _I), ("end_pos", _I), ("is_exported", _B), ("parent", _S), ("ord", _L), ("shape", _S), ("names", _LIST), ("types", _LIST), ("result", _S)]
_REFERENCE = [("owners", _LIST), ("pos", _I), ("base", _S), ("member", _S)]
_IMPORT = [("local", _S), ("source", _S), ("imported", _S)]


class Token:
    __slots__ = ("kind", "text", "start", "end", "pair")

    def __init__(self, kind: str, text: str, start: int):
        self.kind, self.text, self.start, self.end, self.pair = kind, text, start, start + len(text), -1


def tokens(text: str) -> list[Token]:
    """Tokens without space and comments; brackets know their partners. Templates are cut at their expressions."""
    out: list[Token] = []
    stack: list[int] = []
    at = 0

    def template(start: int) -> int:
        """Reads on in a template; leaves at its end, or inside of an expression."""
        i = start
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                out.append(Token("string", text[start : i + 1], start))
                return i + 1
            elif text.startswith("${", i):
                out.append(Token("string", text[start:i], start))
                out.append(Token("mark", "${", i))
                stack.append(len(out) - 1)
                return i + 2
            else:
                i += 1
        return i

    while at < len(text):
        if text[at] == "`":
            at = template(at + 1)
            continue
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1] if out else None
            value = last is not None and (last.kind in ("number", "string") or last.text in (")", "]", "}") or last.kind == "word" and last.text not in _BEFORE_REGEX)
            m = None if value else _REGEX.match(text, at)
            if m:
                out.append(Token("string", m.group(), at))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "skip":
            continue
        t = Token(kind, m.group(), m.start())
        out.append(t)
        if t.text in _OPEN:
            stack.append(len(out) - 1)
        elif t.text in _SHUT:
            while stack and _OPEN[out[stack[-1]].text] != t.text:
                stack.pop()
            if stack:
                t.pair = stack.pop()
                out[t.pair].pair = len(out) - 1
                if out[t.pair].text == "${":
                    at = template(at)
    return out


class Reader:
    """Declarations, imports and references of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.t = path, text, tokens(text)
        self.lines = [m.start() + 1 for m in re.finditer("\n", text)]
        self.wide = [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)]
        self.symbols: list[dict] = []
        self.imports: list[tuple[str, str, str]] = []
        self.exported: set[str] = set()
        self.found: dict[str, list[list[dict]]] = {}
        self.closed: dict[int, int] | None = None
        self.stated = False

    # Looking at tokens.

    def is_(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind != "string" and self.t[i].text in words

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def past(self, i: int) -> int:
        """Behind the token, or behind the bracket's partner."""
        if i >= len(self.t):
            return i + 1
        t = self.t[i]
        return t.pair + 1 if t.kind == "mark" and t.text in _OPEN and t.pair > i else i + 1

    def angles(self, i: int) -> int:
        """Behind type parameters or arguments that open at i, or i."""
        if self.closed is None:
            self.closed = self.angle_pairs()
        return self.closed.get(i, i - 1) + 1

    def angle_pairs(self) -> dict[int, int]:
        """The ``>`` of each ``<`` that has one in its bracket before the next ``;``, in one pass over all tokens."""
        pairs: dict[int, int] = {}
        levels: list[list[int]] = [[]]  # open ones of each bracket around the token
        for k, t in enumerate(self.t):
            if t.kind != "mark":
                continue
            if t.text in _OPEN and t.pair > k:
                levels.append([])
            elif 0 <= t.pair < k and len(levels) > 1:
                levels.pop()
            elif t.text == "<":
                levels[-1].append(k)
            elif t.text == ">" and levels[-1]:
                pairs[levels[-1].pop()] = k
            elif t.text in (";", "}", ")"):
                levels[-1].clear()
        return pairs

    def breaks(self, i: int) -> bool:
        """Whether a statement may end before token i: a line ends there and neither side goes on."""
        if not 0 < i < len(self.t):
            return True
        a, b = self.t[i - 1], self.t[i]
        if "\n" not in self.text[a.end : b.start]:
            return False
        return not (a.kind != "string" and a.text in _WANTS or b.kind != "string" and b.text in _GOES_ON)

    def until(self, i: int, end: int, stops: tuple[str, ...], types: bool = False) -> int:
        """The first of the stops outside of brackets, or the end of the statement."""
        first = i
        while i < end and not self.is_(i, *stops):
            if i > first and self.breaks(i):
                return i
            if self.is_(i, "<") and (k := self.angles(i)) > i and (types or self.is_(k, "(")):
                i = k
                continue
            i = self.past(i)
        return min(i, end)

    def slice(self, i: int, j: int) -> str:
        j = min(j, len(self.t))
        return self.text[self.t[i].start : self.t[j - 1].end] if i < j else ""

    def offset(self, at: int) -> int:
        return at + bisect.bisect_left(self.wide, at)

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at) + 1

    # Declarations.

    def add(self, group: str, name: str, kind: str, i: int, j: int, exported: bool, parent: str | None = None, shape: str = "value", names: list | None = None, types: list | None = None, result: str = "", span: tuple | None = None) -> None:
        a, b = self.t[i].start, self.t[min(j, len(self.t)) - 1].end
        c, d = span or (a, b)
        row = {"name": name, "kind": kind, "start_line": self.line(a), "end_line": self.line(b - 1), "start_pos": self.offset(c), "end_pos": self.offset(d), "is_exported": exported, "parent": parent, "shape": shape, "names": names or [], "types": types or [], "result": result}
        self.found.setdefault(group, [[]])[-1].append(row)

    def parameters(self, i: int) -> tuple[list[str], list[str]]:
        """Names and type texts of a list in brackets."""
        names, types, end = [], [], self.t[i].pair
        k = i + 1
        while k < end:
            stop = self.until(k, end, (",",), True)
            while stop < end and not self.is_(stop, ","):  # a line's end is none in brackets
                stop = self.until(self.past(stop), end, (",",), True)
            a = k
            while self.is_(a, "public", "private", "protected", "readonly", "override") and self.name_at(a + 1) or self.name_at(a) and self.t[a].text.startswith("@") or self.is_(a, "..."):
                a = self.past(a + 1) if self.t[a].text.startswith("@") and self.is_(a + 1, "(") else a + 1
            b = self.past(a)
            colon = b + 1 if self.is_(b, "?") else b
            kind = ""
            if self.is_(colon, ":"):
                kind = self.slice(colon + 1, self.until(colon + 1, stop, ("=",), True))
            elif self.is_(colon, "="):
                kind = self.value_type(colon + 1, stop, False)
            if a < stop:
                names.append(self.slice(a, min(b, stop)))
                types.append(kind or "any")
            k = stop + 1
        return names, types

    def value_type(self, i: int, j: int, const: bool) -> str:
        """The type of a value, as far as its text shows it."""
        if self.is_(i, "new") and self.name_at(i + 1):
            k = i + 2
            while self.is_(k, ".") and self.name_at(k + 1):
                k += 2
            return self.slice(i + 1, self.angles(k) if self.is_(k, "<") else k)
        if j - i == 1:
            t = self.t[i]
            if t.kind == "number":
                return t.text if const else "number"
            if t.kind == "string" and t.text[0] in "\"'":
                return f'"{t.text[1:-1]}"' if const else "string"
            if t.text in ("true", "false"):
                return t.text if const else "boolean"
        k = i + 1 if self.is_(i, "async") else i
        k = self.angles(k) if self.is_(k, "<") else k
        if self.is_(k, "(") and self.is_(self.t[k].pair + 1, "=>", ":"):
            names, types = self.parameters(k)
            stop = self.until(self.t[k].pair + 1, j, ("=>",), True)
            result = self.slice(self.t[k].pair + 2, stop) if self.is_(self.t[k].pair + 1, ":") else "any"
            return f"({', '.join(f'{n}: {t}' for n, t in zip(names, types))}) => {result}"
        return ""

    def statements(self, i: int, end: int, prefix: str = "") -> None:
        while i < end:
            i = max(i + 1, self.statement(i, end, prefix))

    def statement(self, i: int, end: int, prefix: str) -> int:
        first = i
        while self.name_at(i) and self.t[i].text.startswith("@"):
            i = self.past(i + 1) if self.is_(i + 1, "(") else i + 1
        exported = self.is_(i, "export")
        if exported and self.is_(i + 1, "{", "*", "=") or self.is_(i, "export") and self.is_(i + 1, "type") and self.is_(i + 2, "{", "*"):
            return self.export(i, end)
        if self.is_(i, "import") and not self.is_(i + 1, "(", "."):
            return self.import_(i, end)
        while self.name_at(i) and self.t[i].text in _MODIFIERS and not (self.t[i].text == "const" and not self.is_(i + 1, "enum")) and (self.name_at(i + 1) or self.is_(i, "default", "export")):
            i += 1
        if self.is_(i, "function"):
            return self.function(first, i, end, prefix, exported)
        if self.is_(i, "class"):
            return self.class_(first, i, end, prefix, exported)
        if self.name_at(i + 1) or self.is_(i, "module") and i + 1 < end and self.t[i + 1].kind == "string":
            if self.is_(i, "interface"):
                return self.interface(first, i, end, prefix, exported)
            if self.is_(i, "type") and not prefix and self.is_(self.angles(i + 2) if self.is_(i + 2, "<") else i + 2, "="):
                return self.alias(first, i, end, exported)
            if self.is_(i, "enum") and not prefix:
                return self.enum(first, i, end, exported)
            if self.is_(i, "namespace", "module"):
                return self.namespace(i, end, prefix)
        if self.is_(i, "global") and self.is_(i + 1, "{") and i > first:
            return self.namespace(i - 1, end, prefix)
        if self.is_(i, "const", "let", "var"):
            return self.variables(first, i, end, exported) if not prefix else self.until(i + 1, end, (";",)) + 1
        if exported and self.is_(i - 1, "default") and self.name_at(i):
            self.exported.add(self.t[i].text)
        if self.is_(i, "{"):
            return self.past(i)
        stop = self.until(i, end, (";",))
        return stop + 1 if self.is_(stop, ";") else stop

    def function(self, first: int, i: int, end: int, prefix: str, exported: bool) -> int:
        i += 2 if self.is_(i + 1, "*") else 1
        name = self.t[i].text if self.name_at(i) else ""
        i = i + 1 if name else i
        i = self.angles(i) if self.is_(i, "<") else i
        if not self.is_(i, "(") or self.t[i].pair < 0:
            return i
        names, types = self.parameters(i)
        k = self.t[i].pair + 1
        body = self.result(k, end)
        if not self.is_(body, "{") or self.t[body].pair < 0:
            return body + 1 if self.is_(body, ";") else body
        if name:
            self.add("functions", prefix + name, "function", first, self.past(body), exported, None, "callable", names, types, self.slice(k + 1, body) if self.is_(k, ":") else "any")
        return self.past(body)

    def result(self, k: int, end: int) -> int:
        """Where the body opens, or the signature ends; k is behind the parameters."""
        if not self.is_(k, ":"):
            return k
        k += 1
        while k < end:
            if self.is_(k, "{") and not (self.is_(k - 1, ":", "|", "&", "=>", "is", "<", ",")):
                return k
            if self.is_(k, ";") or self.breaks(k) and not self.is_(k, "{"):
                return k
            k = self.angles(k) if self.is_(k, "<") and self.angles(k) > k else self.past(k)
        return k

    def class_(self, first: int, i: int, end: int, prefix: str, exported: bool) -> int:
        i += 1
        name = self.t[i].text if self.name_at(i) and not self.is_(i, "extends", "implements") else ""
        i = i + 1 if name else i
        i = self.angles(i) if self.is_(i, "<") else i
        base, above = "", []
        while i < end and not self.is_(i, "{"):
            if self.is_(i, "extends"):
                k = i + 1
                while self.is_(k + 1, ".") and self.name_at(k + 2):
                    k += 2
                base, i = self.t[k].text if self.name_at(k) else "", k
            elif self.is_(i, "implements"):
                i += 1
                while i < end and not self.is_(i, "{"):
                    k = i + 1
                    while self.is_(k, "."):
                        k += 2
                    above.append(self.slice(i, k))
                    i = self.angles(k) if self.is_(k, "<") else k
                    i = i + 1 if self.is_(i, ",") else i
                break
            i = self.angles(i) if self.is_(i, "<") and self.angles(i) > i else self.past(i)
        if not self.is_(i, "{") or self.t[i].pair < 0:
            return i
        stop = self.past(i)
        if name:
            full = prefix + name
            self.add("classes", full, "class", first, stop, exported, None, "class", above, [], base)
            methods, fields = self.members(i + 1, stop - 1)
            for a, b, own, names, types, result in methods:
                self.add("classes", f"{full}.{own}", "method", a, b, exported, full, "callable", names, types, result)
            for a, b, own, kind in fields if not prefix else []:
                self.add("classes", f"{full}.{own}", "property", a, b, exported, full, "value", [], [], kind)
        return stop

    def members(self, i: int, end: int) -> tuple[list[tuple], list[tuple]]:
        methods, fields = [], []
        while i < end:
            if self.is_(i, ";"):
                i += 1
                continue
            first = i
            while self.name_at(i) and self.t[i].text.startswith("@"):
                i = self.past(i + 1) if self.is_(i + 1, "(") else i + 1
            constant = False
            while self.name_at(i) and self.t[i].text in _MODIFIERS and not self.is_(i + 1, "(", ":", "=", ";", "?", "!", "<", "}"):
                constant |= self.t[i].text == "readonly"
                i += 1
            if self.is_(i, "{"):  # a static block
                i = self.past(i)
                continue
            access = self.is_(i, "get", "set") and not self.is_(i + 1, "(", ":", "=", ";", "?", "!", "<", "}")
            i += access
            i += self.is_(i, "*")
            if i >= end:
                break
            a, k = i, self.past(i)
            name = self.slice(a, k)
            k += self.is_(k, "?", "!")
            open_ = self.angles(k) if self.is_(k, "<") else k
            if self.is_(open_, "(") and self.t[open_].pair > 0:
                names, types = self.parameters(open_)
                back = self.t[open_].pair + 1
                body = self.result(back, end)
                if self.is_(body, "{"):
                    if not access and name != "constructor":
                        methods.append((first, self.past(body), name, names, types, self.slice(back + 1, body) if self.is_(back, ":") else "any"))
                    i = self.past(body)
                else:
                    i = body + 1 if self.is_(body, ";") else max(body, a + 1)
                continue
            kind = ""
            if self.is_(k, ":"):
                stop = self.until(k + 1, end, (";", "="), True)
                kind, k = self.slice(k + 1, stop), stop
            if self.is_(k, "="):
                stop = self.until(k + 1, end, (";",))
                kind, k = kind or self.value_type(k + 1, stop, constant), stop
            k = min(max(k, a + 1), end)
            k += self.is_(k, ";") and k < end
            fields.append((first, k, name, kind))
            i = k
        return methods, fields

    def interface(self, first: int, i: int, end: int, prefix: str, exported: bool) -> int:
        name, k = self.t[i + 1].text, i + 2
        while k < end and not self.is_(k, "{"):
            k = self.angles(k) if self.is_(k, "<") and self.angles(k) > k else k + 1
        if not self.is_(k, "{") or self.t[k].pair < 0:
            return k
        members, at, stop = [], k + 1, self.t[k].pair
        while at < stop:
            b = self.until(at, stop, (";", ","), True)
            b += self.is_(b, ";", ",") and b < stop
            members.append(self.slice(at, max(b, at + 1)))
            at = max(b, at + 1)
        self.add("interfaces", prefix + name, "interface", first, stop + 1, exported, None, "interface", [], members)
        return stop + 1

    def alias(self, first: int, i: int, end: int, exported: bool) -> int:
        k = self.angles(i + 2) if self.is_(i + 2, "<") else i + 2
        stop = self.until(k + 1, end, (";",), True)
        kind = self.slice(k + 1, stop)
        stop += self.is_(stop, ";") and stop < end
        self.add("types", self.t[i + 1].text, "type", first, stop, exported, None, "value", [], [], kind)
        return stop

    def enum(self, first: int, i: int, end: int, exported: bool) -> int:
        if not self.is_(i + 2, "{") or self.t[i + 2].pair < 0:
            return i + 2
        stop, names, values, known, last = self.t[i + 2].pair, [], [], {}, -1
        k = i + 3
        while k < stop:
            b = k
            while b < stop and not self.is_(b, ","):
                b = self.past(b)
            name, value = self.t[k].text, None
            if self.is_(k + 1, "="):
                value = constant(self.slice(k + 2, b), known)
            elif last is not None:
                value = last + 1
            last = value if isinstance(value, (int, float)) else None
            known[name.strip("'\"")] = value
            names.append(name)
            values.append("" if value is None else str(int(value) if isinstance(value, float) and value.is_integer() else value))
            k = b + 1
        self.add("enums", self.t[i + 1].text, "enum", first, stop + 1, exported, None, "enum", names, values)
        return stop + 1

    def variables(self, first: int, i: int, end: int, exported: bool) -> int:
        constant_, own = self.is_(i, "const"), []
        k = b = i + 1
        while k < end:
            b = self.past(k)
            name, kind = self.slice(k, b), ""
            b += self.is_(b, "!")
            if self.is_(b, ":"):
                stop = self.until(b + 1, end, ("=", ",", ";"), True)
                kind, b = self.slice(b + 1, stop), stop
            if self.is_(b, "="):
                stop = self.until(b + 1, end, (",", ";"))
                kind, b = kind or self.value_type(b + 1, stop, constant_), stop
            own.append((name, kind, self.t[k].start, self.t[b - 1].end))
            if not self.is_(b, ","):
                break
            k = b + 1
        b += self.is_(b, ";") and b < end
        for name, kind, a, z in own:
            self.add("variables", name, "variable", first, b, exported, None, "value", [], [], kind, (a, z))
        return b

    def namespace(self, i: int, end: int, prefix: str) -> int:
        k = i + 2
        while self.is_(k, "."):
            k += 2
        if not self.is_(k, "{") or self.t[k].pair < 0:
            return k
        outer, self.found = self.found, {}
        self.statements(k + 1, self.t[k].pair, f"{prefix}{self.slice(i + 1, k)}.")
        inner, self.found = self.found, outer
        rows = [r for g in ("functions", "classes", "interfaces", "namespaces") for part in inner.get(g, []) for r in part]
        self.found.setdefault("namespaces", []).append(rows)
        return self.past(k)

    def import_(self, i: int, end: int) -> int:
        stop = self.until(i + 1, end, (";",))
        source = next((self.t[k].text[1:-1] for k in range(stop - 1, i, -1) if self.t[k].kind == "string"), "")
        k = i + 1 + (self.is_(i + 1, "type") and not self.is_(i + 2, "from"))
        while k < stop and self.t[k].kind != "string" and not self.is_(k, "from"):
            if self.is_(k, "{"):
                self.imports += [(local, source, name) for name, local in self.specifiers(k)]
            elif self.is_(k, "*") and self.is_(k + 1, "as"):
                self.imports.append((self.t[k + 2].text, source, "*"))
                k += 2
            elif self.name_at(k):
                self.imports.append((self.t[k].text, source, "default"))
            k = self.past(k)
        return stop + 1 if self.is_(stop, ";") else stop

    def specifiers(self, k: int) -> list[tuple[str, str]]:
        """(name, local name) of a list in braces."""
        out, a = [], k + 1
        while a < self.t[k].pair:
            b = a
            while b < self.t[k].pair and not self.is_(b, ","):
                b += 1
            a += self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as")
            if a < b:
                out.append((self.t[a].text, self.t[b - 1].text))
            a = b + 1
        return out

    def export(self, i: int, end: int) -> int:
        stop = self.until(i + 1, end, (";",))
        k = i + 2 if self.is_(i + 1, "type") else i + 1
        if self.is_(k, "{") and not self.is_(self.past(k), "from"):
            self.exported |= {name for name, _ in self.specifiers(k)}
        return stop + 1 if self.is_(stop, ";") else stop

    def state(self) -> None:
        """Goes over all statements, once."""
        if not self.stated:
            self.stated = True
            self.statements(0, len(self.t))

    def imported(self) -> list[dict]:
        self.state()
        return [{"local": local, "source": source, "imported": name} for local, source, name in self.imports]

    def declared(self) -> list[dict]:
        """All symbols: functions, classes with their members, interfaces, types, enums, variables, namespaces."""
        self.state()
        out = [r for g in ("functions", "classes", "interfaces", "types", "enums", "variables", "namespaces") for part in self.found.get(g, []) for r in part]
        for k, r in enumerate(out):
            top = r["name"].split(".")[0] if r["parent"] else r["name"]
            r.update(ord=k, is_exported=r["is_exported"] or top in self.exported)
        return out

    # References.

    def referred(self) -> list[dict]:
        return [{"owners": owners, "pos": self.offset(at), "base": base, "member": member} for owners, at, base, member in self.references()]

    def references(self) -> Iterator[tuple[list[str], int, str, str | None]]:
        """(owners from the innermost, place, base, member) of identifiers inside of owners; base is a name that no scope
        binds, or ``this.Class``; member is what is read of it."""
        ends: list[tuple[int, str | None, set[str]]] = []  # open scopes: last token, owner, names bound
        i, n = 0, len(self.t)
        classes: list[tuple[int, str, int]] = []  # last token, name, opening brace
        while i < n:
            while ends and i > ends[-1][0]:
                ends.pop()
            while classes and i > classes[-1][0]:
                classes.pop()
            t = self.t[i]
            if t.text == "{" and t.kind == "mark" and t.pair > i and not (classes and classes[-1][2] == i):
                ends.append((t.pair, None, set()))
            if t.kind == "word" and not self.is_(i - 1, ".", "?."):
                if t.text == "class" and self.name_at(i + 1) and not self.is_(i + 1, "extends"):
                    k = i + 2
                    while k < n and not self.is_(k, "{"):
                        k = self.angles(k) if self.is_(k, "<") and self.angles(k) > k else k + 1
                    if k < n and self.t[k].pair > k:
                        name = self.t[i + 1].text
                        if ends:
                            ends[-1][2].add(name)
                        classes.append((self.t[k].pair, name, k))
                        ends.append((self.t[k].pair, name, set()))  # what it extends is its own, too
                        i += 2
                        continue
                elif t.text == "function":
                    k = i + 1 + self.is_(i + 1, "*")
                    name = self.t[k].text if self.name_at(k) else None
                    if name and ends:
                        ends[-1][2].add(name)
                    i = self.callable(k + 1 if name else k, name, ends)
                    continue
                elif t.text in ("const", "let", "var") and ends:
                    self.bind(i + 1, ends[-1][2])
                elif classes and ends and i > classes[-1][2] and ends[-1][0] == classes[-1][0] and self.member_at(i):
                    k = self.angles(i + 1) if self.is_(i + 1, "<") else i + 1
                    k += self.is_(k, "?", "!")
                    if self.is_(k, "("):
                        owner = classes[-1][1] if t.text == "constructor" else f"{classes[-1][1]}.{t.text}"
                        i = self.callable(k, owner, ends)
                        continue
                    i += 1
                    continue
                elif t.text == "catch" and self.is_(i + 1, "(") and self.is_(self.t[i + 1].pair + 1, "{"):
                    bound: set[str] = set()
                    self.bind(i + 2, bound)
                    ends.append((self.t[self.t[i + 1].pair + 1].pair, None, bound))
                    i += 1
                    continue
            if self.is_(i, "(") and t.pair > i and (self.is_(t.pair + 1, "=>") or self.is_(t.pair + 1, ":") and self.arrow_result(t.pair + 1)):
                self.arrow(i, ends)
            elif t.kind == "word" and self.is_(i + 1, "=>") and t.text not in _KEYWORDS and not self.is_(i - 1, ":", "|", "&", ".", "is", "typeof", "keyof"):
                self.arrow(i, ends)
                i += 1
                continue
            if t.kind == "word" and ends:
                yield from self.reference(i, ends, classes)
            i += 1

    def scope_end(self, i: int) -> int:
        t = self.t[i]
        if t.text in _OPEN and t.pair > i:
            return t.pair
        return self.until(i, len(self.t), (",", ";", ")", "]", "}")) - 1

    def member_at(self, i: int) -> bool:
        """Whether a word in a class body names a member: what follows opens one, and nothing before reads on."""
        if self.t[i].text in _MODIFIERS | {"get", "set"} and self.name_at(i + 1):
            return False
        return self.is_(i + 1, "(", "<", ":", "=", ";", "?", "!", "}") and not self.is_(i - 1, ":", "=", "|", "&", "<", ",", "=>", "new", "extends", "typeof", "@") and not self.t[i].text.startswith("@")

    def bind(self, i: int, names: set[str]) -> None:
        """Names of a declarator or of a binding pattern at i, and of those behind commas."""
        while i < len(self.t):
            if self.is_(i, "{", "[") and self.t[i].pair > i:
                names |= {self.t[k].text for k in range(i + 1, self.t[i].pair) if self.name_at(k) and self.is_(k + 1, ",", "}", "]", "=")}
            elif self.name_at(i):
                names.add(self.t[i].text)
            i = self.past(i)
            if self.is_(i, ":"):
                i = self.until(i + 1, len(self.t), ("=", ",", ";", ")"), True)
            if self.is_(i, "="):
                i = self.until(i + 1, len(self.t), (",", ";", ")"))
            if not self.is_(i, ","):
                return
            i += 1

    def callable(self, i: int, owner: str | None, ends: list) -> int:
        """A function or method from its type parameters or parameters on: opens its scope there."""
        k = self.angles(i) if self.is_(i, "<") else i
        if not self.is_(k, "(") or self.t[k].pair < 0:
            return max(i, k)
        body = self.result(self.t[k].pair + 1, len(self.t))
        last = self.t[body].pair if self.is_(body, "{") and self.t[body].pair > body else body - 1
        bound: set[str] = set()
        for name in self.parameters(k)[0]:
            bound |= set(re.findall(r"[\w$]+", name))
        ends.append((last, owner, bound))
        return k

    def arrow_result(self, k: int) -> bool:
        """Whether what follows the colon at k is a result type and an arrow; object types belong to it."""
        stop = k
        while True:
            stop = self.until(stop + 1, len(self.t), ("=>", ",", ";", "{", "=", ")", "?"), True)
            if not (self.is_(stop, "{") and self.t[stop].pair > stop and self.is_(stop - 1, ":", "|", "&")):
                return self.is_(stop, "=>")
            stop = self.t[stop].pair
            if self.is_(stop + 1, "=>"):
                return True

    def arrow(self, i: int, ends: list) -> None:
        """An arrow function whose parameters open at i: its scope begins there; a variable that it is assigned to owns it."""
        stop = i if self.t[i].kind == "word" else self.t[i].pair
        k = self.until(stop + 1, len(self.t), ("=>",), True) if self.is_(stop + 1, ":") else stop + 1
        b = i - 1 - self.is_(i - 1, "async")
        owner = None
        if self.is_(b, "="):
            v = b - 1
            while v > 0 and not self.is_(v, ",", ";", "{", "}", "const", "let", "var") and not self.breaks(v):
                v -= 1
            if self.is_(v, "const", "let", "var", ",") and self.name_at(v + 1):
                owner = self.t[v + 1].text
        bound = {self.t[i].text} if self.t[i].kind == "word" else {x for name in self.parameters(i)[0] for x in re.findall(r"[\w$]+", name)}
        if k + 1 < len(self.t):
            ends.append((self.scope_end(k + 1), owner, bound))

    def reference(self, i: int, ends: list, classes: list) -> Iterator[tuple[list[str], int, str, str | None]]:
        t = self.t[i]
        owners = [o for _, o, _ in reversed(ends) if o]
        if not owners or self.is_(i - 1, ".", "?.") or self.is_(i + 1 + self.is_(i + 1, "?"), ":") and self.is_(i - 1, "{", ",", ";"):
            return
        member = self.t[i + 2].text if self.is_(i + 1, ".", "?.") and self.name_at(i + 2) else None
        if t.text in ("this", "super") and member and classes:
            yield owners, t.start, f"{t.text}.{classes[-1][1]}", member
        elif t.text.lstrip("@") not in _KEYWORDS:
            name = t.text.lstrip("@")
            if not any(name in bound for _, _, bound in ends):
                yield owners, t.start, name, member


def constant(text: str, known: dict) -> int | float | str | None:
    """The value of a constant expression of an enum, or None."""
    kinds = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.LShift: lambda a, b: a << b, ast.RShift: lambda a, b: a >> b, ast.BitOr: lambda a, b: a | b, ast.BitAnd: lambda a, b: a & b, ast.BitXor: lambda a, b: a ^ b}

    def value(e: ast.expr):
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, ast.Name):
            return known[e.id]
        if isinstance(e, ast.Attribute):
            return known[e.attr]
        if isinstance(e, ast.UnaryOp):
            v = value(e.operand)
            return -v if isinstance(e.op, ast.USub) else ~v if isinstance(e.op, ast.Invert) else +v
        return kinds[type(e.op)](value(e.left), value(e.right))

    try:
        found = value(ast.parse(text.strip().replace("`", '"'), mode="eval").body)
    except (SyntaxError, ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None
    return found if isinstance(found, (int, float, str)) and not isinstance(found, bool) else None


#: What a file's text gives, each part an array of its row.
_PARTS = {"symbols": (_SYMBOL, lambda r: r.declared()), "refs": (_REFERENCE, lambda r: r.referred()), "imports": (_IMPORT, lambda r: r.imported())}
#: Files whose rows are handed on together.
_BATCH = 500


def _parsed(files: DataFrame, *parts: str) -> DataFrame:
    """file_path and the parts of each file; no text is read twice for them.

    A file's text takes far longer to read than to send, so files are dealt anew: those of one small split are read by all.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("file_path", pa.string()), *((k, pa.list_(pa.struct(_PARTS[k][0]))) for k in parts)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                out = []
                for row in whole.slice(at, _BATCH).to_pylist():
                    r = Reader(row["file_path"], row["content"] or "")
                    out.append({"file_path": row["file_path"]} | {k: _PARTS[k][1](r) for k in parts})
                yield pa.RecordBatch.from_pylist(out, schema)

    ddl = ", ".join(["file_path string", *(f"{k} array<struct<{', '.join(f'{c}: {_ddl(t)}' for c, t in _PARTS[k][0])}>>" for k in parts)])
    return _files(files).repartition(n, "file_path").mapInArrow(rows, ddl)


def _ddl(t: pa.DataType) -> str:
    return f"array<{_ddl(t.value_type)}>" if pa.types.is_list(t) else {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean"}[t]


def read(files: DataFrame) -> DataFrame:
    """Files (file_path, content) read once and kept: what the functions below take in their place."""
    return cut(_parsed(files, *_PARTS))


def _part(files: DataFrame, part: str) -> DataFrame:
    rows = files if part in files.columns else _parsed(files, part)
    return rows.select("file_path", F.explode(part).alias("x")).select("file_path", "x.*")


def _files(files: DataFrame) -> DataFrame:
    return files.select(normal_path(F.col("file_path")).alias("file_path"), F.col("content").cast("string").alias("content")).filter("file_path is not null")


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (file_path, content), a row for each declaration; repeated declarations are rows of their own.

    Order (ord) within a file: functions, classes, each with its methods and then its properties, interfaces, types,
    enums, variables, namespaces with what they hold.
    """
    rows = _part(files, "symbols")
    by_shape = F.when(F.col("shape") == "callable", Y.sign_callable(F.col("names"), F.col("types"), F.col("result"))).when(F.col("shape") == "class", Y.sign_class(F.col("result"), F.col("names")))
    by_shape = by_shape.when(F.col("shape") == "interface", Y.sign_interface(F.col("types"))).when(F.col("shape") == "enum", Y.sign_enum(F.col("names"), F.col("types"))).otherwise(Y.sign_value(F.col("result")))
    path = F.col("file_path")
    parent = F.when(F.col("parent").isNotNull(), make_id(path, F.col("parent")))
    places = ("start_line", "end_line", "start_pos", "end_pos")
    return rows.select(make_id(path, F.col("name")).alias("id"), "name", "kind", "file_path", *places, "is_exported", parent.alias("parent_id"), short_hash(by_shape).alias("signature_hash"), "ord")


def imports(files: DataFrame) -> DataFrame:
    """file_path, local, source, imported (a name, 'default' or '*') of each import."""
    return _part(files, "imports")


def _joined_path(path: F.Column, source: F.Column) -> F.Column:
    """A relative source seen from a file: its path without extension."""
    parts = F.concat(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.split(source, "/"))

    def step(done: F.Column, p: F.Column) -> F.Column:
        return F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


#: What a path without extension can stand for.
ENDINGS = tuple(f"{index}.{end}" for index in ("", "/index") for end in ("ts", "tsx", "d.ts", "js", "jsx"))


def _local_stem(file_path: F.Column, source: F.Column) -> F.Column:
    return _joined_path(file_path, F.regexp_replace(source, r"\.(js|jsx|ts|tsx)$", ""))


def import_targets(files: DataFrame) -> DataFrame:
    """path: all paths that the relative imports of files may stand for."""
    stems = imports(files).filter("source like '.%'").select(_local_stem(F.col("file_path"), F.col("source")).alias("stem")).distinct()
    return stems.select(F.explode(F.array(*(F.concat("stem", F.lit(e)) for e in ENDINGS))).alias("path"))


def walk_references(files: DataFrame, symbols: DataFrame, root: str = "", strict: bool = False) -> DataFrame:
    """Edges (src, dst) of the references in files: the innermost owner that is indexed, and what the name stands for.

    A name stands for a declaration of the file, or for what an import of a relative path brings; ``a.b`` also for the
    member b of the class or namespace a, ``this.b`` for that of the class around.  strict: a plain imported name
    stands for its import only, which is no symbol.  Both ends are indexed, loops and repeats are left out.
    """
    own = files.filter(in_graph(F.col("file_path"), root))
    own = own if "refs" in own.columns else cut(_parsed(own, "refs", "imports"))
    refs = _part(own, "refs").withColumn("ref", F.struct("file_path", "pos"))
    known = symbols.select("id", F.col("file_path").alias("at"), "name").distinct()
    # sources: names by the file without its extension
    stem = F.regexp_replace("at", r"(/index)?\.(d\.ts|tsx?|jsx?)$", "")
    brought = imports(own).filter("source like '.%'").select("file_path", F.col("local").alias("base"), _local_stem(F.col("file_path"), F.col("source")).alias("stem"), "imported")
    files_of = known.select("at", stem.alias("stem")).distinct()
    brought = brought.join(files_of, "stem").select("file_path", "base", "at", "imported")
    this = F.regexp_extract("base", r"^(?:this|super)\.(.*)$", 1)
    plain = refs.select("ref", "owners", "file_path", F.when(this != "", this).otherwise(F.col("base")).alias("base"), "member", (this != "").alias("inner"))
    here = plain.select("ref", "owners", F.col("file_path").alias("at"), F.when(~F.col("inner"), F.col("base")).alias("name"), F.concat("base", F.lit("."), "member").alias("both"))
    far = plain.filter("not inner").join(brought, ["file_path", "base"])
    single = F.when((F.col("imported") != "*") & F.lit(not strict), F.col("imported"))
    there = far.select("ref", "owners", "at", single.alias("name"), F.when(F.col("imported") == "*", F.col("member")).otherwise(F.concat("imported", F.lit("."), "member")).alias("both"))
    asked = here.unionByName(there).select("ref", "owners", "at", F.explode(F.array_distinct(F.array("name", "both"))).alias("name"))
    hits = asked.filter("name is not null").join(known, ["at", "name"]).select("ref", "owners", F.col("id").alias("dst")).distinct()
    tried = hits.select("ref", "dst", F.posexplode("owners").alias("place", "owner")).withColumn("src", make_id(F.col("ref.file_path"), F.col("owner")))
    found = tried.join(known.select(F.col("id").alias("src")), "src", "left_semi").groupBy("ref", "dst").agg(F.min_by("src", "place").alias("src"))
    return found.filter("src <> dst").select("src", "dst").distinct()
