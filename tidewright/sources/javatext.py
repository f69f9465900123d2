"""Java source files as tables of methods and of the calls in them, by a scan over tokens, brackets and declarations.

Not a compiler: names are taken as written, and what needs types that a file doesn't name is left to the joins in operators/resolve.py. Bodies of every kind are read: methods,
constructors, initializers of types (owner ``<clinit>``) and of instances (``<instance>``: every constructor runs them), lambdas (of the body they stand
in), arguments and bodies of enum constants, anonymous and local types (named like a compiler names them, Outer$1 and Outer$1Name). A file that can't be
scanned to its end, or a part of one that isn't understood, is reported in ``problem``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..workers import ship

METHODS = "path string, package string, type string, type_kind string, method string, params string, annotations array<string>, type_annotations array<string>, first_line int, last_line int, problem string"
CALLS = "path string, type string, method string, params string, line_no int, kind string, receiver string, receiver_type string, member string, arguments int, literal string"
ARGUMENTS = "path string, caller string, call int, callee string, position int, literal string, passes int, result_of string"
OVERLOADS = "callee string, method string"
# Words of the language that a bracket may follow.
_NO_CALL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "try", "do", "else", "case", "super", "this", "new", "instanceof", "yield"}
_TYPES = ("class", "interface", "enum", "record", "@interface")
_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<block>\"{3}(?:\\.|(?!\"{3})[^\\])*\"{3})|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<chr>'(?:\\.|[^'\\\n])*')|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\.?\d[\w.]*)|(?P<mark>@interface\b|->|::|\.\.\.|.)""", re.S)
_VARIABLE = re.compile(r"\b([A-Z][\w.]*)(?:<[^;=()]*>)?(?:\[\])*\s+(\w+)\s*(?=[=;,):])")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def parameter_types(text: str) -> str:
    """The erased types of a parameter list, without names, annotations and modifiers."""
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            words = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", " ", part).split()
            if words:
                kind = " ".join(words[:-1]) if len(words) > 1 else words[0]
                out.append(kind.replace(" ", "").replace("...", "[]") + "[]" * words[-1].count("[]"))
            part = ""
        elif depth == 0 and c != ">":
            part += c
        elif c == ">" and depth == 0:
            part += " "
    return "(" + ",".join(out) + ")"


class _Type:
    def __init__(self, name: str, full: str, kind: str, marks: list[str], parent: str | None = None, named: bool = True):
        self.name, self.full, self.kind, self.marks, self.parent, self.named = name, full, kind, marks, parent, named
        self.inner: dict[str, int] = {}  # anonymous ('') and local types so far, by name

    def next_inner(self, name: str = "") -> str:
        self.inner[name] = self.inner.get(name, 0) + 1
        return f"{self.full}${self.inner[name]}{name}"


class _Body:
    """Code of a method or initializer: tokens ``first`` to ``last``, of a type, without those of types declared in it."""

    def __init__(self, of: _Type, method: str, params: str, names: list[str], kinds: list[str], first: int, last: int):
        self.of, self.method, self.params, self.names, self.kinds, self.first, self.last = of, method, params, names, kinds, first, last


class _Scan:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tokens: list[tuple[str, str, int]] = []
        self.match: dict[int, int] = {}
        self.lines = [m.end() for m in re.finditer("\n", text)]
        self._tokenize()
        self.package, self.methods, self.inner_methods, self.bodies, self.found, self.problems = "", [], [], [], [], []
        self._unit()
        self.fields = self._variables(0, len(self.tokens))

    def _tokenize(self) -> None:
        opened: list[int] = []
        for m in _TOKEN.finditer(self.text):
            kind = m.lastgroup
            if kind is None:
                continue
            value = m.group()
            if kind == "block":
                kind, value = "str", value[3:-3]
            elif kind == "str":
                value = value[1:-1]
            elif kind == "mark" and value in ("\"", "'"):
                raise ValueError("a literal isn't closed")
            if kind == "mark" and value in _PAIRS:
                opened.append(len(self.tokens))
            elif kind == "mark" and value in ")]}":
                if not opened:
                    raise ValueError("a closing brace too many")
                start = opened.pop()
                if _PAIRS[self.tokens[start][1]] != value:
                    raise ValueError("brackets don't match")
                self.match[start] = len(self.tokens)
                self.match[len(self.tokens)] = start
            self.tokens.append((kind, value, m.start()))
        if opened:
            raise ValueError("a brace isn't closed")

    def _line(self, k: int) -> int:
        return bisect_right(self.lines, self.tokens[k][2]) + 1

    def _is(self, k: int, *values: str) -> bool:
        return k < len(self.tokens) and self.tokens[k][0] in ("mark", "id") and self.tokens[k][1] in values

    def _name(self, k: int) -> bool:
        return k < len(self.tokens) and self.tokens[k][0] == "id"

    def _qualified(self, k: int) -> tuple[str, int]:
        """A name with dots that begins at ``k``, and where it ends."""
        parts = []
        while self._name(k):
            parts.append(self.tokens[k][1])
            k += 1
            if not (self._is(k, ".") and self._name(k + 1)):
                break
            k += 1
        return ".".join(parts), k

    def _generics(self, k: int) -> int:
        """Behind type arguments that begin at ``k``."""
        depth = 0
        while k < len(self.tokens):
            depth += self._is(k, "<") - self._is(k, ">")
            k += 1
            if not depth:
                return k
        raise ValueError("type arguments aren't closed")

    def _unit(self) -> None:
        k, end = 0, len(self.tokens)
        while k < end:
            if self._is(k, "package") and self._name(k + 1):
                self.package, k = self._qualified(k + 1)
            elif self._is(k, "import"):
                while k < end and not self._is(k, ";"):
                    k += 1
            elif self._is(k, ";"):
                k += 1
            else:
                k = self._member(k, end, None)

    def _annotation(self, k: int) -> tuple[str, int]:
        name, k = self._qualified(k + 1)
        return name.rpartition(".")[2], self.match[k] + 1 if self._is(k, "(") else k

    def _type_word(self, k: int) -> bool:
        """Whether a type's declaration begins with the token."""
        return self._is(k, *_TYPES) and self._name(k + 1) and not self._is(k - 1, ".") and (not self._is(k, "record") or self._is(k + 2, "(", "<")) and not (self._is(k, "enum") and not self._is(k + 2, "{", "implements"))

    def _member(self, k: int, end: int, of: _Type | None) -> int:
        """Read the declaration that begins at ``k``; give where the next one does."""
        marks, words, start = [], [], k
        while k < end:
            if self._is(k, "@"):
                mark, k = self._annotation(k)
                marks.append(mark)
            elif self._type_word(k):
                return self._type(k, of, marks)
            elif self._is(k, ";"):
                return k + 1
            elif self._is(k, "{"):
                if of is not None and of.kind == "record" and words and words[-1] == of.name:
                    self._method(of, k - 1, "<init>", "()", [], [], marks, k, k)
                elif of is not None and (not words or words == ["static"]):
                    self._code(_Body(of, "<clinit>" if words else "<instance>", "()", [], [], k + 1, self.match[k]))
                else:
                    self.problems.append(f"line {self._line(k)}: a block that isn't understood")
                return self.match[k] + 1
            elif self._is(k, "(") and of is not None and words and self._name(k - 1):
                return self._callable(k, end, of, words, marks)
            elif self._is(k, "=") and of is not None:
                stop = k + 1
                while stop < end and not self._is(stop, ";"):
                    stop = self.match[stop] + 1 if stop in self.match and self.match[stop] > stop else stop + 1
                self._code(_Body(of, "<clinit>" if "static" in words or of.kind in ("interface", "@interface") else "<instance>", "()", [], [], k + 1, stop))
                return stop + 1
            elif self._is(k, "<"):
                k = self._generics(k)
            else:
                words.append(self.tokens[k][1])
                k += 1
        self.problems.append(f"line {self._line(min(start, len(self.tokens) - 1))}: a declaration that isn't closed")
        return end

    def _type(self, k: int, of: _Type | None, marks: list[str], within: _Type | None = None) -> int:
        kind, name = self.tokens[k][1], self.tokens[k + 1][1]
        full = within.next_inner(name) if within else f"{of.full}${name}" if of else f"{self.package}.{name}" if self.package else name
        new, k = _Type(name, full, kind, marks, named=within is None), k + 2
        while not self._is(k, "{"):
            if k >= len(self.tokens):
                raise ValueError("a type has no body")
            if self._is(k, "extends") and kind == "class":
                new.parent, k = self._qualified(k + 1)
            elif self._is(k, "("):
                k = self.match[k] + 1
            else:
                k += 1
        self._members(k, new)
        return self.match[k] + 1

    def _members(self, brace: int, of: _Type) -> None:
        k, end = brace + 1, self.match[brace]
        if of.kind == "enum":
            while k < end and not self._is(k, ";"):
                if self._is(k, "@"):
                    _, k = self._annotation(k)
                    continue
                if self._is(k, "("):
                    self._code(_Body(of, "<clinit>", "()", [], [], k + 1, self.match[k]))
                elif self._is(k, "{"):
                    self._members(k, _Type(of.name, of.next_inner(), "class", [], of.full, named=False))
                k = self.match[k] + 1 if k in self.match else k + 1
            k += 1
        while k < end:
            k = self._member(k, end, of)

    def _parameters(self, k: int) -> tuple[str, list[str], list[str]]:
        """Erased types as text, names and types of the parameters in the bracket at ``k``."""
        stop, parts, part, depth = self.match[k], [], [], 0
        k += 1
        while k <= stop:
            if k == stop or self._is(k, ",") and not depth:
                if part:
                    parts.append(part)
                part = []
                k += 1
            elif self._is(k, "@"):
                _, k = self._annotation(k)
            else:
                depth += self._is(k, "<") - self._is(k, ">")
                if not depth and not self._is(k, ">", "final"):
                    part.append(self.tokens[k][1])
                k += 1
        parts = [p for p in parts if p[-1] != "this"]
        names = [next((w for w in reversed(p) if w not in "[]"), "") for p in parts]
        kinds = ["".join(p[: len(p) - 1 - p[::-1].index(n)]).replace("...", "[]") + "[]" * p[len(p) - 1 - p[::-1].index(n) :].count("[") for p, n in zip(parts, names)]
        return "(" + ",".join(kinds) + ")", names, kinds

    def _callable(self, k: int, end: int, of: _Type, words: list[str], marks: list[str]) -> int:
        name, at = words[-1], k - 1
        params, names, kinds = self._parameters(k)
        if name == of.name and len([w for w in words if w not in ("public", "protected", "private")]) == 1:
            name = "<init>"
        k = self.match[k] + 1
        while k < end and not self._is(k, "{", ";"):
            k = self.match[k] + 1 if k in self.match and self.match[k] > k else k + 1
        if k >= end:
            self.problems.append(f"line {self._line(at)}: a method without an end")
            return end
        self._method(of, at, name, params, names, kinds, marks, k if self._is(k, "{") else None, k)
        return (self.match[k] if self._is(k, "{") else k) + 1

    def _method(self, of: _Type, at: int, name: str, params: str, names: list[str], kinds: list[str], marks: list[str], brace: int | None, last: int) -> None:
        last = self.match[brace] if brace is not None else last
        row = [self.path, self.package, of.full, of.kind, name, params, marks, of.marks, self._line(at), self._line(last), None]
        (self.methods if of.named else self.inner_methods).append(row)
        if brace is not None:
            self._code(_Body(of, name, params, names, kinds, brace + 1, last))

    def _variables(self, first: int, last: int) -> dict[str, str]:
        """Types of the variables that are declared between two tokens, as written."""
        if first >= last:
            return {}
        begin, stop = self.tokens[first][2], self.tokens[last - 1][2] + len(self.tokens[last - 1][1])
        plain = _TOKEN.sub(lambda m: m.group() if m.lastgroup in ("id", "num", "mark") else " ", self.text[begin : stop + 1])
        return {n: t for t, n in _VARIABLE.findall(plain)}

    def _code(self, body: _Body) -> None:
        """Find the calls of a body; types declared in it are read on their own."""
        self.bodies.append(body)
        self._expressions(body, body.first, body.last)

    def _expressions(self, body: _Body, k: int, end: int) -> None:
        while k < end:
            if self._is(k, "new"):
                k = self._new(body, k)
            elif self._is(k, "@") and self._name(k + 1):
                _, k = self._annotation(k)
            elif self._type_word(k):
                k = self._type(k, None, [], within=body.of)
            elif self._is(k, "::"):
                target = "<init>" if self._is(k + 1, "new") else self.tokens[k + 1][1]
                self.found.append((body, k, "method_reference", *self._receiver(k), target, None))
                k += 2
            elif self._name(k) and self._is(k + 1, "("):
                word = self.tokens[k][1]
                if word in ("this", "super") and not self._is(k - 1, "."):
                    self.found.append((body, k, "constructor_invocation", word, "<init>", k + 1))
                elif word not in _NO_CALL:
                    on = self._receiver(k - 1)[0] if self._is(k - 1, ".") else self._receiver(self._before_generics(k - 1))[0] if self._is(k - 1, ">") else "this"
                    self.found.append((body, k, "method_invocation", on, word, k + 1))
                k += 1
            else:
                k += 1

    def _before_generics(self, k: int) -> int:
        depth = 0
        while k >= 0:
            depth += self._is(k, ">") - self._is(k, "<")
            k -= 1
            if not depth:
                return k
        return -1

    def _receiver(self, dot: int) -> tuple[str | None]:
        """The name before a dot or double colon; '"' for a string, None for any other expression."""
        if not self._is(dot, ".", "::"):
            return ("this",)
        k, parts = dot - 1, []
        if self._is(k, ">"):
            k = self._before_generics(k)
        while self._name(k):
            parts.insert(0, self.tokens[k][1])
            if not self._is(k - 1, "."):
                return (".".join(parts),)
            k -= 2
        return ('"' if not parts and self.tokens[k][0] == "str" else None,)

    def _new(self, body: _Body, k: int) -> int:
        k += 1
        while self._is(k, "@"):
            _, k = self._annotation(k)
        name, after = self._qualified(k)
        while self._is(after, "<", "."):  # type arguments, also in the middle of a name
            if self._is(after, "<"):
                after = self._generics(after)
            else:
                more, after = self._qualified(after + 1)
                name += "." + more
        if not self._is(after, "("):
            return after
        stop = self.match[after]
        self.found.append((body, k - 1, "constructor_invocation", name, "<init>", after))
        self._expressions(body, after + 1, stop)
        if not self._is(stop + 1, "{"):
            return stop + 1
        self._members(stop + 1, _Type(name, body.of.next_inner(), "class", [], name, named=False))
        return self.match[stop + 1] + 1

    def split(self, bracket: int) -> list[tuple[int, int]]:
        """Bounds of each argument in a bracket."""
        out, start, k, stop = [], bracket + 1, bracket + 1, self.match[bracket]
        while k < stop:
            if self._is(k, ","):
                out.append((start, k))
                start = k + 1
            k = self.match[k] + 1 if k in self.match and self.match[k] > k else k + 1
        return [*out, (start, stop)] if start < stop else out

    def calls(self) -> Iterator[tuple]:
        known: dict[int, dict] = {}
        for body, k, kind, on, member, bracket in sorted(self.found, key=lambda f: f[1]):
            names = known.get(id(body))
            if names is None:
                names = known[id(body)] = self.fields | self._variables(body.first, body.last) | dict(zip(body.names, (t.removesuffix("[]") for t in body.kinds)))
            if kind == "constructor_invocation" and on in ("this", "super"):
                receiver, of = on, body.of.full if on == "this" else body.of.parent
            elif kind == "constructor_invocation":
                receiver, of = None, on
            elif on == '"':
                receiver, of = None, "String"
            elif on in (None, "super"):
                receiver, of = on, body.of.parent if on else None
            else:
                first = on.removeprefix("this.")
                receiver, of = on, body.of.full if on == "this" else names.get(first, on if on[:1].isupper() else None)
            parts = self.split(bracket) if bracket is not None else []
            literal = self.tokens[parts[0][0]][1] if parts and parts[0][1] - parts[0][0] == 1 and self.tokens[parts[0][0]][0] == "str" else None
            yield self.path, body.of.full, body.method, body.params, self._line(k), kind, receiver, of, member, len(parts) if bracket is not None else None, literal

    def arguments(self) -> Iterator[tuple]:
        """Arguments of calls of the file's own methods (callee type.name/number) and of look-ups of classes, as operators.propagation takes them."""
        own = {(r[2], r[4], r[5].count(",") + (r[5] != "()")) for r in self.methods + self.inner_methods}
        fixed: dict[int, dict] = {}
        for body, k, kind, on, member, bracket in sorted(self.found, key=lambda f: f[1]):
            if kind != "method_invocation":
                continue
            parts = self.split(bracket)
            callee = f"{body.of.full}.{member}/{len(parts)}"
            if not (on in ("this", body.of.name) and (body.of.full, member, len(parts)) in own):
                if member in ("forName", "loadClass") and parts:
                    callee = LOOKUP
                else:
                    continue
            texts = fixed.setdefault(id(body), None) or self._fixed(body)
            fixed[id(body)] = texts
            for position, (low, high) in enumerate(parts):
                sort, value, _ = self.tokens[low]
                literal = passes = result = None
                if high - low == 1 and sort == "str":
                    literal = value
                elif high - low == 1 and value in body.names and body.kinds[body.names.index(value)].rpartition(".")[2] == "String" and value not in self._assigned(body):
                    passes = body.names.index(value)
                elif high - low == 1 and value in texts:
                    literal = texts[value]
                elif sort == "id" and self._is(low + 1, "(") and self.match[low + 1] == high - 1 and (body.of.full, value, len(self.split(low + 1))) in own:
                    result = f"{body.of.full}.{value}/{len(self.split(low + 1))}"
                yield self.path, f"{body.of.full}.{body.method}{body.params}", self.tokens[k][2], callee, position, literal, passes, result
                if callee == LOOKUP:
                    break

    def _assigned(self, body: _Body) -> set[str]:
        """Names that a body gives a value outside of their declaration."""
        return {self.tokens[k - 1][1] for k in range(body.first + 1, body.last) if self._is(k, "=") and self._name(k - 1) and not self._is(k + 1, "=") and not (self._name(k - 2) or self._is(k - 2, ">", "]", "."))}

    def _fixed(self, body: _Body) -> dict[str, str]:
        """Variables and constants of type String that are given one literal when they are declared, and nothing else."""
        out = {}
        for first, last, final in ((body.first, body.last, False), (0, len(self.tokens), True)):
            for k in range(first, last - 4):
                if self._is(k, "String") and self._name(k + 1) and self._is(k + 2, "=") and self.tokens[k + 3][0] == "str" and self._is(k + 4, ";") and (not final or self._is(k - 1, "final") or self._is(k - 2, "final")):
                    out.setdefault(self.tokens[k + 1][1], self.tokens[k + 3][1])
        return {n: t for n, t in out.items() if n not in self._assigned(body)}


#: The callee that stands for every look-up of a class by its name, at position 0.
LOOKUP = "class-lookup"


def _run(files: DataFrame, schema: str, rows_of) -> DataFrame:
    ship(files.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                rows += rows_of(path, text or "")
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "text").mapInPandas(run, schema)


def methods(files: DataFrame, inner: bool = False) -> DataFrame:
    """One row for each method and constructor of ``path, text``, with annotations of its own and of its type; with ``inner`` also those of anonymous and local types and of bodies of enum constants.

    A file that can't be scanned, and each part of one that isn't understood, is a row with ``problem``.
    """
    def rows_of(path: str, text: str) -> list:
        try:
            s = _Scan(path, text)
            return s.methods + (s.inner_methods if inner else []) + [[path, *[None] * 9, p] for p in s.problems]
        except (ValueError, IndexError, RecursionError) as e:
            return [[path, *[None] * 9, str(e) or type(e).__name__]]

    return _run(files, METHODS, rows_of)


def _of_scan(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def rows(path: str, text: str) -> list:
        try:
            return list(rows_of(_Scan(path, text)))
        except (ValueError, IndexError, RecursionError):
            return []

    return _run(files, schema, rows)


def calls(files: DataFrame) -> DataFrame:
    """One row for each call, constructor call and method reference in the bodies of ``path, text``; files that can't be scanned give none (see methods).

    ``receiver`` is 'this' for calls without one, null for expressions; ``receiver_type`` is its declared type as written, null where the file doesn't tell.
    """
    return _of_scan(files, CALLS, lambda s: s.calls())


def arguments(files: DataFrame) -> DataFrame:
    """Arguments of calls within a type and of look-ups of classes (callee LOOKUP), as operators.propagation takes them.

    Callers are written type.method(types), callees type.method/number: the group of overloads with so many parameters. What is neither a literal, a variable with one literal, the
    caller's own parameter of type String, nor a call within the type isn't known.
    """
    return _of_scan(files, ARGUMENTS, lambda s: s.arguments())


def overloads(files: DataFrame) -> DataFrame:
    """``callee, method``: the methods that each callee of ``arguments`` may mean."""
    return _of_scan(files, OVERLOADS, lambda s: [(f"{r[2]}.{r[4]}/{r[5].count(',') + (r[5] != '()')}", f"{r[2]}.{r[4]}{r[5]}") for r in s.methods + s.inner_methods])
