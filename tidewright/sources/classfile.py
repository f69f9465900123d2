"""Class files as tables: references from methods to methods, fields and types, and the shapes of fields.

Written after the class file format of the Java Virtual Machine Specification, chapters 4 and 6.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..workers import ship

CALLS = "archive string, class string, method string, descriptor string, kind string, owner string, member string, target_descriptor string, problem string"
FIELDS = "archive string, class string, field string, type string, flags int, constant string, problem string"
#: Bytes of a constant of each tag after the tag itself; strings (1) have a length of their own.
_CONSTANT = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_BASE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def _lengths() -> list[int]:
    """Bytes of each instruction, by opcode; 0 where that depends on what follows."""
    size = [1] * 256
    for opcodes, n in (
        ((0x10, 0x12, *range(0x15, 0x1A), *range(0x36, 0x3B), 0xA9, 0xBC), 2),
        ((0x11, 0x13, 0x14, 0x84, *range(0x99, 0xA9), *range(0xB2, 0xB9), 0xBB, 0xBD, 0xC0, 0xC1, 0xC6, 0xC7), 3),
        ((0xC5,), 4), ((0xB9, 0xBA, 0xC8, 0xC9), 5), ((0xAA, 0xAB, 0xC4), 0),
    ):
        for op in opcodes:
            size[op] = n
    return size


_LENGTH = _lengths()


def source_types(descriptor: str) -> list[str]:
    """The types of a descriptor in source form, one by one; parentheses are passed over."""
    out, i = [], 0
    while i < len(descriptor):
        if descriptor[i] in "()":
            i += 1
            continue
        dims = 0
        while descriptor[i] == "[":
            dims, i = dims + 1, i + 1
        if descriptor[i] == "L":
            end = descriptor.index(";", i)
            name, i = descriptor[i + 1 : end].replace("/", "."), end + 1
        else:
            name, i = _BASE[descriptor[i]], i + 1
        out.append(name + "[]" * dims)
    return out


class ClassFile:
    """The constants, fields and methods of one class file; ValueError or struct.error if it isn't one."""

    def __init__(self, data: bytes):
        if data[:4] != b"\xca\xfe\xba\xbe":
            raise ValueError("no class file")
        self.data, self.at = data, 8
        self.major = struct.unpack_from(">H", data, 6)[0]
        self.pool: list = [None] * self.u2()
        i = 1
        while i < len(self.pool):
            tag = data[self.at]
            self.at += 1
            if tag == 1:
                n = self.u2()
                self.pool[i] = (1, data[self.at : self.at + n].decode("utf-8", "replace"))
                self.at += n
            else:
                self.pool[i] = (tag, data[self.at : self.at + _CONSTANT[tag]])
                self.at += _CONSTANT[tag]
            i += 2 if tag in (5, 6) else 1
        self.u2()
        self.name = self.type_at(self.u2())
        self.parent = self.type_at(self.u2())
        self.interfaces = [self.type_at(self.u2()) for _ in range(self.u2())]
        self.fields = [self.member() for _ in range(self.u2())]
        self.methods = [self.member() for _ in range(self.u2())]
        self.attributes = self.read_attributes()

    def u2(self) -> int:
        self.at += 2
        return struct.unpack_from(">H", self.data, self.at - 2)[0]

    def text(self, i: int) -> str:
        return self.pool[i][1] if i else ""

    def pair(self, i: int) -> tuple[int, int]:
        return struct.unpack(">HH", self.pool[i][1])

    def type_at(self, i: int) -> str:
        return self.text(struct.unpack(">H", self.pool[i][1])[0]).replace("/", ".") if i else ""

    def reference(self, i: int) -> tuple[str, str, str]:
        owner, rest = self.pair(i)
        name, descriptor = self.pair(rest)
        return self.type_at(owner), self.text(name), self.text(descriptor)

    def read_attributes(self) -> list[tuple[str, int, int]]:
        out = []
        for _ in range(self.u2()):
            name = self.text(self.u2())
            size = struct.unpack_from(">I", self.data, self.at)[0]
            out.append((name, self.at + 4, size))
            self.at += 4 + size
        return out

    def member(self) -> tuple:
        return self.u2(), self.text(self.u2()), self.text(self.u2()), self.read_attributes()

    def constant(self, attributes: list) -> str | None:
        """The value of a constant field as text."""
        for name, at, _ in attributes:
            if name == "ConstantValue":
                tag, raw = self.pool[struct.unpack_from(">H", self.data, at)[0]]
                if tag == 8:
                    return self.text(struct.unpack(">H", raw)[0])
                return str(struct.unpack({3: ">i", 4: ">f", 5: ">q", 6: ">d"}[tag], raw)[0])
        return None

    def handles(self) -> list[list[int]]:
        """For each bootstrap method, the constants that its arguments name."""
        for name, at, _ in self.attributes:
            if name == "BootstrapMethods":
                out, self.at = [], at
                for _ in range(self.u2()):
                    self.u2()
                    out.append([self.u2() for _ in range(self.u2())])
                return out
        return []

    def references(self, attributes: list) -> Iterator[tuple[str, str, str, str]]:
        """kind, owner, member and descriptor of what a method's code refers to, in order."""
        bootstrap = self.handles()
        for name, at, _ in attributes:
            if name != "Code":
                continue
            i, end = at + 8, at + 8 + struct.unpack_from(">I", self.data, at + 4)[0]
            start = i
            while i < end:
                op = self.data[i]
                arg = struct.unpack_from(">H", self.data, i + 1)[0] if i + 2 < end else 0
                if 0xB2 <= op <= 0xB5:
                    yield "field_access", *self.reference(arg)
                elif 0xB6 <= op <= 0xB9:
                    to = self.reference(arg)
                    yield "constructor_invocation" if to[1] == "<init>" else "method_invocation", *to
                elif op == 0xBA:
                    index, rest = self.pair(arg)
                    member, descriptor = self.pair(rest)
                    yield "invokedynamic", "", self.text(member), self.text(descriptor)
                    for k in bootstrap[index] if index < len(bootstrap) else ():
                        if self.pool[k][0] == 15:
                            yield "invokedynamic_method_reference", *self.reference(struct.unpack(">H", self.pool[k][1][1:])[0])
                elif op in (0xBB, 0xBD, 0xC0, 0xC1, 0xC5):
                    yield "type_reference", self.type_at(arg), "", ""
                elif op in (0x12, 0x13):
                    k = self.data[i + 1] if op == 0x12 else arg
                    if self.pool[k][0] == 7:
                        yield "type_reference", self.type_at(k), "", ""
                if op in (0xAA, 0xAB):
                    table = i + 1 + (-(i + 1 - start)) % 4
                    low, high = struct.unpack_from(">ii", self.data, table + 4)
                    i = table + 12 + 4 * (high - low + 1) if op == 0xAA else table + 8 + 8 * low
                elif op == 0xC4:
                    i += 6 if self.data[i + 1] == 0x84 else 4
                else:
                    i += _LENGTH[op]
            self.at = end
            for _ in range(self.u2()):
                self.at += 6
                if caught := self.u2():
                    yield "exception_handler", self.type_at(caught), "", ""


_BROKEN = (ValueError, struct.error, KeyError, IndexError, TypeError)


def _rows(classes: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    ship(classes.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for archive, name, content in zip(b["archive"], b["class"], b["content"]):
                try:
                    rows += [(archive, *r, None) for r in rows_of(ClassFile(content or b""))]
                except _BROKEN as e:
                    rows.append((archive, name, *[None] * (len(names) - 3), f"CLASS_FILE_INVALID: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=names).astype({"flags": "Int32"} if "flags" in names else {})

    return classes.select("archive", "class", "content").mapInPandas(run, schema)


def calls(classes: DataFrame) -> DataFrame:
    """One row for each reference that a method of ``archive, class, content`` makes; repeated ones are kept.

    A file that isn't a class file, null or empty ones included, gives one row that says so in ``problem``.
    """
    def rows_of(c: ClassFile):
        for _, method, descriptor, attributes in c.methods:
            for kind, owner, member, target in c.references(attributes):
                yield c.name, method, descriptor, kind, owner, member, target

    return _rows(classes, CALLS, rows_of)


def field_shapes(classes: DataFrame) -> DataFrame:
    """One row for each field: its type in source form, access flags and constant value."""
    def rows_of(c: ClassFile):
        for flags, name, descriptor, attributes in c.fields:
            yield c.name, name, source_types(descriptor)[0], flags, c.constant(attributes)

    return _rows(classes, FIELDS, rows_of)


def consumer_links(references: DataFrame, fields: DataFrame) -> DataFrame:
    """``owner, field, consumers, links``: how many methods of how many references (see calls) link to each field (owner, field) at run time.

    A constant that the compiler copied leaves no such link, so a field without a row is not thereby unused.
    """
    used = references.where("problem IS NULL AND kind LIKE '%field%'").select("owner", F.col("member").alias("field"), "archive", "class", "method", "descriptor")
    met = used.join(fields.select("owner", "field").distinct(), ["owner", "field"])
    return met.groupBy("owner", "field").agg(F.countDistinct("archive", "class", "method", "descriptor").alias("consumers"), F.count("*").alias("links"))
