"""Outputs of build and comparison tools as tables: dependency lists, binary comparison XML, unified diffs."""

from __future__ import annotations

import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..workers import ship

#: A line of a dependency list: three to five fields and a scope, joined by colons; then perhaps a file and remarks. Lazy, so that
#: a drive letter goes to the file.
_FIELD = r"[^\s:()\[\]]"
_COORDINATE = rf"^\s*(?:\[[^\]]*\]\s*)?({_FIELD}+(?::{_FIELD}*){{2,4}}?:{_FIELD}+)(?::((?:[A-Za-z]:)?[\\/].*?))?(?:\s+(?:--\s|\().*)?\s*$"


def maven_dependencies(lines: DataFrame, column: str = "line") -> DataFrame:
    """``group_id, artifact_id, type, classifier, version, scope, path, key`` of the lines of a dependency list.

    A field is any run without blanks, colons and brackets, and scopes may be any word. From the ends inwards a coordinate has
    group and artifact, version and scope; what is left between is the type (jar if blank) and the classifier. Lines of another
    form, null ones and those of type pom give no row.
    """
    found = lines.select(F.split(F.regexp_extract(column, _COORDINATE, 1), ":").alias("f"), F.regexp_extract(column, _COORDINATE, 2).alias("path")).where(F.size("f") >= 4)
    between = F.slice("f", F.lit(3), F.size("f") - 4)
    named = found.select(
        F.get("f", F.lit(0)).alias("group_id"), F.get("f", F.lit(1)).alias("artifact_id"), F.coalesce(F.nullif(F.get(between, F.lit(0)), F.lit("")), F.lit("jar")).alias("type"),
        F.array_join(F.filter(F.slice(between, F.lit(2), F.greatest(F.size(between), F.lit(1))), lambda x: x != ""), ":").alias("classifier"),
        F.get("f", F.size("f") - 2).alias("version"), F.lower(F.get("f", F.size("f") - 1)).alias("scope"), "path",
    )
    kept = named.where("artifact_id != '' AND version != '' AND lower(type) != 'pom'")
    return kept.withColumn("key", F.concat_ws(":", "group_id", "artifact_id", F.nullif("classifier", F.lit(""))))


def gradle_dependencies(lines: DataFrame, column: str = "line") -> DataFrame:
    """``group_id, artifact_id, requested, version, depth, project`` of a dependency tree; ``a -> b`` means b was chosen."""
    m = r"^([|\s]*)[+\\]---\s+"
    body = F.trim(F.regexp_replace(F.regexp_replace(column, m, ""), r"\s+\((?:\*|c|n)\)\s*$", ""))
    depth = (F.length(F.regexp_extract(column, m, 1)) / 5).cast("int")
    rows = lines.where(F.col(column).rlike(m)).select(depth.alias("depth"), body.alias("body"))
    get = lambda k: F.regexp_extract("body", r"^([\w.\-]+):([\w.\-]+)(?::([^\s:{]+|\{[^}]*\}))?(?:\s+->\s+(?:[\w.\-]+:[\w.\-]+:)?(\S+))?", k)
    requested, chosen = get(3), get(4)
    project = F.regexp_extract("body", r"^project\s+(:\S+)", 1)
    return rows.select(get(1).alias("group_id"), get(2).alias("artifact_id"), requested.alias("requested"), F.when(chosen != "", chosen).otherwise(requested).alias("version"), "depth", project.alias("project")).where("group_id != '' OR project != ''")


FACTS = "report string, owner string, kind string, name string, parameters string, status string, binary string, source string, old_value string, new_value string, flags array<string>, relation boolean, problem string"
_FACT_NAMES = [x.split()[0] for x in FACTS.split(", ")]
# Element names of a comparison report, and packages of the platform itself.
_TYPES, _MEMBERS = ("class", "interface", "enum", "annotation", "record"), ("method", "constructor", "field")
_LISTS, _PARENTS = ("classes", "classlist"), ("interfaces", "superclass", "superclasses", "annotations")
PLATFORM = ("java.", "jdk.", "sun.", "com.sun.")


class _Report:
    """Collects the facts of one report from parser events; ``open`` holds the elements around the present one, each with its fact if it has one."""

    def __init__(self, report: str):
        self.report, self.facts, self.open, self.lists = report, [], [], 0

    def start(self, tag: str, attributes: dict) -> None:
        name = tag.rpartition("}")[2].lower().replace("-", "").replace("_", "")
        have = {k.rpartition("}")[2].lower().replace("_", ""): v for k, v in attributes.items()}
        around = self.open[-1][0] if self.open else ""
        inner = next((f for _, f in reversed(self.open) if f), None)
        fact = None
        if name in _LISTS:
            self.lists += 1
        elif name in _TYPES and around not in _PARENTS and self.lists:
            fact = self._fact(have.get("fullyqualifiedname") or have.get("name"), name, have)
            if not fact["owner"]:
                raise ValueError("a type without a name")
        elif name in _MEMBERS and inner:
            fact = self._fact(inner["owner"], name, have) | {"name": have.get("name", ""), "parameters": "" if name == "field" else None}
        elif inner is not None:
            self._detail(inner, name, around, have)
        self.open.append((name, fact))
        if fact:
            self.facts.append(fact)

    def _fact(self, owner: str | None, kind: str, have: dict) -> dict:
        return dict.fromkeys(_FACT_NAMES) | {
            "report": self.report, "owner": owner, "kind": kind, "name": "", "parameters": "", "status": have.get("changestatus", "").upper(), "binary": have.get("binarycompatible", "unknown").lower(),
            "source": have.get("sourcecompatible", "unknown").lower(), "old_value": have.get("oldvalue", ""), "new_value": have.get("newvalue", ""), "flags": [], "relation": False,
        }

    def _detail(self, fact: dict, name: str, around: str, have: dict) -> None:
        if name == "parameter" and fact["parameters"] is None:
            fact["parameters"] = have.get("type", "")
        elif name == "parameter" and fact["kind"] in ("method", "constructor"):
            fact["parameters"] += "," + have.get("type", "")
        elif name == "compatibilitychange" and (flag := have.get("type") or have.get("name")) and flag not in fact["flags"]:
            fact["flags"].append(flag)
        elif name in ("oldvalue", "newvalue") and have.get("value"):
            fact[name[:3] + "_value"] = have["value"]
        elif (around in ("interfaces", "superclasses") or name == "superclass") and have.get("changestatus", "").upper() not in ("", "NEW", "UNCHANGED"):
            fact["relation"] = True

    def end(self, text: str) -> None:
        name, fact = self.open.pop()
        text = text.strip()
        inner = next((f for _, f in reversed(self.open) if f), None)
        if fact and fact["parameters"] is None:
            fact["parameters"] = ""
        elif inner is not None and text and name in ("oldvalue", "newvalue"):
            inner[name[:3] + "_value"] = text
        elif inner is not None and text and name == "compatibilitychange" and text not in inner["flags"]:
            inner["flags"].append(text)


def _facts(report: str, text: str) -> list[tuple]:
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("a document type isn't allowed")
    parser, found = ET.XMLPullParser(["start", "end"]), _Report(report)
    parser.feed(text)
    parser.close()
    for event, e in parser.read_events():
        if event == "start":
            found.start(e.tag, e.attrib)
        else:
            found.end(e.text or "")
    if not found.lists:
        raise ValueError("no list of classes")
    return [tuple(f[n] for n in _FACT_NAMES) for f in found.facts]


def comparison_facts(reports: DataFrame) -> DataFrame:
    """What a binary comparison's XML says of each type and member (``report, text``).

    Types are classes, interfaces, enums, annotations and records in the report's list; the parents listed inside a type only tell whether
    its relations changed. A flag belongs to the innermost element around it. Null, malformed and other documents are one row with ``problem``.
    """
    ship(reports.sparkSession)

    def run(batches):
        for b in batches:
            for report, text in zip(b["report"], b["text"]):
                try:
                    rows = _facts(report, text or "")
                except (ET.ParseError, ValueError) as e:
                    rows = [(report, *[None] * (len(_FACT_NAMES) - 2), str(e))]
                yield pd.DataFrame(rows, columns=_FACT_NAMES).astype({"relation": "boolean"})

    return reports.select("report", "text").mapInPandas(run, FACTS)


def outcomes(spark: SparkSession) -> DataFrame:
    """The truth table ``value, removed, binary, source, modified -> change_type, reason``; combinations that aren't in it are no change.

    ``value`` says that a field's constant has another value, ``binary`` and ``source`` are true, false or unknown.
    """
    rows = []
    for value, removed, modified in itertools.product((True, False), repeat=3):
        for binary, source in itertools.product(("true", "false", "unknown"), repeat=2):
            if value:
                rows.append((value, removed, modified, binary, source, "CONSTANT_VALUE_CHANGED", "constant_value_changed"))
            elif removed:
                rows.append((value, removed, modified, binary, source, "REMOVED", "removed"))
            elif (binary, source) == ("true", "false"):
                rows.append((value, removed, modified, binary, source, "SOURCE_INCOMPATIBLE", "binary_compatible_source_incompatible"))
            elif "false" in (binary, source) or (modified and (binary, source) == ("unknown", "unknown")):
                rows.append((value, removed, modified, binary, source, "SIGNATURE_CHANGED", "binary_or_source_incompatible"))
    return spark.createDataFrame(rows, "value boolean, removed boolean, modified boolean, binary string, source string, change_type string, reason string")


def changed_apis(facts: DataFrame, platform: tuple[str, ...] = PLATFORM) -> DataFrame:
    """The changes among the facts, with change type and reason; new, unchanged and compatible ones go, and so do owners of the platform.

    A type is reported as modified when any of its members is; only a flag or a changed parent of its own makes it a change. A field that is
    removed with its constant gets the flag CONSTANT_REMOVED.
    """
    is_type, constant = F.col("kind").isin(*_TYPES), (F.col("kind") == "field") & (F.col("old_value") != "")
    own = (F.size("flags") > 0) | F.col("relation")
    known = lambda c: F.when(F.col(c).isin("true", "false"), F.col(c)).otherwise("unknown")
    keyed = facts.where("problem IS NULL AND status NOT IN ('NEW', 'UNCHANGED')").where(~is_type | (F.col("status") != "MODIFIED") | own).where(~reduce(lambda a, b: a | b, [F.col("owner").startswith(x) for x in platform]))
    keyed = keyed.withColumn("value", constant & (F.col("new_value") != "") & (F.col("old_value") != F.col("new_value"))).withColumn("removed", F.col("status") == "REMOVED").withColumn("modified", F.col("status") == "MODIFIED")
    keyed = keyed.withColumn("flags", F.when(constant & F.col("removed"), F.array_union("flags", F.array(F.lit("CONSTANT_REMOVED")))).otherwise(F.col("flags")))
    keyed = keyed.withColumn("binary", known("binary")).withColumn("source", known("source"))
    on = ["value", "removed", "modified", "binary", "source"]
    # The table has at most 72 rows.
    return keyed.join(F.broadcast(outcomes(facts.sparkSession)), on).select(*[c for c in facts.columns if c not in ("problem", "relation")], "change_type", "reason")


CHANGED = "diff string, path string, sign string, line_no int, line string"


def _hunks(diff: str, text: str) -> Iterator[tuple]:
    path, old, new, left, right = "", 0, 0, 0, 0
    for line in (text or "").splitlines():
        if left > 0 or right > 0:
            sign = line[:1] or " "
            if sign in "+-":
                yield diff, path, sign, new if sign == "+" else old, line[1:]
            if sign in "- ":
                old, left = old + 1, left - 1
            if sign in "+ ":
                new, right = new + 1, right - 1
        elif line.startswith("--- "):
            path = re.sub("^[ab]/", "", line[4:].split("\t")[0])
        elif line.startswith("+++ ") and line[4:] != "/dev/null":
            path = re.sub("^[ab]/", "", line[4:].split("\t")[0])
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            old, new = int(m[1]), int(m[3])
            left, right = int(m[2] or 1), int(m[4] or 1)


def changed_lines(diffs: DataFrame) -> DataFrame:
    """Each added and removed line of unified diffs (``diff, text``) with file and line number; hunk sizes, not prefixes, tell headers from lines."""
    ship(diffs.sparkSession)

    def run(batches):
        for b in batches:
            for diff, text in zip(b["diff"], b["text"]):
                yield pd.DataFrame(_hunks(diff, text), columns=[x.split()[0] for x in CHANGED.split(", ")])

    return diffs.select("diff", "text").mapInPandas(run, CHANGED)


def changed_declarations(changed: DataFrame) -> DataFrame:
    """Public or protected Java methods that a diff removes, or declares otherwise: ``diff, path, name, old, change_type``.

    A method that was only moved or reformatted (same erased declaration on both signs) gives no row.
    """
    java = r"^\s*(?:@\w+\s+)*(?:public|protected)\s+[^=;]*?(\w+)\s*\(([^)]*)\)"
    norm = F.trim(F.regexp_replace(F.regexp_extract("line", java, 0), r"\s+", " "))
    d = changed.where(F.col("path").endswith(".java") & F.col("line").rlike(java)).select("diff", "path", "sign", F.regexp_extract("line", java, 1).alias("name"), norm.alias("declaration")).distinct()
    keys = ["diff", "path", "name"]
    gone, came = d.where("sign = '-'").drop("sign"), d.where("sign = '+'").drop("sign")
    gone = gone.join(came, [*keys, "declaration"], "left_anti")
    again = came.select(*keys).distinct().withColumn("again", F.lit(True))
    return gone.join(again, keys, "left").select(*keys, F.col("declaration").alias("old"), F.when(F.col("again"), "SIGNATURE_CHANGED").otherwise("REMOVED").alias("change_type"))


_MODIFIERS = r"(?:(?:static|final|abstract|synchronized|default|native|transient|volatile|strictfp)\s+)*"
_KOTLIN = r"(?:(?:open|abstract|override|final|suspend|inline|operator|infix|tailrec|external|const|lateinit)\s+)*"
#: What a line of a diff may declare: language, kind and pattern, whose last group is the name. Kotlin's members are public unless they say otherwise.
_DECLARED = (
    (".java", "method", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:public|protected)\s+" + _MODIFIERS + r"(?:<[^>]+>\s+)?(?:[\w.$<>\[\],?& ]+\s)?(\w+)\s*\([^)]*\)"),
    (".java", "field", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:public|protected)\s+" + _MODIFIERS + r"[\w.$<>\[\],?]+(?:\s*<[^=;()]*>)?(?:\[\])*\s+(\w+)\s*(?:=[^;]*)?;"),
    (".kt", "method", r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected)\s+)?" + _KOTLIN + r"fun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(\w+)\s*\([^)]*\)(?:\s*:\s*[\w.<>?, ]+)?"),
    (".kt", "field", r"^(?: {0,4}|\t?)(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected)\s+)?" + _KOTLIN + r"(?:val|var)\s+(\w+)\s*(?::\s*[\w.<>?, ]+)?(?:\s*=.*)?$"),
)


def changed_members(changed: DataFrame) -> DataFrame:
    """Public and protected methods and fields of Java and Kotlin that a diff adds, removes or declares otherwise: ``diff, path, kind, name, old, new, change_type``.

    ``changed`` as of changed_lines. A declaration is compared without its body, in single blanks: one that was only moved or formatted otherwise gives no row. Of overloads, those
    that differ are paired in the order of their texts; a pair is METHOD_SIGNATURE_CHANGED or FIELD_CHANGED (its value counts too), what is left over is ADDED or REMOVED. Kotlin's properties are members if they
    are indented by four blanks or a tab at most; declarations that go over several lines aren't seen.
    """
    parts = []
    for ending, kind, pattern in _DECLARED:
        mine = changed.where(F.col("path").endswith(ending) & F.col("line").rlike(pattern))
        if ending == ".kt":
            mine = mine.where(~F.col("line").rlike(r"\b(private|internal)\b"))
        text = F.regexp_extract("line", pattern, 0) if kind == "method" else F.col("line")
        parts.append(mine.select("diff", "path", F.lit(kind).alias("kind"), F.regexp_extract("line", pattern, 1).alias("name"), "sign", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("declaration")))
    d = reduce(DataFrame.unionByName, parts).distinct()
    keys = ["diff", "path", "kind", "name"]
    signs = d.groupBy(*keys, "declaration").agg(F.count("*").alias("n"), F.min("sign").alias("sign")).where("n = 1")  # on one sign alone
    place = F.row_number().over(Window.partitionBy(*keys, "sign").orderBy("declaration"))
    each = signs.withColumn("k", place)
    both = each.groupBy(*keys, "k").agg(F.max(F.when(F.col("sign") == "-", F.col("declaration"))).alias("old"), F.max(F.when(F.col("sign") == "+", F.col("declaration"))).alias("new"))
    change = F.when(F.col("new").isNull(), "REMOVED").when(F.col("old").isNull(), "ADDED").when(F.col("kind") == "field", "FIELD_CHANGED").otherwise("METHOD_SIGNATURE_CHANGED")
    return both.select(*keys, "old", "new", change.alias("change_type"))
