"""Framework entries: which methods pointcuts and routes select, and whether the runtime proves that the framework is active.

Patterns are broken up into atoms, and every alternative of a pattern is looked up by its most telling literal part (a type, an annotation, a method's name, a
package) in an inverted index of the methods' parts, an equi-join; only what is found there is matched in full. What isn't understood or proved is
a row with its reason, never left out.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..workers import ship
from .resolve import activated

UNSUPPORTED, UNMATCHED, UNPROVEN = "POINTCUT_UNSUPPORTED", "FRAMEWORK_ENTRY_UNMATCHED", "FRAMEWORK_ACTIVATION_UNPROVEN"
_ATOM = "struct<kind: string, negated: boolean, type_re: string, subtypes: boolean, method_re: string, params_re: string, annotation: string>"
_CLAUSES = f"advice string, clause int, anchor string, part string, atoms array<{_ATOM}>, reason string"
_WORDS = re.compile(r"\s*(&&|\|\||!|\band\b|\bor\b|\bnot\b|[()]|@?[\w.]+(?=\s*\())")


def type_pattern(text: str) -> tuple[str, bool]:
    """A regular expression for a type pattern, and whether it stands for subtypes too: * is a part of a name, .. any packages."""
    text = text.strip()
    plus = text.endswith("+")
    parts = re.split(r"(\.\.|\*|\.)", text.rstrip("+"))
    made = "".join(r"(?:\.[\w.$]*)?\." if p == ".." else r"[\w$]*" if p == "*" else r"[.$]" if p == "." else re.escape(p) for p in parts)
    return (r"[\w.$]*" if text.rstrip("+") == "*" else made.replace(r"(?:\.[\w.$]*)?\.", r"[.](?:[\w.$]*[.$])?")), plus


def _execution(text: str) -> dict:
    """The atom of ``[modifiers] result [type.]name(parameters)``."""
    m = re.fullmatch(r"\s*(.*?)([\w.*$+]+)\s*\(([^()]*)\)(?:\s*throws\s.*)?\s*", text)
    if not m:
        raise ValueError(text)
    owner, _, name = m[2].rpartition(".")
    owner = owner.removesuffix(".") + (".." if m[2][: len(m[2]) - len(name)].endswith("..") else "")
    kind, plus = type_pattern(owner + "*" if owner.endswith("..") else owner) if owner else (r"[\w.$]*", False)
    params = []
    for p in (x.strip() for x in m[3].split(",") if x.strip()):
        params.append(None if p == ".." else r"[^,()]+" if p == "*" else r"(?:[\w.$]*[.$])?" + type_pattern(p.rpartition(".")[2])[0])
    # .. stands for any number of parameters, also none.
    made = "".join(r"(?:,[^,()]+)*" if p is None else "," + p for p in params)
    return {"kind": "execution", "type_re": kind, "subtypes": plus, "method_re": "[\\w$<>]*".join(map(re.escape, name.split("*"))), "params_re": made}


class _Pointcut:
    """A pointcut's alternatives (lists of atoms), with names of other pointcuts put in; a bad or endless one raises ValueError."""

    def __init__(self, definitions: dict[str, str]):
        self.definitions = definitions

    def clauses(self, text: str, within: tuple[str, ...] = ()) -> list[list[dict]]:
        self.text, at = text, 0
        out, at = self._any(text, at, within)
        if text[at:].strip():
            raise ValueError(text[at:])
        return out

    def _any(self, text: str, at: int, within: tuple[str, ...]) -> tuple[list, int]:
        out, at = self._all(text, at, within)
        while (m := _WORDS.match(text, at)) and m[1] in ("||", "or"):
            more, at = self._all(text, m.end(), within)
            out = out + more
        return out, at

    def _all(self, text: str, at: int, within: tuple[str, ...]) -> tuple[list, int]:
        out, at = self._one(text, at, within)
        while (m := _WORDS.match(text, at)) and m[1] in ("&&", "and"):
            more, at = self._one(text, m.end(), within)
            out = [a + b for a, b in product(out, more)]
        return out, at

    def _one(self, text: str, at: int, within: tuple[str, ...]) -> tuple[list, int]:
        m = _WORDS.match(text, at)
        if not m:
            raise ValueError(text[at:])
        if m[1] in ("!", "not"):
            inner, at = self._one(text, m.end(), within)
            # None of the alternatives: of each one atom at least doesn't hold.
            return [[a | {"negated": not a.get("negated", False)} for a in some] for some in product(*inner)], at
        if m[1] == "(":
            out, at = self._any(text, m.end(), within)
            m = _WORDS.match(text, at)
            if not m or m[1] != ")":
                raise ValueError(text[at:])
            return out, m.end()
        start = text.index("(", m.end()) + 1
        depth, end = 1, start
        while depth:
            if end >= len(text):
                raise ValueError(text)
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        return self._atom(m[1], text[start : end - 1], within), end

    def _atom(self, word: str, inside: str, within: tuple[str, ...]) -> list[list[dict]]:
        if word == "execution":
            return [[_execution(inside)]]
        if word == "within":
            kind, plus = type_pattern(inside + "*" if inside.strip().endswith("..") else inside)
            return [[{"kind": "within", "type_re": kind, "subtypes": plus}]]
        if word in ("@annotation", "@within", "@target"):
            return [[{"kind": "annotation" if word == "@annotation" else "type_annotation", "annotation": inside.strip().rpartition(".")[2]}]]
        name = word.rpartition(".")[2]
        if name in self.definitions and name not in within:
            return _Pointcut(self.definitions).clauses(self.definitions[name], (*within, name))
        raise ValueError(word)


def _anchor(atoms: list[dict]) -> tuple[str, str]:
    """The literal part by which an alternative is looked up: the first there is of a type, an annotation, a method's name and a package."""
    sure = [a for a in atoms if not a.get("negated")]
    for a in sure:
        if a["kind"] in ("annotation", "type_annotation"):
            return a["kind"], a["annotation"]
    for a in sure:
        simple = re.fullmatch(r"(?:[\w$.()\\?:*\[\]]*\[\.\$\])?(\w+)", a.get("type_re") or "")
        if simple and not a["subtypes"] and "*" not in simple[1]:
            return "type", simple[1]
    for a in sure:
        if a["kind"] == "execution" and re.fullmatch(r"\w+", a["method_re"]):
            return "method", a["method_re"]
    for a in sure:
        package = re.match(r"((?:\w+\[\.\$\])*\w+)(?=\[\.)", a.get("type_re") or "")
        if package and not a["subtypes"]:
            return "package", package[1].replace("[.$]", ".")
    return "any", ""


def pointcuts(advices: DataFrame, definitions: DataFrame) -> DataFrame:
    """``advice, clause, anchor, part, atoms, reason`` of each alternative of each advice's pointcut.

    ``advices``: advice, aspect, expression; ``definitions``: aspect, name, expression (named pointcuts that expressions of the same aspect may hold). execution, within, @annotation, @within and
    @target are understood, with and, or, not and brackets; an expression with anything else, or that holds itself, has one row with ``reason``. Expressions of one aspect meet in one task.
    """
    ship(advices.sparkSession)
    both = advices.select("aspect", "advice", F.lit(None).cast("string").alias("name"), "expression").unionByName(definitions.select("aspect", F.lit(None).cast("string").alias("advice"), "name", "expression"))
    names = ["advice", "clause", "anchor", "part", "atoms", "reason"]
    empty = {"negated": False, "type_re": None, "subtypes": False, "method_re": None, "params_re": None, "annotation": None}

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        named = {n: e for a, n, e in zip(pdf["advice"], pdf["name"], pdf["expression"]) if a is None}
        rows, seen = [], {}
        for a, e in zip(pdf["advice"], pdf["expression"]):
            if a is not None:
                e = e or ""
                if e not in seen:
                    try:
                        seen[e] = [(k, *_anchor(atoms), [empty | x for x in atoms], None) for k, atoms in enumerate(_Pointcut(named).clauses(e))]
                    except ValueError:
                        seen[e] = [(None, None, None, None, UNSUPPORTED)]
                rows.extend((a, *x) for x in seen[e])
        return pd.DataFrame(rows, columns=names, dtype=object).astype({"clause": "Int32"})

    return both.groupBy("aspect").applyInPandas(read, _CLAUSES)


def method_parts(methods: DataFrame) -> DataFrame:
    """``method_id, anchor, part``: the inverted index of methods, by simple type, annotations, name and each package above."""
    simple = F.element_at(F.split("type", r"[.$]"), -1)
    package = F.split(F.regexp_extract("type", r"^(.*)\.[^.]*$", 1), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(package)), lambda n: F.array_join(F.slice(package, F.lit(1), n), "."))
    part = lambda anchor, values: F.transform(values, lambda v: F.struct(F.lit(anchor).alias("anchor"), v.alias("part")))
    none = F.array().cast("array<string>")
    parts = F.concat(part("type", F.array(simple)), part("method", F.array("method")), part("annotation", F.coalesce("annotations", none)), part("type_annotation", F.coalesce("type_annotations", none)), part("package", above), part("any", F.array(F.lit(""))))
    return methods.select("method_id", F.explode(F.array_distinct(parts)).alias("p")).select("method_id", "p.anchor", "p.part")


def _holds(a: Column) -> Column:
    """Whether an atom holds for a method (type, supertypes, method, params, annotations, type_annotations)."""
    whole = lambda text, pattern: F.regexp_like(text, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))
    none = F.array().cast("array<string>")
    of = whole(F.col("type"), a["type_re"]) | (a["subtypes"] & F.exists(F.coalesce("supertypes", none), lambda t: whole(t, a["type_re"])))
    given = F.concat(F.lit(","), F.regexp_replace("params", r"[()]", ""))
    run = of & whole(F.col("method"), a["method_re"]) & (whole(given, a["params_re"]) | ((given == ",") & whole(F.lit(""), a["params_re"])))
    met = F.when(a["kind"] == "execution", run).when(a["kind"] == "within", of).when(a["kind"] == "annotation", F.array_contains(F.coalesce("annotations", none), a["annotation"])).otherwise(F.array_contains(F.coalesce("type_annotations", none), a["annotation"]))
    return F.coalesce(met, F.lit(False)) != a["negated"]


def advised_classes(clauses: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pointcuts select, by classes: ``advice, pointcut`` of advices, ``pointcut, shape`` that meet, each pair once, and ``method_id, shape`` of methods.

    Advices of equal alternatives are one pointcut, methods that are alike in all that a pointcut can ask for one shape; each is named by its smallest member. Only one of each is matched, so copies
    on either side aren't multiplied: counts and sums of pairs come from those of classes. Input as of advised.
    """
    good = clauses.where("reason IS NULL").groupBy("advice").agg(F.array_sort(F.collect_set(F.struct("anchor", "part", "atoms"))).alias("_alternatives"))
    kinds = good.groupBy("_alternatives").agg(F.min("advice").alias("pointcut"))
    look = F.struct("type", "supertypes", "method", "params", "annotations", "type_annotations").alias("_look")
    each = methods.where("method_id IS NOT NULL").select("method_id", look).distinct()
    shapes = each.groupBy("_look").agg(F.min("method_id").alias("shape"))
    # A method may have several rows: its shapes are told apart by what they look like.
    one = shapes.select(F.struct("shape", "_look").alias("method_id"), "shape", "_look.*")
    asked = kinds.select("pointcut", F.explode("_alternatives").alias("_a")).select("pointcut", "_a.*")
    met = asked.join(method_parts(one), ["anchor", "part"]).join(one, "method_id")
    met = met.where(F.forall("atoms", _holds)).select("pointcut", F.col("method_id").alias("shape")).distinct()
    members = each.join(shapes, "_look").select("method_id", F.struct("shape", "_look").alias("shape"))
    return good.join(kinds, "_alternatives").select("advice", "pointcut"), met, members


def advised(clauses: DataFrame, methods: DataFrame) -> DataFrame:
    """``advice, method_id`` of every method that a pointcut selects, each pair once; ``clauses`` as of pointcuts.

    ``methods``: method_id, type, supertypes, method, params (erased, in brackets), annotations, type_annotations (simple names). Results of methods aren't told apart.
    """
    advices, met, members = advised_classes(clauses, methods)
    return advices.join(met, "pointcut").join(members, "shape").select("advice", "method_id").distinct()


def route_pattern(pattern: Column) -> Column:
    """A regular expression for an ant-style path pattern: ** is any path, * a part of a segment; a variable of a route may be anything."""
    p = F.regexp_replace(F.regexp_replace(pattern, r"\{[^/{}]*\}", "*"), r"([.+^$|()\[\]\\])", r"\\$1")
    p = F.regexp_replace(p, r"/\*\*", "\u0001")
    p = F.regexp_replace(p, r"\*", r"[^/]*")
    p = F.regexp_replace(p, r"(?<=/)([^/\u0001\[\]*]+)(?=/|\u0001|$)", r"(?:$1|\\{\\})")
    return F.concat(F.lit("^"), F.replace(p, F.lit("\u0001"), F.lit("(?:/.*)?")), F.lit("$"))


def filtered(filters: DataFrame, routes: DataFrame) -> DataFrame:
    """``filter_id, method_id`` of the routes that each filter's path pattern may meet. ``filters``: filter_id, pattern; ``routes``: method_id, route.

    A pattern is looked up by the literal segments that it begins with, among those that routes begin with; a segment that is a variable of the route is one of the pattern's in any case.
    """
    clean = lambda c: F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(c, r"^/+|/+$", "")), r"\{[^/{}]*\}", "{}")
    r = routes.select("method_id", clean(F.col("route")).alias("_route"))
    lead = lambda c: F.regexp_extract(c, r"^((?:/[^/*?{}]+(?=/|$))*)", 1)
    depth = F.size(F.split(lead(F.col("_route")), "/"))
    heads = r.select("method_id", "_route", F.explode(F.sequence(F.lit(1), depth)).alias("_n")).select("method_id", "_route", F.array_join(F.slice(F.split("_route", "/"), F.lit(1), F.col("_n")), "/").alias("_head"))
    f = filters.select("filter_id", clean(F.col("pattern")).alias("_pattern")).withColumn("_lead", lead(F.col("_pattern")))
    # A route whose literal beginning is shorter, because a variable follows, is met at its own length too.
    shorter = r.where(F.col("_route").contains("{}")).select("method_id", "_route", lead(F.col("_route")).alias("_own"))
    same = f.join(heads, F.col("_lead") == F.col("_head")).select("filter_id", "method_id", "_pattern", "_route")
    above = f.select("filter_id", "_pattern", "_lead", F.explode(F.sequence(F.lit(1), F.size(F.split("_lead", "/")))).alias("_n")).select("filter_id", "_pattern", F.array_join(F.slice(F.split("_lead", "/"), F.lit(1), F.col("_n")), "/").alias("_above"))
    loose = above.join(shorter, F.col("_above") == F.col("_own")).select("filter_id", "method_id", "_pattern", "_route")
    return same.unionByName(loose).where(F.regexp_like("_route", route_pattern(F.col("_pattern")))).select("filter_id", "method_id").distinct()


def framework_candidates(entries: DataFrame, methods: DataFrame, records: DataFrame, proofs: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """``record_id, method_id, kind, activated, reason``: every framework entry with the methods that it selects and the proof of its activation, in one table.

    ``entries``: record_id, method_id, kind (as of advised, filtered or registrations); ``methods``: method_id, owner_type and test: only code of the business that isn't a test can be an entry.
    ``records``: record_id, path, sha256, entry; ``proofs``: path, sha256, entry of the runtime catalog, as in resolve.activated. A record without a method has one row with a null method
    and FRAMEWORK_ENTRY_UNMATCHED, or its own reason from ``problems`` (record_id, reason); one that isn't proved says what differs.
    """
    real = methods.where("owner_type = 'business' AND NOT test").select("method_id")
    found = entries.select("record_id", "method_id", "kind").distinct().join(real, "method_id", "left_semi")
    state = activated(records, proofs).select("record_id", "activated", "proof")
    out = state.join(found, "record_id", "left")
    if problems is not None:
        out = out.join(problems.groupBy("record_id").agg(F.min("reason").alias("_why")), "record_id", "left")
    else:
        out = out.withColumn("_why", F.lit(None).cast("string"))
    reason = F.when(F.col("method_id").isNull(), F.coalesce("_why", F.lit(UNMATCHED))).when(~F.col("activated"), F.concat(F.lit(UNPROVEN + ":"), "proof"))
    return out.select("record_id", "method_id", "kind", F.col("activated") & F.col("method_id").isNotNull(), reason.alias("reason")).toDF("record_id", "method_id", "kind", "activated", "reason")


def activation_edges(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """``caller, callee, kind``: edges from proved candidates, from the selected method to what the framework runs for it. ``entries``: record_id, callee."""
    return candidates.where("activated").join(entries.select("record_id", "callee"), "record_id").select(F.col("method_id").alias("caller"), "callee", "kind").distinct()


def unproven(candidates: DataFrame) -> DataFrame:
    """``reason, records, methods``: what isn't proved, by reason."""
    return candidates.where("reason IS NOT NULL").groupBy("reason").agg(F.countDistinct("record_id").alias("records"), F.countDistinct("method_id").alias("methods"))

