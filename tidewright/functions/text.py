"""Scalar functions of names, versions and signatures, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Order of version qualifiers; no qualifier is 0, an unknown one -6.
QUALIFIERS = {"snapshot": -5, "alpha": -4, "a": -4, "beta": -3, "b": -3, "milestone": -2, "m": -2, "rc": -1, "cr": -1, "sp": 1, "sr": 1}
# Endings that say nothing about the order of versions.
PLAIN_ENDINGS = ("release", "final", "ga", "jre", "android")
# Published names of reasons that had another name before.
REASON_ALIASES = {"UNRESOLVED_DEPENDENCY_COORDINATES_AFTER_ENRICHMENT": "DEPENDENCY_COORDINATES_UNRESOLVED", "SPRING_PACKAGED_CLASS_AMBIGUOUS": "SPRING_RUNTIME_CLASS_AMBIGUOUS"}

#: Word boundaries by ASCII alone: \b of Java before 19 counts all letters as parts of words, that of other engines doesn't.
_OPENS, _CLOSES = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_EDGE = f"(?:{_OPENS}(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_]){_CLOSES})"
# Where a sure part of a word follows or comes before, one look is enough, which is many times faster.
_WORD = r"\[(?:a-z|A-Z|0-9|_)+\]"
_OPENING, _CLOSING = re.compile(rf"\w(?![*?{{|])|{_WORD}(?![*?{{|])|\({_WORD}\+\)(?![*?{{|])", re.A), re.compile(r"(?<![\\\w])\w+\Z", re.A)


def ascii_edges(pattern: str) -> str:
    """A regular expression whose \\b goes by ASCII letters, digits and _ on every Java version."""
    def edge(m: re.Match) -> str:
        if m[1] != "b":
            return m[0]
        before, after = _CLOSING.search(pattern[: m.start()]), _OPENING.match(pattern, m.end())
        return _EDGE if bool(before) == bool(after) else _OPENS if after else _CLOSES

    return re.sub(r"\\(.)", edge, pattern, flags=re.S)


def normal_version(version: Column) -> Column:
    """A version without leading v, build metadata after '+', one plain ending and loose separators; null as ''."""
    core = F.ltrim(F.substring_index(F.trim(F.coalesce(version, F.lit(""))), "+", 1), F.lit("vV"))
    over = F.lit(0)
    for word in PLAIN_ENDINGS:
        over = F.when(F.endswith(F.lower(core), F.lit(word)), len(word)).otherwise(over)
    return F.btrim(F.left(core, F.length(core) - over), F.lit("._-"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def version_key(version: Column) -> Column:
    """A struct that sorts as versions do: all numbers (without zeros at the end), qualifier rank, qualifier number; null if irregular.

    A version is irregular if nothing but letters comes first, or nothing at all.
    """
    ranks = F.create_map(*[F.lit(x) for pair in QUALIFIERS.items() for x in pair])

    def key(t: Column) -> Column:
        last = F.aggregate(F.transform(t["numbers"], lambda x, k: F.when(x != 0, k + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        rank = F.when(t["word"] == "", 0).otherwise(F.coalesce(F.try_element_at(ranks, t["word"]), F.lit(-6))).cast("bigint")
        found = F.struct(F.slice(t["numbers"], F.lit(1), last).alias("numbers"), rank.alias("qualifier"), F.coalesce(t["number"].try_cast("bigint"), F.lit(0)).alias("number"))
        return F.when(F.size(t["numbers"]) > 0, found)

    def parts(text: Column) -> Column:
        front = r"^(?:[^A-Za-z0-9]*[0-9]+)+[^A-Za-z0-9]*"
        numbers = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"^((?:[^A-Za-z0-9]*[0-9]+)*)", 1), F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))
        return F.struct(numbers.alias("numbers"), F.lower(F.regexp_extract(text, front + "([A-Za-z]+)", 1)).alias("word"), F.regexp_extract(text, front + "[A-Za-z]+[^A-Za-z0-9]*([0-9]+)", 1).alias("number"))

    return let(let(normal_version(version), parts), key)


def version_verdict(old: Column, new: Column) -> Column:
    """``change`` and ``risk`` of two version strings, as a struct; '-' means absent.

    Changes: added, removed, unchanged, irregular, major, minor, patch, qualifier (a rise within equal numbers), downgrade, changed (two texts that
    stand for one version). Risks: pending, verify, confirm, high, medium, low; a downgrade is high if it crosses a major or minor version.
    """
    at = lambda k, n: F.coalesce(F.get(k["numbers"], F.lit(n)), F.lit(0))

    def change(v: Column) -> Column:
        a, b = v["a"], v["b"]
        kind = (
            F.when(v["old"] == "-", "added").when(v["new"] == "-", "removed").when(v["old"] == v["new"], "unchanged").when(a.isNull() | b.isNull(), "irregular").when(b < a, "downgrade")
            .when(at(a, 0) != at(b, 0), "major").when(at(a, 1) != at(b, 1), "minor").when(a["numbers"] != b["numbers"], "patch").when(a < b, "qualifier").otherwise("changed")
        )
        return F.struct(kind.alias("change"), ((at(a, 0) != at(b, 0)) | (at(a, 1) != at(b, 1))).alias("far"))

    def risk(v: Column) -> Column:
        c = v["change"]
        r = F.when(c.isin("added", "removed"), "pending").when(c == "unchanged", "verify").when(c.isin("irregular", "changed"), "confirm").when((c == "major") | ((c == "downgrade") & v["far"]), "high").when(c.isin("minor", "downgrade"), "medium").otherwise("low")
        return F.struct(c.alias("change"), r.alias("risk"))

    return let(let(F.struct(old.alias("old"), new.alias("new"), version_key(old).alias("a"), version_key(new).alias("b")), change), risk)


def version_change(old: Column, new: Column) -> Column:
    """The change alone (see version_verdict)."""
    return version_verdict(old, new)["change"]


def version_risk(old: Column, new: Column) -> Column:
    """The risk alone (see version_verdict)."""
    return version_verdict(old, new)["risk"]


def erase_generics(signature: Column) -> Column:
    """A signature without type arguments, however deep, in one pass over its characters; varargs become arrays, blanks go."""
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c == "<", s["depth"] + 1).when((c == ">") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when((s["depth"] == 0) & (c != "<"), F.concat(s["kept"], c)).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(F.split(F.regexp_replace(signature, r"\s+", ""), ""), state, step)["kept"]
    return F.replace(kept, F.lit("..."), F.lit("[]"))


def lookup_signature(signature: Column) -> Column:
    """The erased signature with simple type names only."""
    return F.regexp_replace(erase_generics(signature), r"(?:[A-Za-z_$][\w$]*\.)+", "")


def signature_types(signature: Column) -> Column:
    """The erased types of a parameter list, with or without brackets, in order; an empty list for no parameters."""
    inner = F.regexp_replace(erase_generics(signature), r"^\(|\)$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def signatures_agree(left: Column, right: Column) -> Column:
    """Whether two parameter lists may be of one method: as many types, and each pair equal, or equal by simple name where one has no package."""
    a, b = signature_types(left), signature_types(right)
    simple = lambda x: F.element_at(F.split(x, r"\."), -1)
    pair = lambda p: (p["a"] == p["b"]) | ((simple(p["a"]) == simple(p["b"])) & (~p["a"].contains(".") | ~p["b"].contains(".")))
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), pair)


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 12 hex digits of the SHA-1 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 12))


def path_id(*nodes: Column) -> Column:
    """PATH- and the first 12 hex digits of the SHA-1 of the nodes as a JSON list with a blank after each comma."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for n in nodes]
    return F.concat(F.lit("PATH-"), F.substring(F.sha1(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")).cast("binary")), 1, 12))


def canonical_reason(value: Column, default: str = "UNKNOWN") -> Column:
    """A reason in capitals with underscores between its words, camel case split; blank ones are ``default``, old names the present ones.

    A fold over the characters that knows how many capitals came last: a capital after a small letter or digit begins a word, and so does the last of several
    capitals once a small letter follows it.
    """
    state = F.struct(F.lit("").alias("said"), F.lit(0).alias("capitals"), F.lit(False).alias("low"))

    def step(s: Column, c: Column) -> Column:
        said, many = s["said"], s["capitals"]
        capital, small, digit = c.between("A", "Z"), c.between("a", "z"), c.between("0", "9")
        grown = (
            F.when(capital & s["low"], F.concat(said, F.lit("_"), c)).when(small & (many > 1), F.concat(F.left(said, F.length(said) - 1), F.lit("_"), F.right(said, F.lit(1)), c))
            .when(capital | small | digit, F.concat(said, c)).when((said == "") | F.endswith(said, F.lit("_")), said).otherwise(F.concat(said, F.lit("_")))
        )
        return F.struct(grown.alias("said"), F.when(capital, many + 1).otherwise(0).alias("capitals"), (small | digit).alias("low"))

    letters = F.filter(F.split(F.coalesce(value, F.lit("")), ""), lambda c: c != "")
    words = F.upper(F.btrim(F.aggregate(letters, state, step)["said"], F.lit("_")))
    known = F.create_map(*[F.lit(x) for pair in REASON_ALIASES.items() for x in pair])
    return let(F.when(words == "", default).otherwise(words), lambda name: F.coalesce(F.try_element_at(known, name), name))


def safe_name(text: Column, longest: int = 120) -> Column:
    """A file name: other characters than letters, digits, dot, minus become one underscore each run; never blank."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9.\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", "unnamed").otherwise(F.substring(cleaned, 1, longest))


def chain_nodes(chain: Column) -> Column:
    """The trimmed nodes of a chain written with arrows (→ or ->), blanks left out."""
    return F.filter(F.transform(F.split(chain, r"\s*(?:→|->)\s*"), F.trim), lambda x: x != "")


def chain_precision(chain: Column) -> Column:
    """How many nodes of a chain carry a signature."""
    return F.size(F.filter(chain_nodes(chain), lambda x: x.contains("(")))


def chain_skeleton(chain: Column) -> Column:
    """The chain's nodes without signatures, joined by arrows."""
    return F.array_join(F.transform(chain_nodes(chain), lambda x: F.regexp_replace(x, r"\(.*$", "")), " → ")


def humanise(text: Column) -> Column:
    """Words of a code name for a reader: underscores and dashes become blanks, small letters, the first one a capital."""
    words = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[_\-\s]+", " ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
