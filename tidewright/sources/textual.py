"""Text output of disassemblers and of binary comparisons: what a line means depends on the last heading before it in the same file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .files import lines


def _under(files: DataFrame, headings: dict[str, Column]) -> DataFrame:
    """``path, line_no, line`` with, for each heading, its last value at or before the line; a file is read in one sort."""
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = lines(files)
    for name, value in headings.items():
        each = each.withColumn(name, F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(so_far))
    return each


def disassembled_calls(files: DataFrame) -> DataFrame:
    """``path, class, method, params, kind, owner, member, descriptor`` of the references in disassembler output (path, text).

    ``method`` is <init> for constructors and <clinit> for static blocks, ``params`` the erased types of its heading, so that overloads differ. A reference without an owner is to
    the class itself; an invokedynamic has none. Reflective look-ups can be told by owner and member.
    """
    owner = F.regexp_extract("line", r"^(?:[\w]+\s+)*(?:class|interface|enum|record)\s+([\w.$]+)", 1)
    # Headings of methods are indented and hold no slash, unlike the comments of instructions.
    head = r"^\s+(?:[^()/;=:\d\s][^()/;=:]*\s)?([\w.$]+)\(([^()]*)\)(?:\s+throws\s+[^;]+)?;\s*$"
    erased = F.regexp_replace(F.regexp_extract("line", head, 2), r"<[^<>]*>", "")
    erased = F.regexp_replace(F.regexp_replace(erased, r"<[^<>]*>|\s", ""), r"\.\.\.", "[]")  # of two levels
    static = F.col("line").rlike(r"^\s+static\s*\{\s*\};\s*$")
    heading = F.when(static, F.lit("<clinit>()")).when(F.regexp_extract("line", head, 1) != "", F.concat(F.regexp_extract("line", head, 1), F.lit("("), erased, F.lit(")"))).otherwise("")
    under = _under(files, {"class": owner, "heading": heading})
    name = F.substring_index("heading", "(", 1)
    ref = r"//\s*(Method|InterfaceMethod|Field|InvokeDynamic|class)\s+(?:#\d+:|\"?([\w/$\[;]+)\"?\.)?\"?([\w<>$/\[;]+)\"?(?::(\S+))?"
    kind = F.regexp_extract("line", ref, 1)
    found = under.where(kind != "")
    of, member = F.translate(F.regexp_extract("line", ref, 2), "/", "."), F.regexp_extract("line", ref, 3)
    is_class, dynamic = kind == "class", kind == "InvokeDynamic"
    sort = F.when(is_class, "type_reference").when(kind == "Field", "field_access").when(dynamic, "invokedynamic").when(member == "<init>", "constructor_invocation").otherwise("method_invocation")
    return found.select(
        "path", "class", F.when(name == F.col("class"), "<init>").otherwise(name).alias("method"), F.concat(F.lit("("), F.substring_index("heading", "(", -1)).alias("params"), sort.alias("kind"),
        F.when(is_class, F.translate(member, "/", ".")).when(dynamic, "").when(of == "", F.col("class")).otherwise(of).alias("owner"), F.when(~is_class, member).alias("member"), F.when(~is_class, F.regexp_extract("line", ref, 4)).alias("descriptor"),
    )


def compared_members(files: DataFrame) -> DataFrame:
    """``path, owner, kind, status, incompatible, declaration`` of a comparison's text output: marks, a status, the kind and the declaration, under their class.

    Lines of types aren't indented; those of their members, super types and interfaces are. A type's name is what follows its modifiers.
    """
    line = r"^(\s*)(?:[+\-*=]{3,4})(!?)\s*(NEW|REMOVED|MODIFIED|UNCHANGED)\s+(CLASS|INTERFACE|ENUM|ANNOTATION|RECORD|METHOD|CONSTRUCTOR|FIELD|SUPERCLASS):?\s*(.*)$"
    get = lambda k: F.regexp_extract("line", line, k)
    name = F.regexp_extract(get(5), r"^(?:[A-Z_]+(?:\([+\-]\))?\s+|\(<-\s*[A-Z_\s]*\)\s*)*([\w$.]+)", 1)
    typed = F.when(get(4).isin("CLASS", "INTERFACE", "ENUM", "ANNOTATION", "RECORD") & (get(1) == ""), name).otherwise("")
    under = _under(files, {"owner": typed}).where(get(3) != "")
    return under.select("path", "owner", F.lower(get(4)).alias("kind"), get(3).alias("status"), (get(2) == "!").alias("incompatible"), F.trim(get(5)).alias("declaration"))
