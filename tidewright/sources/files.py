"""Text sources and sinks: CSV with a checked header, tolerant JSON, source trees, configuration, bounded parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Folders of a source tree that hold built or foreign files.
BUILD_FOLDERS = (".git", "target", "build", ".gradle", "out", "bin", "__pycache__", "node_modules", ".upgrade-report", ".trae")


def read_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] | None = None) -> DataFrame:
    """A CSV table of strings whose first line names its columns; a byte order mark before it is passed over.

    ``columns`` is what the caller wants, in this order; a column the file lacks is null, unless it is ``required``:
    then ValueError. Only the first line is read here; rows stay a lazy scan.
    """
    head = spark.read.option("header", True).csv(path).columns
    clean = [c.lstrip("\ufeff").strip() for c in head]
    if lacking := sorted(set(required or ()) - set(clean)):
        raise ValueError(f"{path}: required columns are missing: {', '.join(lacking)}")
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(len(head))])
    # Fields may hold line breaks, quotes are doubled in them.
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    place = {c: i for i, c in reversed(list(enumerate(clean)))}
    return rows.select(*[(F.col(f"_{place[c]}") if c in place else F.lit(None).cast("string")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and doubled quotes, as read_csv reads it; mode "append" adds parts."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def parse_json(df: DataFrame, column: str, schema: str, artifact: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``parsed`` (null where the text isn't JSON of this schema), and a diagnostics row for each text that isn't.

    Null and blank texts are diagnosed as missing. Diagnostics: artifact, reason, sample.
    """
    parsed = df.withColumn("parsed", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    wrong = F.when(blank, "INPUT_MISSING").when(F.col("parsed._corrupt").isNotNull(), "INPUT_MALFORMED")
    found = parsed.select(F.lit(artifact).alias("artifact"), wrong.alias("reason"), F.substring(column, 1, 200).alias("sample")).where("reason IS NOT NULL")
    good = parsed.withColumn("parsed", F.when(wrong.isNull(), F.col("parsed").dropFields("_corrupt")))
    return good, found


def source_files(spark: SparkSession, root: str, extensions: list[str], tests: bool = False) -> DataFrame:
    """``path, text`` of the files below ``root`` by extension, without build folders and, unless asked for, tests."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    below = F.regexp_replace(full, "^.*?" + _quoted(root.split(":", 1)[-1].rstrip("/")) + "/", "")
    skipped = "(^|/)(" + "|".join(_quoted(x) for x in BUILD_FOLDERS) + ")/"
    out = files.select(full.alias("path"), below.alias("below"), F.col("value").alias("text")).where(~F.col("below").rlike(skipped))
    return (out if tests else out.where(~F.col("below").rlike("(^|/)(test|tests)/"))).select("path", "text")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def lines(files: DataFrame) -> DataFrame:
    """``path, line_no`` (from 1) and ``line`` of ``path, text``."""
    each = files.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("k", "line"))
    return each.select("path", (F.col("k") + 1).alias("line_no"), "line")


def scan_lines(files: DataFrame, pattern: str, comments: bool = False, per_file: int | None = None) -> DataFrame:
    """Lines that match ``pattern`` without regard to case; comment lines only if asked for.

    ``per_file`` keeps the first so many hits of each file: a feature of the report, off by default.
    """
    hit = lines(files).where(F.col("line").rlike("(?i)" + pattern))
    if not comments:
        hit = hit.where(~F.ltrim("line").rlike(r"^(//|/\*|\*|#|<!--)"))
    if per_file is None:
        return hit
    k = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return hit.withColumn("k", k).where(F.col("k") <= per_file).drop("k")


def flatten_properties(files: DataFrame) -> DataFrame:
    """``path, line_no, key, value`` of .properties texts: a line that ends in an odd backslash goes on in the next one.

    Blank lines and comments (# or !) are passed over; a key without separator has the value ''.
    """
    joined = files.select("path", F.regexp_replace("text", r"(?<!\\)((?:\\\\)*)\\(?:\r\n|\n|\r)[ \t]*", "$1").alias("text"))
    kept = lines(joined).where(~F.ltrim("line").rlike("^([#!]|$)"))
    key = r"^\s*((?:\\.|[^\\=:\s])+)"
    return kept.select("path", "line_no", F.regexp_extract("line", key, 1).alias("key"), F.trim(F.regexp_replace("line", key + r"\s*[=:]?\s*", "")).alias("value")).where("key != ''")


def flatten_yaml(files: DataFrame) -> DataFrame:
    """``path, line_no, key, value, incomplete`` of YAML texts with nested maps: keys joined by dots.

    A line with a tab in its indentation or with flow style ({ or [) is reported as incomplete, not guessed at. The
    open keys of a line are those before it with less indentation than all between, which one fold over a file's lines keeps.
    """
    line = F.transform(F.split("text", "\r\n|\n|\r"), lambda x, k: F.struct((k + 1).alias("line_no"), x.alias("line")))
    kept = F.filter(line, lambda x: ~F.ltrim(x["line"]).rlike("^(#|$|---|- )"))
    start = F.struct(F.array().cast("array<struct<depth:int,key:string>>").alias("open"), F.array().cast("array<struct<line_no:int,key:string,value:string,incomplete:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        depth = F.length(F.regexp_extract(x["line"], r"^(\s*)", 1))
        key = F.regexp_replace(F.trim(F.regexp_extract(x["line"], r"^\s*([^:#]+?)\s*:(\s|$)", 1)), "^['\"]|['\"]$", "")
        value = F.trim(F.regexp_replace(F.regexp_replace(x["line"], r"^\s*[^:#]+?\s*:", ""), r"\s+#.*$", ""))
        bad = x["line"].rlike(r"^\s*\t") | value.rlike(r"^[{\[]") | (key == "")
        above = F.filter(state["open"], lambda o: o["depth"] < depth)
        opened = F.concat(above, F.array(F.struct(depth.alias("depth"), key.alias("key"))))
        full = F.array_join(F.transform(opened, lambda o: o["key"]), ".")
        row = F.struct(x["line_no"].alias("line_no"), full.alias("key"), F.regexp_replace(value, "^(['\"])(.*)\\1$", "$2").alias("value"), bad.alias("incomplete"))
        return F.struct(F.when(bad, state["open"]).otherwise(opened).alias("open"), F.when(bad | (value != ""), F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    found = files.select("path", F.explode(F.aggregate(kept, start, step)["out"]).alias("r"))
    return found.select("path", "r.*")


def write_parts(df: DataFrame, path: str, rows: int = 50_000, row_bytes: int | None = None, part_bytes: int = 8 << 20) -> None:
    """Parquet parts of at most ``rows`` rows, and about ``part_bytes`` bytes if the size of a row is given."""
    most = min(rows, max(1, part_bytes // row_bytes)) if row_bytes else rows
    df.write.option("maxRecordsPerFile", most).parquet(path)


def append_ledger(df: DataFrame, path: str, step: str) -> None:
    """Append rows to a ledger partitioned by step; what is there is never rewritten."""
    df.withColumn("step", F.lit(step)).write.mode("append").partitionBy("step").parquet(path)
