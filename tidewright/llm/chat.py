"""Chat formatting in budgeted windows, in DataFrame operations only.

Template: a turn is ``<turn ROLE>TEXT</turn>`` and a line feed; a turn that only repeats what an
earlier window held starts with ``<past ``. Inside role and text the control characters ``\\``, ``<`` and
``>`` become ``\\s``, ``\\l`` and ``\\g``, so no text can hold a mark and every text can be restored.

Prefix sums of the turns' tokens cut a conversation at turns into spans: a span holds the turns that
start within one stretch of half the budget. Each span makes a window: the conversation's system turn, as many of the last
turns before the span as the budget leaves room for (``history`` at most), then the span's own turns. The loss
mask covers the texts of assistant turns in the window that has them as its own, so each is a target
once. A window keeps to the budget unless one of its own turns is longer than half of it. Prefix sums are taken
over buckets of turns first and then inside each bucket, so that no task sorts a whole large conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stage, table

BUDGET, HISTORY, BUCKET = 512, 4, 1024
#: A turn costs its words and so many tokens for the marks.
OVERHEAD = 2
# Control characters and their escapes, in the order in which they are escaped.
_ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), text)


def _segment(mark: str, role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"<{mark} "), role, F.lit(">"), text, F.lit("</turn>\n"))


def windows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, bucket: int = BUCKET) -> DataFrame:
    """``conv_id, window, text, loss, n_own, n_tokens`` for each window; ``loss`` has (start, end) in characters of ``text``.

    Rows are taken by turn (nulls first), those of equal turn by role and text; repeated rows are turns of
    their own. Null roles and texts count as empty, a null conversation id is an id like any other. An empty table gives no
    windows. Other columns aren't read. The system turn is the first turn if its role is ``system``.
    """
    t = conversations.select(F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), escape(F.coalesce(role_col, F.lit(""))).alias("role"), escape(F.coalesce(text_col, F.lit(""))).alias("text"))
    # Null ids get a flag, so that joins on plain equality find them.
    t = t.select(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("none"), "turn", "role", "text", (F.regexp_count("text", F.lit(r"\S+")) + OVERHEAD).cast("bigint").alias("tokens"), F.floor(F.col("turn") / bucket).alias("bucket"))
    conv = ["id", "none"]
    sums = t.groupBy(*conv, "bucket").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy(*conv).orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*conv, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("idx0"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before0"))
    order = Window.partitionBy(*conv, "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    inside = t.select("*", F.row_number().over(order).alias("k"), F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before1"))
    on = [inside[c].eqNullSafe(sums[c]) for c in (*conv, "bucket")]
    turns = inside.join(sums, on).select(inside["id"], inside["none"], "role", "text", "tokens", (F.col("idx0") + F.col("k") - 1).alias("idx"), (F.col("before0") + F.col("before1")).alias("before"))
    turns = stage(turns.withColumn("span", F.floor(F.col("before") / (budget // 2))), "turns")

    system = turns.where("idx = 0 AND role = 'system'").select(*conv, F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    own = Window.partitionBy(*conv, "span").orderBy("idx")
    part = _segment("turn", F.col("role"), F.col("text"))
    placed = turns.select("*", part.alias("part")).withColumn("at", F.coalesce(F.sum(F.char_length("part")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("at") + F.char_length("role") + F.lit(len("<turn >"))
    mask = F.when(F.col("role") == "assistant", F.struct(start.cast("bigint").alias("start"), (start + F.char_length("text")).cast("bigint").alias("end")))
    spans = placed.groupBy(*conv, "span").agg(
        F.min("idx").alias("first"), F.min("before").alias("before"), F.sum("tokens").alias("own_tokens"), F.count("*").alias("n_own"),
        F.array_sort(F.collect_list(F.struct("idx", "part"))).alias("parts"), F.array_sort(F.collect_list(mask)).alias("masks"))
    spans = spans.join(system, conv, "left").withColumn("has_system", F.col("system").isNotNull() & (F.col("first") > 0))
    room = F.lit(budget) - F.col("own_tokens") - F.when(F.col("has_system"), F.col("system_tokens")).otherwise(0)
    spans = stage(spans.withColumn("room", room), "spans")

    # History: the last turns before a span, found by position, so that a large conversation's are spread over tasks.
    low = F.greatest(F.col("first") - history, F.when(F.col("has_system"), 1).otherwise(0))
    wanted = spans.where(F.col("first") > low).select(*conv, "span", "room", F.col("before").alias("span_before"), F.explode(F.sequence(low, F.col("first") - 1)).alias("idx"))
    past = wanted.join(turns.select(*conv, "idx", "role", "text", "before", "tokens"), [*conv, "idx"]).where(F.col("span_before") - F.col("before") <= F.col("room"))
    past = past.groupBy(*conv, "span").agg(F.array_sort(F.collect_list(F.struct("idx", _segment("past", F.col("role"), F.col("text")).alias("part")))).alias("past"), F.sum("tokens").alias("past_tokens"))
    made = spans.join(past, [*conv, "span"], "left")
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: x.part), "")
    made = made.withColumn("ahead", F.concat(F.when(F.col("has_system"), _segment("past", F.lit("system"), F.col("system"))).otherwise(""), F.coalesce(joined("past"), F.lit(""))))
    shift = F.char_length("ahead").cast("bigint")
    return made.select(
        F.when(~F.col("none"), F.col("id")).alias("conv_id"), F.col("span").alias("window"), F.concat("ahead", joined("parts")).alias("text"),
        F.transform("masks", lambda m: F.struct((m.start + shift).alias("start"), (m.end + shift).alias("end"))).alias("loss"), "n_own",
        (F.lit(budget) - F.col("room") + F.coalesce("past_tokens", F.lit(0))).alias("n_tokens"))


def read_back(made: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of conversations, from their windows alone.

    The digests are of a conversation's whole text, so they need it in one row: the only place where a conversation isn't spread out.
    """
    parts = F.filter(F.split("text", "</turn>\n"), lambda x: x.startswith("<turn "))
    head = lambda x: F.instr(x, ">")
    turn = lambda x: F.concat(unescape(F.substring(x, F.lit(7), head(x) - 7)), F.lit("\n"), unescape(F.substring(x, head(x) + 1, F.char_length(x))), F.lit("\n"))
    target = F.transform("loss", lambda s: unescape(F.substring("text", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    each = made.select("conv_id", "window", F.size(parts).cast("bigint").alias("n"), F.array_join(F.transform(parts, turn), "").alias("turns"), F.array_join(target, "").alias("target"), F.char_length("text").cast("bigint").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "target"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    text = lambda f: F.array_join(F.transform("all", lambda x: x[f]), "")
    return whole.select("conv_id", "n_turns", F.sha2(text("turns").cast("binary"), 256).alias("turns_sha256"), F.char_length(text("target")).cast("bigint").alias("loss_chars"), F.sha2(text("target").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return read_back(windows(given.unionByName(extra)))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) + 2 AS tokens, row_number() OVER o - 1 AS idx,
         15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx) - tokens AS before FROM t),
s AS (SELECT conv_id, before // 256 AS span, min(idx) AS first, min(before) AS before, sum(tokens) AS own, sum(chars) AS chars FROM b GROUP BY ALL),
y AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM b WHERE idx = 0 AND role = 'system'),
w AS (SELECT s.*, CASE WHEN first > 0 THEN sys_tokens END AS sys_tokens, CASE WHEN first > 0 THEN sys_chars END AS sys_chars FROM s LEFT JOIN y USING (conv_id)),
h AS (
  SELECT w.conv_id, w.span, sum(b.chars) AS past_chars FROM w JOIN b ON w.conv_id = b.conv_id AND b.idx < w.first AND b.idx >= w.first - 4
    AND (w.sys_tokens IS NULL OR b.idx > 0) AND w.before - b.before <= 512 - w.own - coalesce(w.sys_tokens, 0)
  GROUP BY ALL),
f AS (SELECT w.conv_id, CAST(sum(w.chars + coalesce(sys_chars, 0) + coalesce(past_chars, 0)) AS BIGINT) AS formatted_chars FROM w LEFT JOIN h USING (conv_id, span) GROUP BY w.conv_id),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS target
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(target) AS BIGINT) AS loss_chars, sha256(target) AS loss_sha256, formatted_chars FROM g JOIN f USING (conv_id)
"""
