"""Evidence fusion: one verdict of five states for each target, from flags that one aggregation collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATES = ("reachable", "uncertain", "not_analyzed", "not_found_in_static_analysis", "not_impacted")


def five_state(c: dict[str, Column]) -> Column:
    """The verdict, first match wins; ``c`` has boolean columns, null counts as false.

    invalid_input, preserved, business_path (complete, certain and activated), blocking, independent_semantic, concern,
    unactivated, ambiguous, truncated, physical_path, any_path, applicable, all_complete.
    Incomplete coverage without path, concern or preservation counts as blocking, so that no negative is
    concluded from a scan that didn't see everything.
    """
    f = {k: F.coalesce(v, F.lit(False)) for k, v in c.items()}
    complete = f["applicable"] & f["all_complete"]
    gap = f["applicable"] & ~f["all_complete"] & ~f["any_path"] & ~f["concern"] & ~f["preserved"]
    blocking = f["blocking"] | gap
    return (
        F.when(f["invalid_input"], "not_analyzed")
        .when(f["preserved"], "not_impacted")
        .when(f["business_path"], "reachable")
        .when(blocking & ~f["independent_semantic"], "not_analyzed")
        .when(f["concern"] | f["unactivated"] | f["ambiguous"], "uncertain")
        .when(f["truncated"], "not_analyzed")
        .when(f["physical_path"], "uncertain")
        .when(blocking, "not_analyzed")
        .when(complete, "not_found_in_static_analysis")
        .otherwise("not_analyzed")
    )


def worst(status: Column, order: list[str]) -> Column:
    """The aggregate of a group: its last status by ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), status)
    return F.element_at(F.array(*map(F.lit, order)), F.max(rank).cast("int"))


def frozen(text: Column) -> Column:
    """Nested evidence (JSON text) as a variant, null where it isn't JSON: keys have no order there, lists do."""
    return F.try_parse_json(text)


def canonical(value: Column) -> Column:
    """The one text of a variant: keys sorted, numbers as short as they can be; equal texts are equal evidence."""
    return F.to_json(value)


def evidence_id(value: Column) -> Column:
    """A digest that depends on what a variant holds, not on the order of its keys."""
    return F.sha2(canonical(value).cast("binary"), 256)


def thawed(value: Column, schema: str) -> Column:
    """A variant as a plain value of a schema, null where it doesn't fit."""
    return F.from_json(canonical(value), schema)


def as_sets(text: Column, schema: str, sets: list[str]) -> Column:
    """Evidence whose named top-level lists have no order: they are sorted, and repeated entries given once, before it is frozen."""
    plain = F.from_json(text, schema)
    for name in sets:
        plain = plain.withField(name, F.array_sort(F.array_distinct(plain[name])))
    return F.parse_json(F.to_json(plain))


def differences(rows: DataFrame, one: str, other: str, keys: list[str]) -> DataFrame:
    """``keys, field, one, other`` (texts) of the top-level fields in which two variants of a row differ; a field that one lacks is null there."""
    def fields(side: str) -> DataFrame:
        each = rows.select(*keys, F.explode(F.map_entries(F.from_json(canonical(F.col(side)), "map<string, variant>"))).alias("e"))
        return each.select(*keys, F.col("e.key").alias("field"), F.to_json("e.value").alias(side))

    both = fields(one).join(fields(other), [*keys, "field"], "full")
    return both.where(~F.col(one).eqNullSafe(F.col(other)))
