"""Next-number assignment for whole batches: highest number + 1, 2, 3 ... without gaps, without
sorting the batch in one task, and without a job before the result is asked for.

The number of a form is its rank by ``submission_id``, which is unique. Ranks are counted in
blocks of ``SPAN`` ids and regions of ``SPAN`` blocks, so every window holds at most ``SPAN`` rows however
the ids are spread, and a row that is computed again after a lost executor gets the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions.joins import of_heads, with_per_key
from tallyhouse.functions.ordering import running_totals
from tallyhouse.functions.predicates import scoped
from tallyhouse.tables import Tables

SPAN = 1_000_000


def running(rows: DataFrame, order: str, name: str, measure: Column) -> DataFrame:
    """Adds ``name``, the sum of ``measure`` up to and with each row, by the unique whole number ``order``;
    rows without one are left out. The joins on blocks and regions add no NULL filter, as neither can be NULL:
    so what counts the rows is the same in all branches, and Spark derives the rows below its exchange once."""
    placed = rows.filter(F.col(order).isNotNull()).withColumns(
        {
            "_block": F.expr(f"coalesce({order} div {SPAN}, 0)"),
            "_region": F.expr(f"coalesce({order} div {SPAN * SPAN}, 0)"),
        }
    )
    keys = ["_region", "_block"]
    totals = placed.groupBy(*keys).agg(F.sum(measure).alias("_sum"))
    earlier = (Window.unboundedPreceding, -1)
    # One row a region: a single one for ids below 10^12, eighteen million at most.
    regions = totals.groupBy("_region").agg(F.sum("_sum").alias("_sum")).select(
        F.col("_region").alias("_of"),
        F.sum("_sum").over(Window.orderBy("_region").rowsBetween(*earlier)).alias("_regions"),
    )
    inside = Window.partitionBy("_region").orderBy("_block").rowsBetween(*earlier)
    opening = totals.withColumn("_blocks", F.sum("_sum").over(inside)).join(
        regions, F.col("_region") == F.col("_of")
    )
    before = F.coalesce("_blocks", F.lit(0)) + F.coalesce("_regions", F.lit(0))
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_own", F.sum(measure).over(own))
        .join(opening.select(*keys, before.alias("_before_block")), keys)
        .select(*rows.columns, (F.col("_before_block") + F.col("_own")).alias(name))
    )


def numbers_of(D: Tables, table: str, number: str) -> DataFrame:
    """The numbers given out in a table: of stored tables just the highest one, which their version
    keeps, else the whole column."""
    rows = scoped(getattr(D, table)).select(number)
    if table not in D.marks:
        return rows
    mark = F.lit(D.marks[table]).cast(rows.schema[number].dataType)
    return rows.sparkSession.range(1).select(mark.alias(number))


def highest(*numbers: DataFrame) -> Column:
    """The highest number in the only column of the given frames, 0 without rows, as a
    scalar subquery."""
    first, *rest = [n.toDF("number") for n in numbers]
    for other in rest:
        first = first.unionByName(other)
    return first.agg(F.coalesce(F.max("number"), F.lit(0)).alias("highest")).scalar()


def assign_numbers(rows: DataFrame, order: str, number: str, *existing: DataFrame) -> DataFrame:
    """Fills ``number`` with the numbers that follow the highest existing one, by the unique ``order``."""
    indexed = running(rows, order, "_index", F.lit(1))
    return indexed.withColumn(number, highest(*existing) + F.col("_index")).drop("_index")


def assign_line_numbers(
    lines: DataFrame, form: str, position: str, number: str, *existing: DataFrame, forms: DataFrame | None = None
) -> DataFrame:
    """The same for lines, by form and position in it (unique together): the lines of all forms before, plus
    the place in the own form. A form with a third of all lines is spread over blocks of positions.

    With ``forms`` (one row a form) only their lines are numbered, with the forms' columns. They meet the
    sizes of the forms, one row to one row, and the lines just once, with the opening numbers."""
    sizes = lines.groupBy(form).agg(F.count(F.lit(1)).alias("_size"))
    if forms is not None:
        sizes = sizes.join(forms, form)
    opening = running(sizes, form, "_upto", F.col("_size")).withColumn(
        "_before", F.col("_upto") - F.col("_size")
    ).drop("_size", "_upto")
    blocks = lines.withColumn("_block", F.expr(f"{position} div {SPAN}"))
    placed = running_totals(blocks, [form], ["_block"], [position], _place=F.lit(1))
    join = with_per_key if forms is None else of_heads
    return (
        join(placed, opening, [form])
        .withColumn(number, highest(*existing) + F.col("_before") + F.col("_place"))
        .drop("_block", "_before", "_place")
    )
