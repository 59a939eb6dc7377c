"""Stock levels from the append-only movement ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.ordering import by_label, running_totals
from tallyhouse.functions.predicates import scoped
from tallyhouse.functions.values import sign_label, signed_quantity, stock_status
from tallyhouse.tables import Tables

LEVEL = "decimal(28,2)"

# Ids per ledger segment: bounds how many rows of one part and day share a task.
SEGMENT_IDS = 1_000_000


def movement_sums(ledger: DataFrame) -> DataFrame:
    """Per company and part: ``SUMS`` of its movements. They add up, so sums of parts of the ledger can be
    merged by ``merged_sums``."""

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("qty"))), F.lit(0)).cast(LEVEL)

    def level(sign: str) -> Column:
        return F.sum(signed_quantity(F.col("type"), F.col("qty"), sign)).cast(LEVEL)

    return ledger.filter("part_num is not null").groupBy("company", "part_num").agg(
        level("reference").alias("level_reference"),
        level("adjusted").alias("level_adjusted"),
        total("IN").alias("total_in"),
        total("OUT").alias("total_out"),
        F.count(F.lit(1)).alias("movements"),
        F.max("update_date").alias("last_updated"),
    )


def merged_sums(sums: DataFrame) -> DataFrame:
    """One row a part from several."""
    added = [F.sum(c).cast(LEVEL).alias(c) for c in ("level_reference", "level_adjusted", "total_in", "total_out")]
    return sums.groupBy("company", "part_num").agg(
        *added, F.sum("movements").alias("movements"), F.max("last_updated").alias("last_updated")
    )


def sums_of(D: Tables) -> DataFrame:
    """Movement sums of the parts of company 1, from what is kept of them where it is kept."""
    return scoped(D.standing() if D.standing else movement_sums(D.stock_update)).drop("company")


def ledger_level(D: Tables, sign: str = "reference") -> DataFrame:
    """Signed ledger sum per part; rows without a part are left out."""
    return sums_of(D).select("part_num", F.col(f"level_{sign}").alias("current_stock"))


def part_stock_info(D: Tables, sign: str = "reference") -> DataFrame:
    """Per part: level, number of movements, date of the last one."""
    totals = sums_of(D).select(
        "part_num",
        F.col(f"level_{sign}").alias("current_stock"),
        F.col("movements").alias("total_transactions"),
        "last_updated",
    )
    return (
        scoped(D.part)
        .select("part_num")
        .join(totals, "part_num", "left")
        .select(
            "part_num",
            F.coalesce("current_stock", F.lit(0)).cast(LEVEL).alias("current_stock"),
            F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
            "last_updated",
        )
    )


def _levels(D: Tables, sign: str) -> DataFrame:
    level = F.coalesce("current_stock", F.lit(0)).cast(LEVEL)
    return (
        scoped(D.part, active=True)
        .join(ledger_level(D, sign), "part_num", "left")
        .withColumn("current_stock", level)
    )


def stock_on_hand(D: Tables, sign: str = "reference") -> DataFrame:
    """Active parts with unit, level, reserved (none) and available stock."""
    units = D.unit.select("company", "unit_id", "unit_desc")
    return (
        _levels(D, sign)
        .join(units, ["company", "unit_id"], "left")
        .select(
            "part_num", "part_desc", "part_category", "unit_desc", "current_stock",
            F.lit(0).alias("reserved_stock"),
            F.col("current_stock").alias("available_stock"),
            "pur_price", "sell_price",
            stock_status(F.col("current_stock")).alias("status"),
        )
        .orderBy(*by_label("part_desc", "part_num"))
    )


def stock_kpis(D: Tables, sign: str = "reference") -> DataFrame:
    """Parts in total, in stock, low (up to and including 10) and out of stock."""
    level = F.col("current_stock")
    return _levels(D, sign).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(level > 0).alias("in_stock"),
        F.count_if((level > 0) & (level <= 10)).alias("low_stock"),
        F.count_if(level <= 0).alias("out_of_stock"),
    )


def stock_valuation(D: Tables, sign: str = "reference") -> DataFrame:
    """Per active part purchase price x level, NULL where either is missing or 0."""
    price, level = F.col("pur_price"), F.col("current_stock")
    return _levels(D, sign).select(
        "part_num",
        "pur_price",
        "current_stock",
        F.when((price != 0) & (level != 0), (price * level).cast(LEVEL)).alias("stock_value"),
    )


def stock_value_total(D: Tables, sign: str = "reference") -> DataFrame:
    return stock_valuation(D, sign).agg(
        F.coalesce(F.sum("stock_value"), F.lit(0)).alias("total_stock_value")
    )


def stock_running_balance(
    D: Tables, sign: str = "reference", opening: DataFrame | None = None
) -> DataFrame:
    """Every movement with the part's balance after it, in date and id order. ``opening`` are the movement
    sums of the ledger before the rows of ``D``, where these are only some of its months."""
    moves = (
        scoped(D.stock_update)
        .filter("part_num is not null")
        .select("part_num", "update_date", "update_id", "type", "qty")
        .withColumns(
            {
                "signed": signed_quantity(F.col("type"), F.col("qty"), sign),
                "block": F.expr(f"update_id div {SEGMENT_IDS}"),
            }
        )
    )
    balanced = running_totals(
        moves,
        ["part_num"],
        ["update_date", "block"],
        ["update_date", "update_id"],
        running_balance=F.col("signed"),
    )
    balance = F.col("running_balance")
    if opening is not None:
        before = scoped(opening).select("part_num", F.col(f"level_{sign}").alias("opening"))
        balanced = with_per_key(balanced, before, ["part_num"])
        balance = balance + F.coalesce("opening", F.lit(0))
    balance = balance.cast(LEVEL)
    return balanced.select(
        "part_num", "update_date", "update_id", "type", "qty",
        balance.alias("running_balance"),
        sign_label(balance).alias("balance_state"),
    )


def movement_summary(D: Tables) -> DataFrame:
    """Per part: IN total, OUT total, their difference and the number of movements."""
    return sums_of(D).select(
        "part_num",
        "total_in",
        "total_out",
        "movements",
        (F.col("total_in") - F.col("total_out")).cast(LEVEL).alias("net_balance"),
    )


def project_stock(movements: DataFrame, D: Tables, sign: str = "reference") -> DataFrame:
    """Preview of submitted movements (part_num, type, quantity): the level after each
    one alone. Here ``INCREASE`` adds, as the form shows it."""
    change = signed_quantity(F.col("type"), F.col("quantity"), "adjusted")
    current = F.coalesce("current_stock", F.lit(0)).cast(LEVEL)
    return (
        with_per_key(movements, ledger_level(D, sign), ["part_num"])
        .withColumn("current_stock", current)
        .withColumn("new_stock", (F.col("current_stock") + change).cast(LEVEL))
        .withColumns(
            {
                "status": stock_status(F.col("new_stock")),
                "is_negative": F.col("new_stock") < 0,
            }
        )
    )
