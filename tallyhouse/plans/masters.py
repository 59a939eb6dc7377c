"""Inserting and updating parts, vendors and customers from submitted forms."""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.values import normalise
from tallyhouse.operators.catalog import LOOKUPS
from tallyhouse.plans.batches import Frames, Posting, accepted, rejected, with_reasons
from tallyhouse.plans.documents import USER
from tallyhouse.plans.numbering import assign_numbers, numbers_of
from tallyhouse.schemas import conform, schema
from tallyhouse.tables import Tables

KEPT = ("company", "created_by", "updated")


def upsert_master(D: Tables, kind: str, forms: DataFrame, as_of: dt.date) -> Posting:
    """Merges master forms (all fields text, plus ``submission_id``) into the table.

    A form without a code is a new row and gets the next one; a code that exists is an
    update, else an insert. An insert is active whatever the form says; updates take the
    form's checkbox. With several forms of one code the last one wins.
    """
    key, name = LOOKUPS[kind]
    fields = [f for f in schema(kind) if f.name not in KEPT]
    cleaned = normalise(_with_all_fields(forms, [f.name for f in fields]), kind)
    typed = cleaned.select(
        "submission_id",
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields],
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col(f.name).isNotNull()
                        & F.col(f.name).try_cast(f.dataType).isNull(),
                        F.lit(f.name),
                    )
                    for f in fields
                ]
            )
        ).alias("unread"),
    )
    checked = with_reasons(
        typed,
        {
            f"missing {name}": F.col(name).isNull(),
            "unreadable field": F.size("unread") > 0,
        },
    ).drop("unread")

    @cache
    def merged_table() -> DataFrame:
        posted = accepted(checked)
        given = posted.filter(F.col(key).isNotNull())
        numbered = assign_numbers(
            posted.filter(F.col(key).isNull()),
            "submission_id",
            key,
            numbers_of(D, kind, key),
            given.select(key),
        )
        names = [f.name for f in fields if f.name != key]
        latest = (
            given.unionByName(numbered.select(*given.columns))
            .groupBy(key)
            .agg(
                F.max(F.struct("submission_id", *names)).alias("form"),
                F.count(F.lit(1)).alias("forms"),
            )
            .select(F.lit(1).alias("company"), key, "form", "forms")
        )
        old = getattr(D, kind)
        merged = old.withColumn("_old", F.lit(True)).join(latest, ["company", key], "full_outer")
        touched = F.col("form").isNotNull()
        inserted_once = F.col("_old").isNull() & (F.col("forms") == 1)
        values = {n: F.when(touched, F.col(f"form.{n}")).otherwise(F.col(n)) for n in names}
        values["active"] = (
            F.when(inserted_once, F.lit(True))
            .when(touched, F.col("form.active"))
            .otherwise(F.col("active"))
        )
        values["created_by"] = F.when(F.col("_old").isNull(), F.lit(USER)).otherwise(
            F.col("created_by")
        )
        values["updated"] = F.when(touched, F.lit(as_of)).otherwise(F.col("updated"))
        return merged.withColumns({**values, "_hit": touched})

    return Posting(
        rejects=rejected(checked, "submission_id"),
        state=Frames(**{kind: lambda: conform(merged_table(), kind)}),
        changed=Frames(**{kind: lambda: conform(merged_table().filter("_hit"), kind)}),
    )


def _with_all_fields(forms: DataFrame, names: list[str]) -> DataFrame:
    absent = [n for n in names if n not in forms.columns]
    return forms.withColumns({n: F.lit(None).cast("string") for n in absent})
