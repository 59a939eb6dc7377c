"""Batches of submitted forms and the result of posting them.

A batch is flat: one row per form (``heads``, with a unique ``submission_id`` that gives
the order of arrival) and one row per form line (``lines``, with ``position`` from 1).
Form fields of lines are text, as entered. A form of any size is many line rows, so no
form has to fit one row; ``explode_batch`` accepts the nested layout as well.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.values import line_amount
from tallyhouse.tables import Tables


@dataclass(frozen=True)
class Batch:
    heads: DataFrame
    lines: DataFrame


class Frames(Mapping):
    """Frames by table, each built when first asked for: numbering runs Spark jobs, which a
    caller that wants the rejects or another table should not wait for."""

    def __init__(self, **builders: Callable[[], DataFrame]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


@dataclass(frozen=True)
class Posting:
    """``added``: rows to append per table; ``state``: full new content of tables in which
    rows changed; ``changed``: of these tables the changed masters, heads or lines of changed
    documents only, in place of all rows with their key; ``rewritten``: of changed lines that were read from some
    ``months`` of a store all rows of these months with their ``month``, and the new rows; those of changed documents
    are marked by ``_hit`` and have the date of their document in ``_dated``."""

    rejects: DataFrame
    added: Mapping[str, DataFrame] = field(default_factory=dict)
    state: Mapping[str, DataFrame] = field(default_factory=dict)
    changed: Mapping[str, DataFrame] = field(default_factory=dict)
    rewritten: Mapping[str, DataFrame] = field(default_factory=dict)
    months: Mapping[str, Collection[str]] = field(default_factory=dict)

    def apply(self, D: Tables) -> Tables:
        """The tables as they are after the posting."""

        def table(name: str) -> DataFrame:
            if name in self.state:
                return self.state[name]
            rows = getattr(D, name)
            return rows.unionByName(self.added[name]) if name in self.added else rows

        return Tables(table)


def explode_batch(forms: DataFrame) -> Batch:
    """The flat batch of forms that hold their lines as an array of structs."""
    lines = forms.select("submission_id", F.posexplode("lines").alias("pos", "line"))
    return Batch(
        forms.drop("lines"),
        lines.select("submission_id", (F.col("pos") + 1).alias("position"), "line.*"),
    )


def filled(*columns: str) -> Column:
    """True when all the text fields are present and not empty, for filters: NULL where one is NULL. A field
    is mostly a cast or a CASE, which a filter works out anew for each test, so there is one test a field."""
    result = F.lit(True)
    for c in columns:
        result = result & (F.col(c) != "")
    return result


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``, the texts of the broken rules (a rule is broken when true)."""
    flags = [F.when(broken, F.lit(text)) for text, broken in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*flags)))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame, *keys: str) -> DataFrame:
    return df.filter(F.size("reasons") > 0).select(*keys, "reasons")


def entered_lines(lines: DataFrame) -> DataFrame:
    """Complete lines with their numbers read; incomplete lines are skipped and keep
    their place in the numbering. A number that cannot be read stays NULL."""
    complete = lines.filter(filled("part_num", "quantity", "rate"))
    read = complete.select(
        "submission_id",
        F.col("position").cast("int").alias("rowid"),
        F.col("part_num").try_cast("bigint").alias("partnum"),
        F.col("quantity").try_cast("decimal(18,2)").alias("quantity"),
        F.col("rate").try_cast("decimal(18,2)").alias("unit_price"),
    )
    return read.withColumn("amount", line_amount(F.col("quantity"), F.col("unit_price")))


def unreadable(lines: DataFrame, *columns: str) -> DataFrame:
    """Submissions with a line in which one of the numbers could not be read."""
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.col(c).isNull()
    return (
        lines.filter(broken)
        .select("submission_id")
        .distinct()
        .withColumn("unreadable", F.lit(True))
    )


def check_numbers(
    forms: DataFrame, number: str, existing: DataFrame, rules: dict[str, Column]
) -> DataFrame:
    """Applies ``rules``, and rejects a given number that exists or that an earlier sound
    form of the batch has taken. Forms without a number take no part in the joins on it,
    so they do not all meet in the partition of the NULL key."""
    blank = with_reasons(forms.filter(F.col(number).isNull()), rules)
    taken = existing.select(number, F.lit(True).alias("taken"))
    given = with_reasons(
        with_per_key(forms.filter(F.col(number).isNotNull()), taken, [number]),
        {**rules, "number exists": F.col("taken")},
    )
    first = (
        accepted(given).groupBy(number).agg(F.min("submission_id").alias("first_submission"))
    )
    repeated = (F.size("reasons") == 0) & (F.col("first_submission") != F.col("submission_id"))
    judged = with_per_key(given, first, [number]).withColumn(
        "reasons",
        F.when(repeated, F.array(F.lit("number repeated in batch"))).otherwise(
            F.col("reasons")
        ),
    )
    return judged.drop("taken", "first_submission").unionByName(blank)
