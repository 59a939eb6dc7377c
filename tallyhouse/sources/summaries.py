"""Monthly sums of stored documents, and history summaries made from them.

A month is summed on two levels: per partner (documents, lines, quantity, value), and per partner, part and
block of 64 document numbers. The second one has a bit for each number of its block, so the distinct
documents under any part filter are counted exactly: the bits of a block are merged by OR. Bits, counts and
sums are of fixed size and added in hash aggregates, so no list is sorted or gathered.
A document lies in one month and has one partner, so sums and counts of months add up.

A summary takes whole months of its date range from the sums, and scans lines for the days at the edges and for
months whose documents have changed since they were summed.
"""

from __future__ import annotations

import calendar
import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.joins import of_heads
from tallyhouse.functions.predicates import contains_pattern, scoped
from tallyhouse.operators.documents import DocumentKind, parts_with_unit
from tallyhouse.operators.history import matching_documents, summed
from tallyhouse.sources.store import NO_MONTH, Manifest, Store

TOTAL = "decimal(38,2)"
PARTY = f"company int, party bigint, documents bigint, lines bigint, quantity {TOTAL}, amount {TOTAL}"
PART = (
    "company int, party bigint, partnum bigint, block bigint, bits bigint, lines bigint,"
    f" quantity {TOTAL}, amount {TOTAL}"
)


def _sums() -> list[Column]:
    return [F.sum(c).cast(TOTAL).alias(c) for c in ("quantity", "amount")]


def _name(kind: DocumentKind) -> str:
    return f"{kind.tran}_sums"


def _valid(current: Manifest, kind: DocumentKind) -> dict[str, dict]:
    """The summed months of which heads and lines are still the files they were made from."""
    heads, lines = current.parts.get(kind.head, {}), current.parts.get(kind.tran, {})
    return {
        m: made
        for m, made in current.derived.get(_name(kind), {}).items()
        if made["covers"].get(m, []) == lines.get(m, []) and made["heads"] == heads.get(m, [])
    }


def keep_sums(store: Store, kind: DocumentKind) -> Manifest:
    """Sums all months that have no valid sums yet."""
    current = store.manifest()
    kept = _valid(current, kind)
    months = [m for m in current.parts.get(kind.head, {}) if m not in kept and m != NO_MONTH]
    if not months:
        return current
    heads = store.rows(current, kind.head, months).select(
        "company", kind.number, F.col(kind.party).alias("party"), "month"
    )
    lines = store.rows(current, kind.tran, months).filter("active")
    bought = lines.select("company", kind.number, "partnum", "quantity", "amount")
    per_part = (
        of_heads(bought, heads, ["company", kind.number])
        .groupBy("month", "company", "party", "partnum", F.shiftright(kind.number, 6).alias("block"))
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast({kind.number} & 63 as int))")).alias("bits"),
            F.count(F.lit(1)).alias("lines"),
            *_sums(),
        )
    )
    per_document = lines.groupBy("company", kind.number).agg(
        F.count(F.lit(1)).alias("lines"), *_sums()
    )
    per_party = (
        heads.join(per_document, ["company", kind.number])
        .groupBy("month", "company", "party")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("lines").alias("lines"), *_sums())
    )
    folder = f"commit={uuid.uuid4().hex}"
    base = f"{store.root}/data/{_name(kind)}/{folder}"
    per_part.hint("rebalance", "month").write.partitionBy("month").parquet(f"{base}/part")
    per_party.hint("rebalance", "month").write.partitionBy("month").parquet(f"{base}/party")
    made = {
        m: {
            "folder": folder,
            "table": kind.tran,
            "covers": {m: current.parts.get(kind.tran, {}).get(m, [])},
            "heads": current.parts[kind.head][m],
        }
        for m in months
    }
    return store.follow(current, derived={**current.derived, _name(kind): {**kept, **made}})


def _read(store: Store, kind: DocumentKind, made: dict[str, dict], level: str, layout: str) -> DataFrame:
    """The sums of some months; a month without an active line has no folder."""
    found = []
    for folder in {m["folder"] for m in made.values()}:
        base = f"{store.root}/data/{_name(kind)}/{folder}/{level}"
        there = set(store._names(base))
        found += [f"{base}/month={m}" for m, of in made.items() if of["folder"] == folder and f"month={m}" in there]
    if not found:
        return store.spark.createDataFrame([], layout)
    return store.spark.read.schema(layout).parquet(*found)


def _whole(month: str, date_from: dt.date | None, date_to: dt.date | None) -> bool:
    year, number = map(int, month.split("-"))
    last = dt.date(year, number, calendar.monthrange(year, number)[1])
    return (not date_from or date_from <= last.replace(day=1)) and (not date_to or last <= date_to)


def _day(value) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) and value else value or None


def stored_summary(
    store: Store,
    current: Manifest,
    kind: DocumentKind,
    *,
    party: str | None = None,
    part: str | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """``history_summary`` of stored documents, from kept sums where a whole month is asked for."""
    first, last = _day(date_from), _day(date_to)
    in_range = [
        m
        for m in current.parts.get(kind.head, {})
        if (m == NO_MONTH and not (first or last))
        or (m != NO_MONTH and (not first or m >= f"{first:%Y-%m}") and (not last or m <= f"{last:%Y-%m}"))
    ]
    made = {m: d for m, d in _valid(current, kind).items() if m in in_range and _whole(m, first, last)}
    scanned = [m for m in in_range if m not in made]
    D = store.tables(current, {kind.head: scanned, kind.tran: scanned})
    wanted_party, wanted_part = contains_pattern(kind.party_name, party), contains_pattern("part_desc", part)
    sums = scoped(_read(store, kind, made, "party", PARTY) if wanted_part is None else _read(store, kind, made, "part", PART))
    if wanted_party is not None:
        parties = kind.parties(D).filter(wanted_party).withColumnRenamed(kind.party, "party")
        sums = sums.join(parties, ["company", "party"], "left_semi")
    if wanted_part is not None:
        sums = sums.join(parts_with_unit(D).filter(wanted_part), ["company", "partnum"], "left_semi")
        sums = sums.groupBy("block").agg(
            F.bit_count(F.bit_or("bits")).cast("bigint").alias("documents"), F.sum("lines").alias("lines"), *_sums()
        )
    edges = matching_documents(D, kind, party=party, part=part, date_from=date_from, date_to=date_to)
    edges = edges.select(F.lit(1).cast("bigint").alias("documents"), "lines", "quantity", "amount")
    return summed(sums.select(*edges.columns).unionByName(edges))
