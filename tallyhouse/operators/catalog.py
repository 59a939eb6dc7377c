"""Master data: part catalogue, directories, pick lists, details, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.ordering import by_label
from tallyhouse.functions.predicates import scoped
from tallyhouse.tables import Tables

PARTY_KEYS = {
    "vendor": ("vendor_code", "vendor_name"),
    "customer": ("customer_code", "customer_name"),
}
LOOKUPS = {
    "unit": ("unit_id", "unit_desc"),
    "tax": ("tax_id", "tax_desc"),
    "part": ("part_num", "part_desc"),
    **PARTY_KEYS,
}
CATALOG_COLUMNS = [
    "part_num", "part_desc", "part_type", "part_category", "unit_desc", "pur_price",
    "sell_price", "hsn_code", "tax_desc", "tax_percent", "active",
]


def with_labels(parts: DataFrame, D: Tables) -> DataFrame:
    """Parts with the unit and tax labels of their own company."""
    units = D.unit.select("company", "unit_id", "unit_desc")
    taxes = D.tax.select("company", "tax_id", "tax_desc")
    return parts.join(units, ["company", "unit_id"], "left").join(
        taxes, ["company", "tax_id"], "left"
    )


def part_catalog(D: Tables, company: int | None = None) -> DataFrame:
    rows = with_labels(scoped(D.part, company), D)
    return rows.orderBy("part_num", "company").select(*CATALOG_COLUMNS)


def directory(D: Tables, kind: str, company: int | None = None) -> DataFrame:
    """Vendors or customers by name."""
    code, name = PARTY_KEYS[kind]
    return (
        scoped(getattr(D, kind), company)
        .orderBy(*by_label(name, code))
        .select(code, name, "city", "state", "phone", "mobile", "email", "gst", "active")
    )


def vendor_directory(D: Tables) -> DataFrame:
    return directory(D, "vendor")


def customer_directory(D: Tables) -> DataFrame:
    return directory(D, "customer")


def active_lookup(D: Tables, kind: str, company: int | None = None) -> DataFrame:
    """The active entries of a pick list as (id, label), taxes with their percentage."""
    key, label = LOOKUPS[kind]
    extra = ["tax_percent"] if kind == "tax" else []
    return (
        scoped(getattr(D, kind), company, active=True)
        .select(F.col(key).alias("id"), F.col(label).alias("label"), *extra)
        .orderBy(*by_label("label", "id"))
    )


def entity_detail(D: Tables, kind: str, keys: DataFrame | None = None) -> DataFrame:
    """Detail rows of company 1; ``keys`` restricts them to the given codes."""
    rows = scoped(getattr(D, kind))
    if keys is not None:
        rows = rows.join(keys.select(LOOKUPS[kind][0]), LOOKUPS[kind][0], "left_semi")
    if kind != "part":
        return rows
    return with_labels(rows, D).withColumn("tax_desc", F.coalesce("tax_desc", F.lit("N/A")))


def part_price_lookup(D: Tables) -> DataFrame:
    """Prices and tax of active parts for line entry; unknown numbers count as 0."""
    rows = scoped(D.part, active=True)
    units = D.unit.select("company", "unit_id", "unit_desc")

    def or_zero(name: str):
        return F.coalesce(name, F.lit(0)).alias(name)

    return rows.join(units, ["company", "unit_id"], "left").select(
        "part_num",
        "part_desc",
        or_zero("pur_price"),
        or_zero("sell_price"),
        or_zero("tax_percent"),
        "unit_id",
        F.coalesce("unit_desc", F.lit("")).alias("unit_desc"),
    )


def directory_stats(D: Tables, kind: str) -> DataFrame:
    """Totals above a directory; the facet is the category of parts, else the state."""
    facet = "part_category" if kind == "part" else "state"
    active = F.coalesce("active", F.lit(False))
    return getattr(D, kind).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(active).alias("active"),
        F.count_if(~active).alias("inactive"),
        F.count_distinct(F.nullif(F.col(facet), F.lit(""))).alias("distinct_facets"),
    )


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed values for a filter list, blanks and '-' left out."""
    value = F.trim(F.col(column).cast("string"))
    return (
        df.select(value.alias("value"))
        .filter("value is not null and value not in ('', '-')")
        .distinct()
        .orderBy("value")
    )
