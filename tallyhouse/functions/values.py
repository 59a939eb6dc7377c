"""Derived columns: amounts, tax, margin, stock bands, codes and form cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.schemas import MONEY

# Display prefixes and date formats of the source system's pages.
CODE_PREFIX = {
    "part": "P",
    "customer": "C",
    "vendor": "V",
    "purchase_order": "PO",
    "sales_invoice": "SI",
    "indent": "IN",
}
DATE_FORMATS = {
    "iso": "yyyy-MM-dd",
    "day_first": "dd-MM-yyyy",
    "short": "dd MMM",
    "minute": "dd-MM-yyyy HH:mm",
}
LOW_STOCK = 10
CHECKBOXES = {
    "part": ["lot", "batch", "warranty", "active"],
    "vendor": ["active"],
    "customer": ["active"],
}


def money(column: Column) -> Column:
    return column.cast(MONEY)


def line_amount(quantity: Column, rate: Column) -> Column:
    """Quantity times rate, without tax, in whole cents."""
    return money(quantity * rate)


def amount_with_tax(quantity: Column, rate: Column, tax_percent: Column) -> Column:
    """Base plus base x tax / 100 in whole cents; no tax percentage counts as 0."""
    factor = F.lit(100) + F.coalesce(tax_percent, F.lit(0).cast("decimal(5,2)"))
    base = (quantity * rate).cast("decimal(24,4)")
    return money(base * factor.cast("decimal(6,2)") * F.lit("0.01").cast("decimal(2,2)"))


def margin_percent(purchase: Column, sale: Column) -> Column:
    """Margin over the purchase price to one decimal; NULL unless both prices are
    present and non-zero."""
    cost, price = purchase.cast("double"), sale.cast("double")
    known = (cost != 0) & (price != 0)
    return F.when(known, F.round((price - cost) / cost * 100, 1))


def sign_label(column: Column) -> Column:
    return (
        F.when(column > 0, "positive").when(column < 0, "negative").when(column == 0, "zero")
    )


def stock_status(level: Column) -> Column:
    return F.when(level <= 0, "out").when(level < LOW_STOCK, "low").otherwise("in")


def signed_quantity(kind: Column, quantity: Column, sign: str = "reference") -> Column:
    """A ledger row's effect on stock. ``reference``: only ``IN`` adds, so an
    ``INCREASE`` adjustment lowers stock; ``adjusted``: ``INCREASE`` adds as well."""
    adding = {"reference": ["IN"], "adjusted": ["IN", "INCREASE"]}[sign]
    return F.when(kind.isin(*adding), quantity).otherwise(-quantity)


def display_code(kind: str, number: Column, dashed: bool = False) -> Column:
    """``PO-12`` (dashed) or the padded form ``P001``."""
    if dashed:
        return F.concat(F.lit(CODE_PREFIX[kind] + "-"), number.cast("string"))
    return F.format_string(CODE_PREFIX[kind] + "%03d", number.cast("bigint"))


def date_text(column: Column, style: str = "iso") -> Column:
    return F.date_format(column, DATE_FORMATS[style])


def blank_to_null(column: Column) -> Column:
    text = F.trim(column)
    return F.when(text != "", text)


def normalise(df: DataFrame, kind: str) -> DataFrame:
    """Clean one submitted master form: blanks become NULL, a ticked checkbox ("on")
    becomes true and any other value false, GST and PAN are upper-cased."""
    boxes = CHECKBOXES[kind]
    cleaned = {}
    for field in df.schema:
        column = F.col(field.name)
        if field.name in boxes:
            cleaned[field.name] = F.coalesce(column == "on", F.lit(False))
        elif field.name in ("gst", "pan"):
            cleaned[field.name] = F.upper(blank_to_null(column))
        elif field.dataType.typeName() == "string":
            cleaned[field.name] = blank_to_null(column)
    return df.withColumns(cleaned)
