"""Figures as text: money, metrics, changes, sizes, confidence. Rounding is that of the exact binary value, ties away from zero."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import fixed, indian_groups

# Fixed values.
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}
NONE = "—"


def symbol(currency: str | None) -> str:
    return SYMBOLS.get(currency or "INR", "")


def _missing(v) -> bool:
    return v is None or v != v or v in (float("inf"), float("-inf"))


def _grouped(n: int, currency: str) -> str:
    return indian_groups(n) if currency == "INR" else f"{n:,}"


def whole(v: float) -> int:
    return int(Decimal(v).quantize(Decimal(1), ROUND_HALF_UP))


def money(v: float | None, currency: str = "INR") -> str:
    """Short: crores and lakhs for rupees, billions, millions and thousands otherwise."""
    if _missing(v):
        return NONE
    n, head = abs(v), ("-" if v < 0 else "") + symbol(currency)
    scales = [(1e7, " Cr", 2), (1e5, " L", 2)] if currency == "INR" else [(1e9, "B", 2), (1e6, "M", 2), (1e3, "K", 1)]
    for scale, name, places in scales:
        if n >= scale:
            return f"{head}{fixed(n / scale, places)}{name}"
    return head + _grouped(whole(n), currency)


def exact(v: float | None, currency: str = "INR") -> str:
    """In full, with up to two decimals."""
    if _missing(v):
        return NONE
    digits, _, rest = fixed(abs(v), 2).partition(".")
    rest = rest.rstrip("0")
    return symbol(currency) + ("-" if v < 0 else "") + _grouped(int(digits), currency) + (f".{rest}" if rest else "")


def metric(v: float | None, kind: str, currency: str = "INR") -> str:
    if _missing(v):
        return NONE
    shown = {"currency": lambda: money(v, currency), "percent": lambda: f"{fixed(v * 100, 1)}%", "times": lambda: f"{fixed(v, 2)}×", "days": lambda: f"{whole(v)} days"}
    return shown.get(kind, lambda: fixed(v, 2))()


def change(v: float | None, share: float | None, kind: str, currency: str = "INR") -> str | None:
    """A change: money with its share, points for percentages, else the share, else the difference."""
    if _missing(v):
        return None
    plus = "+" if v > 0 else ""
    part = None if _missing(share) else f"{plus}{fixed(share * 100, 1)}%"
    if kind == "currency":
        return f"{plus}{money(v, currency)}" + (f" ({part})" if part else "")
    return f"{plus}{fixed(v * 100, 1)} pts" if kind == "percent" else part or f"{plus}{fixed(v, 2)}"


def file_size(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{fixed(n / 1024, 0)} KB" if n < 1024**2 else f"{fixed(n / 1024**2, 1)} MB"


def duration(ms: int) -> str:
    return f"{ms} ms" if ms < 1000 else f"{fixed(ms / 1000, 1)} s"


def lower_first(text: str) -> str:
    """The first letter in lower case, unless the text starts with an acronym or with no letter."""
    letter = lambda c: c.isascii() and c.isalpha()
    if not text[:1] or not letter(text[0]) or (len(text) > 1 and text[:2].isupper() and letter(text[1])):
        return text
    return text[0].lower() + text[1:]


def lower_first_column(text: Column) -> Column:
    stays = ~text.rlike("^[A-Za-z]") | text.rlike("^[A-Z]{2}")
    return F.when(stays, text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def _column(function, kind: str, *columns: Column) -> Column:
    """A function of this module over columns. Rounding of the exact binary value isn't among the built-in functions, hence pandas."""

    @F.pandas_udf(kind)
    def run(rows: pd.DataFrame) -> pd.Series:
        plain = rows.astype(object).where(rows.notna(), None)
        return pd.Series([function(*r) for r in plain.itertuples(index=False, name=None)], dtype=object)

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))


def money_column(v: Column, currency: Column) -> Column:
    return _column(money, "string", v, currency)


def exact_column(v: Column, currency: Column) -> Column:
    return _column(exact, "string", v, currency)


def metric_column(v: Column, kind: Column, currency: Column) -> Column:
    return _column(metric, "string", v, kind, currency)


def change_column(v: Column, share: Column, kind: Column, currency: Column) -> Column:
    return _column(change, "string", v, share, kind, currency)


def file_size_column(n: Column) -> Column:
    return _column(lambda x: None if x is None else file_size(int(x)), "string", n)


def duration_column(ms: Column) -> Column:
    return _column(lambda x: None if x is None else duration(int(x)), "string", ms)


def texts(shown: dict[str, tuple[Column, str]], currency: Column) -> Column:
    """A struct of texts, by name: the number and its kind (of metric(), or "change": a percentage with its sign). Null for missing numbers. One pass for all."""
    kinds = {k: kind for k, (_, kind) in shown.items()}

    @F.pandas_udf("struct<" + ",".join(f"{k}:string" for k in shown) + ">")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        said = {}
        for k, kind in kinds.items():
            own = zip(rows[k], rows["_currency"], strict=True)
            said[k] = [None if _missing(v) else f"{'+' if v > 0 else ''}{metric(v, 'percent')}" if kind == "change" else metric(v, kind, c) for v, c in own]
        return pd.DataFrame(said, index=rows.index, dtype=object)

    return run(F.struct(*[v.cast("double").alias(k) for k, (v, _) in shown.items()], currency.alias("_currency")))


def confidence_tier(sure: Column) -> Column:
    pct = F.floor(sure * 100 + 0.5)
    return F.when(pct >= 80, "High").when(pct >= 60, "Moderate").otherwise("Low")


def improving(moved: Column, higher_is_better: Column) -> Column:
    """Whether a change is for the better; null where that isn't known."""
    return F.when(moved.isNotNull() & higher_is_better.isNotNull(), F.when(higher_is_better, moved > 0).otherwise(moved < 0))


def arrow(moved: Column) -> Column:
    return F.when(moved > 0, "up").when(moved < 0, "down").otherwise("level")


def provenance(origin: Column, confidence: Column, label: Column, raw: Column, page: Column, repaired: Column) -> Column:
    """Where a figure comes from, in lines."""
    source = F.when(origin == "derived", "computed").when(origin == "assisted", "assisted").otherwise("read from the document")
    return F.concat_ws(
        "\n",
        F.when(label.isNotNull(), F.concat(F.lit("Caption: "), label)),
        F.when(raw.isNotNull(), F.concat(F.lit("Printed as: "), raw)),
        F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))),
        F.concat(F.lit("Source: "), source, F.lit(", confidence "), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%")),
        F.when(repaired, "Digits were repaired."),
    )
