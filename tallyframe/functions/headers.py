"""What headers say: years, months, units and currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, and letters that are read as digits in a year.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
YEAR_LETTERS = {"l": "1", "I": "1", "|": "1", "!": "1", "o": "0", "O": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "b": "8"}
# Units and currencies in the order in which they are tried.
_UNIT = r"\bin\s+(?:(?:rs\.?|inr|usd|eur|gbp|₹|\$|€|£)\s*)?(?:{})\b"
UNITS = [("crores?|crs?", 1e7, "Crore"), ("lakhs?|lacs?", 1e5, "Lakh"), ("millions?|mns?", 1e6, "Million"), ("thousands?|'?000s?", 1e3, "Thousand")]
CURRENCIES = [(r"₹|\binr\b|indian rupees?\b|\brs\.?\b", "INR"), (r"\busd\b|\bus dollars?\b|\$", "USD"), (r"\beur\b|\beuros?\b|€", "EUR"), (r"\bgbp\b|\bpounds?\b|£", "GBP")]


def year(text: Column) -> Column:
    """The first year from 1950 to 2049, letters that look like digits read as these."""
    found = F.regexp_extract(F.translate(text, "".join(YEAR_LETTERS), "".join(YEAR_LETTERS.values())), r"\b(19[5-9][0-9]|20[0-4][0-9])\b", 1)
    return F.when(found != "", found.try_cast("int"))


def month(text: Column) -> Column:
    """The first month of the calendar whose three letters the text holds."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), i) for i, m in enumerate(MONTHS, 1)])


def period_end(y: Column, m: Column) -> Column:
    """The last day of a month; March where only the year is known."""
    return F.when(y.isNotNull(), F.last_day(F.make_date(y, F.coalesce(m, F.lit(3)), F.lit(1))))


def unit_scale(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(_UNIT.format(p)), F.lit(s)) for p, s, _ in UNITS], F.lit(1.0))


def unit_label(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(_UNIT.format(p)), F.lit(n)) for p, _, n in UNITS], F.lit("Absolute"))


def currency(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for p, n in CURRENCIES], F.lit("INR"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# What is taken out of a period's name.
UNNAMED = (r"(?i)\(?amount\s*in\s*[^)]*\)?", r"(?i)\(rs\.?\)", r"[^A-Za-z0-9_\s,'-]")


def header_label(text: Column, y: Column) -> Column:
    """What a period is called: the header's own words if they are short and hold a digit."""
    for pattern in UNNAMED:
        text = F.regexp_replace(text, pattern, " ")
    s = squeezed(text)
    return F.when(F.length(s).between(6, 40) & s.rlike("[0-9]"), s).when(y.isNotNull(), F.concat(F.lit("FY "), y)).when(s != "", s).otherwise("Period")
