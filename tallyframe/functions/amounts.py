"""Amounts as printed or scanned: shape test, parsing with repair, confidence, display."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that scans confuse with a digit, and those that may separate groups.
LOOKALIKES = {
    "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "t": "1", "T": "1", "r": "1",
    "O": "0", "o": "0", "Q": "0", "D": "0",
    "S": "5", "s": "5",
    "B": "8",
    "Z": "2", "z": "2",
    "g": "9", "q": "9",
    "b": "6", "G": "6",
}
SEPARATORS = ",.'\"_;:J  –—-"
_IN_CLASS = ",.'\"_;:J \\u00a0–—\\-"
SHAPE = rf"^[()+\-]?[0-9lIioOQDSsBZzgqbGtTr|!{_IN_CLASS}]+[()%]?$"
_CURRENCY = re.compile(r"[₹$€£]|(?:^|(?<=\s))(?:rs\.?|inr|usd|eur)(?=\s|$)", re.I)
AMOUNT = "struct<value:double,confidence:double,repaired:boolean,raw:string>"


def numericish(text: Column) -> Column:
    """Whether all of a token is of the alphabet of amounts."""
    return F.trim(text).rlike(SHAPE)


def looks_like_amount(text: Column) -> Column:
    """Whether a token is a plausible amount: bare numbers of up to four digits aren't."""
    t = F.trim(text)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return numericish(text) & (digits >= 2) & (t.rlike(f"[{_IN_CLASS}]") | (digits > 4) | t.rlike("[()]"))


def is_amount(text: str) -> bool:
    """The same for a single text."""
    t = text.strip()
    digits = sum(c in "0123456789" for c in t)
    return bool(re.fullmatch(SHAPE[1:-1], t)) and digits >= 2 and (digits > 4 or any(c in SEPARATORS or c in "()" for c in t))


def grouping_quality(groups: list[str]) -> float:
    """How regular digit groups are."""
    if len(groups) == 1:
        return 0.85
    head, tail = groups[0], groups[1:]
    if len(head) <= 3 and all(len(g) == 3 for g in tail):
        return 1.0
    if len(head) <= 2 and len(tail[-1]) == 3 and all(len(g) == 2 for g in tail[:-1]):
        return 1.0
    return 0.7 if len({len(g) for g in tail}) == 1 else 0.45


def parse_amount(raw: str | None) -> tuple[float, float, bool, str] | None:
    """value, confidence, whether digits were repaired, and the text; None for prose."""
    s = _CURRENCY.sub(" ", (raw or "").strip()).strip()
    opened, closed = s.startswith("("), s.endswith(")")
    negative = opened or closed
    if opened and closed and len(s) > 1:
        s = s[1:-1]
    elif negative:
        s = s.replace("(", "").replace(")", "")
    s = s.strip()
    if s[:1] in tuple("-–—"):
        negative, s = True, s[1:]
    elif s[-1:] in tuple("-–—") and re.search("[0-9]", s):
        negative, s = True, s[:-1]
    s = s.removesuffix("%").strip()
    chars, repaired = list(s), False
    for i, c in enumerate(chars):
        if c in LOOKALIKES and any(0 <= j < len(chars) and (chars[j] in SEPARATORS or chars[j] in "0123456789") for j in (i - 1, i + 1)):
            chars[i], repaired = LOOKALIKES[c], True
    if not any(c in "0123456789" for c in chars) or any(c not in "0123456789" and c not in SEPARATORS for c in chars):
        return None
    groups, marks = [""], []
    for c in chars:
        if c in SEPARATORS:
            marks.append(c)
            groups.append("")
        else:
            groups[-1] += c
    last = marks[-1] if marks else ""
    groups = [g for g in groups if g]
    fraction = groups.pop() if len(groups) > 1 and last == "." and len(groups[-1]) <= 2 else ""
    digits = "".join(groups)
    if len(digits) > 18:
        return None
    value = float(int(digits)) + (int(fraction) / 10 ** len(fraction) if fraction else 0.0)
    confidence = grouping_quality(groups) * (0.8 if repaired else 1.0) * (0.85 if len(set(marks)) > 1 else 1.0)
    return (-value if negative else value), max(0.2, min(1.0, confidence)), repaired, raw


#: White space that str.strip() takes off, for expressions of the JVM.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ALIKE, _DASHES = "".join(f"\\{c}" if c == "|" else c for c in LOOKALIKES), "\\-–—"


def _stripped(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_SPACE}+|{_SPACE}+$", "")


# Amounts that need no repair: bare digits, groups of three, or Indian groups; in brackets, or with a dash before or after.
CLEAN = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}|[0-9]+)"


def parse_amount_column(text: Column) -> Column:
    """parse_amount over a column, in built-in functions. Clean amounts, the most frequent, are read by a shorter way.

    Repair goes from left to right, and a repaired digit vouches for the look-alike that follows it; so a run of look-alikes is
    repaired whole after a digit or a separator, and at the start only if it's a single one before such.
    """
    s = _stripped(F.regexp_replace(_stripped(text), rf"(?i)[₹$€£]|(?:^|(?<={_SPACE}))(?:rs\.?|inr|usd|eur)(?={_SPACE}|$)", " "))
    step = lambda own, then: F.transform(F.array(own), then)[0]  # a name for an expression that is used often

    def signed(s: Column) -> Column:
        opened, closed = s.startswith("("), s.endswith(")")
        bare = F.when(opened & closed & (F.length(s) > 1), F.substring(s, F.lit(2), F.length(s) - 2)).when(opened | closed, F.regexp_replace(s, "[()]", "")).otherwise(s)
        return step(F.struct(_stripped(bare).alias("s"), (opened | closed).alias("negative")), undashed)

    def undashed(x: Column) -> Column:
        s = x["s"]
        first, last = s.rlike(f"^[{_DASHES}]"), s.rlike(f"[{_DASHES}]$") & s.rlike("[0-9]")
        bare = F.when(first, F.substring(s, F.lit(2), F.length(s))).when(last, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
        return step(F.struct(_stripped(F.regexp_replace(bare, "%$", "")).alias("s"), (x["negative"] | first | last).alias("negative")), repaired)

    def repaired(x: Column) -> Column:
        fixed = F.translate(x["s"], "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
        fine = x["s"].rlike(f"^[{_ALIKE}]?[0-9{_IN_CLASS}][0-9{_IN_CLASS}{_ALIKE}]*$") & fixed.rlike("[0-9]")
        groups = F.filter(F.split(fixed, f"[{_IN_CLASS}]"), lambda g: g != "")
        marks = F.regexp_replace(fixed, "[0-9]", "")
        return F.when(fine, step(F.struct(groups.alias("groups"), marks.alias("marks"), (fixed != x["s"]).alias("repaired"), x["negative"].alias("negative")), read))

    def read(x: Column) -> Column:
        groups, n = x["groups"], F.size(x["groups"])
        split = (n > 1) & x["marks"].endswith(".") & (F.length(F.element_at(groups, -1)) <= 2)
        whole = F.when(split, F.slice(groups, F.lit(1), n - 1)).otherwise(groups)
        fraction = F.when(split, F.element_at(groups, -1).cast("double") / F.pow(F.lit(10.0), F.length(F.element_at(groups, -1)))).otherwise(0.0)
        several = F.length(F.regexp_replace(x["marks"], r"(.)(?=.*\1)", "")) > 1
        return step(F.struct(whole.alias("groups"), fraction.alias("fraction"), several.alias("several"), x["repaired"].alias("repaired"), x["negative"].alias("negative")), valued)

    def valued(x: Column) -> Column:
        groups, digits = F.array_join(x["groups"], ","), F.array_join(x["groups"], "")
        tail = F.array_distinct(F.transform(F.slice(x["groups"], F.lit(2), F.size(x["groups"])), lambda g: F.length(g)))
        quality = F.when(F.size(x["groups"]) == 1, 0.85).when(groups.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$|^[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}$"), 1.0).when(F.size(tail) == 1, 0.7).otherwise(0.45)
        sure = quality * F.when(x["repaired"], 0.8).otherwise(1.0) * F.when(x["several"], 0.85).otherwise(1.0)
        value = digits.try_cast("double") + x["fraction"]
        out = F.struct(F.when(x["negative"], -value).otherwise(value).alias("value"), F.greatest(F.lit(0.2), F.least(F.lit(1.0), sure)).alias("confidence"), x["repaired"].alias("repaired"), text.alias("raw"))
        return F.when(F.length(digits) <= 18, out)

    bare = F.regexp_replace(text, "[^0-9]", "")
    clean = text.rlike(rf"^(?:{CLEAN}|\({CLEAN}\)|-{CLEAN}|{CLEAN}-)$") & (F.length(bare) <= 18)
    sign = F.when(text.rlike("[(-]"), F.lit(-1.0)).otherwise(1.0)
    plain = F.struct((bare.try_cast("double") * sign).alias("value"), F.when(F.contains(text, F.lit(",")), 1.0).otherwise(0.85).alias("confidence"), F.lit(False).alias("repaired"), text.alias("raw"))
    return F.when(clean, plain).otherwise(step(s, signed))


def fixed(value: float, places: int) -> str:
    """Decimal text of the exact binary value, ties away from zero."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def indian_groups(n: int) -> str:
    s = str(n)
    head, tail = s[:-3], s[-3:]
    while len(head) > 2:
        head, tail = head[:-2], f"{head[-2:]},{tail}"
    return f"{head},{tail}" if head else tail


def money(value: float, symbol: str = "₹", indian: bool = True) -> str:
    """Short text of an amount: crores and lakhs, or billions, millions and thousands."""
    sign, n = "-" if value < 0 else "", abs(value)
    scales = [(1e7, " Cr"), (1e5, " L")] if indian else [(1e9, "B"), (1e6, "M"), (1e3, "K")]
    for scale, name in scales:
        if n >= scale:
            return f"{sign}{symbol}{fixed(n / scale, 2)}{name}"
    whole = int(Decimal(n).quantize(Decimal(1), ROUND_HALF_UP))
    return f"{sign}{symbol}{indian_groups(whole) if indian else f'{whole:,}'}"
