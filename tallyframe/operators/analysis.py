"""Figures to findings: roll-ups, the accounting identity, metrics, changes, insights. Column expressions and windows throughout.

Input is the long table of figures: doc_id, concept, period_id, ord (newest highest), value, origin, confidence, and where there
is any its provenance: page, source_label, raw, repaired. One shuffle brings a document's period together; every total, check and
metric is then a column of that row. Numbers become text at the very end, in one pass over a few columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display
from ..functions.chart import COMPOSITION, CONCEPTS, TOTALS, about, label_of
from ..store import settled

#: Relative difference up to which a printed total is taken to agree with its parts.
AGREES = 0.02
#: What a figure carries along, and its types.
PROVENANCE = {"page": "int", "source_label": "string", "raw": "string", "repaired": "boolean"}
FIGURE = ("value", "origin", "confidence", *PROVENANCE)
#: Origins in the order in which a figure is marked by them.
MARKS = ("derived", "assisted", "repaired")


def with_provenance(figures: DataFrame) -> DataFrame:
    """figures with the columns of PROVENANCE, null where there are none."""
    return figures.withColumns({k: F.lit(None).cast(t) for k, t in PROVENANCE.items() if k not in figures.columns})


def wide(figures: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """A row for each document and period: a struct (FIGURE) for each concept, null where there is none. periods (doc_id, period_id, ord) adds those without any figure."""
    one = lambda c: F.max(F.when(F.col("concept") == c, F.struct(*FIGURE))).alias(c)
    rows = with_provenance(figures)
    if periods is not None:
        bare = periods.select("doc_id", "period_id", "ord", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("concept", *FIGURE)])
        rows = rows.select("doc_id", "period_id", "ord", "concept", *FIGURE).unionByName(bare)
    return rows.groupBy("doc_id", "period_id", "ord").agg(*[one(c["concept"]) for c in CONCEPTS])


def roll_up(rows: DataFrame) -> DataFrame:
    """Totals from their parts, lower ones first. A printed total stays if it agrees, and is surer then; else the parts count, less surely."""
    for total, parts in COMPOSITION.items():
        values = [F.col(f"{p}.value") for p in parts]
        some = reduce(lambda a, b: a | b, [v.isNotNull() for v in values])
        added = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
        weakest = F.least(*[F.col(f"{p}.confidence") for p in parts]) * 0.97
        own, printed = F.col(f"{total}.value"), F.col(f"{total}.origin") == "extracted"
        agrees = F.abs(own - added) / F.greatest(F.abs(own), F.abs(added), F.lit(1.0)) <= AGREES
        derived = lambda sure: F.struct(added.alias("value"), F.lit("derived").alias("origin"), sure.alias("confidence"), *[F.lit(None).cast(t).alias(k) for k, t in PROVENANCE.items()])
        kept = F.col(total).withField("confidence", F.least(F.lit(1.0), F.col(f"{total}.confidence") * 1.1))
        rows = rows.withColumn(total, F.when(~some, F.col(total)).when(printed & agrees, kept).when(printed, derived(weakest * 0.85)).otherwise(derived(weakest)))
    return rows


def long(rows: DataFrame) -> DataFrame:
    """Back to a row for each figure."""
    each = F.explode(F.array(*[F.struct(F.lit(c["concept"]).alias("concept"), F.col(c["concept"]).alias("v")) for c in CONCEPTS]))
    return rows.select("doc_id", "period_id", "ord", each.alias("x")).filter("x.v is not null").select("doc_id", "period_id", "ord", "x.concept", "x.v.*")


def mean_confidence(figures: DataFrame) -> DataFrame:
    """doc_id, confidence: how sure a document's figures are on average; 0 without any."""
    return figures.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def identity() -> dict[str, Column]:
    """The columns of the accounting identity, of a row after roll_up()."""
    assets, claims = F.col("totalAssets.value"), F.col("totalEquityAndLiabilities.value")
    relative = F.when(assets.isNotNull() & claims.isNotNull(), F.abs(assets - claims) / F.greatest(F.abs(assets), F.abs(claims), F.lit(1.0)))
    status = F.when(relative.isNull(), "insufficient-data").when(relative <= 0.001, "balanced").when(relative <= 0.01, "minor-variance").otherwise("imbalanced")
    return {"assets": assets, "claims": claims, "difference": assets - claims, "relative": relative, "status": status}


def balance_checks(rows: DataFrame) -> DataFrame:
    """rows: after roll_up(). doc_id, period_id, ord, assets, claims, difference, relative, status, message."""
    out = rows.select("doc_id", "period_id", "ord", *[c.alias(k) for k, c in identity().items()])
    off = F.concat(F.format_number(F.col("relative") * 100, 3), F.lit("%"))
    message = (
        F.when(F.col("status") == "insufficient-data", "One side of the balance sheet is missing, so it can't be checked.")
        .when(F.col("difference") == 0, "Both sides are equal.")
        .when(F.col("status") == "balanced", F.concat(F.lit("Both sides agree within "), off, F.lit(".")))
        .when(F.col("status") == "minor-variance", F.concat(F.lit("The sides differ by "), off, F.lit("; a line may be missing or misread.")))
        .otherwise(F.concat(F.lit("The sides differ by "), off, F.lit("; lines are missing, and ratios may mislead.")))
    )
    return out.withColumn("message", message)


# Fixed values. Metric: format, category, whether higher is better, bands (up: at least; down: at most) for strong, healthy, watch.
METRICS = {
    "currentRatio": ("ratio", "liquidity", True, ("up", 2, 1.5, 1)),
    "quickRatio": ("ratio", "liquidity", True, ("up", 1.5, 1, 0.75)),
    "cashRatio": ("ratio", "liquidity", True, ("up", 0.5, 0.25, 0.1)),
    "workingCapital": ("currency", "liquidity", True, None),
    "totalDebt": ("currency", "leverage", False, None),
    "netWorth": ("currency", "structure", True, None),
    "debtToEquity": ("times", "leverage", False, ("down", 0.5, 1, 2)),
    "assetToLiability": ("times", "structure", True, ("up", 1.75, 1.3, 1)),
    "debtToAssets": ("percent", "leverage", False, ("down", 0.3, 0.5, 0.7)),
    "equityRatio": ("percent", "structure", True, ("up", 0.6, 0.4, 0.25)),
    "inventoryShareOfCurrentAssets": ("percent", "efficiency", False, ("down", 0.3, 0.5, 0.65)),
}
#: Metric: what it tells, and its formula; the names in braces are columns of parts().
METRIC_TEXTS = {
    "currentRatio": ("How far current assets cover what falls due within a year.", "{ca} / {cl}"),
    "quickRatio": ("The same cover, inventories left out.", "({ca} - {inv}) / {cl}"),
    "cashRatio": ("The same cover, by cash alone.", "{cash} / {cl}"),
    "workingCapital": ("What is left of current assets after all current liabilities.", "{ca} - {cl}"),
    "totalDebt": ("Borrowings of any term.", "{lt} + {st}"),
    "netWorth": ("What belongs to the owners.", "{eq}"),
    "debtToEquity": ("Borrowings against the owners' funds.", "{debt} / {eq}"),
    "assetToLiability": ("How far all assets cover all liabilities.", "{ta} / {tl}"),
    "debtToAssets": ("The share of assets that borrowings pay for.", "{debt} / {ta}"),
    "equityRatio": ("The share of assets that the owners pay for.", "{eq} / {ta}"),
    "inventoryShareOfCurrentAssets": ("How much of current assets is stock.", "{inv} / {ca}"),
}
PARTS = {
    "ca": "totalCurrentAssets", "cl": "totalCurrentLiabilities", "ta": "totalAssets", "tl": "totalLiabilities", "eq": "totalEquity", "inv": "inventories",
    "cash": "cashAndCashEquivalents", "lt": "longTermBorrowings", "st": "shortTermBorrowings", "debt": "totalDebt",
}


def dim_metric(spark: SparkSession) -> DataFrame:
    """metric, seq, label, description, formula, format, category, higher_is_better."""
    names = {k: label_of(v).lower() for k, v in PARTS.items()}
    rows = [(m, i, label_of(m), METRIC_TEXTS[m][0], METRIC_TEXTS[m][1].format(**names), f, c, up) for i, (m, (f, c, up, _)) in enumerate(METRICS.items())]
    return spark.createDataFrame(rows, "metric string, seq int, label string, description string, formula string, format string, category string, higher_is_better boolean")


def ratio(a: Column, b: Column) -> Column:
    """Null where either is missing or the divisor is zero."""
    return F.try_divide(a, b)


def metric_columns() -> dict[str, Column]:
    v = lambda c: F.col(f"{c}.value")
    ca, cl, ta, tl, eq = v("totalCurrentAssets"), v("totalCurrentLiabilities"), v("totalAssets"), v("totalLiabilities"), v("totalEquity")
    inv = v("inventories")
    lt, st = v("longTermBorrowings"), v("shortTermBorrowings")
    debt = F.when(lt.isNotNull() | st.isNotNull(), F.coalesce(lt, F.lit(0.0)) + F.coalesce(st, F.lit(0.0)))
    return {
        "currentRatio": ratio(ca, cl), "quickRatio": ratio(ca - F.coalesce(inv, F.lit(0.0)), cl), "cashRatio": ratio(v("cashAndCashEquivalents"), cl),
        "workingCapital": ca - cl, "totalDebt": debt, "netWorth": eq, "debtToEquity": ratio(debt, eq), "assetToLiability": ratio(ta, tl),
        "debtToAssets": ratio(debt, ta), "equityRatio": ratio(eq, ta), "inventoryShareOfCurrentAssets": ratio(inv, ca),
    }


def verdict(metric: str, value: Column, liabilities: Column) -> Column:
    """strong, healthy, watch, weak or neutral; liabilities: total current liabilities, for working capital."""
    bands = METRICS[metric][3]
    if bands:
        way, *limits = bands
        meets = [value >= x if way == "up" else value <= x for x in limits]
        graded = F.when(meets[0], "strong").when(meets[1], "healthy").when(meets[2], "watch").otherwise("weak")
    elif metric == "workingCapital":
        graded = F.when((value > 0) & (value > 0.5 * liabilities), "strong").when(value > 0, "healthy").otherwise("weak")
    elif metric == "netWorth":
        graded = F.when(value > 0, "healthy").otherwise("weak")
    else:
        graded = F.lit("neutral")
    return F.when(value.isNull(), "neutral").otherwise(graded)


def metrics(rows: DataFrame) -> DataFrame:
    """rows: after roll_up(). doc_id, period_id, ord, metric, value, verdict, change and change_pct against the period before; metrics that a document has in no period go."""
    wide_rows = rows.select("doc_id", "period_id", "ord", F.col("totalCurrentLiabilities.value").alias("cl"), *[c.alias(m) for m, c in metric_columns().items()])
    each = [F.struct(F.lit(m).alias("metric"), F.lit(i).alias("seq"), F.col(m).cast("double").alias("value"), verdict(m, F.col(m), F.col("cl")).alias("verdict")) for i, m in enumerate(METRICS)]
    out = wide_rows.select("doc_id", "period_id", "ord", F.explode(F.array(*each)).alias("x")).select("doc_id", "period_id", "ord", "x.*")
    every, newest = Window.partitionBy("doc_id", "metric"), Window.partitionBy("doc_id", "metric").orderBy(F.desc("ord"), "period_id")
    out = out.withColumns({"known": F.count("value").over(every), "before": F.lead("value").over(newest)}).filter("known > 0")
    change = F.col("value") - F.col("before")
    return out.withColumns({"change": change, "change_pct": ratio(change, F.abs("before"))}).drop("known", "before")


def _with_currency(rows: DataFrame, companies: DataFrame | None) -> DataFrame:
    """rows with the document's currency, name and unit; rupees and no name where nothing is told."""
    if companies is None:
        return rows.withColumns({"currency": F.lit("INR"), "name": F.lit(None).cast("string")})
    return rows.join(companies.select("doc_id", "currency", "name"), "doc_id", "left").withColumn("currency", F.coalesce("currency", F.lit("INR")))


def workings(rows: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """rows: after roll_up(). doc_id, period_id, metric, workings: each metric's formula with its figures, where it has a value."""
    value, own = lambda k: F.col(f"{PARTS[k]}.value") if k != "debt" else metric_columns()["totalDebt"], _with_currency(rows, companies)
    told = display.texts({k: (F.coalesce(value(k), F.lit(0.0)), "currency") for k in PARTS}, F.col("currency"))
    own = own.select("doc_id", "period_id", told.alias("t"), *[c.isNotNull().alias(m) for m, c in metric_columns().items()])

    def text(formula: str) -> Column:
        pieces = [x for part in formula.split("{") for x in part.split("}")]
        return F.concat(*[F.col(f"t.{x}") if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x or i % 2])

    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(F.col(m), text(METRIC_TEXTS[m][1])).alias("workings")) for m in METRICS]))
    return own.select("doc_id", "period_id", each.alias("x")).select("doc_id", "period_id", "x.*").filter("workings is not null")


SEVERITY, KIND = ("high", "medium", "low"), ("concern", "strength", "trend", "observation")


def latest_two(rows: DataFrame) -> DataFrame:
    """A row for each document: figures, metrics and check of its latest period, and figures and metrics of the one before as p_*."""
    flat = rows.select("doc_id", "period_id", "ord", identity()["status"].alias("status"), *[F.col(f"{c['concept']}.value").alias(c["concept"]) for c in CONCEPTS], *[x.alias(f"m_{m}") for m, x in metric_columns().items()])
    newest = Window.partitionBy("doc_id").orderBy(F.desc("ord"), "period_id")
    names = [c for c in flat.columns if c not in ("doc_id", "period_id", "ord", "status")]
    out = flat.withColumns({"i": F.row_number().over(newest), "two": F.lead("ord").over(newest).isNotNull(), **{f"p_{n}": F.lead(n).over(newest) for n in names}})
    return out.filter("i = 1")


def delta(name: str) -> Column:
    """Relative change of a column against the period before."""
    return ratio(F.col(name) - F.col(f"p_{name}"), F.abs(f"p_{name}"))


def insight_rules() -> list[tuple[int, Column, Column, Column, Column, list[str]]]:
    """Rule number, id, condition, kind, severity, evidence, in the order of evaluation."""
    lit, c = F.lit, F.col
    cr, qr, de, al, share = c("m_currentRatio"), c("m_quickRatio"), c("m_debtToEquity"), c("m_assetToLiability"), c("m_inventoryShareOfCurrentAssets")
    funding = ratio(c("shortTermBorrowings"), c("totalCurrentLiabilities"))
    debt, size = delta("m_totalDebt"), delta("totalAssets")
    reserves, prior = c("reservesAndSurplus"), c("p_reservesAndSurplus")
    out = [
        (1, lit("liquidity-strong"), cr >= 2, lit("strength"), lit("low"), ["m_currentRatio", "m_workingCapital"]),
        (1, lit("liquidity-adequate"), (cr >= 1) & (cr < 2), lit("observation"), lit("medium"), ["m_currentRatio"]),
        (1, lit("liquidity-deficit"), cr < 1, lit("concern"), lit("high"), ["m_currentRatio", "m_workingCapital"]),
        (2, lit("inventory-heavy-liquidity"), (share >= 0.45) & qr.isNotNull() & cr.isNotNull(), F.when(qr < 1, "concern").otherwise("observation"), F.when(qr < 1, "high").otherwise("medium"), ["m_quickRatio", "m_inventoryShareOfCurrentAssets", "inventories"]),
        (3, lit("leverage-conservative"), de <= 1, lit("strength"), lit("low"), ["m_debtToEquity", "m_netWorth", "m_totalDebt"]),
        (3, lit("leverage-moderate"), (de > 1) & (de <= 2), lit("observation"), lit("medium"), ["m_debtToEquity", "m_totalDebt"]),
        (3, lit("leverage-high"), de > 2, lit("concern"), lit("high"), ["m_debtToEquity", "m_totalDebt", "m_netWorth"]),
        (4, lit("short-term-funding-concentration"), funding >= 0.55, lit("concern"), F.when(funding >= 0.75, "high").otherwise("medium"), ["shortTermBorrowings", "totalCurrentLiabilities"]),
        (5, lit("debt-trend"), c("two") & (F.abs(debt) >= 0.05), F.when(debt < 0, "strength").otherwise("concern"), F.when(debt < 0, "low").when(debt > 0.25, "high").otherwise("medium"), ["m_totalDebt", "m_debtToEquity"]),
        (6, lit("balance-sheet-size-trend"), c("two") & (F.abs(size) >= 0.05), lit("trend"), F.when(F.abs(size) > 0.2, "medium").otherwise("low"), ["totalAssets"]),
    ]
    for name in ("inventories", "tradeReceivables", "cashAndCashEquivalents", "tradePayables"):
        falls = (delta(name) < -0.4) if name == "cashAndCashEquivalents" else lit(False)
        out.append((7, lit(f"mover-{name}"), c("two") & (F.abs(delta(name)) >= 0.2), F.when(falls, "concern").otherwise("trend"), F.when(falls, "medium").otherwise("low"), [name]))
    moved = reserves - prior
    return [
        *out,
        (8, lit("solvency-cushion"), al >= 1.3, lit("strength"), lit("low"), ["m_assetToLiability", "m_netWorth"]),
        (8, lit("solvency-thin"), (al >= 1) & (al < 1.3), lit("observation"), lit("medium"), ["m_assetToLiability"]),
        (8, lit("solvency-negative"), al < 1, lit("concern"), lit("high"), ["m_assetToLiability", "m_netWorth"]),
        (9, lit("reserves-trend"), c("two") & (F.abs(moved) >= F.abs(prior) * 0.01), F.when(moved > 0, "strength").otherwise("concern"), F.when(moved > 0, "low").otherwise("medium"), ["reservesAndSurplus", "m_netWorth"]),
        (10, lit("identity-unverified"), c("status") == "insufficient-data", lit("observation"), lit("medium"), []),
        (10, lit("identity-variance"), c("status").isin("minor-variance", "imbalanced"), lit("concern"), F.when(c("status") == "imbalanced", "high").otherwise("medium"), []),
    ]


#: What each finding says: title and detail. The names in braces are texts of _said(); a bracketed part goes where a text is missing.
INSIGHT_TEXTS = {
    "liquidity-strong": ("Current assets cover current liabilities {cr}", "Current assets are {cr} of current liabilities[ ({p_cr} the year before)], which leaves {wc} of working capital."),
    "liquidity-adequate": ("Current assets cover current liabilities {cr}, with little to spare", "The cover is {cr}[ ({p_cr} the year before)]; late payments or a loss on stock could use it up."),
    "liquidity-deficit": ("Current assets cover current liabilities only {cr}", "What falls due within a year is more than current assets[; the cover was {p_cr} the year before]. New funds or cash from trading are needed in time."),
    "inventory-heavy-liquidity": ("{share} of current assets are inventories", "Inventories of {inv} are {share} of current assets of {ca}. Without them the cover falls from {cr} to {qr}."),
    "leverage-conservative": ("Debt is {de} of equity, which is moderate", "Borrowings of {debt} stand against equity of {eq}[; the ratio was {p_de} the year before]."),
    "leverage-moderate": ("Debt is {de} of equity", "Borrowings of {debt} are more than equity of {eq}[; the ratio was {p_de} the year before]."),
    "leverage-high": ("Debt is {de} of equity, which is high", "Borrowings of {debt} are more than twice the equity of {eq}[; the ratio was {p_de} the year before]."),
    "short-term-funding-concentration": ("{funding} of current liabilities are short-term borrowings", "Short-term borrowings of {stb} make up {funding} of current liabilities of {cl}, and have to be renewed within the year."),
    "debt-trend": ("Total debt moved by {d_debt} in a year", "Total debt went from {p_debt} to {debt}, by {d_debt}."),
    "balance-sheet-size-trend": ("Total assets moved by {d_assets} in a year", "Total assets went from {p_assets} to {assets}, by {d_assets}."),
    "mover-inventories": ("Inventories moved by {d_inv} in a year", "Inventories went from {p_inv} to {inv}."),
    "mover-tradeReceivables": ("Trade receivables moved by {d_rec} in a year", "Trade receivables went from {p_rec} to {rec}."),
    "mover-cashAndCashEquivalents": ("Cash moved by {d_cash} in a year", "Cash and cash equivalents went from {p_cash} to {cash}."),
    "mover-tradePayables": ("Trade payables moved by {d_pay} in a year", "Trade payables went from {p_pay} to {pay}."),
    "solvency-cushion": ("Assets cover liabilities {al}", "All assets are {al} of all liabilities; equity of {eq} stands behind them."),
    "solvency-thin": ("Assets cover liabilities {al}, a thin margin", "All assets are only {al} of all liabilities."),
    "solvency-negative": ("Liabilities are more than all assets", "All assets are {al} of all liabilities; equity is {eq}."),
    "reserves-trend": ("Reserves moved by {moved} in a year", "Reserves and surplus went from {p_res} to {res}, equity is {eq}."),
    "identity-unverified": ("The two sides couldn't be compared", "A total of one side is missing in the latest period."),
    "identity-variance": ("The two sides of the balance sheet differ", "Total assets of {assets} stand against claims of {claims}; some lines may be missing or misread."),
}


def _said() -> dict[str, tuple[Column, str]]:
    """Name, number and kind of each text that findings and the summary use, of a row of latest_two()."""
    c = F.col
    out = {
        "cr": (c("m_currentRatio"), "times"), "p_cr": (c("p_m_currentRatio"), "times"), "qr": (c("m_quickRatio"), "times"), "wc": (c("m_workingCapital"), "currency"), "share": (c("m_inventoryShareOfCurrentAssets"), "percent"),
        "de": (c("m_debtToEquity"), "times"), "p_de": (c("p_m_debtToEquity"), "times"), "al": (c("m_assetToLiability"), "times"), "eq": (c("m_netWorth"), "currency"),
        "debt": (c("m_totalDebt"), "currency"), "p_debt": (c("p_m_totalDebt"), "currency"), "d_debt": (delta("m_totalDebt"), "change"),
        "ca": (c("totalCurrentAssets"), "currency"), "cl": (c("totalCurrentLiabilities"), "currency"), "stb": (c("shortTermBorrowings"), "currency"), "funding": (ratio(c("shortTermBorrowings"), c("totalCurrentLiabilities")), "percent"),
        "claims": (c("totalEquityAndLiabilities"), "currency"), "moved": (c("reservesAndSurplus") - c("p_reservesAndSurplus"), "currency"),
    }
    for k, name in (("assets", "totalAssets"), ("inv", "inventories"), ("rec", "tradeReceivables"), ("cash", "cashAndCashEquivalents"), ("pay", "tradePayables"), ("res", "reservesAndSurplus")):
        out |= {k: (c(name), "currency"), f"p_{k}": (c(f"p_{name}"), "currency"), f"d_{k}": (delta(name), "change")}
    return out


def _filled(text: str) -> Column:
    """A text with the names in braces filled in from the struct `t`."""
    parts = []
    for piece in text.replace("]", "[").split("["):
        own = [x for y in piece.split("{") for x in y.split("}")]
        parts.append(F.concat(*[F.col(f"t.{x}") if i % 2 else F.lit(x) for i, x in enumerate(own)]))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def insights(rows: DataFrame, companies: DataFrame | None = None, told: bool = True) -> DataFrame:
    """rows: after roll_up(). doc_id, insight, kind, severity, title, detail, evidence (metrics and concepts), position (from 1: severity, then kind, then rule order).

    Without `told` there is no title and no detail, and nothing is turned into text.
    """
    found = []
    for seq, (_, name, holds, kind, severity, evidence) in enumerate(insight_rules()):
        said = F.array(*[F.lit(e.removeprefix("m_")) for e in evidence]).cast("array<string>")
        found.append(F.when(holds, F.struct(F.lit(seq).alias("seq"), name.alias("insight"), kind.alias("kind"), severity.alias("severity"), said.alias("evidence"))))
    two = latest_two(rows)
    keep = ["doc_id"]
    if told:
        two = _with_currency(two, companies).withColumn("t", display.texts(_said(), F.col("currency")))
        keep.append("t")
    out = two.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("x")).select(*keep, "x.*")
    place = lambda c, order: F.array_position(F.array(*map(F.lit, order)), F.col(c))
    by = Window.partitionBy("doc_id").orderBy(place("severity", SEVERITY), place("kind", KIND), "seq")
    if told:
        texts = [reduce(lambda a, b: a.when(b[0], b[1]), [(F.col("insight") == k, _filled(v[i])) for k, v in INSIGHT_TEXTS.items()], F.when(F.lit(False), "")) for i in (0, 1)]
        out = out.withColumns({"title": texts[0], "detail": texts[1]})
    return out.select("doc_id", "insight", "kind", "severity", *(["title", "detail"] if told else []), "evidence", F.row_number().over(by).alias("position"))


def summary(rows: DataFrame, companies: DataFrame | None = None, periods: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """doc_id, summary: size and equity, liquidity and leverage, the first strength, the first concern; a fixed text without data. found: insights(), if they are at hand."""
    two = _with_currency(latest_two(rows), companies)
    first = (insights(rows, companies) if found is None else found).groupBy("doc_id").agg(*[F.min_by(F.when(F.col("kind") == k, display.lower_first_column(F.col("title"))), F.when(F.col("kind") == k, F.col("position"))).alias(k) for k in ("strength", "concern")])
    if periods is not None:
        two = two.join(periods.select("doc_id", "period_id", F.col("label").alias("called")), ["doc_id", "period_id"], "left")
    two = two.withColumn("t", display.texts(_said(), F.col("currency"))).join(first, "doc_id", "left")
    known = lambda c, text: F.when(F.col(c).isNotNull(), _filled(text))
    when = F.coalesce("called", "period_id") if periods is not None else F.col("period_id")
    parts = [
        F.concat(F.coalesce("name", F.lit("The company")), F.lit(" has total assets of "), known("totalAssets", "{assets}"), F.lit(" at "), when, F.coalesce(known("totalEquity", ", of which {eq} is equity"), F.lit("")), F.lit(".")),
        F.when(F.col("m_currentRatio").isNotNull() & F.col("m_debtToEquity").isNotNull(), _filled("The current ratio is {cr}, and debt is {de} of equity.")),
        F.concat(F.lit("First strength: "), F.col("strength"), F.lit(".")),
        F.concat(F.lit("First concern: "), F.col("concern"), F.lit(".")),
    ]
    text = F.concat_ws(" ", *parts)
    return two.select("doc_id", F.when(text == "", "The statement holds too few figures to sum up.").otherwise(text).alias("summary"))


# Fixed values. Bands of the two sides.
FUNDING = {
    "equity": ["totalEquity"], "longTermDebt": ["longTermBorrowings"], "otherLongTerm": ["deferredTaxLiabilities", "longTermProvisions", "otherNonCurrentLiabilities"],
    "shortTermDebt": ["shortTermBorrowings"], "operating": ["tradePayables", "otherCurrentLiabilities", "shortTermProvisions"],
}
DEPLOYMENT = {
    "fixed": ["totalNonCurrentAssets"], "inventories": ["inventories"], "receivables": ["tradeReceivables"], "cash": ["cashAndCashEquivalents", "currentInvestments"],
    "other": ["shortTermLoansAndAdvances", "otherCurrentAssets"],
}


def composition(rows: DataFrame, bands: dict[str, list[str]]) -> DataFrame:
    """doc_id, period_id, band, value (missing parts as zero), share of the period's positive bands; bands that are positive in no period go."""
    total = lambda parts: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{p}.value"), F.lit(0.0)) for p in parts])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), total(p).alias("value")) for b, p in bands.items()]))
    out = rows.select("doc_id", "period_id", each.alias("x")).select("doc_id", "period_id", "x.*")
    shown = F.max("value").over(Window.partitionBy("doc_id", "band")) > 0
    positive = F.when(F.col("value") > 0, F.col("value"))
    share = ratio(positive, F.sum(positive).over(Window.partitionBy("doc_id", "period_id")))
    return out.withColumns({"shown": shown, "share": share}).filter("shown").drop("shown")


def movers(rows: DataFrame) -> DataFrame:
    """doc_id, concept, change, change_pct, position: leaf figures of the last two periods, the largest change first."""
    both = latest_two(rows)
    each = F.explode(F.array(*[F.struct(F.lit(c["ord"]).alias("seq"), F.lit(c["concept"]).alias("concept"), F.col(c["concept"]).alias("a"), F.col(f"p_{c['concept']}").alias("b")) for c in CONCEPTS if c["concept"] not in TOTALS]))
    out = both.filter("two").select("doc_id", each.alias("x")).select("doc_id", "x.*").filter("a is not null and b is not null")
    out = out.withColumns({"change": F.col("a") - F.col("b"), "change_pct": ratio(F.col("a") - F.col("b"), F.abs("b"))})
    by = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("change")), "seq")
    return out.select("doc_id", "concept", "change", "change_pct", F.row_number().over(by).alias("position"))


def extent(moved: DataFrame) -> DataFrame:
    """doc_id, extent: the largest change, for a symmetric axis."""
    return moved.groupBy("doc_id").agg(F.max(F.abs("change")).alias("extent"))


def statement_table(rows: DataFrame) -> DataFrame:
    """The statement as it's shown, in presentation order: doc_id, concept, ord, label, section, grp, is_total, values (period to value), figures (period to struct: FIGURE, and mark, the first of MARKS that holds)."""
    mark = F.when(F.col("origin").isin(*MARKS[:2]), F.col("origin")).when(F.col("repaired"), MARKS[2])
    figures = long(rows).withColumn("mark", mark)
    both = F.array_sort(F.collect_list(F.struct("period_id", F.struct(*FIGURE, "mark").alias("f"))))
    shown = figures.groupBy("doc_id", "concept").agg(F.map_from_entries(both).alias("figures"))
    told = [about(F.col("concept"), k).alias(k) for k in ("ord", "label", "section", "grp", "is_total")]
    return shown.select("doc_id", "concept", *told, F.transform_values("figures", lambda k, v: v["value"]).alias("values"), "figures")


# Fixed value: categories of metrics in the order in which they are shown; kinds of findings are in KIND.
CATEGORIES = ("liquidity", "leverage", "structure", "efficiency")


def grouped_for_display(rows: DataFrame, group: Column, order: tuple[str, ...], fields: list[str]) -> DataFrame:
    """A row for each document and group that isn't empty: doc_id, grp, place (of the group, from 1), rows (the fields, sorted)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("grp")).cast("int")
    return rows.withColumn("grp", group).groupBy("doc_id", "grp").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")).select("doc_id", "grp", place.alias("place"), "rows")


def metrics_view(found: DataFrame) -> DataFrame:
    """found: metrics(). Metrics by category: of each the value and verdict of every period."""
    category = F.element_at(F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[1])]), F.col("metric"))
    return grouped_for_display(found, category, CATEGORIES, ["seq", "metric", "ord", "period_id", "value", "verdict"])


def insights_view(found: DataFrame) -> DataFrame:
    """found: insights(). Findings by kind, in their order."""
    return grouped_for_display(found, F.col("kind"), KIND, ["position", *[c for c in found.columns if c not in ("doc_id", "kind", "position")]])


def merge_assisted(figures: DataFrame, unmapped: DataFrame, proposals: DataFrame, least: float = 0.6, most: int = 40) -> DataFrame:
    """Adds proposed captions to figures: the first sure enough proposal of a concept that is still missing, for a row that exists.

    unmapped: doc_id, row_index, period_id, ord, value. proposals: doc_id, row_index, concept, confidence, seq; a document's first `most` count.
    """
    known = [c["concept"] for c in CONCEPTS]
    listed = proposals.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))).filter(F.col("i") <= most).drop("i")
    open_ = listed.filter((F.col("confidence") >= least) & F.col("concept").isin(known)).join(figures.select("doc_id", "concept").distinct(), ["doc_id", "concept"], "left_anti")
    first = Window.partitionBy("doc_id", "concept").orderBy("seq")
    chosen = open_.join(unmapped.select("doc_id", "row_index").distinct(), ["doc_id", "row_index"], "left_semi").withColumn("i", F.row_number().over(first)).filter("i = 1").drop("i", "seq")
    added = chosen.join(unmapped, ["doc_id", "row_index"]).select(
        "doc_id", "concept", "period_id", "ord", "value", F.lit("assisted").alias("origin"), F.least(F.lit(0.75), "confidence").alias("confidence"),
        *[F.col(c) if c in unmapped.columns else F.lit(None).cast("int" if c == "page" else "string").alias(c) for c in ("page", "label")],
    ).withColumnRenamed("label", "source_label")
    return with_provenance(figures).unionByName(with_provenance(added))


def variances(checks: DataFrame) -> DataFrame:
    """doc_id, code, severity, message: a warning for each period whose sides differ."""
    severity = F.when(F.col("status") == "imbalanced", "warning").otherwise("info")
    return checks.filter(F.col("status").isin("imbalanced", "minor-variance")).select("doc_id", F.lit("BALANCE_VARIANCE").alias("code"), severity.alias("severity"), F.concat("period_id", F.lit(": "), "message").alias("message"))


def assisted_mapping(figures: DataFrame) -> DataFrame:
    """doc_id, code, severity, message: documents of which some concepts were mapped with outside help."""
    n = figures.filter("origin = 'assisted'").groupBy("doc_id").agg(F.count_distinct("concept").alias("n"))
    return n.select("doc_id", F.lit("ASSISTED_MAPPING").alias("code"), F.lit("info").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" captions were mapped with outside help and are marked so.")).alias("message"))


def together(lists: dict[str, DataFrame], ones: dict[str, DataFrame]) -> DataFrame:
    """A row for each doc_id of any part: of `lists` the rows as one array of structs, in the order of their columns (empty where there are none); of `ones`, tables with a row for each document at most, the columns.

    The parts are a tagged union, each row with the struct of its own part alone, which is grouped once: one shuffle for all.
    """
    rest = lambda df: [c for c in df.columns if c != "doc_id"]
    tagged = [df.select("doc_id", F.struct(*rest(df)).alias(name)) for name, df in (lists | ones).items()]
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    whole = [F.array_sort(F.collect_list(name)).alias(name) for name in lists] + [F.first(name, ignorenulls=True).alias(name) for name in ones]
    out = union.groupBy("doc_id").agg(*whole)
    return out.select("doc_id", *lists, *(F.col(f"{name}.{c}").alias(c) for name, df in ones.items() for c in rest(df)))


def report(figures: DataFrame, periods: DataFrame | None = None, companies: DataFrame | None = None, warnings: DataFrame | None = None, unmapped: DataFrame | None = None, files: DataFrame | None = None, narrative: DataFrame | None = None) -> DataFrame:
    """One nested row for each document; to_json() of it is the report. Documents of `files` without any figure have one too, with their error.

    source and error (of files: doc_id, file_name, file_size, format, page_count, sheet_names, error), company, periods, statement,
    checks, metrics, insights, summary, warnings, unmapped, confidence, and what outside help gave. Only what is given is told.
    """
    spark = figures.sparkSession
    rows = settled(roll_up(wide(figures, periods)), "rolled")  # read by every part
    checks, found = balance_checks(rows), settled(insights(rows, companies), "insights")
    line = statement_table(rows).withColumn("figures", F.map_entries("figures"))
    told = metrics(rows).join(workings(rows, companies), ["doc_id", "period_id", "metric"], "left").join(F.broadcast(dim_metric(spark).drop("seq")), "metric")  # eleven rows
    value = F.struct("ord", "period_id", "value", "verdict", "workings", "change", "change_pct")
    told = told.groupBy("doc_id", "seq", "metric", "label", "description", "formula", "format", "category", "higher_is_better").agg(F.reverse(F.array_sort(F.collect_list(value))).alias("values"))
    every = reduce(DataFrame.unionByName, [x for x in (warnings, variances(checks), assisted_mapping(figures)) if x is not None])
    narrated = figures.select("doc_id").distinct().select("doc_id", F.lit(False).alias("narrated")) if narrative is None else narrative.select("doc_id", F.lit(True).alias("narrated"))
    text = summary(rows, companies, periods, found)
    if narrative is not None:
        from .assist import narrate, retold

        found, both = narrate(found, narrative), retold(text, narrative)
        text, narrated = both.drop("told"), both.select("doc_id", F.col("told").alias("narrated"))
    helped = figures.groupBy("doc_id").agg(F.bool_or(F.col("origin") == "assisted").alias("assisted"))
    lists = {"statement": line.select("doc_id", "ord", "concept", "label", "section", "grp", "is_total", "figures"), "checks": checks, "metrics": told, "insights": found.select("doc_id", "position", *[c for c in found.columns if c not in ("doc_id", "position")]), "warnings": every}
    ones = {"_text": text, "_sure": mean_confidence(long(rows)), "_helped": helped, "_narrated": narrated}
    if periods is not None:
        lists["periods"] = periods.select("doc_id", (-F.col("ord")).alias("place"), "column_index", "period_id", "label", "end_date")
    if companies is not None:
        ones["_company"] = companies.select("doc_id", F.struct(*[c for c in companies.columns if c != "doc_id"]).alias("company"))
    if unmapped is not None:
        lists["unmapped"] = unmapped.select("doc_id", "row_index", "period_id", "label", "page", "value")
    here = F.lit(True).alias("_here")
    ones["_base"] = files.select("doc_id", F.struct("file_name", "file_size", "format", "page_count", "sheet_names").alias("source"), "error", here) if files is not None else rows.select("doc_id").distinct().select("doc_id", here)
    out = together(lists, ones).filter("_here").drop("_here").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    first = ["doc_id", *(c for c in ("source", "error") if c in out.columns)]
    return out.select(*first, *(c for c in out.columns if c not in first))
