"""Queries over a ledger that the driver's tables yield, and their DuckDB SQL. See FIXTURES.md, C1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chart import COMPOSITION, CONCEPTS, LEAVES
from ..operators import analysis as A
from ..store import settled

#: The ledger in SQL that both engines run.
_LEDGER = """
WITH base AS (SELECT c_nationkey AS ent, CAST(year(o_orderdate) AS INT) AS yr, CAST(l_partkey % 21 AS INT) AS ci, CAST(sum(round(l_extendedprice)) AS DOUBLE) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
scaled AS (SELECT ent, yr, ci, v * CASE WHEN ci = 16 AND ent % 4 = 0 THEN 8 WHEN ci = 6 AND ent % 5 = 0 THEN 5 ELSE 1 END AS v FROM base),
kept AS (SELECT * FROM scaled WHERE (7 * ent + ci + yr) % 11 <> 0 AND NOT (ent = 24 AND yr = 1995 AND ci >= 10)),
gaps AS (SELECT ent, yr, sum(CASE WHEN ci >= 10 THEN v ELSE 0 END) - sum(CASE WHEN ci < 10 AND ci <> 1 THEN v ELSE 0 END) AS gap FROM kept GROUP BY ent, yr),
ledger AS (SELECT k.ent, k.yr, k.ci, CASE WHEN k.ci = 1 AND k.ent % 3 = 0 THEN gap WHEN k.ci = 1 AND k.ent % 3 = 1 THEN round(gap * 1.02) ELSE k.v END AS v FROM kept k JOIN gaps g ON k.ent = g.ent AND k.yr = g.yr)
"""
TABLES = ("lineitem", "orders", "customer")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as figures: a document is an entity, a period a year."""
    views(spark, sf_dir, *TABLES)
    names = F.array(*map(F.lit, LEAVES))
    sure = F.lit(0.5) + F.col("ci") % 4 * 0.125
    return spark.sql(_LEDGER + "SELECT * FROM ledger").select(
        F.col("ent").alias("doc_id"), F.element_at(names, F.col("ci") + 1).alias("concept"), F.concat(F.lit("FY"), "yr").alias("period_id"), F.col("yr").alias("ord"),
        F.col("v").alias("value"), F.lit("extracted").alias("origin"), sure.alias("confidence"),
    )


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.roll_up(A.wide(figures(spark, sf_dir)))


def _wide_sql() -> str:
    """leaf columns, then totals, as SQL common tables over the ledger."""
    leaves = ", ".join(f"max(CASE WHEN ci = {i} THEN v END) AS {c}" for i, c in enumerate(LEAVES))
    out, last = [f"w0 AS (SELECT ent, yr, {leaves} FROM ledger GROUP BY ent, yr)"], "w0"
    for k, (total, parts) in enumerate(COMPOSITION.items(), 1):
        added = " + ".join(f"coalesce({p}, 0)" for p in parts)
        some = " OR ".join(f"{p} IS NOT NULL" for p in parts)
        out.append(f"w{k} AS (SELECT *, CASE WHEN {some} THEN {added} END AS {total} FROM {last})")
        last = f"w{k}"
    debt = "CASE WHEN longTermBorrowings IS NOT NULL OR shortTermBorrowings IS NOT NULL THEN coalesce(longTermBorrowings, 0) + coalesce(shortTermBorrowings, 0) END"
    d = lambda a, b: f"({a}) / nullif({b}, 0)"
    ca, cl = "totalCurrentAssets", "totalCurrentLiabilities"
    metric = {
        "currentRatio": d(ca, cl), "quickRatio": d(f"{ca} - coalesce(inventories, 0)", cl), "cashRatio": d("cashAndCashEquivalents", cl), "workingCapital": f"{ca} - {cl}", "totalDebt": debt, "netWorth": "totalEquity",
        "debtToEquity": d(debt, "totalEquity"), "assetToLiability": d("totalAssets", "totalLiabilities"), "debtToAssets": d(debt, "totalAssets"), "equityRatio": d("totalEquity", "totalAssets"), "inventoryShareOfCurrentAssets": d("inventories", ca),
    }
    out.append(f"wide AS (SELECT *, {', '.join(f'{x} AS m_{m}' for m, x in metric.items())}, abs(totalAssets - totalEquityAndLiabilities) / greatest(abs(totalAssets), abs(totalEquityAndLiabilities), 1) AS rel FROM {last})")
    out.append("chk AS (SELECT *, CASE WHEN totalAssets IS NULL OR totalEquityAndLiabilities IS NULL THEN 'insufficient-data' WHEN rel <= 0.001 THEN 'balanced' WHEN rel <= 0.01 THEN 'minor-variance' ELSE 'imbalanced' END AS status FROM wide)")
    return _LEDGER.rstrip() + ",\n" + ",\n".join(out)


def _verdict_sql(m: str) -> str:
    bands, v = A.METRICS[m][3], f"m_{m}"
    if bands:
        op = ">=" if bands[0] == "up" else "<="
        graded = f"CASE WHEN {v} {op} {bands[1]} THEN 'strong' WHEN {v} {op} {bands[2]} THEN 'healthy' WHEN {v} {op} {bands[3]} THEN 'watch' ELSE 'weak' END"
    elif m == "workingCapital":
        graded = f"CASE WHEN {v} > 0 AND {v} > 0.5 * totalCurrentLiabilities THEN 'strong' WHEN {v} > 0 THEN 'healthy' ELSE 'weak' END"
    else:
        graded = f"CASE WHEN {v} > 0 THEN 'healthy' ELSE 'weak' END" if m == "netWorth" else "'neutral'"
    return f"CASE WHEN {v} IS NULL THEN 'neutral' ELSE {graded} END"


def _metrics_sql() -> str:
    each = " UNION ALL ".join(f"SELECT ent, yr, '{m}' AS metric, m_{m} AS value, {_verdict_sql(m)} AS verdict FROM chk" for m in A.METRICS)
    return _wide_sql() + f""", each AS ({each}),
led AS (SELECT *, count(value) OVER (PARTITION BY ent, metric) AS known, lead(value) OVER (PARTITION BY ent, metric ORDER BY yr DESC) AS prior FROM each),
metrics AS (SELECT ent AS doc_id, 'FY' || yr AS period_id, metric, value, verdict, value - prior AS change, (value - prior) / nullif(abs(prior), 0) AS change_pct FROM led WHERE known > 0)"""


def _two_sql() -> str:
    names = [*[c["concept"] for c in CONCEPTS], *[f"m_{m}" for m in A.METRICS]]
    leads = ", ".join(f"lead({n}) OVER n AS p_{n}" for n in names)
    return _wide_sql() + f", two AS (SELECT * FROM (SELECT *, row_number() OVER n AS i, lead(yr) OVER n IS NOT NULL AS has, {leads} FROM chk WINDOW n AS (PARTITION BY ent ORDER BY yr DESC)) WHERE i = 1)"


_EVIDENCE = {
    "liquidity-strong": "currentRatio workingCapital", "liquidity-adequate": "currentRatio", "liquidity-deficit": "currentRatio workingCapital", "inventory-heavy-liquidity": "quickRatio inventoryShareOfCurrentAssets inventories",
    "leverage-conservative": "debtToEquity netWorth totalDebt", "leverage-moderate": "debtToEquity totalDebt", "leverage-high": "debtToEquity totalDebt netWorth", "short-term-funding-concentration": "shortTermBorrowings totalCurrentLiabilities",
    "debt-trend": "totalDebt debtToEquity", "balance-sheet-size-trend": "totalAssets", "mover-inventories": "inventories", "mover-tradeReceivables": "tradeReceivables", "mover-cashAndCashEquivalents": "cashAndCashEquivalents", "mover-tradePayables": "tradePayables",
    "solvency-cushion": "assetToLiability netWorth", "solvency-thin": "assetToLiability", "solvency-negative": "assetToLiability netWorth", "reserves-trend": "reservesAndSurplus netWorth", "identity-unverified": "", "identity-variance": "",
}


def _confidence_sql() -> str:
    """The confidence of each total: that of its weakest part, lower totals first."""
    leaves = ", ".join(f"max(CASE WHEN ci = {i} THEN CAST({_SURE} AS DOUBLE) END) AS {c}" for i, c in enumerate(LEAVES))
    out, last = [f"c0 AS (SELECT ent, yr, {leaves} FROM ledger GROUP BY ent, yr)"], "c0"
    for k, (total, parts) in enumerate(COMPOSITION.items(), 1):
        out.append(f"c{k} AS (SELECT *, least({', '.join(parts)}) * CAST(0.97 AS DOUBLE) AS {total} FROM {last})")
        last = f"c{k}"
    return _LEDGER.rstrip() + ",\n" + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {_KEY}, '{t}' AS concept, {t} AS confidence FROM {last} WHERE {t} IS NOT NULL" for t in COMPOSITION)


def _insights_sql() -> str:
    d = lambda n: f"(({n} - p_{n}) / nullif(abs(p_{n}), 0))"
    fund, debt, size, moved = "(shortTermBorrowings / nullif(totalCurrentLiabilities, 0))", d("m_totalDebt"), d("totalAssets"), "(reservesAndSurplus - p_reservesAndSurplus)"
    rules = [
        ("liquidity-strong", "m_currentRatio >= 2", "'strength'", "'low'"),
        ("liquidity-adequate", "m_currentRatio >= 1 AND m_currentRatio < 2", "'observation'", "'medium'"),
        ("liquidity-deficit", "m_currentRatio < 1", "'concern'", "'high'"),
        ("inventory-heavy-liquidity", "m_inventoryShareOfCurrentAssets >= 0.45 AND m_quickRatio IS NOT NULL AND m_currentRatio IS NOT NULL", "CASE WHEN m_quickRatio < 1 THEN 'concern' ELSE 'observation' END", "CASE WHEN m_quickRatio < 1 THEN 'high' ELSE 'medium' END"),
        ("leverage-conservative", "m_debtToEquity <= 1", "'strength'", "'low'"),
        ("leverage-moderate", "m_debtToEquity > 1 AND m_debtToEquity <= 2", "'observation'", "'medium'"),
        ("leverage-high", "m_debtToEquity > 2", "'concern'", "'high'"),
        ("short-term-funding-concentration", f"{fund} >= 0.55", "'concern'", f"CASE WHEN {fund} >= 0.75 THEN 'high' ELSE 'medium' END"),
        ("debt-trend", f"has AND abs({debt}) >= 0.05", f"CASE WHEN {debt} < 0 THEN 'strength' ELSE 'concern' END", f"CASE WHEN {debt} < 0 THEN 'low' WHEN {debt} > 0.25 THEN 'high' ELSE 'medium' END"),
        ("balance-sheet-size-trend", f"has AND abs({size}) >= 0.05", "'trend'", f"CASE WHEN abs({size}) > 0.2 THEN 'medium' ELSE 'low' END"),
    ]
    for n in ("inventories", "tradeReceivables", "cashAndCashEquivalents", "tradePayables"):
        falls = f"{d(n)} < -0.4" if n == "cashAndCashEquivalents" else "false"
        rules.append((f"mover-{n}", f"has AND abs({d(n)}) >= 0.2", f"CASE WHEN {falls} THEN 'concern' ELSE 'trend' END", f"CASE WHEN {falls} THEN 'medium' ELSE 'low' END"))
    rules += [
        ("solvency-cushion", "m_assetToLiability >= 1.3", "'strength'", "'low'"),
        ("solvency-thin", "m_assetToLiability >= 1 AND m_assetToLiability < 1.3", "'observation'", "'medium'"),
        ("solvency-negative", "m_assetToLiability < 1", "'concern'", "'high'"),
        ("reserves-trend", f"has AND abs({moved}) >= abs(p_reservesAndSurplus) * 0.01", f"CASE WHEN {moved} > 0 THEN 'strength' ELSE 'concern' END", f"CASE WHEN {moved} > 0 THEN 'low' ELSE 'medium' END"),
        ("identity-unverified", "status = 'insufficient-data'", "'observation'", "'medium'"),
        ("identity-variance", "status IN ('minor-variance', 'imbalanced')", "'concern'", "CASE WHEN status = 'imbalanced' THEN 'high' ELSE 'medium' END"),
    ]
    each = " UNION ALL ".join(f"SELECT ent, {i} AS seq, '{n}' AS insight, {k} AS kind, {s} AS severity, '{_EVIDENCE[n]}' AS evidence FROM two WHERE {c}" for i, (n, c, k, s) in enumerate(rules))
    order = lambda c, xs: f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(xs)) + " END"
    return _two_sql() + f", hits AS ({each}) SELECT ent AS doc_id, insight, kind, severity, evidence, CAST(row_number() OVER (PARTITION BY ent ORDER BY {order('severity', A.SEVERITY)}, {order('kind', A.KIND)}, seq) AS INT) AS position FROM hits"


def _mix_sql(bands: dict[str, list[str]]) -> str:
    each = " UNION ALL ".join(f"SELECT ent, yr, '{b}' AS band, {' + '.join(f'coalesce({p}, 0)' for p in parts)} AS value FROM chk" for b, parts in bands.items())
    return _wide_sql() + f", bands AS ({each}), s AS (SELECT *, max(value) OVER (PARTITION BY ent, band) AS top, sum(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY ent, yr) AS total FROM bands) SELECT ent AS doc_id, 'FY' || yr AS period_id, band, value, CASE WHEN value > 0 THEN value END / total AS share FROM s WHERE top > 0"


def _money_sql(v: str) -> str:
    """Rupees as text: crores, lakhs, or whole with groups."""
    n = f"abs({v})"
    whole = f"CAST(floor({n} + 0.5) AS BIGINT)"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || '\u20b9' || CASE WHEN {n} >= 1e7 THEN format('{{:.2f}}', {n} / 1e7) || ' Cr' WHEN {n} >= 1e5 THEN format('{{:.2f}}', {n} / 1e5) || ' L' WHEN {whole} >= 1000 THEN ({whole} // 1000) || ',' || lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0') ELSE CAST({whole} AS VARCHAR) END)"


def _workings_sql() -> str:
    def text(formula: str) -> str:
        pieces = [x for part in formula.split("{") for x in part.split("}")]
        return " || ".join(_money_sql(f"coalesce({'m_totalDebt' if x == 'debt' else A.PARTS[x]}, 0)") if i % 2 else f"'{x}'" for i, x in enumerate(pieces) if x)

    return _wide_sql() + " " + " UNION ALL ".join(f"SELECT {_KEY}, '{m}' AS metric, {text(A.METRIC_TEXTS[m][1])} AS workings FROM chk WHERE m_{m} IS NOT NULL" for m in A.METRICS)


def _said_sql() -> dict[str, str]:
    """The texts that findings use, by name, of a row of `two`."""
    share = lambda a, b: f"(({a}) / nullif({b}, 0))"
    moved = lambda n: share(f"{n} - p_{n}", f"abs(p_{n})")
    times = lambda v: f"(format('{{:.2f}}', {v}) || '\u00d7')"
    percent = lambda v: f"(format('{{:.1f}}', {v} * 100) || '%')"
    signed = lambda v: f"(CASE WHEN {v} > 0 THEN '+' ELSE '' END || {percent(v)})"
    names = {"assets": "totalAssets", "inv": "inventories", "rec": "tradeReceivables", "cash": "cashAndCashEquivalents", "pay": "tradePayables", "res": "reservesAndSurplus"}
    out = {k: _money_sql(n) for k, n in names.items()} | {f"p_{k}": _money_sql(f"p_{n}") for k, n in names.items()} | {f"d_{k}": signed(moved(n)) for k, n in names.items()}
    out |= {k: times(v) for k, v in {"cr": "m_currentRatio", "p_cr": "p_m_currentRatio", "qr": "m_quickRatio", "de": "m_debtToEquity", "p_de": "p_m_debtToEquity", "al": "m_assetToLiability"}.items()}
    out |= {k: _money_sql(v) for k, v in {"wc": "m_workingCapital", "eq": "m_netWorth", "debt": "m_totalDebt", "p_debt": "p_m_totalDebt", "ca": "totalCurrentAssets", "cl": "totalCurrentLiabilities", "stb": "shortTermBorrowings", "claims": "totalEquityAndLiabilities", "moved": "(reservesAndSurplus - p_reservesAndSurplus)"}.items()}
    return out | {"share": percent("m_inventoryShareOfCurrentAssets"), "funding": percent(share("shortTermBorrowings", "totalCurrentLiabilities")), "d_debt": signed(moved("m_totalDebt"))}


def _insight_texts_sql() -> str:
    said = _said_sql()

    def filled(text: str) -> str:
        """Bracketed parts, and parts between brackets, are left out where a text is missing."""
        parts = []
        for piece in text.replace("]", "[").split("["):
            own = [x for y in piece.split("{") for x in y.split("}")]
            words = [f"said.{x}" if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(own)]
            parts.append(f"coalesce({' || '.join(words)}, '')")
        return " || ".join(parts)

    case = lambda i: "CASE insight " + " ".join(f"WHEN '{k}' THEN {filled(v[i])}" for k, v in A.INSIGHT_TEXTS.items()) + " END"
    hits = _insights_sql().rsplit(" SELECT ent AS doc_id", 1)[0]
    return hits + f", said AS (SELECT ent, {', '.join(f'{v} AS {k}' for k, v in said.items())} FROM two) SELECT hits.ent AS doc_id, insight, {case(0)} AS title, {case(1)} AS detail FROM hits JOIN said ON hits.ent = said.ent"


def _summary_sql() -> str:
    head, texts = _insight_texts_sql().rsplit(" SELECT hits.ent", 1)
    first = lambda k: f"arg_min(CASE WHEN regexp_matches(title, '^[A-Za-z]') AND NOT regexp_matches(title, '^[A-Z][A-Z]') THEN lower(title[1]) || title[2:] ELSE title END, position) FILTER (kind = '{k}')"
    order = lambda c, xs: f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(xs)) + " END"
    told = " SELECT hits.ent" + texts.replace(" AS detail FROM hits", f" AS detail, kind, row_number() OVER (PARTITION BY hits.ent ORDER BY {order('severity', A.SEVERITY)}, {order('kind', A.KIND)}, seq) AS position FROM hits")
    return head + f""", told AS ({told}), firsts AS (SELECT doc_id AS ent, {first('strength')} AS strength, {first('concern')} AS concern FROM told GROUP BY doc_id)
      SELECT two.ent AS doc_id, concat_ws(' ', 'The company has total assets of ' || CASE WHEN totalAssets IS NOT NULL THEN assets END || ' at FY' || yr || CASE WHEN totalEquity IS NOT NULL THEN ', of which ' || eq || ' is equity' ELSE '' END || '.',
        CASE WHEN m_currentRatio IS NOT NULL AND m_debtToEquity IS NOT NULL THEN 'The current ratio is ' || cr || ', and debt is ' || de || ' of equity.' END, 'First strength: ' || strength || '.', 'First concern: ' || concern || '.') AS summary
      FROM two JOIN said ON two.ent = said.ent LEFT JOIN firsts ON firsts.ent = two.ent"""


def _messages_sql() -> str:
    off = "format('{:,.3f}', rel * 100) || '%'"
    return _wide_sql() + f""" SELECT {_KEY}, CASE WHEN status = 'insufficient-data' THEN 'One side of the balance sheet is missing, so it can''t be checked.' WHEN totalAssets = totalEquityAndLiabilities THEN 'Both sides are equal.'
      WHEN status = 'balanced' THEN 'Both sides agree within ' || {off} || '.' WHEN status = 'minor-variance' THEN 'The sides differ by ' || {off} || '; a line may be missing or misread.' ELSE 'The sides differ by ' || {off} || '; lines are missing, and ratios may mislead.' END AS message,
      CASE status WHEN 'imbalanced' THEN 'warning' WHEN 'minor-variance' THEN 'info' END AS severity FROM chk"""


_KEY = "ent AS doc_id, 'FY' || yr AS period_id"
_LEAF_ORDER = [c for c in CONCEPTS if c["concept"] in LEAVES]
_SURE = "(0.5 + (ci % 4) * 0.125)"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """totalEquity as printed: the sum times 1, 1.01 or 1.5 by entity; doc_id, period_id, value, origin after the roll-up."""
    f = figures(spark, sf_dir)
    factor = F.element_at(F.array(F.lit(1.0), F.lit(1.01), F.lit(1.5)), F.col("doc_id") % 3 + 1)
    parts = f.filter(F.col("concept").isin(COMPOSITION["totalEquity"])).groupBy("doc_id", "period_id", "ord").agg((F.sum("value")).alias("value"))
    printed = parts.select("doc_id", F.lit("totalEquity").alias("concept"), "period_id", "ord", (F.col("value") * factor).alias("value"), F.lit("extracted").alias("origin"), F.lit(0.5).alias("confidence"))
    rows = A.roll_up(A.wide(f.unionByName(printed)))
    return rows.filter("totalEquity is not null").select("doc_id", "period_id", F.col("totalEquity.value").alias("value"), F.col("totalEquity.origin").alias("origin"))


def _assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories, cash and current investments are missing in even entities, and proposed for rows 0 and 1; the second proposal for a concept, and those for others, are passed over. Of entities that aren't multiples of 4 the proposal for investments comes after 40 others, too late."""
    f = figures(spark, sf_dir)
    hidden = (F.col("doc_id") % 2 == 0) & F.col("concept").isin("inventories", "cashAndCashEquivalents", "currentInvestments")
    unmapped = f.filter(hidden & (F.col("concept") != "currentInvestments")).select("doc_id", F.when(F.col("concept") == "inventories", 0).otherwise(1).alias("row_index"), "period_id", "ord", "value")
    docs = f.select("doc_id").distinct()
    offers = [(0, "inventories", 0.9, 0), (1, "inventories", 0.95, 1), (1, "cashAndCashEquivalents", 0.6, 2), (0, "tradePayables", 0.9, 3), (7, "goodwill", 0.9, 4), (1, "shareCapital", 0.5, 5), *[(0, "goodwill", 0.9, 6 + i) for i in range(34)], (0, "currentInvestments", 0.9, 40)]
    proposals = docs.crossJoin(F.broadcast(spark.createDataFrame(offers, "row_index int, concept string, confidence double, seq int")))  # some fixed offers
    proposals = proposals.filter((F.col("doc_id") % 4 != 0) | ~((F.col("concept") == "goodwill") & (F.col("seq") > 10)))
    return A.merge_assisted(f.filter(~hidden), unmapped, proposals).filter("origin = 'assisted'").select("doc_id", "concept", "period_id", "value", "confidence")


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of everything each report holds."""
    n = lambda c: F.size(F.coalesce(c, F.array())).alias(f"n_{c}")
    return A.report(figures(spark, sf_dir)).select("doc_id", n("statement"), n("checks"), n("metrics"), n("insights"), n("warnings"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each period's sides, and how severe the warning is, if any."""
    checks = A.balance_checks(settled(rolled(spark, sf_dir), "rolled"))
    told = A.variances(checks).select("doc_id", F.substring_index("message", ": ", 1).alias("period_id"), "severity")
    return checks.select("doc_id", "period_id", "message").join(told, ["doc_id", "period_id"], "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    figure = lambda s, d: A.long(rolled(s, d)).filter(F.col("concept").isin(list(COMPOSITION)))
    found = {
        "rollup_totals": lambda s, d: figure(s, d).select("doc_id", "period_id", "concept", "value"),
        "rollup_printed_override": _printed,
        "rollup_confidence": lambda s, d: figure(s, d).select("doc_id", "period_id", "concept", "confidence"),
        "balance_check": lambda s, d: A.balance_checks(rolled(s, d)).select("doc_id", "period_id", "assets", "claims", "difference", "status"),
        "insight_texts": lambda s, d: A.insights(settled(rolled(s, d), "rolled")).select("doc_id", "insight", "title", "detail"),
        "summary_texts": lambda s, d: A.summary(settled(rolled(s, d), "rolled")),
        "balance_messages": lambda s, d: _messages(s, d),
        "metric_workings": lambda s, d: A.workings(rolled(s, d)),
        "metric_yoy_change": lambda s, d: A.metrics(rolled(s, d)).select("doc_id", "period_id", "metric", "change", "change_pct"),
        "metric_presence": lambda s, d: A.metrics(rolled(s, d)).groupBy("doc_id", "metric").agg(F.count("value").alias("n")),
        "insight_hits": lambda s, d: A.insights(rolled(s, d), told=False).withColumn("evidence", F.array_join("evidence", " ")),
        "movers_ranked": lambda s, d: A.movers(rolled(s, d)),
        "mover_extent": lambda s, d: A.extent(A.movers(rolled(s, d))),
        "funding_mix": lambda s, d: A.composition(rolled(s, d), A.FUNDING),
        "deployment_mix": lambda s, d: A.composition(rolled(s, d), A.DEPLOYMENT),
        "statement_pivot": lambda s, d: A.statement_table(rolled(s, d)).select("doc_id", "concept", "ord", "label", "section", "grp", "is_total", F.explode("figures").alias("period_id", "f")).select("*", "f.value", "f.origin", "f.mark").drop("f"),
        "latest_period": lambda s, d: A.latest_two(rolled(s, d)).select("doc_id", "period_id", "status"),
        "mean_confidence": lambda s, d: A.mean_confidence(figures(s, d)),
        "assist_merge": _assist,
        "metric_groups": lambda s, d: A.metrics_view(A.metrics(rolled(s, d))).select("doc_id", "grp", "place", F.size("rows").alias("n"), F.col("rows")[0]["metric"].alias("first")),
        "insight_groups": lambda s, d: A.insights_view(A.insights(rolled(s, d), told=False)).select("doc_id", "grp", "place", F.size("rows").alias("n"), F.col("rows")[0]["insight"].alias("first")),
        "report_scalars": _scalars,
        "report_json": lambda s, d: A.report(figures(s, d)).select("doc_id", F.to_json(F.struct("*")).alias("report")),
    }
    for m in A.METRICS:
        found[f"metric_{m}"] = lambda s, d, m=m: A.metrics(rolled(s, d)).filter(F.col("metric") == m).select("doc_id", "period_id", "value", "verdict")
    return found


def oracle_sql() -> dict[str, str]:
    total = lambda names: " UNION ALL ".join(f"SELECT {_KEY}, '{t}' AS concept, {t} AS value FROM chk WHERE {t} IS NOT NULL" for t in names)
    leaf_rows = " UNION ALL ".join(f"SELECT ent, yr, {c['ord']} AS seq, '{c['concept']}' AS concept, {c['concept']} AS a, p_{c['concept']} AS b FROM two WHERE has" for c in _LEAF_ORDER)
    movers = _two_sql() + f", m AS ({leaf_rows}), r AS (SELECT ent AS doc_id, concept, a - b AS change, (a - b) / nullif(abs(b), 0) AS change_pct, seq FROM m WHERE a IS NOT NULL AND b IS NOT NULL)"
    every = " UNION ALL ".join(f"SELECT ent, yr, '{c['concept']}' AS concept, CAST({c['ord']} AS INT) AS ord, '{c['label']}' AS label, '{c['section']}' AS section, '{c['grp']}' AS grp, {str(c['is_total']).lower()} AS is_total, {c['concept']} AS value FROM chk WHERE {c['concept']} IS NOT NULL" for c in CONCEPTS)
    counted = ", ".join(f"SELECT ent, '{c['concept']}' FROM chk WHERE {c['concept']} IS NOT NULL" for c in CONCEPTS).replace(", SELECT", " UNION SELECT")
    found = {
        "rollup_totals": _wide_sql() + " " + total(COMPOSITION),
        "rollup_printed_override": _wide_sql() + ", p AS (SELECT *, totalEquity * CASE ent % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CAST(1.01 AS DOUBLE) ELSE 1.5 END AS printed FROM chk WHERE totalEquity IS NOT NULL), q AS (SELECT *, abs(printed - totalEquity) / greatest(abs(printed), abs(totalEquity), 1) <= 0.02 AS ok FROM p)"
        f" SELECT {_KEY}, CASE WHEN ok THEN printed ELSE totalEquity END AS value, CASE WHEN ok THEN 'extracted' ELSE 'derived' END AS origin FROM q",
        "rollup_confidence": _confidence_sql(),
        "balance_check": _wide_sql() + f" SELECT {_KEY}, totalAssets AS assets, totalEquityAndLiabilities AS claims, totalAssets - totalEquityAndLiabilities AS difference, status FROM chk",
        "insight_texts": _insight_texts_sql(),
        "summary_texts": _summary_sql(),
        "balance_messages": _messages_sql(),
        "metric_workings": _workings_sql(),
        "metric_yoy_change": _metrics_sql() + " SELECT doc_id, period_id, metric, change, change_pct FROM metrics",
        "metric_presence": _metrics_sql() + " SELECT doc_id, metric, count(value) AS n FROM metrics GROUP BY doc_id, metric",
        "insight_hits": _insights_sql(),
        "movers_ranked": movers + " SELECT doc_id, concept, change, change_pct, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(change) DESC, seq) AS INT) AS position FROM r",
        "mover_extent": movers + " SELECT doc_id, max(abs(change)) AS extent FROM r GROUP BY doc_id",
        "funding_mix": _mix_sql(A.FUNDING),
        "deployment_mix": _mix_sql(A.DEPLOYMENT),
        "statement_pivot": _wide_sql() + f", e AS ({every}) SELECT ent AS doc_id, 'FY' || yr AS period_id, concept, ord, label, section, grp, is_total, value, CASE WHEN is_total THEN 'derived' ELSE 'extracted' END AS origin, CASE WHEN is_total THEN 'derived' END AS mark FROM e",
        "metric_groups": _metrics_sql() + f""", g(metric, seq, grp, place) AS (VALUES {', '.join(f"('{m}', {i}, '{v[1]}', {A.CATEGORIES.index(v[1]) + 1})" for i, (m, v) in enumerate(A.METRICS.items()))})
          SELECT doc_id, grp, place, CAST(count(*) AS INT) AS n, arg_min(metric, seq) AS first FROM metrics JOIN g USING (metric) GROUP BY ALL""",
        "insight_groups": _insights_sql().replace("SELECT ent AS doc_id, insight,", ", i AS (SELECT ent AS doc_id, insight,", 1) + f") SELECT doc_id, kind AS grp, CAST(list_position({list(A.KIND)}, kind) AS INT) AS place, CAST(count(*) AS INT) AS n, arg_min(insight, position) AS first FROM i GROUP BY doc_id, kind",
        "report_scalars": _insights_sql().replace("SELECT ent AS doc_id, insight,", ", i AS (SELECT ent AS doc_id, insight,", 1) + f"), l(ent, concept) AS ({counted}), m AS (" + " UNION ALL ".join(f"SELECT ent, '{m}' AS metric FROM chk GROUP BY ent HAVING count(m_{m}) > 0" for m in A.METRICS) + """)
          SELECT ent AS doc_id, CAST((SELECT count(*) FROM l WHERE l.ent = c.ent) AS INT) AS n_statement, CAST(count(*) AS INT) AS n_checks, CAST((SELECT count(*) FROM m WHERE m.ent = c.ent) AS INT) AS n_metrics, CAST((SELECT count(*) FROM i WHERE i.doc_id = c.ent) AS INT) AS n_insights,
          CAST(count(*) FILTER (status IN ('imbalanced', 'minor-variance')) AS INT) AS n_warnings FROM chk c GROUP BY ent""",
        "latest_period": _two_sql() + f" SELECT {_KEY}, status FROM two",
        "mean_confidence": _LEDGER + f" SELECT ent AS doc_id, avg(CAST({_SURE} AS DOUBLE)) AS confidence FROM ledger GROUP BY ent",
        "assist_merge": _LEDGER + f" SELECT ent AS doc_id, CASE WHEN ci = 16 THEN 'inventories' ELSE 'cashAndCashEquivalents' END AS concept, 'FY' || yr AS period_id, v AS value, CAST(CASE WHEN ci = 16 THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence FROM ledger WHERE ent % 2 = 0 AND ci IN (16, 18) UNION ALL SELECT ent, 'currentInvestments', 'FY' || yr, v, 0.75 FROM ledger WHERE ent % 4 = 0 AND ci = 16",
    }
    for m in A.METRICS:
        found[f"metric_{m}"] = _metrics_sql() + f" SELECT doc_id, period_id, value, verdict FROM metrics WHERE metric = '{m}'"
    return found
