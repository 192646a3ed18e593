"""The chart of accounts and what hangs on it: concepts, synonyms, totals, metrics. All are small fixed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. Concept, section, group, whether a total, specificity, synonyms (first ones first), words that exclude it.
_CONCEPTS = [
    ("shareCapital", "equity", "equity", False, 3, ["equitysharecapital", "issuedsubscribedandpaidupcapital", "paidupsharecapital", "sharecapital", "capitalstock", "commonstock", "sharedcapital"], ["reserve", "workingcapital", "capitalworkinprogress", "capitalreserve"]),
    ("reservesAndSurplus", "equity", "equity", False, 3, ["reservesandsurplus", "retainedearnings", "otherequity", "accumulatedprofits", "profitandlossaccount", "reserves", "surplus"], ["deficit"]),
    ("totalEquity", "equity", "equity", True, 5, ["totalshareholdersfunds", "totalshareholdersequity", "shareholdersfunds", "shareholdersequity", "totalstockholdersequity", "totalequity", "networth"], ["liabilit", "other"]),
    ("longTermBorrowings", "liabilities", "nonCurrentLiabilities", False, 4, ["longtermborrowings", "noncurrentborrowings", "longtermdebt", "longtermloans", "noncurrentfinancialliabilitiesborrowings", "termloans", "securedloans"], ["shortterm", "currentportion", "loansandadvances", "advances"]),
    ("deferredTaxLiabilities", "liabilities", "nonCurrentLiabilities", False, 4, ["deferredtaxliabilities", "deferredtaxliability", "deferredtax"], ["asset"]),
    ("longTermProvisions", "liabilities", "nonCurrentLiabilities", False, 4, ["longtermprovisions", "noncurrentprovisions"], []),
    ("otherNonCurrentLiabilities", "liabilities", "nonCurrentLiabilities", False, 4, ["otherlongtermliabilities", "othernoncurrentliabilities"], []),
    ("totalNonCurrentLiabilities", "liabilities", "nonCurrentLiabilities", True, 6, ["totalnoncurrentliabilities", "totallongtermliabilities"], ["other"]),
    ("shortTermBorrowings", "liabilities", "currentLiabilities", False, 4, ["shorttermborrowings", "currentborrowings", "shorttermdebt", "workingcapitalloan", "cashcredit", "bankoverdraft", "packingcredit", "currentmaturitiesoflongtermdebt", "currentportionoflongtermdebt"], []),
    ("tradePayables", "liabilities", "currentLiabilities", False, 4, ["tradepayables", "accountspayable", "sundrycreditors", "creditors", "payables"], ["receivable", "debtors"]),
    ("otherCurrentLiabilities", "liabilities", "currentLiabilities", False, 4, ["othercurrentliabilities", "otherfinancialliabilities"], []),
    ("shortTermProvisions", "liabilities", "currentLiabilities", False, 4, ["shorttermprovisions", "currentprovisions", "provisions"], ["longterm", "noncurrent"]),
    ("totalCurrentLiabilities", "liabilities", "currentLiabilities", True, 6, ["totalcurrentliabilities"], ["other"]),
    ("totalLiabilities", "liabilities", "totals", True, 5, ["totalliabilities"], ["equity", "shareholders", "current", "other"]),
    ("totalEquityAndLiabilities", "liabilities", "totals", True, 7, ["totalequityandliabilities", "totalliabilitiesandequity", "totalliabilitiesandshareholdersequity", "totalequityliabilities"], ["other"]),
    ("propertyPlantAndEquipment", "assets", "nonCurrentAssets", False, 4, ["propertyplantandequipment", "plantandequipment", "tangibleassets", "fixedassets", "netblock", "propertyplantequipment"], ["intangible"]),
    ("intangibleAssets", "assets", "nonCurrentAssets", False, 4, ["intangibleassets", "goodwill"], []),
    ("nonCurrentInvestments", "assets", "nonCurrentAssets", False, 4, ["noncurrentinvestments", "longterminvestments"], []),
    ("longTermLoansAndAdvances", "assets", "nonCurrentAssets", False, 4, ["longtermloansandadvances", "noncurrentloansandadvances"], []),
    ("otherNonCurrentAssets", "assets", "nonCurrentAssets", False, 4, ["othernoncurrentassets", "capitalworkinprogress"], []),
    ("totalNonCurrentAssets", "assets", "nonCurrentAssets", True, 6, ["totalnoncurrentassets", "totalfixedassets"], ["other"]),
    ("currentInvestments", "assets", "currentAssets", False, 4, ["currentinvestments", "shortterminvestments", "investments"], ["noncurrent", "longterm"]),
    ("inventories", "assets", "currentAssets", False, 4, ["inventories", "inventory", "stockintrade", "closingstock", "stocks"], []),
    ("tradeReceivables", "assets", "currentAssets", False, 4, ["tradereceivables", "accountsreceivable", "sundrydebtors", "debtors", "receivables"], ["payable", "creditors"]),
    ("cashAndCashEquivalents", "assets", "currentAssets", False, 4, ["cashandcashequivalents", "cashandbankbalances", "cashandbank", "bankbalances", "cashatbankandinhand", "cashinhand", "cash"], ["cashcredit", "cashflow"]),
    ("shortTermLoansAndAdvances", "assets", "currentAssets", False, 4, ["shorttermloansandadvances", "currentloansandadvances", "loansandadvances"], []),
    ("otherCurrentAssets", "assets", "currentAssets", False, 4, ["othercurrentassets", "prepaidexpenses"], []),
    ("totalCurrentAssets", "assets", "currentAssets", True, 6, ["totalcurrentassets"], ["other"]),
    ("totalAssets", "assets", "totals", True, 6, ["totalassets"], ["current", "fixed", "other"]),
]

# Fixed values. Groups in the order of presentation, and what they are called.
GROUP_LABELS = {
    "equity": "Equity",
    "nonCurrentLiabilities": "Non-current liabilities",
    "currentLiabilities": "Current liabilities",
    "nonCurrentAssets": "Non-current assets",
    "currentAssets": "Current assets",
    "totals": "Totals",
}

# Fixed values. Total and components, in the order of evaluation; lower totals come first.
COMPOSITION = {
    "totalEquity": ["shareCapital", "reservesAndSurplus"],
    "totalNonCurrentLiabilities": ["longTermBorrowings", "deferredTaxLiabilities", "longTermProvisions", "otherNonCurrentLiabilities"],
    "totalCurrentLiabilities": ["shortTermBorrowings", "tradePayables", "otherCurrentLiabilities", "shortTermProvisions"],
    "totalLiabilities": ["totalNonCurrentLiabilities", "totalCurrentLiabilities"],
    "totalNonCurrentAssets": ["propertyPlantAndEquipment", "intangibleAssets", "nonCurrentInvestments", "longTermLoansAndAdvances", "otherNonCurrentAssets"],
    "totalCurrentAssets": ["currentInvestments", "inventories", "tradeReceivables", "cashAndCashEquivalents", "shortTermLoansAndAdvances", "otherCurrentAssets"],
    "totalAssets": ["totalNonCurrentAssets", "totalCurrentAssets"],
    "totalEquityAndLiabilities": ["totalEquity", "totalLiabilities"],
}

# Fixed values. Section headings in the order of matching.
SECTION_MARKERS = [
    ("equityandliabilities", "liabilities"), ("liabilitiesandequity", "liabilities"), ("equityliabilities", "liabilities"),
    ("noncurrentassets", "assets"), ("currentassets", "assets"),
    ("noncurrentliabilities", "liabilities"), ("currentliabilities", "liabilities"),
    ("shareholdersfunds", "equity"), ("stockholdersequity", "equity"),
    ("assets", "assets"), ("liabilities", "liabilities"), ("equity", "equity"),
]


def label_of(concept: str) -> str:
    """What a concept is called: the words of its name."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", concept).capitalize().replace("Non current", "Non-current").replace("non current", "non-current")


_FIELDS = ("concept", "section", "grp", "is_total", "specificity", "synonyms", "exclude")
CONCEPTS = [{"ord": i, "label": label_of(c[0]), **dict(zip(_FIELDS, c, strict=True))} for i, c in enumerate(_CONCEPTS)]
BY_ID = {c["concept"]: c for c in CONCEPTS}
#: The 21 concepts that aren't totals, in presentation order.
LEAVES = [c["concept"] for c in CONCEPTS if not c["is_total"]]
TOTALS = list(COMPOSITION)


def dim_concept(spark: SparkSession) -> DataFrame:
    rows = [(c["concept"], c["ord"], c["label"], c["section"], c["grp"], GROUP_LABELS[c["grp"]], c["is_total"]) for c in CONCEPTS]
    return spark.createDataFrame(rows, "concept string, ord int, label string, section string, grp string, group_label string, is_total boolean")


def dim_synonym(spark: SparkSession) -> DataFrame:
    rows = [(c["concept"], c["ord"], k, s) for c in CONCEPTS for k, s in enumerate(c["synonyms"])]
    return spark.createDataFrame(rows, "concept string, ord int, k int, synonym string")


def about(concept: Column, field: str) -> Column:
    """A field of the concept that a column names, null for unknown ones: a constant map, so nothing is joined."""
    return F.element_at(F.create_map(*[F.lit(x) for c in CONCEPTS for x in (c["concept"], c[field])]), concept)
