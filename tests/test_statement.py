import datetime
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe import sources, streaming
from tallyframe.operators import analysis as A
from tallyframe.operators import layout, statement

# Figures of two years, and what they add up to.
FIGURES = """shareCapital 37362140 37362140
reservesAndSurplus 513975424 491983895
longTermBorrowings 202508939 273290824
deferredTaxLiabilities 2611863 7656018
shortTermBorrowings 361211353 491257194
tradePayables 27056594 27795484
otherCurrentLiabilities 32091101 41171976
propertyPlantAndEquipment 64282324 127137234
currentInvestments 7330400 7330400
inventories 699006548 798810631
tradeReceivables 245438959 213511710
cashAndCashEquivalents 33721121 88054819
shortTermLoansAndAdvances 127098062 135072732"""


def figures(spark, **changed):
    rows = []
    for line in FIGURES.splitlines():
        c, a, b = line.split()
        if changed.get(c, 1) is not None:
            rows += [("d", c, f"FY{y}", y, float(v), "extracted", 0.9) for y, v in ((2024, a), (2023, b))]
    rows += [("d", c, "FY2024", 2024, v, "extracted", 0.9) for c, v in changed.items() if v is not None]
    return spark.createDataFrame(rows, "doc_id string, concept string, period_id string, ord int, value double, origin string, confidence double")


def test_roll_up_and_checks(spark):
    rows = A.roll_up(A.wide(figures(spark)))
    got = {r["concept"]: r["value"] for r in A.long(rows).filter("ord = 2024").collect()}
    want = {"totalEquity": 551337564, "totalCurrentLiabilities": 420359048, "totalNonCurrentLiabilities": 205120802, "totalCurrentAssets": 1112595090, "totalAssets": 1176877414, "totalEquityAndLiabilities": 1176817414}
    assert {k: got[k] for k in want} == want
    check = A.balance_checks(rows).filter("ord = 2024").first()
    assert check["difference"] == 60000 and check["status"] == "balanced"


def test_metrics(spark):
    m = {r["metric"]: r for r in A.metrics(A.roll_up(A.wide(figures(spark)))).filter("ord = 2024").collect()}
    for name, value in (("currentRatio", 2.647), ("debtToEquity", 1.022), ("workingCapital", 692236042), ("totalDebt", 563720292), ("assetToLiability", 1.882), ("quickRatio", 0.984)):
        assert m[name]["value"] == pytest.approx(value, abs=6e-4)
    assert m["totalDebt"]["change_pct"] == pytest.approx(-0.2626, abs=1e-4) and m["currentRatio"]["verdict"] == "strong"


def test_printed_totals(spark):
    rows = A.roll_up(A.wide(figures(spark, totalEquity=552000000.0, totalCurrentAssets=5.0)))
    r = rows.filter("ord = 2024").select("totalEquity.*").first()
    assert r["value"] == 552000000 and r["origin"] == "extracted" and r["confidence"] == pytest.approx(0.99)
    r = rows.filter("ord = 2024").select("totalCurrentAssets.*").first()
    assert r["value"] == 1112595090 and r["origin"] == "derived"


def test_insights_and_summary(spark):
    rows = A.roll_up(A.wide(figures(spark)))
    found = {r["insight"]: r for r in A.insights(rows).collect()}
    assert {"liquidity-strong", "inventory-heavy-liquidity", "leverage-moderate", "debt-trend"} <= set(found)
    assert found["liquidity-strong"]["title"] == "Current assets cover current liabilities 2.65×" and found["liquidity-strong"]["evidence"] == ["currentRatio", "workingCapital"]
    assert "went from ₹76.45 Cr to ₹56.37 Cr, by -26.3%" in found["debt-trend"]["detail"] and "(2.22× the year before)" in found["liquidity-strong"]["detail"]
    assert A.summary(rows).first()["summary"].startswith("The company has total assets of ₹117.69 Cr at FY2024, of which ₹55.13 Cr is equity. The current ratio is 2.65×, and debt is 1.02× of equity. First strength: ")
    one_year = A.roll_up(A.wide(figures(spark).filter("ord = 2024")))
    said = {r["insight"]: r for r in A.insights(one_year).collect()}
    assert "debt-trend" not in said and "year before" not in said["liquidity-strong"]["detail"]
    missing = A.roll_up(A.wide(figures(spark, inventories=None)))
    assert A.balance_checks(missing).filter("ord = 2024").first()["status"] == "imbalanced"


def test_periods_without_figures_count(spark):
    periods = spark.createDataFrame([("d", "FY2025", 2025), ("d", "FY2024", 2024), ("d", "FY2023", 2023)], "doc_id string, period_id string, ord int")
    two = A.latest_two(A.roll_up(A.wide(figures(spark), periods))).first()
    assert two["period_id"] == "FY2025" and two["status"] == "insufficient-data" and two["p_inventories"] == 699006548


def test_equal_years_have_an_order(spark):
    """FY2024 and FY2024-2 have the same ord: the first is newer, whatever the partitions."""
    f = figures(spark)
    both = f.filter("ord = 2024").unionByName(f.filter("ord = 2023").withColumns({"ord": F.lit(2024), "period_id": F.lit("FY2024-2")}))
    for n in (1, 4):
        m = A.metrics(A.roll_up(A.wide(both.repartition(n)))).filter("metric = 'totalDebt' and change is not null").collect()
        assert [(r["period_id"], round(r["change_pct"], 2)) for r in m] == [("FY2024", -0.26)]


def test_report_is_one_row(spark):
    r = A.report(figures(spark)).collect()
    assert len(r) == 1 and len(r[0]["metrics"]) == 11 and all(len(m["values"]) == 2 for m in r[0]["metrics"])
    current = next(m for m in r[0]["metrics"] if m["metric"] == "currentRatio")
    assert current["values"][0]["workings"] == "₹111.26 Cr / ₹42.04 Cr" and current["formula"] == "total current assets / total current liabilities" and current["values"][0]["period_id"] == "FY2024"
    assert r[0]["warnings"] == [] or all(w["code"] == "BALANCE_VARIANCE" for w in r[0]["warnings"])


def row(y, label, *values):
    return layout.Row(y, 1, [], label, [layout.Cell(i, float(v), 1.0, False, "", 400.0 + 90 * i, 45.0) for i, v in enumerate(values)])


def test_alignment_of_a_skewed_page():
    rows = []
    for i in range(7):
        rows += [row(600 - 24 * i, f"Caption {i}"), row(593 - 24 * i, "", 1000 + i, 2000 + i)]
    assert layout.vertical_offset(rows) == 7
    assert [b.cells[0].value for _, b, _ in layout.align(rows)] == [1000 + i for i in range(7)]
    level = [row(600 - 20 * i, f"Caption {i}", 5 * i) for i in range(4)]
    assert layout.vertical_offset(level) == 0 and all(b is a for a, b, _ in layout.align(level))
    assert [b for _, b, _ in layout.align([row(10, "a"), row(0, "b")])] == [None, None]


def test_stitching():
    assert [r[0] for r in layout.stitch([("79,88,10,63", 0, 60, False), ("I", 62, 6, False)], 8)] == ["79,88,10,63I"]
    assert len(layout.stitch([("1,000", 0, 30, False), ("2,000", 90, 30, False)], 8)) == 2
    assert len(layout.stitch([("1,000", 0, 30, False), ("and", 31, 10, False), ("2,000", 42, 30, False)], 8)) == 2


LINES = [
    ("Acme Exports Limited", None, None), ("Balance Sheet as at 31st March 2024", None, None), ("Particulars", "31st Mar 2024", "31st March 2023"), ("EQUITY AND LIABILITIES", None, None),
    ("Share Capital", 37362140, 37362140), ("Reserves and Surplus", 513975424, 491983895), ("Non-Current Liabilities", None, None), ("Long-Term Borrowings", 202508939, 273290824), ("Deferred Tax Liabilities", 2611863, 7656018),
    ("Current Liabilities", None, None), ("Short-Term Borrowings", 361211353, 491257194), ("Trade Payables", 27056594, 27795484), ("Other Current Liabilities", 32091101, 41171976),
    ("ASSETS", None, None), ("Property, Plant and Equipment", 64282324, 127137234), ("Current Assets", None, None), ("Current Investments", 7330400, 7330400), ("Inventories", 699006548, 798810631),
    ("Trade Receivables", 245438959, 213511710), ("Cash and Cash Equivalents", 33721121, 88054819), ("Short-Term Loans and Advances", 127098062, 135072732),
]


def xlsx(lines) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda v: "<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="BS" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def tokens_of(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    return sources.read_files(spark, str(tmp_path / "in"))


def as_csv(lines) -> bytes:
    return "\n".join(",".join("" if v is None else f'"{v}"' if isinstance(v, str) else str(v) for v in r) for r in lines).encode()


def named(df):
    return {r["doc_id"].rpartition("/")[2]: r for r in df.collect()}


WANT = {line.split()[0]: float(line.split()[1]) for line in FIGURES.splitlines()}


def test_files_to_reports(spark, tmp_path):
    """Every file has its row: a workbook, CSV and PDF with the same statement, and files that can't be read."""
    bad = {"c.pdf": b"%PDF-1.7", "d.xlsx": b"PK\x03\x04 no", "e.txt": b"x", "f.csv": b"a,b\n1,2", "h.xlsx": xlsx([["=" * 200, 1], [None, 2]]).replace(b"inlineStr", b"s"), "i.xls": bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 500}
    files = tokens_of(spark, tmp_path, {"a.xlsx": xlsx(LINES), "b.csv": as_csv(LINES), "p.pdf": pdf(LINES), **bad})
    got = named(streaming.reports(files))
    assert {k: r["error"] for k, r in got.items()} == {"a.xlsx": None, "b.csv": None, "p.pdf": None, "c.pdf": "UNREADABLE_PDF", "d.xlsx": "UNREADABLE_SPREADSHEET", "e.txt": "UNSUPPORTED_FORMAT", "f.csv": "NO_TEXT_LAYER", "h.xlsx": "UNREADABLE_SPREADSHEET", "i.xls": "UNREADABLE_SPREADSHEET"}
    for k in ("a.xlsx", "b.csv", "p.pdf"):
        r = got[k]
        newest = r["periods"][0]["period_id"]
        values = {x["concept"]: f["value"] for x in r["statement"] if not x["is_total"] for f in x["figures"] if f["key"] == newest for f in [f["value"]]}
        assert values == WANT, k
        assert [p["period_id"] for p in r["periods"]] == ["FY2024", "FY2023"] and r["company"]["name"] == "Acme Exports LIMITED" and r["company"]["title"].startswith("Balance Sheet as at")
        cash = next(x for x in r["statement"] if x["concept"] == "cashAndCashEquivalents")["figures"][1]["value"]
        assert cash["source_label"] == "Cash and Cash Equivalents" and cash["page"] == 1 and cash["origin"] == "extracted" and cash["mark"] is None and cash["raw"].replace(",", "") == "33721121"
        assert next(x for x in r["statement"] if x["concept"] == "totalAssets")["figures"][0]["value"]["mark"] == "derived"
        assert r["summary"].startswith("Acme Exports LIMITED has total assets of ₹117.69 Cr at 31st Mar") and 0 < r["confidence"] <= 1 and r["narrated"] is False and r["assisted"] is False
    assert got["p.pdf"]["source"]["page_count"] == 1 and got["a.xlsx"]["source"]["sheet_names"] == ["BS"] and got["e.txt"]["summary"] is None
    assert sources.dim_code(spark).filter(F.col("code").isin([r["error"] for r in got.values() if r["error"]])).count() == 4
    empty = spark.createDataFrame([("x/a.csv", 0, bytearray()), ("x/b.pdf", 16 * 1024 * 1024, bytearray(b"%PDF"))], "path string, length long, content binary")
    assert {r["code"] for r in sources.errors(sources.tokens_of_files(empty)).collect()} == {"EMPTY_FILE", "FILE_TOO_LARGE"}


def test_odd_files_are_error_rows(spark, tmp_path):
    """Whatever a file sets off in a reader stays with it; a field of any length is read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook")
    stream = b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R]>> endobj 3 0 obj <</Type/Page/Contents 4 0 R>> endobj 4 0 obj <</Length 9/Filter/FlateDecode>> stream\nnot flate\nendstream"
    files = tokens_of(spark, tmp_path, {"a.csv": b'"' + b"x" * 140_000 + b'",1', "b.xlsx": out.getvalue(), "c.pdf": b"%PDF-1.4 " + stream, "d.pdf": b"%PDF-1.4 /Encrypt 5 0 R", "e.pdf": b"plain"})
    tokens = sources.tokens_of_files(files)
    assert {k.rpartition("/")[2]: c for k, c in ((r["doc_id"], r["code"]) for r in sources.errors(tokens).collect())} == {"b.xlsx": "UNREADABLE_SPREADSHEET", "c.pdf": "UNREADABLE_PDF", "d.pdf": "UNREADABLE_PDF", "e.pdf": "CORRUPT_PDF"}
    assert tokens.filter("code is null").select(F.max(F.length("text"))).first()[0] == 140_000


def test_cells_of_csv():
    cell = sources.typed
    assert [cell(x) for x in ("1,234", "(1,234.5)", "12%", "$5", "1e3", " 7 ", "TRUE", "2024-03-31", "31-Mar-2024", "Cash", "", "1,2,x", "12-34")] == [1234.0, -1234.5, 0.12, 5.0, 1000.0, 7.0, True, datetime.date(2024, 3, 31), datetime.date(2024, 3, 31), "Cash", "", "1,2,x", "12-34"]
    tokens = sources.grid_tokens([("S", [["Cash", 5.0, None], [None, None, None], ["–", "-", 2.5, 7.0]]), ("T", [])])
    assert [t[2:6] for t in tokens] == [("Cash", 0.0, 0.0, 24.0), ("5", 120.0, 0.0, 6.0), ("–", 0.0, -20.0, 6.0), ("2.5", 240.0, -20.0, 18.0), ("7", 360.0, -20.0, 6.0), (None, 0.0, 0.0, 0.0)]
    assert {t[8:] for t in tokens} == {(480.0, 40.0, "S"), (120.0, 20.0, "T")}


def pdf(lines, packed=True) -> bytes:
    """A page with a simple font for captions, and one with a map to Unicode and two-byte codes for figures."""
    shown = []
    for i, r in enumerate(lines):
        y = 800 - 20 * i
        shown.append(f"BT /F1 10 Tf 1 0 0 1 50 {y} Tm [({r[0][:3]}) 20 ({r[0][3:]})] TJ ET".encode())
        for v, right in zip(r[1:], (400, 520), strict=False):
            if v is not None:
                text = f"{v:,}" if isinstance(v, int) else v
                shown.append(f"q 2 0 0 2 0 0 cm BT /F2 5 Tf {(right - 5 * len(text)) / 2} {y / 2} Td <{''.join(f'{ord(c):04x}' for c in text)}> Tj ET Q".encode())
    content = b"\n".join(shown)
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0020> <007e> <0020> endbfrange"
    stream = lambda raw: b"<</Filter/FlateDecode/Length %d>>\nstream\n%b\nendstream" % (len(zlib.compress(raw)), zlib.compress(raw))
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 595 842]/Resources<</Font<</F1 5 0 R/F2 6 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>",
        5: b"<</Type/Font/Subtype/TrueType/Encoding/WinAnsiEncoding/FirstChar 32/Widths[" + b"500 " * 95 + b"]>>", 6: b"<</Type/Font/Subtype/Type0/ToUnicode 8 0 R/DescendantFonts[7 0 R]>>", 7: b"<</Type/Font/W[32 126 500]>>",
    }
    head = b"%PDF-1.5\n4 0 obj " + stream(content) + b" endobj\n8 0 obj " + stream(cmap) + b" endobj\n"
    if not packed:
        return head + b"".join(b"%d 0 obj %b endobj\n" % x for x in objects.items())
    index, body = b"", b""
    for n, x in objects.items():
        index += b"%d %d " % (n, len(body))
        body += x + b" "
    return head + b"9 0 obj <</Type/ObjStm/N %d/First %d/Length %d>>\nstream\n%b\nendstream endobj\n" % (len(objects), len(index), len(index + body), index + body)


def test_pdf_runs():
    from tallyframe.sources import pdf as reader

    for packed in (True, False):
        ((width, height, runs),) = reader.read(pdf([("Cash (net)", 1234, None), ("Due [b]", None, 5)], packed))
        assert (width, height) == (595, 842)
        assert [(t, round(x, 1), round(y, 1), round(w, 1), round(h, 1)) for t, x, y, w, h in runs] == [("Cash (net)", 50, 800, 49.8, 10), ("1,234", 375, 800, 25, 10), ("Due [b]", 50, 780, 34.8, 10), ("5", 515, 780, 5, 10)]
    with pytest.raises(ValueError):
        reader.read(b"%PDF-1.7 nothing")
    read = reader.Reader(rb"(a\(b(c)\051 \
d\n) <48 6> /A#20b -1.5 [1 0 R true] % rest")
    assert [read.next() for _ in range(5)] == [b"a(b(c)) d\n", b"H`", "A b", -1.5, [reader.Ref(1), True]] and read.next() is None


def test_two_pages(spark, tmp_path):
    """Claims on one sheet, assets on the next, notes before: both are read, each with its own sections."""
    half = LINES.index(("ASSETS", None, None))
    ns = [("Notes forming part of the accounts", 1, 2), ("Cash in hand", 1234, 5678)]
    out = io.BytesIO()
    made = [xlsx(x) for x in (ns, LINES[:half], [LINES[2], *LINES[half:]])]
    with zipfile.ZipFile(out, "w") as z:
        sheets = "".join(f'<sheet name="S{i}" r:id="r{i}"/>' for i in range(3))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(3)) + "</Relationships>")
        for i, x in enumerate(made):
            z.writestr(f"xl/worksheets/sheet{i}.xml", zipfile.ZipFile(io.BytesIO(x)).read("xl/worksheets/sheet1.xml"))
    tokens = sources.tokens_of_files(tokens_of(spark, tmp_path, {"a.xlsx": out.getvalue()})).drop("code")
    read = statement.statements(tokens)
    assert sorted(r["page"] for r in read.chosen.collect()) == [2, 3]
    assert {r["concept"]: r["value"] for r in read.figures.filter("ord = 2024").collect()} == WANT


def test_layout_of_cells():
    page = lambda *rows: [(i, *t) for i, t in enumerate(t for r in rows for t in r)]
    numbers = lambda y, *cells: [(text, x, y, 6.0 * len(text), 10.0, numeric) for text, x, numeric in cells]
    rows, columns = layout.read_page(page(numbers(0, ("Cash", 0, False), ("12345678901234567890", 240, False)), numbers(-20, ("Stock", 0, False), ("98765432109876543210", 240, False))), 1, 360.0)
    assert columns == [] and rows[0].label == "Cash 12345678901234567890", "what doesn't parse founds no column"
    rows, columns = layout.read_page(page(*[numbers(-20 * i, ("Cash", 0, False), ("12", 120, True), ("8600", 240, True)) for i in range(3)]), 1, 360.0)
    assert [c["right_edge"] for c in columns] == [264] and [c.value for c in rows[0].cells] == [8600] and rows[0].label == "Cash 12" and rows[0].start == 0
    two = [("Both", 0, -60, 24.0, 10.0, False), ("1,000", 231, -60, 18.0, 10.0, False), ("l,00", 254, -60, 20.0, 10.0, False)]
    rows, _ = layout.read_page(page(*[numbers(-20 * i, ("Cash", 0, False), ("9,999", 234, False)) for i in range(3)], two), 1, 360.0)
    assert [c.value for c in rows[-1].cells] == [1000], "the surer of two figures for a column stays"
    single, columns = layout.read_page(page(numbers(0, ("a", 0, False), ("1,000", 200, False), ("2,000", 400, False))), 1, 595.0)
    assert len(columns) == 2 and all(c["support"] == 1 for c in columns), "without any column of support enough all stay"


def test_duplicate_years_and_unread_ones(spark):
    def tokens(*heads):
        rows = [("d", 1, k, text, x, 100.0, 60.0, 8.0, False) for k, (text, x) in enumerate(zip(heads, (390.0, 480.0), strict=True))]
        rows += [("d", 1, 10 * i + k, text, x, 80.0 - 20 * i, 6.0 * len(text), 8.0, False) for i in range(3) for k, (text, x) in enumerate((("Cash", 60.0), ("1,000", 420.0), ("2,000", 510.0)))]
        return spark.createDataFrame(rows, "doc_id string, page int, token_seq int, text string, x double, y double, width double, height double, is_numeric boolean")

    got = statement.periods(layout.pages(tokens("2024", "2024"))).orderBy("column_index").collect()
    assert [(r["period_id"], r["ord"]) for r in got] == [("FY2024", 2024), ("FY2024-2", 2024)]
    read = statement.statements(tokens("this", "last"))
    assert [(r["period_id"], r["ord"], r["end_date"]) for r in read.periods.orderBy("column_index").collect()] == [("COL1", 2, None), ("COL2", 1, None)]
    assert {r["code"] for r in read.warnings.collect()} == {"LOW_CONCEPT_MATCH", "PERIOD_LABELS_INFERRED"}
    none = statement.statements(tokens("this", "last").filter("text in ('this', 'last')"))
    assert {r["code"] for r in none.warnings.collect()} == {"LOW_CONCEPT_MATCH", "NO_VALUE_COLUMNS", "NO_LINE_ITEMS"}
    assert statement.statements(tokens("a", "b").limit(0)).figures.count() == 0


def test_unmapped_rows_and_help(spark):
    rows = [("d", 1, 10 * i + k, text, x, 500.0 - 20 * i, 6.0 * len(text), 8.0, False) for i, label in enumerate(("Inventories", "Odd things", "Trade payables", "Cash", "More odd things")) for k, (text, x) in enumerate(((label, 60.0), (f"{i + 1},000", 420.0)))]
    rows.append(("d", 1, 99, "in thousands 2024", 330.0, 560.0, 100.0, 8.0, False))
    read = statement.statements(spark.createDataFrame(rows, "doc_id string, page int, token_seq int, text string, x double, y double, width double, height double, is_numeric boolean"))
    assert [tuple(r) for r in read.unmapped.select("row_index", "label", "value").orderBy("row_index").collect()] == [(0, "Odd things", 2_000_000.0), (1, "More odd things", 5_000_000.0)]
    offers = spark.createDataFrame([("d", 0, "tradeReceivables", 0.9, 1), ("d", 1, "inventories", 0.9, 2), *[("d", 1, "goodwill", 0.9, 3 + i) for i in range(38)], ("d", 1, "intangibleAssets", 0.9, 41)], "doc_id string, row_index int, concept string, confidence double, seq int")
    merged = A.merge_assisted(read.figures, read.unmapped, offers)
    assert [(r["concept"], r["value"], r["confidence"], r["source_label"]) for r in merged.filter("origin = 'assisted'").collect()] == [("tradeReceivables", 2_000_000.0, 0.75, "Odd things")], "only the first 40 proposals count"
    report = A.report(merged, read.periods, read.companies, read.warnings, read.unmapped).first()
    assert report["assisted"] and {w["code"] for w in report["warnings"]} >= {"ASSISTED_MAPPING", "UNIT_SCALED"} and len(report["unmapped"]) == 2


def test_stream_of_files(spark, tmp_path):
    tokens_of(spark, tmp_path, {"a.xlsx": xlsx(LINES)})
    seen = []
    streaming.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert len(seen) == 1 and seen[0]["error"] is None and seen[0]["company"]["name"] == "Acme Exports LIMITED"


def test_assist_tables(spark):
    from tallyframe.operators import assist

    rows = A.roll_up(A.wide(figures(spark)))
    found = A.insights(rows)
    schema = "doc_id string, summary string, insights array<struct<kind:string,severity:string,title:string,detail:string>>"
    told = spark.createDataFrame([("d", "x" * 50, [("strength", "low", "Fine", "so"), ("odd", "low", "No", "so")])], schema)
    assert [(r["title"], r["detail"], r["evidence"]) for r in assist.narrate(found, told).collect()] == [("Fine", "so", [])]
    narrated = A.report(figures(spark), narrative=told).first()
    assert narrated["summary"] == "x" * 50 and narrated["narrated"] and len(narrated["insights"]) == 1
    short = spark.createDataFrame([("d", "x", [("strength", "low", "Fine", "so")])], schema)
    assert assist.narrate(found, short).count() == found.count()
    block = assist.data_block(A.long(rows), A.metrics(rows), found).first()["block"]
    assert "currentRatio FY2024 2.65 strong" in block and block.index("inventories FY2024") < block.index("currentRatio FY2024") < block.index("low strength")
    c = lambda **k: {n: F.lit(v) for n, v in k.items()}
    want = lambda sure, rows, there, no: spark.range(1).select(assist.wanted(*c(a=sure, b=rows, c=there, d=no).values()).alias("x")).first()["x"]
    assert want(0.5, 0, True, False) and want(0.9, 1, True, False) and not want(0.9, 0, True, False) and not want(0.5, 1, False, False) and not want(0.5, 1, True, True)


def test_labels_are_read_once_for_each_distinct_one(spark, monkeypatch):
    """A page's captions are the same whether what is known of labels is broadcast or met in a shuffle, and a query makes no tables that it doesn't ask for."""
    from tallyframe.operators import joins

    texts = ("EQUITY AND LIABILITIES", "Trade payables", "Current assets", "Cash and cash equivalents", "Cash and cash equivalents", "")
    tokens = spark.createDataFrame([(str(d), 1, 10 * i + j, t, x, 700.0 - 24 * i, 6.0 * len(t), 8.0, False) for d in range(3) for i, text in enumerate(texts) for j, (t, x) in enumerate(((text, 60.0), (f"1,{i}{d}0", 402.0), (f"2,{i}{d}0", 492.0)))], "doc_id string, page int, token_seq int, text string, x double, y double, width double, height double, is_numeric boolean")
    read = statement.statements(tokens)
    assert read.companies.count() == 3 and not {"periods", "_rows"} & set(vars(read))
    few = {tuple(r) for r in read.captions.collect()}
    monkeypatch.setattr(joins, "FEW", 0)
    assert few == {tuple(r) for r in statement.captioned(read.pages).collect()} and len(few) == 18
    assert {r[6] for r in few if r[3] == "Cash and cash equivalents"} == {"assets"}
