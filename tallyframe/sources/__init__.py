"""Files to tokens: format sniffing, admission, spreadsheets, CSV and the text layer of PDF. What can't be read is an error row.

Old xls files (OLE2) are told by their first bytes, but not read: UNREADABLE_SPREADSHEET.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

# What may be read, and the most bytes of a file.
EXTENSIONS = ("pdf", "xlsx", "xlsm", "xls", "csv")
LIMIT = 15 * 1024 * 1024
# Fixed value: the least text that a document needs; less has no text layer.
LEAST_TEXT = 120
BLANK = re.compile(r"^[\s\-_.]*$")
# The size of a spreadsheet's cell, as a part of a page.
COLUMN, ROW = 120.0, 20.0
#: The most bytes that the parts of a workbook may inflate to.
INFLATED = 1 << 28
#: Codes of what goes wrong: where it happens, and the status of a reply.
CODES = {
    "UNSUPPORTED_FORMAT": ("admission", 415), "FILE_TOO_LARGE": ("admission", 400), "EMPTY_FILE": ("admission", 422), "NO_FILE": ("admission", 400), "TOO_MANY_FILES": ("admission", 400), "UNEXPECTED_FIELD": ("admission", 400), "UPLOAD_FAILED": ("admission", 400),
    "CORRUPT_PDF": ("format", 422), "UNRECOGNISED_CONTENT": ("format", 422), "UNREADABLE_PDF": ("reading", 422), "UNREADABLE_SPREADSHEET": ("reading", 422), "EMPTY_WORKBOOK": ("reading", 422), "NO_TEXT_LAYER": ("reading", 422),
    "NOT_FOUND": ("service", 404), "INTERNAL_ERROR": ("service", 500),
}
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sniff(content: Column, name: Column) -> Column:
    """pdf, excel, csv, or an error code, by the first bytes, then by the name."""
    head, low = F.hex(F.substring(content, 1, 8)), F.lower(name)
    starts = lambda *xs: head.rlike("^(" + "|".join(xs) + ")")
    return (
        F.when(starts("25504446"), "pdf").when(starts("504B0304", "504B0506", "D0CF11E0A1B11AE1"), "excel")
        .when(F.endswith(low, F.lit(".csv")), "csv").when(F.endswith(low, F.lit(".pdf")), "CORRUPT_PDF").otherwise("UNRECOGNISED_CONTENT")
    )


def admit(length: Column, name: Column, limit: int = LIMIT) -> Column:
    """Null, or the code of what keeps a file out."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(~kind.isin(*EXTENSIONS), "UNSUPPORTED_FORMAT").when(length > limit, "FILE_TOO_LARGE").when(length == 0, "EMPTY_FILE")


def kind_of(content: bytes, name: str) -> str:
    """sniff() of a single file."""
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith((b"PK\x03\x04", b"PK\x05\x06", bytes.fromhex("D0CF11E0A1B11AE1"))):
        return "excel"
    low = name.lower()
    return "csv" if low.endswith(".csv") else "CORRUPT_PDF" if low.endswith(".pdf") else "UNRECOGNISED_CONTENT"


def refusal(length: int, name: str, limit: int = LIMIT) -> str | None:
    """admit() of a single file."""
    if name.rpartition(".")[2].lower() not in EXTENSIONS or "." not in name:
        return "UNSUPPORTED_FORMAT"
    return "FILE_TOO_LARGE" if length > limit else "EMPTY_FILE" if length == 0 else None


def cell_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, date):
        return value.isoformat()[:10]
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return str(value)


def workbook(content: bytes) -> list[tuple[str, list[list]]]:
    """Sheets of an xlsx file: name and rows of cells (text, number, boolean, date or None)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if sum(x.file_size for x in z.infolist()) > INFLATED:
            raise ValueError("the workbook is too large")
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated = _date_styles(read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in read("xl/workbook.xml").iter(f"{_NS}sheet"):
            path = targets[sheet.get(f"{_REL}id")].lstrip("/")
            rows: list[list] = []
            for r in read(path if path.startswith("xl/") else f"xl/{path}").iter(f"{_NS}row"):
                row: list = []
                for c in r.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (at - len(row))
                    row.append(_cell(c, shared, dated))
                rows.append(row)
            out.append((sheet.get("name"), rows))
        return out


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _date_styles(styles) -> set[int]:
    """Cell styles that show dates: built-in formats, and own ones that hold a day or year."""
    own = {f.get("numFmtId"): f.get("formatCode") or "" for f in styles.iter(f"{_NS}numFmt")}
    is_date = lambda i: i in map(str, [*range(14, 23), *range(45, 48)]) or bool(re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")), re.I))
    xfs = styles.find(f"{_NS}cellXfs")
    return {k for k, x in enumerate(xfs if xfs is not None else []) if is_date(x.get("numFmtId", "0"))}


def _cell(c, shared: list[str], dated: set[int]):
    kind, v = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "e"):
        return v.text
    if kind == "b":
        return v.text == "1"
    n = float(v.text)
    return date(1899, 12, 30) + timedelta(days=int(n)) if int(c.get("s", "0")) in dated else n


def grid_tokens(sheets: list[tuple[str, list[list]]]) -> list[tuple]:
    """Tokens of sheets: a sheet is a page, a column 120 units wide, a row 20 units high; blank rows go first. A page without tokens has one without text."""
    out = []
    for page, (name, rows) in enumerate(sheets, 1):
        full = [r for r in rows if any(cell_text(v).strip() for v in r)]
        size = (COLUMN * max(1, max(map(len, full), default=1)), ROW * max(1, len(full)), name)
        own = [(i, j, text, isinstance(v, float)) for i, row in enumerate(full) for j, v in enumerate(row) if (text := cell_text(v).strip()) and not BLANK.match(text)]
        out += [(page, seq, text, COLUMN * j, -ROW * i, min(6.0 * len(text), COLUMN - 20), 10.0, number, *size) for seq, (i, j, text, number) in enumerate(own)] or [(page, 0, None, 0.0, 0.0, 0.0, 0.0, False, *size)]
    return out


_DATES = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%y", "%d-%b-%Y", "%d-%b-%y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y")


def typed(text: str):
    """A CSV cell as a spreadsheet has it: numbers (with separators, dollar or percent sign, or in brackets), dates and truth values become such."""
    s = text.strip()
    if s.upper() in ("TRUE", "FALSE"):
        return s.upper() == "TRUE"
    plain = re.sub(r"(?<=\d),(?=\d)", "", s).replace("$", "")
    m = re.fullmatch(r"(\()?\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(%)?\s*(\))?\s*(%)?", plain)
    if m and bool(m[1]) == bool(m[4]):
        n = float(m[2]) / (100 if m[3] or m[5] else 1)
        return (-n if m[1] else n) if abs(n) < float("inf") else text
    if re.search(r"\d", s) and len(s) <= 20:
        for form in _DATES:
            try:
                return datetime.strptime(s, form).date()
            except ValueError:
                continue
    return text


def csv_grid(content: bytes) -> list[list]:
    """Rows of a CSV file; a field may be as long as the file."""
    csv.field_size_limit(max(csv.field_size_limit(), len(content) + 1))
    return [[typed(s) for s in row] for row in csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))]


def pdf_tokens(content: bytes) -> list[tuple]:
    """Tokens of a PDF file's text layer, one for each run of text. A page without any has one without text."""
    out = []
    for page, (width, height, runs) in enumerate(pdf.read(content), 1):
        out += [(page, seq, text, x, y, w, h, False, width, height, None) for seq, (text, x, y, w, h) in enumerate(runs)] or [(page, 0, None, 0.0, 0.0, 0.0, 0.0, False, width, height, None)]
    return out


READERS = {"excel": (lambda c: grid_tokens(workbook(c)), "UNREADABLE_SPREADSHEET"), "csv": (lambda c: grid_tokens([("Sheet1", csv_grid(c))]), "UNREADABLE_SPREADSHEET"), "pdf": (pdf_tokens, "UNREADABLE_PDF")}
TOKENS = "doc_id string, page int, token_seq int, text string, x double, y double, width double, height double, is_numeric boolean, page_width double, page_height double, page_name string, code string"


def tokens_in(path: str, content: bytes, kind: str) -> list[tuple]:
    """The tokens of a file of this kind, or a row with an error code: of the kind, if that is a code, or of the reader."""
    if kind not in READERS:
        return [(path, *[None] * 11, kind)]
    reader, code = READERS[kind]
    try:
        got = reader(content)
    except Exception:  # whatever a damaged file sets off is that file's error, never the job's
        return [(path, *[None] * 11, code)]
    return [(path, *t, None) for t in got] or [(path, *[None] * 11, "EMPTY_WORKBOOK")]


def tokens_of_files(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """files: path, length, content (as binaryFile yields). Tokens with doc_id = path; a file that can't be read is one row with code instead.

    What isn't admitted is told by its name and length alone: its content is neither read nor sent to Python.
    """
    names = [x.split()[0] for x in TOKENS.split(", ")]
    refused = admit(F.col("length"), F.col("path"), limit)
    out_ = files.select("path", "length").filter(refused.isNotNull()).select(F.col("path").alias("doc_id"), *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in TOKENS.split(", ")[1:-1]], refused.alias("code"))

    def run(batches):
        for own in batches:
            for f in own.itertuples():
                yield pd.DataFrame(tokens_in(f.path, bytes(f.content), f.kind), columns=names)

    admitted = files.filter(refused.isNull()).select("path", "content", sniff(F.col("content"), F.col("path")).alias("kind"))
    return admitted.mapInPandas(run, TOKENS).unionByName(out_)


def documents(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """A row for each file: doc_id, file_name, file_size, format, page_count (of PDF), sheet_names (of workbooks), text_length, error (null where it can be read).

    tokens: of tokens_of_files(). A document with too little text has no text layer.
    """
    kind = F.when(F.lower("path").rlike(r"\.pdf$"), "pdf").otherwise("excel")
    pages = tokens.groupBy("doc_id", "page").agg(F.first("page_name", ignorenulls=True).alias("name"), F.sum(F.length("text")).alias("n"), F.max("code").alias("code"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("page", "name")))), lambda x: x["name"])
    told = pages.groupBy("doc_id").agg(F.max("code").alias("code"), F.count("page").cast("int").alias("pages"), names.alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("text_length"))
    out = files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), kind.alias("format")).join(told, "doc_id", "left")
    error = F.coalesce("code", F.when(F.col("text_length") < LEAST_TEXT, "NO_TEXT_LAYER"))
    return out.select("doc_id", "file_name", "file_size", "format", F.when(F.col("format") == "pdf", F.col("pages")).alias("page_count"), F.when(F.col("format") != "pdf", F.col("names")).alias("sheet_names"), "text_length", error.alias("error"))


def dim_code(spark: SparkSession) -> DataFrame:
    """code, stage, status: what can go wrong with a file."""
    return spark.createDataFrame([(k, *v) for k, v in CODES.items()], "code string, stage string, status int")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def save_report(report: DataFrame, path: str) -> None:
    """One JSON document for each statement."""
    report.write.mode("overwrite").json(path)


def errors(tokens: DataFrame) -> DataFrame:
    """doc_id, code: the dead-letter rows of tokens_of_files()."""
    return tokens.filter("code is not null").select("doc_id", "code")
