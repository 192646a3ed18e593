"""Geometry from SQL: table functions over the tokens of a page.

    register(spark)
    SELECT * FROM page_rows(TABLE(tokens) PARTITION BY (doc_id, page) ORDER BY token_seq)

Each call gets the rows of its own page alone, as Spark deals and sorts them; a task holds one page at a time. The columns of
tokens are those of layout.TOKENS, in any order; others are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession

from ..operators import layout

_KEY = "doc_id string, page int"


class _Page:
    """Gathers a page's tokens; subclasses tell what is made of them."""

    schema: str

    def __init__(self) -> None:
        self.key: tuple = (None, None)
        self.width = layout.PAGE_SIZE[0]
        self.tokens: list[tuple] = []

    def eval(self, token: Row) -> None:
        if lacking := [c for c in ("doc_id", "page", *layout.FIELDS) if c not in token]:
            raise ValueError(f"a table of tokens has these columns too: {', '.join(lacking)}")
        self.key = token["doc_id"], token["page"]
        told = token["page_width"] if "page_width" in token else None
        self.width = self.width if told is None else told
        self.tokens.append(tuple(token[c] for c in layout.FIELDS))

    def read(self) -> tuple[list[layout.Row], list[dict]]:
        return layout.read_page(self.tokens, self.key[1] or 1, self.width)

    def terminate(self) -> Iterator[tuple]:
        for row in self.rows():
            yield (*self.key, *row)

    def rows(self) -> Iterator[tuple]:
        raise NotImplementedError


class PageRows(_Page):
    """A row for each line of a page: its number from the top, baseline, label, text and number of tokens."""

    schema = f"{_KEY}, row_seq int, y double, label string, text string, n_tokens int"

    def rows(self) -> Iterator[tuple]:
        for i, r in enumerate(self.read()[0]):
            yield i, r.y, r.label, " ".join(t[0] for t in r.tokens), len(r.tokens)


class PageColumns(_Page):
    """A row for each value column of a page."""

    schema = f"{_KEY}, column_index int, right_edge double, left double, right double, support int"

    def rows(self) -> Iterator[tuple]:
        for c in self.read()[1]:
            yield c["column_index"], c["right_edge"], c["left"], c["right"], c["support"]


class PageCells(_Page):
    """A row for each figure of a page in its column."""

    schema = f"{_KEY}, row_seq int, column_index int, value double, confidence double, raw string"

    def rows(self) -> Iterator[tuple]:
        for i, r in enumerate(self.read()[0]):
            for c in r.cells:
                yield i, c.column, c.value, c.confidence, c.raw


class PageMatches(_Page):
    """A row for each labelled line of a page: the line whose figures are its own (null if none), and how sure that is."""

    schema = f"{_KEY}, row_seq int, label string, value_seq int, confidence double"

    def rows(self) -> Iterator[tuple]:
        rows = self.read()[0]
        at = {id(r): i for i, r in enumerate(rows)}
        for a, b, sure in layout.align(rows):
            yield at[id(a)], a.label, at[id(b)] if b else None, sure


FUNCTIONS = {"page_rows": PageRows, "page_columns": PageColumns, "page_cells": PageCells, "page_matches": PageMatches}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    from pyspark.sql.functions import udtf

    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=kind.schema))


__all__ = ["FUNCTIONS", "register"]
