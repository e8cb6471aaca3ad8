"""Bank statements as a pluggable source of transactions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.references import transaction_id
from tallyloom.plans.glyphs import glyph_map, pdf_face, pdf_fonts
from tallyloom.plans.statement import FILE, Layout, StatementError, glyphs_of_traces, page_problem, read_statements, require_balanced
from tallyloom.scratch import cut


class StatementSource(Protocol):
    """Anything that reads statements into rows of all directions."""

    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


def with_ids(rows: DataFrame) -> DataFrame:
    """Add the id that follows from a row's content and place."""
    names = ("source_file", "posted_date", "direction", "amount", "currency", "description", "source_page", "source_row")
    return rows.withColumn("id", transaction_id(*map(F.col, names)))


class GlyphStatements:
    """Statements whose glyphs lie in a table, as a PDF adapter writes them."""

    def __init__(self, glyph_map: DataFrame, layout: Layout = Layout()) -> None:
        self.glyph_map, self.layout = glyph_map, layout

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        rows, check = read_statements(spark.read.parquet(path), self.glyph_map, self.layout)
        require_balanced(check)
        return with_ids(rows.drop("stray").withColumnRenamed("file", "source_file"))


TRACES = "page int, width double, height double, spans array<struct<font:string,chars:array<struct<glyph_id:int,x0:double,y0:double,x1:double>>>>"


def pdf_traces(content: bytes) -> list[tuple]:
    """Pages with their width and height in points and their traced spans, by the
    PDF library of the installation."""
    import pymupdf

    pages = []
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if pdf.needs_pass or not len(pdf):
            raise StatementError("the statement is encrypted or empty")
        for number, page in enumerate(pdf, 1):
            spans = [(s.get("font"), [(int(c[1]), *map(float, c[3][:3])) for c in s["chars"]]) for s in page.get_texttrace()]
            pages.append((number, page.rect.width, page.rect.height, spans))
    return pages


class PdfStatements:
    """Statements as PDF files.

    Their fonts' characters are either given as a table, ``glyph_map``, or found by
    ``fonts``, which lists names and contents of a file's fonts, ``draw``, which
    draws one, and ``reference``, the ink of the known characters.  ``trace`` makes
    traced pages of a file's bytes: number, width and height where they are known
    (they must be the layout's), and spans.  All run on executors.
    """

    def __init__(
        self, glyph_map: DataFrame | None = None, layout: Layout = Layout(), trace: Callable[[bytes], list[tuple]] = pdf_traces,
        reference: DataFrame | None = None, fonts: Callable[[bytes], list[tuple]] = pdf_fonts, draw: Callable[[bytes, bool], Iterable[tuple]] = pdf_face,
    ) -> None:
        self.glyph_map, self.layout, self.trace = glyph_map, layout, trace
        self.reference, self.fonts, self.draw = reference, fonts, draw

    def _of_files(self, held: DataFrame, make: Callable[[bytes], list[tuple]], names: list[str], kind: str) -> DataFrame:
        """A row for each item that ``make`` lists of a file's content."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for file, content in zip(batch["path"], batch["content"], strict=True):
                    yield pd.DataFrame([("", file, *item) for item in make(bytes(content))], columns=["scope_id", "file", *names])

        return held.mapInPandas(run, "scope_id string, file string, " + kind)

    def _names(self, held: DataFrame) -> DataFrame:
        if self.glyph_map is not None:
            return self.glyph_map
        if self.reference is None:
            raise StatementError("no characters of the statement's fonts are known")
        embedded = self._of_files(held, self.fonts, ["font", "content"], "font string, content binary")
        return cut(glyph_map(embedded, FILE, self.reference, self.draw), "statement-fonts")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        held = spark.read.format("binaryFile").load(path).select("path", "content")
        names, trace = self._names(held), self.trace

        def pages_of(content: bytes) -> list[tuple]:
            chars = lambda cs: [dict(zip(("glyph_id", "x0", "y0", "x1"), c, strict=True)) for c in cs]
            return [(n, *(size or (None, None)), [{"font": f, "chars": chars(cs)} for f, cs in spans]) for n, *size, spans in trace(content)]

        pages = cut(self._of_files(held, pages_of, ["page", "width", "height", "spans"], TRACES), "statement-pages")
        odd = pages.where("width is not null").select("file", "page", page_problem(F.col("width"), F.col("height"), self.layout).alias("problem")).where("problem is not null")
        if bad := odd.orderBy("file", "page").limit(1).collect():
            raise StatementError(f"{bad[0]['file']}, page {bad[0]['page']}: {bad[0]['problem']}")
        rows, check = read_statements(cut(glyphs_of_traces(pages), "statement-glyphs"), names, self.layout)
        require_balanced(check)
        return with_ids(rows.drop("stray").withColumn("source_file", F.element_at(F.split("file", "/"), -1)).drop("file"))


class CsvStatements:
    """Statements as CSV with a header: scope_id, posted_date, direction, amount,
    currency, description, merchant_raw."""

    SCHEMA = "scope_id string, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string"

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        rows = spark.read.schema(self.SCHEMA).option("header", "true").option("multiLine", "true").csv(path)
        nothing = F.lit(None).cast("int")
        rows = rows.select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), nothing.alias("source_page"), nothing.alias("source_row"))
        return with_ids(rows)
