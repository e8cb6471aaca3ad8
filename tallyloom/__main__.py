"""``python -m tallyloom check-folder FOLDER``: check a folder's contract, and
match its bank statement, if it has one, in ``report.html``."""

from __future__ import annotations

import argparse
import sys
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import LANGUAGES, ConfigError, ocr_languages
from tallyloom.plans.contract import check_folders, report_texts
from tallyloom.plans.folders import audit_folders, pick_statements
from tallyloom.plans.glyphs import pdf_reference
from tallyloom.plans.reports import html_rows, write_html
from tallyloom.plans.statement import StatementError
from tallyloom.sources.files import read_pages, scan_documents, with_text
from tallyloom.sources.statements import PdfStatements, StatementSource


def read_folder(spark: SparkSession, folder: str, extract=read_pages) -> DataFrame | None:
    """The folder's files with content and text; None if it has none."""
    files = scan_documents(spark, folder, folder, content=True)
    return None if files.isEmpty() else with_text(files, extract)


def check_folder(spark: SparkSession, folder: str, extract=read_pages) -> str:
    """The text report of one folder."""
    files = read_folder(spark, folder, extract)
    if files is None:
        files = spark.createDataFrame([(folder, "-", "-", "")], "scope_id string, filename string, rel_path string, text string")
    folders, expected = check_folders(files.select("scope_id", "filename", "rel_path", "text"))
    return report_texts(folders, expected).first()["report"]


def statement_report(spark: SparkSession, folder: str, source: StatementSource, extract=read_pages) -> Path | None:
    """Match the folder's bank statement with its other files and write
    ``report.html`` there; None if the folder has no statement."""
    files = read_folder(spark, folder, extract)
    pick = None if files is None else pick_statements(files).first()
    if pick is None or (pick["statement"] is None and pick["problem"] is None):
        return None
    if pick["problem"]:
        raise StatementError(pick["problem"])
    transactions = source.read(spark, str(Path(folder) / pick["statement"])).withColumn("scope_id", F.lit(folder))
    result = audit_folders(files, transactions)
    target = Path(folder) / "report.html"
    write_html(html_rows(result), target)
    return target


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    command = parser.add_subparsers(dest="command", required=True).add_parser("check-folder")
    command.add_argument("folder")
    command.add_argument("--glyphs", help="Parquet table (font, glyph_id, ch) of the characters of statements' fonts")
    command.add_argument("--faces", nargs=2, metavar=("REGULAR", "BOLD"), help="font files whose characters the statements' fonts are compared with")
    command.add_argument("--languages", default="eng+lav", help="codes of the languages of images, joined by +")
    args = parser.parse_args(argv)
    try:
        extract = partial(read_pages, languages=ocr_languages({"language": args.languages, "supported_languages": LANGUAGES}))
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    try:
        print(check_folder(spark, args.folder, extract))
        known = spark.read.parquet(args.glyphs) if args.glyphs else None
        faces = pdf_reference(spark, *(Path(f).read_bytes() for f in args.faces)) if args.faces else None
        report = statement_report(spark, args.folder, PdfStatements(known, reference=faces), extract)
        if report is not None:
            print(f"\nStatement report: {report}")
    except (FileNotFoundError, NotADirectoryError, StatementError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
