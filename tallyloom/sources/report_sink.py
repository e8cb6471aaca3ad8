"""HTML reports as a data sink: executors write one page a scope.

    spark.dataSource.register(HtmlReports)
    write_reports(html_rows(result), folder)

Tasks write pages below a folder of the job; the driver moves them to their places
when all tasks have ended.  A job that fails leaves older pages as they were.
Executors and the driver see the folder under the same path.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyloom.plans.reports import PAGE, html_row


@dataclass
class Pages(WriterCommitMessage):
    """Scopes' names for files, of one task, and where their pages lie."""

    folder: str
    scopes: list[str]


class HtmlReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "html_reports"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


class PageWriter(DataSourceWriter):
    """Writes rows that come by scope; a scope's rows are in one partition."""

    def __init__(self, path: str) -> None:
        self.path = os.path.abspath(path)
        self.job = os.path.join(self.path, f".job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Pages:
        # A task that runs twice writes twice, and only the one that is committed counts.
        folder = os.path.join(self.job, uuid.uuid4().hex)
        os.makedirs(folder)
        head, tail = PAGE.format(rows="\0").split("\0")
        scopes: list[str] = []
        page = None
        here = None
        try:
            for row in iterator:
                if page is None or row["scope_id"] != here:
                    if page:
                        page.write(tail)
                        page.close()
                    here = row["scope_id"]
                    scopes.append(quote(str(here), safe="").replace(".", "%2E"))
                    page = open(os.path.join(folder, scopes[-1]), "w", encoding="utf-8")  # noqa: SIM115
                    page.write(head)
                else:
                    page.write("\n")
                page.write(html_row(row))
            if page:
                page.write(tail)
        finally:
            if page:
                page.close()
        return Pages(folder, scopes)

    def commit(self, messages: list[Pages | None]) -> None:
        for done in messages:
            for scope in done.scopes if done else ():
                target = os.path.join(self.path, scope)
                os.makedirs(target, exist_ok=True)
                os.replace(os.path.join(done.folder, scope), os.path.join(target, "report.html"))
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Pages | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


def write_reports(rows: DataFrame, folder: str) -> None:
    """Write ``folder/<scope>/report.html`` for every scope of the rows of
    ``html_rows``, in the order of ``ord`` if they have it, else by date and id.
    Marks other than letters, digits, ``_``, ``-`` and ``~`` in a scope's name are
    written as in a URL."""
    spark = rows.sparkSession
    spark.dataSource.register(HtmlReports)
    order = ["ord"] if "ord" in rows.columns else ["date", "transaction_id"]
    rows = rows.withColumn("scope_id", F.col("scope_id").cast("string"))
    dealt = rows.repartition("scope_id").sortWithinPartitions("scope_id", *order)
    dealt.write.format("html_reports").mode("append").save(folder)
