"""Documents as tables of pages, so that a long file is many tasks' work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.files import clean_page

#: A file's pages are read in this many parts at most, so its bytes are sent so often.
PARTS = 64


def page_rows(
    files: DataFrame, key: list[str], count: Callable[[bytes], int], read: Callable[[bytes, int, int], list[str]], least: int = 20, parts: int = PARTS
) -> DataFrame:
    """Key, page (from 1), text and error of files(key, content): a row a page.

    ``count`` gives a file's number of pages and ``read`` the texts of its pages
    from one number to before another; both run on executors.  Every part has at
    least ``least`` pages and is read by a task of its own choice.  A file that
    fails to count, or a part that fails to read, is one row without page and
    text whose ``error`` is the type of failure only, never what the file holds.
    Files without pages give no row; key columns are unique and are kept.
    """
    kinds = [files.schema[c].dataType.simpleString() for c in key]
    names = ", ".join(f"`{c}` {k}" for c, k in zip(key, kinds, strict=True))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, errors = [], []
            for content in batch.column("content"):
                try:
                    numbers.append(int(count(content.as_py() or b"")))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any reader's error becomes the file's
                    numbers.append(0)
                    errors.append(type(e).__name__)
            yield batch.append_column("pages", pa.array(numbers, pa.int32())).append_column("error", pa.array(errors, pa.string()))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in ("content", "a", "b", "error")}
                found: list[tuple] = [(None, None, at["error"])] if at["error"] else []
                if not found:
                    try:
                        found = [(at["a"] + i, t, None) for i, t in enumerate(read(at["content"] or b"", at["a"], at["b"]))]
                    except Exception as e:  # noqa: BLE001
                        found = [(None, None, type(e).__name__)]
                same = pa.array([row] * len(found), pa.int32())
                own = [batch.column(c).take(same) for c in key]
                page, text, error = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([*own, pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=[*key, "page", "text", "error"])

    known = files.select(*key, "content").mapInArrow(counted, f"{names}, content binary, pages int, error string")
    step = F.greatest(F.lit(least), F.ceil(F.col("pages") / parts).cast("int"))
    begins = F.when(F.col("error").isNotNull(), F.array(F.lit(1))).when(F.col("pages") > 0, F.sequence(F.lit(1), F.col("pages"), step))
    dealt = known.withColumn("a", F.explode(begins)).withColumn("b", F.least(F.col("a") + step, F.col("pages") + 1))
    dealt = dealt.repartition(*key, "a").select(*key, "content", "a", "b", "error")
    return dealt.mapInArrow(texts, f"{names}, page int, text string, error string")


def texts_of_pages(pages: DataFrame, key: list[str]) -> DataFrame:
    """Key, text and error of files from rows of their pages: the non-empty pages
    in order, a blank line between them; a file with an error has empty text."""
    cleaned = pages.withColumn("text", clean_page(F.col("text")))
    listed = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("page", "text"))))
    found = cleaned.groupBy(*key).agg(listed.alias("l"), F.max("error").alias("error"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n\n")
    return found.select(*key, F.when(F.col("error").isNull(), text).otherwise("").alias("text"), "error")


def pdf_page_count(content: bytes) -> int:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if pdf.needs_pass or not len(pdf):
            raise ValueError("encrypted or empty")
        return len(pdf)


def pdf_page_texts(content: bytes, first: int, end: int) -> list[str]:
    """Texts of a PDF's pages ``first`` to before ``end``, by the PDF library."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        return [pdf[n - 1].get_text() for n in range(first, end)]
