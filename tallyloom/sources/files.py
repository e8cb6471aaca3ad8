"""Folders of documents: listing, content, and text through adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.ocr_packs import OcrError, find_program, pack_folders, prepared_packs
from tallyloom.sources.scan import SUFFIXES, DocumentFolder


def scan_documents(spark: SparkSession, root: str | Path, scope_id: str = "", content: bool = False) -> DataFrame:
    """Supported files below a folder: scope_id, path, rel_path, filename and
    document_type, in the order of rel_path, and their content if asked for.

    Suffixes count in any case; empty and hidden files are listed and folders
    are not.  Executors list and read the files (``DocumentFolder``).
    """
    root = Path(root)
    if not root.exists():
        raise FileNotFoundError(root)
    if not root.is_dir():
        raise NotADirectoryError(root)
    spark.dataSource.register(DocumentFolder)
    options = {"content": str(content).lower(), "scope_id": scope_id, "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("document_folder").options(**options).load(str(root)).orderBy("rel_path")


def read_stored(spark: SparkSession, glob: str) -> DataFrame:
    """The same columns with content and its hash, for files in any store that
    Spark reads.  Spark's reader leaves out empty and hidden files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), kind.alias("document_type"), "content")
    return named.where(F.col("document_type").isin(*SUFFIXES)).withColumn("file_hash", F.sha2("content", 256))


def clean_page(text):
    """A page's text with plain line ends and without blanks at line ends."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?|\f", "\n"), r"(?Um)[^\S\n]+$", "")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def joined_pages(pages):
    """The non-empty pages of an array, a blank line between them."""
    return F.array_join(F.filter(F.transform(pages, clean_page), lambda p: p != ""), "\n\n")


def with_text(files: DataFrame, extract: Callable[[bytes, str], list[str]]) -> DataFrame:
    """Add text and extract_error to files(content, document_type, ...).

    ``extract`` gives the pages of one file; it runs on executors.  A file that
    fails has empty text, and its error names the type of failure only, never
    what the file holds.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in batches:
            out = []
            for content, kind in zip(contents, kinds, strict=True):
                try:
                    out.append((list(extract(bytes(content), kind)), None))
                except Exception as e:  # noqa: BLE001  any extractor's error becomes the file's
                    out.append(([], type(e).__name__))
            yield pd.DataFrame(out, columns=["pages", "error"])

    read = F.pandas_udf(run, "pages array<string>, error string")
    found = files.withColumn("read", read("content", "document_type"))
    return found.withColumn("text", joined_pages("read.pages")).withColumn("extract_error", F.col("read.error")).drop("read")


def pdf_pages(content: bytes, kind: str) -> list[str]:
    """Pages of a PDF's text layer, by the PDF library of the installation."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        if pdf.needs_pass or not len(pdf):
            raise ValueError("encrypted or empty")
        return [page.get_text() for page in pdf]


def threshold(gray: np.ndarray, block: int = 31, offset: float = 11) -> np.ndarray:
    """A grey image in black and white: against the Gaussian mean of each pixel's
    surroundings, or, if a side is no longer than ``block``, against the one
    level that parts dark and light best."""
    if gray.ndim != 2:
        raise OcrError("the image is not grey")
    if min(gray.shape) <= block:
        share = np.bincount(gray.ravel(), minlength=256) / max(1, gray.size)
        below, mean = np.cumsum(share), np.cumsum(share * np.arange(256))
        with np.errstate(divide="ignore", invalid="ignore"):
            between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
        return np.where(gray > int(np.nan_to_num(between, posinf=0.0).argmax()), 255, 0).astype(np.uint8)
    sigma, half = 0.3 * ((block - 1) * 0.5 - 1) + 0.8, block // 2
    weights = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    mean = np.pad(gray.astype(np.float64), half, mode="edge")
    for axis in (0, 1):
        mean = np.apply_along_axis(np.convolve, axis, mean, weights, "valid")
    return np.where(gray > np.rint(mean) - offset, 255, 0).astype(np.uint8)


def image_pages(content: bytes, kind: str, languages: str = "eng+lav", seconds: int = 30) -> list[str]:
    """The text of an image, by the OCR library of the installation.

    ``languages`` are codes as :func:`tallyloom.config.ocr_languages` gives them;
    their packs are looked for on the worker."""
    import io

    import pytesseract
    from PIL import Image, ImageFilter, ImageOps

    program = find_program()
    if program is not None:
        pytesseract.pytesseract.tesseract_cmd = str(program)
    packs = prepared_packs(languages, pack_folders(program), program.parent / "tessdata") if program else None
    try:
        image = ImageOps.grayscale(Image.open(io.BytesIO(content)))
    except (OSError, Image.DecompressionBombError) as e:
        raise OcrError("the image could not be opened") from e
    if max(image.size) < 1600:
        image = image.resize((2 * image.width, 2 * image.height), Image.Resampling.BICUBIC)
    if min(image.size) >= 3:
        image = image.filter(ImageFilter.MedianFilter(3))
    image = Image.fromarray(threshold(np.asarray(image)))
    return [pytesseract.image_to_string(image, lang=languages, config=f'--tessdata-dir "{packs}"' if packs else "", timeout=seconds)]


def read_pages(content: bytes, kind: str, languages: str = "eng+lav") -> list[str]:
    return pdf_pages(content, kind) if kind == "pdf" else image_pages(content, kind, languages)
