"""The text-recognition program of a worker and the language packs it reads.

Each executor looks for its own: programs and packs may lie in other places from
machine to machine, and packs can be sent along with ``spark.sparkContext.addFile``.
Nothing in a worker's environment is changed, as workers run several tasks.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path


class OcrError(ValueError):
    """The settings, the installation or the image do not allow text recognition."""


def find_program(name: str = "tesseract", variable: str = "TESSERACT_CMD", places: Iterable[str | Path] = ()) -> Path | None:
    """The program that ``variable`` names (None if that is no file), else the one
    on the path, else the first of ``places`` that is a file."""
    if named := os.environ.get(variable, "").strip():
        return Path(named) if Path(named).is_file() else None
    found = shutil.which(name)
    return Path(found) if found else next((Path(p) for p in places if Path(p).is_file()), None)


def _of_spark(*below: str) -> Path | None:
    """The folder that Spark gives this worker or driver for files, if there is one."""
    from pyspark import SparkContext, SparkFiles

    if SparkFiles._is_running_on_worker or SparkContext._active_spark_context:
        return Path(SparkFiles.getRootDirectory(), *below)
    return None


def pack_folders(program: Path | None, more: Iterable[str | Path] = ()) -> list[Path]:
    """Folders that may hold packs, without repeats: beside the program, the one
    that TESSDATA_PREFIX names, ``more``, those sent to this worker by Spark, and
    ``tessdata`` in the working folder."""
    found = [program.parent / "tessdata"] if program else []
    if named := os.environ.get("TESSDATA_PREFIX", "").strip():
        found.append(Path(named))
    found += map(Path, more)
    if sent := _of_spark():
        found.append(sent)
    found.append(Path.cwd() / "tessdata")
    return list(dict.fromkeys(p.resolve() for p in found))


def prepared_packs(languages: str, folders: list[Path], own: Path | None = None, target: str | Path | None = None) -> Path | None:
    """The folder that holds the packs of ``languages``, codes joined by ``+``.

    None if ``own``, the program's folder, has them all.  A folder of ``folders``
    that has them all is taken as it is.  Else they are copied from the first folder
    that has each to ``target``, by default below the folder that Spark gives this
    worker for files; a copy that is older than its source is made anew, and copies
    are moved to their place when they are whole, as several tasks may prepare them
    at once.  A language without a pack raises and is named."""
    files = [f"{code}.traineddata" for code in dict.fromkeys(languages.split("+"))]
    holds = lambda folder: all((folder / f).is_file() for f in files)
    if own is not None and holds(own):
        return None
    if whole := next((f for f in folders if holds(f)), None):
        return whole
    sources = {f: next((folder / f for folder in folders if (folder / f).is_file()), None) for f in files}
    if lacking := [f.split(".")[0] for f, source in sources.items() if source is None]:
        raise OcrError(f"no language pack for {', '.join(lacking)}")
    folder = Path(target) if target else _of_spark("packs")
    if folder is None:
        raise OcrError("the packs lie in several folders; name one to gather them in")
    folder.mkdir(parents=True, exist_ok=True)
    for f, source in sources.items():
        copy = folder / f
        if not copy.is_file() or source.stat().st_mtime_ns > copy.stat().st_mtime_ns:
            part = folder / f".{f}-{uuid.uuid4().hex}"
            shutil.copyfile(source, part)
            part.replace(copy)
    return folder
