"""Folders of documents as a data source: listed, filtered and read by executors.

    spark.dataSource.register(DocumentFolder)
    spark.read.format("document_folder").option("path", folder).load()

Columns are scope_id, path, rel_path, filename and document_type, and content with
the option ``content``.  With the option ``scopes`` each folder directly below the
path is a scope of its own, named by its path; else all files are of ``scope_id``.
The driver lists the first level only, for one partition each; what lies below
them is listed by the tasks.  Executors see the folder under the same path.
With the option ``pushdown``, filters on document_type are applied by the listing;
Spark asks for ``spark.sql.python.filterPushdown.enabled`` then.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: The kinds of files that are documents.
SUFFIXES = ("pdf", "jpg", "jpeg", "png")
COLUMNS = "scope_id string, path string, rel_path string, filename string, document_type string"


@dataclass
class Part(InputPartition):
    """A folder, with all below it or with its own files only."""

    folder: str
    scope_id: str
    deep: bool

    def __post_init__(self) -> None:
        super().__init__(self.folder)


class DocumentFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return COLUMNS + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> FolderReader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else FolderReader
        return kind(dict(self.options), "content" in schema.fieldNames())


class FolderReader(DataSourceReader):
    """Reads documents of a folder."""

    def __init__(self, options: dict, with_content: bool) -> None:
        self.root = os.path.abspath(options["path"])
        self.scope = options.get("scope_id", "")
        self.scopes = options.get("scopes", "false").lower() == "true"
        self.with_content = with_content
        self.kinds = set(SUFFIXES)

    def partitions(self) -> list[Part]:
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir())
        own = [] if self.scopes else [Part(self.root, self.scope, False)]
        return own + [Part(path, path if self.scopes else self.scope, True) for path in below] or [Part(self.root, self.scope, False)]

    def _files(self, part: Part) -> Iterator[str]:
        """Paths of the part's files; a link to a folder is not followed."""
        folders = [part.folder]
        while folders:
            with os.scandir(folders.pop()) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if part.deep:
                            folders.append(e.path)
                    elif e.is_file():
                        yield e.path

    def read(self, partition: Part) -> Iterator[tuple]:
        top = partition.folder if self.scopes else self.root
        for path in self._files(partition):
            kind = os.path.splitext(path)[1].lower().lstrip(".")
            if kind in self.kinds:
                row = (partition.scope_id, path, os.path.relpath(path, top).replace(os.sep, "/"), os.path.basename(path), kind)
                if self.with_content:
                    with open(path, "rb") as f:
                        row += (f.read(),)
                yield row


class FilteringReader(FolderReader):
    """The same, with filters on document_type applied by the listing."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("document_type",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("document_type",):
                self.kinds &= set(f.value)
            else:
                yield f
