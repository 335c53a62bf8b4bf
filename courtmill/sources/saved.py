"""A data source of saved pages: one folder per site, one JSON file per page, read in parallel.

``spark.dataSource.register(SavedPages)`` and ``spark.read.format("saved_pages").load(folder)``. Each file
holds an object with ``url``, ``status``, ``text`` and ``fetched_at``; a file that is none gives a row with
its name and an error, not a failed job. A partition is at most ``FILES`` files of one site, so a large site
is many tasks; ``option("sources", "a,b")`` reads those sites only, and the folder must be shared by all
executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = 200


class _Files(InputPartition):
    def __init__(self, source: str, names: list[str]):
        self.source, self.names = source, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        chosen = options.get("sources", "")
        self.chosen = {s.strip() for s in chosen.split(",") if s.strip()}

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source in sorted(e.name for e in os.scandir(self.folder) if e.is_dir() and (not self.chosen or e.name in self.chosen)):
            names = sorted(e.name for e in os.scandir(os.path.join(self.folder, source)) if e.name.endswith(".json"))
            out += [_Files(source, names[i : i + FILES]) for i in range(0, len(names), FILES)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no site at all
            return
        for name in partition.names:
            try:
                with open(os.path.join(self.folder, partition.source, name), encoding="utf-8") as file:
                    page = json.load(file)
                status = page.get("status")
                yield partition.source, name, page["url"], None if status is None else int(status), page.get("text"), page.get("fetched_at"), None
            except (OSError, ValueError, KeyError, TypeError, AttributeError) as error:
                yield partition.source, name, None, None, None, None, f"{type(error).__name__}: {error}"


class SavedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "source string, file string, url string, status int, text string, fetched_at string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
