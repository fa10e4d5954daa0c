"""A folder of Markdown notes as a Spark data source: one partition for each folder.

The driver lists folders only; notes are listed, checked and read by the tasks. On a cluster the
vault is a mount that all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that hold no notes.
EXCLUDED = (".obsidian", "_resources", "Templates", "Excalidraw", ".git", ".DS_Store", "node_modules", ".trash")
#: Larger notes are refused.
MOST_BYTES = 2_000_000
SCHEMA = "path string, source_url string, data_id string, topic string, outcome string, body string"


def within(path: str, root: str) -> bool:
    """Whether a resolved path is a resolved root or below it."""
    return os.path.commonpath([path, root]) == root


class Folder(InputPartition):
    """One folder, named from the vault's root."""

    def __init__(self, relative: str):
        super().__init__(relative)


class VaultReader(DataSourceReader):
    """Reads the notes of each folder."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        roots = [os.path.realpath(r) for r in options.get("roots", "").split(os.pathsep) if r]
        # before anything is opened, so that an error doesn't tell what exists outside
        if roots and not any(within(self.root, r) for r in roots):
            raise ValueError(f"{self.root} is in none of the roots {roots}")
        self.exclude = {*EXCLUDED, *(e.strip() for e in options.get("exclude", "").split(",") if e.strip())}
        self.most = int(options.get("mostbytes", MOST_BYTES))

    def partitions(self) -> list[InputPartition]:
        """The folders: linked ones and excluded ones are never entered."""
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")
        out: list[InputPartition] = []
        for where, folders, _ in os.walk(self.root):
            folders[:] = sorted(d for d in folders if d not in self.exclude)
            out.append(Folder(os.path.relpath(where, self.root)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = os.path.normpath(os.path.join(self.root, partition.value))
        for name in sorted(os.listdir(where)):
            path = os.path.join(where, name)
            if not name.endswith(".md") or name in self.exclude or os.path.isdir(path):
                continue
            relative = os.path.relpath(path, self.root)
            top = relative.split(os.sep)[0] if os.sep in relative else ""
            outcome, body = self._note(path)
            yield path, relative, top, name[: -len(".md")], outcome, body

    def _note(self, path: str) -> tuple[str, str | None]:
        real = os.path.realpath(path)
        if not within(real, self.root) or self.exclude & set(os.path.relpath(real, self.root).split(os.sep)):
            return "outside", None
        try:
            if os.path.getsize(real) > self.most:
                return "too_large", None
            with open(real, "rb") as f:
                body = f.read().decode("utf-8")
        except OSError:
            return "unreadable", None
        except UnicodeDecodeError:
            return "not_text", None
        return ("note", body) if body.strip() else ("empty", None)


class VaultSource(DataSource):
    """``spark.read.format("vault")``: (path, source_url, data_id, topic, outcome, body).

    source_url is the path from the root, data_id the folder at the top, topic the name without its ending.
    outcome is note, or why a file has no body: outside (a link that leaves the vault or leads to an excluded folder, never opened),
    too_large, empty, not_text, unreadable. Options: path; exclude, names separated by commas, beside EXCLUDED; mostBytes; roots, folders
    (separated as in a search path) of which one must hold the vault.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
