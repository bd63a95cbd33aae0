"""The vault as a table that several jobs may write at once.

A vault is a folder with data folders, which are written once and never changed, and a log of versions, each of which names the data
folders of the vault at that version.  A writer reads a version, assigns tokens against it, writes its rows to a
folder of its own, and publishes the next version; publishing fails if another writer was first.  The loser then reads what came in
between.  Values that the others gave the same token it leaves out, and tries again; if one of its values has got another token, or
one of its tokens stands for another value, nothing is published and its values are assigned again.  So no value ever has
two tokens and no token two values, readers see whole versions only, and nobody waits for a lock.

Publishing needs a file system that moves a file to a name only if that is free: local folders (hard links) and
HDFS (rename) do.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokens import Keys
from ..shared import kept
from . import vault

SCHEMA = "bidx string, kind string, token string, raw_enc binary, hits long"
COLUMNS = ["bidx", "kind", "token", "raw_enc", "hits"]


class Busy(RuntimeError):
    """Other writers were first as often as was allowed."""


class VaultTable:
    """A vault at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._name("_log")
        self._fs = self._log.getFileSystem(self._conf)

    def _name(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def version(self) -> int:
        """The newest version; 0 is the empty vault."""
        if not self._fs.exists(self._log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def folders(self, version: int) -> list[str]:
        """The data folders of a version."""
        if not version:
            return []
        stream = self._fs.open(self._name("_log", f"{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))["folders"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._rows(self.folders(self.version() if version is None else version))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Makes a version known, unless there is one of that number."""
        draft, target = self._name("_log", f".{uuid.uuid4().hex}"), self._name("_log", f"{version:020d}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps({"folders": folders}).encode())
        out.close()
        try:
            if self._fs.getScheme() == "file":
                here, there = (urlparse(p.toString()).path for p in (draft, target))
                try:
                    os.link(here, there)
                except FileExistsError:
                    return False
                return True
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            return True
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def commit(self, rows: DataFrame, base: int, tries: int = 64) -> int | None:
        """Adds rows that were assigned against the version ``base``; the version that holds them, or None if values must be assigned
        again because another writer's rows are at odds with them."""
        mine = rows.select(*COLUMNS)
        folder = self._write(mine)
        if folder is None:
            return base
        mine = self._rows([folder])
        for _ in range(tries):
            have = self.folders(base)
            if self._publish(base + 1, [*have, folder]):
                return base + 1
            newest = self.version()
            added = self._rows([f for f in self.folders(newest) if f not in set(have)]).select("bidx", "token")
            odd_value = mine.join(added.toDF("bidx", "theirs"), "bidx").where("token <> theirs")
            odd_token = mine.join(added.toDF("theirs", "token"), "token").where("bidx <> theirs")
            if not (odd_value.isEmpty() and odd_token.isEmpty()):
                return None
            folder = self._write(mine.join(added.select("bidx"), "bidx", "left_anti").select(*COLUMNS))
            if folder is None:
                return newest
            mine, base = self._rows([folder]), newest
        raise Busy(f"{tries} other writers were first")

    def _write(self, rows: DataFrame) -> str | None:
        """A new data folder with the rows; None if there are none."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return None if self._rows([folder]).isEmpty() else folder

    def assign(self, found: DataFrame, keys: Keys, keep_scope: bool = True, keep_domain: bool = False, tries: int = 64) -> int:
        """Sees to it that every value among findings (kind, value) has a token; the version in which all have."""
        found = kept(found.select("kind", "value"), "found")
        for _ in range(tries):
            base = self.version()
            rows = vault.assign(found, keys, self.read(base), keep_scope, keep_domain)
            done = self.commit(vault.sealed(rows, keys), base)
            if done is not None:
                return done
        raise Busy(f"{tries} other writers were first")

    def compact(self) -> int:
        """The same rows in one data folder, as a new version; older versions stay readable."""
        base = self.version()
        folder = self._write(self.read(base))
        if folder is None or len(self.folders(base)) == 1:
            return base
        return base + 1 if self._publish(base + 1, [folder]) else self.version()
