"""Tables that change in one step: staged writes, then a commit marker.

A published table is a folder: ``data/_write=<id>/<partitions>/`` holds what
one write produced, ``_commits/<n>.json`` names the folders that make up
version n. A write that dies before its marker leaves the last version as it
was; readers never see half a write. A marker appears by a rename that fails if
the name is taken, so of two writers that start from one version one commits
and the other begins again from the new version.

* ``publish`` replaces exactly the partitions that the new rows touch (without
  partition columns: the whole table), for CREATE TABLE AS reports that are
  made anew month by month or market by market;
* ``append`` adds a batch under a key that the markers remember, so the same
  batch twice gives one copy.

Partition columns are folders, so filters on them prune what is listed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITE = "_write"
#: Times that a writer begins again because another one has committed.
ATTEMPTS = 20


class Published:
    """A published table at ``path`` (any file system that Spark can write)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root, conf = self._path(self.path), spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # -- versions -------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version (the last one) consists of; None without any."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return None
        stream = self._fs.open(self._path(f"{self.path}/_commits/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> bool:
        """Whether ``manifest`` has become its version."""
        staged, final = (self._path(f"{self.path}/_commits/{n}") for n in (f".{uuid.uuid4().hex}", f"{manifest['version']:012d}.json"))
        out = self._fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            self._files.rename(staged, final, self._no_overwrite)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(staged, False)
            return False
        return True

    # -- reading --------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one)."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/data/{f}" for part in sorted(m["folders"]) for f in m["folders"][part]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        with_write = T.StructType([*schema.fields, T.StructField(_WRITE, T.StringType())])
        rows = self.spark.read.schema(with_write).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])

    # -- writing --------------------------------------------------------------------

    def _stage(self, df: DataFrame, partition_by: Sequence[str]) -> dict[str, list[str]]:
        """Writes ``df`` to a folder of its own; its folders by partition."""
        write = f"{_WRITE}={uuid.uuid4().hex}"
        # the rows of a partition value in few files, a large one dealt over several tasks
        rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/data/{write}")
        level = [""]
        for _ in partition_by:
            level = [f"{p}/{n}" if p else n for p in level for n in self._names(f"data/{write}/{p}") if "=" in n]
        return {p: [f"{write}/{p}" if p else write] for p in level}

    def _change(self, df: DataFrame, partition_by: Sequence[str], change: Callable[[dict, dict], dict | None]) -> int:
        """Stages ``df`` once and commits what ``change`` makes of the last manifest; its version."""
        ordered = [c for c in df.columns if c not in partition_by] + list(partition_by)
        schema = json.loads(df.select(*[F.col(f"`{c}`") for c in ordered]).schema.json())
        for field in schema["fields"]:
            field["nullable"] = True
        staged = None
        for _ in range(ATTEMPTS):
            last = self.manifest() or {"version": 0, "partition_by": list(partition_by), "schema": schema, "folders": {}, "batches": []}
            if last["partition_by"] != list(partition_by):
                raise ValueError(f"the table is partitioned by {last['partition_by']}")
            if [(f["name"], f["type"]) for f in last["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]:
                raise ValueError("columns differ from those of the table")
            if change(last, {}) is None:  # nothing to do, so nothing is written
                return last["version"]
            staged = staged if staged is not None else self._stage(df, partition_by)
            made = change(last, staged) | {"version": last["version"] + 1}
            if self._commit(made):
                return made["version"]
        raise RuntimeError(f"{ATTEMPTS} other writers have committed to {self.path} meanwhile")

    def create(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """CREATE TABLE AS: an error if the table is there already."""
        def change(last: dict, staged: dict) -> dict:
            if last["version"]:
                raise FileExistsError(f"{self.path} is published already")
            return last | {"folders": staged}
        return self._change(df, partition_by, change)

    def publish(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """The partitions that ``df`` has rows of are replaced, others stay; the table is created if it has to be."""
        def change(last: dict, staged: dict) -> dict:
            kept = last["folders"] if partition_by else {}
            return last | {"folders": kept | staged}
        return self._change(df, partition_by, change)

    def append(self, df: DataFrame, batch: str, partition_by: Sequence[str] = ()) -> int:
        """Adds the rows of ``batch``; nothing if a batch of that name has been added."""
        def change(last: dict, staged: dict) -> dict | None:
            if batch in last["batches"]:
                return None
            folders = {p: last["folders"].get(p, []) + staged.get(p, []) for p in {*last["folders"], *staged}}
            return last | {"folders": folders, "batches": [*last["batches"], batch]}
        return self._change(df, partition_by, change)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes writes that none of the last ``keep`` versions names; how many. Not while others write."""
        named = {f.split("/")[0] for v in self.versions()[-keep:] for fs in self.manifest(v)["folders"].values() for f in fs}
        stale = [n for n in self._names("data") if n not in named]
        for n in stale:
            self._fs.delete(self._path(f"{self.path}/data/{n}"), True)
        return len(stale)
