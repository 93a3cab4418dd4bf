"""Several tables under one version number: a commit shows whole or not at all.

Data folders are written aside, each under a name of its own, and never changed.  A
manifest names the folders of every table, with some facts such as a watermark; it
becomes visible in one step, a rename that fails where that number is taken.  So a job
that dies half way leaves folders nobody reads, a reader keeps one version through all
its tables, and of two writers with the same base one gets ``Conflict`` and has to look
again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit took the next number."""


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)  # name: {"schema": JSON, "paths": [...]}
    facts: dict[str, str] = field(default_factory=dict)


class Versions:
    """A folder of versioned tables that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def listed(self, name: str) -> list[str]:
        """Names in a folder below the root."""
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def numbers(self) -> list[int]:
        """Numbers of the versions that can be read."""
        return [int(n.removesuffix(".json")) for n in self.listed("versions") if n.endswith(".json")]

    def at(self, number: int | None = None) -> Manifest:
        """One version, the latest by default; an empty one where nothing was committed."""
        known = self.numbers()
        if number is None:
            number = known[-1] if known else 0
        if not number:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/versions/{number:010d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def read(self, table: str, version: Manifest | None = None) -> DataFrame:
        """A table as one version has it."""
        entry = (version or self.at()).tables[table]
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if not entry["paths"]:
            return self.spark.createDataFrame([], schema)
        whole = None
        for path in entry["paths"]:  # each folder by itself: their partition columns have different roots
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").select(schema.names)
            whole = part if whole is None else whole.union(part)
        return whole

    def put(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> dict:
        """Write a folder aside; the entry that makes it a table's whole content."""
        path = f"data/{table}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{path}")
        return {"schema": df.schema.json(), "paths": [path]}

    def commit(self, base: Manifest, changes: Mapping[str, dict], facts: Mapping[str, str] | None = None, add: bool = False, only: bool = False) -> Manifest:
        """Make the version after ``base``: entries replace their table's, or with ``add`` come on top; new facts win over old ones.

        With ``only`` nothing of ``base`` stays but what is given.
        """
        tables = {} if only else dict(base.tables)
        for name, entry in changes.items():
            before = tables[name]["paths"] if add and name in tables else []
            tables[name] = {"schema": entry["schema"], "paths": [*before, *entry["paths"]]}
        new = Manifest(base.number + 1, tables, {**({} if only else base.facts), **(facts or {})})
        draft, final = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(f"versions/{new.number:010d}.json")
        out = self._files.create(draft, True)
        out.writeBytes(json.dumps(new.__dict__))
        out.close()
        self._files.mkdirs(final.getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        # Without an option the rename is refused where the name is taken.
        try:
            self._hadoop.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.number} is taken") from e
            raise
        return new

    def expire(self, keep: int = 2) -> list[str]:
        """Forget all but the newest ``keep`` versions, and remove folders that none of these names; their names.

        Call it where no writer is at work: what a running one has put aside is not named yet.
        """
        known = self.numbers()
        for number in known[: max(len(known) - keep, 0)]:
            self._files.delete(self._path(f"versions/{number:010d}.json"), False)
        named = {"/".join(p.split("/")[:2]) for n in known[-keep:] for e in self.at(n).tables.values() for p in e["paths"]}
        gone = [p for p in (f"data/{name}" for name in self.listed("data")) if p not in named]
        for path in gone:
            self._files.delete(self._path(path), True)
        return gone
