"""State between runs: several tables that change together.

A commit writes its tables into a folder of its own and then publishes one
small manifest, ``commits/<number>``, that names the folder. The number follows
that of the commit the run had read; a rename that never replaces a file makes
it public. So a reader sees all of a run's tables or none, a crash before the
manifest leaves the former state in force, and of two runs that started from the
same state the second one fails instead of overwriting the first.

Tables are written by tasks; only manifests (a few hundred bytes) pass through
the driver. ``read`` takes the tables of the last commit, ``history`` a table of
all commits, for logs that each commit adds to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


class Conflict(RuntimeError):
    """Another run has committed since the state was read."""


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """The commits' numbers in order."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path("commits", f"{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> int:
        """The last commit's number, 0 before the first."""
        return max(self.numbers(), default=0)

    def read(self, table: str, schema: str, number: int | None = None) -> DataFrame:
        """A table as of a commit (the last one), empty where it has none."""
        number = self.current() if number is None else number
        folders = [self.manifest(number)] if number else []
        return self._tables(table, schema, folders)

    def history(self, table: str, schema: str) -> DataFrame:
        """A table's rows of all commits."""
        return self._tables(table, schema, [self.manifest(n) for n in self.numbers()])

    def _tables(self, table: str, schema: str, manifests: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{m['folder']}/{table}" for m in manifests if table in m["tables"]]
        if not paths:
            row = F.from_json(F.lit(None).cast("string"), schema).alias("row")  # a plan that is known to be empty: joins with it go
            return self.spark.range(1).select(row).select("row.*").filter(F.lit(False))
        return self.spark.read.schema(schema).parquet(*paths)

    def commit(self, tables: dict[str, DataFrame], after: int) -> int:
        """Store ``tables`` as the commit that follows ``after`` (the number the
        run started from); returns the new number."""
        folder = f"data/{after + 1:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        self._publish(after + 1, {"folder": folder, "tables": sorted(tables)})
        return after + 1

    def _publish(self, number: int, manifest: dict) -> None:
        draft, public = self._path(f"drafts/{uuid.uuid4().hex}"), self._path("commits", f"{number:012d}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._fs.mkdirs(public.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(public.toUri(), self._conf)
        no_replace = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = no_replace
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(public), options)
        except (Py4JJavaError, PySparkException) as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {number} exists") from None
            raise
