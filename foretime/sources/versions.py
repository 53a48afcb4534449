"""Tables that switch together: a commit writes all of them as new folders, then one small file makes them the current ones.

The file of version n is created only if it isn't there, so of two writers one fails, and a writer that dies before leaves the
version before as it was. Readers see whole versions only. Folders that no version names are left over from failures.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The tables below a path: `<table>/<id>` folders and `_versions/<n>.json` files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The number of the current version; 0 before the first."""
        where, fs = self._file("_versions")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def _tables(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version}.json", wholetext=True).first()["value"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version, else the current one."""
        folders = self._tables(self.current() if version is None else version)
        if table not in folders:
            raise ValueError(f"there is no table {table!r} yet")
        return self.spark.read.parquet(f"{self.path}/{table}/{folders[table]}")

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Write the tables and switch to them at once; others stay. base: the version they were made from; if there is a newer one by now, it is an error and nothing changes."""
        base = self.current() if base is None else base
        folders = self._tables(base)
        for name, df in tables.items():
            folders[name] = uuid.uuid4().hex
            df.write.mode("error").parquet(f"{self.path}/{name}/{folders[name]}")
        where, fs = self._file(f"_versions/{base + 1}.json")
        try:
            out = fs.create(where, False)  # an error if it exists
        except Py4JJavaError as e:
            raise RuntimeError(f"version {base + 1} was made by another writer") from e
        out.write(bytearray(json.dumps(folders), "utf-8"))
        out.close()
        return base + 1

    def update(self, change: Callable[[Versions], dict[str, DataFrame]]) -> int:
        """Commit what change makes of the current version."""
        base = self.current()
        return self.commit(change(self), base)
