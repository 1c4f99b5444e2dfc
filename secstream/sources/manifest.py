"""Folder tables whose live part is named by numbered manifests.

Spark writes the data of a commit to a folder of its own; then one small file, written once and never changed,
lists the folders that are live from now on. Readers take the newest list, so that they see a rewrite as a whole
or not at all, and files that a failed job left behind are in no list. A commit carries a run key: repeating a
run adds nothing. Lists name folders, not files: their length is days times commits since the last compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Manifests that are kept behind the newest one, for readers that have just opened one.
KEPT = 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Live:
    number: int
    folders: tuple[tuple[str, str], ...]  # (folder under the table's data, run key)
    runs: frozenset[str]


class Manifest:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def live(self, number: int | None = None) -> Live:
        """The newest list, or that of a number not long ago; nothing before the first commit."""
        if number is None:
            number = max((int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not number:
            return Live(0, (), frozenset())
        stream = self._fs.open(self._at(f"_manifests/{number:012d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Live(number, tuple(map(tuple, held["folders"])), frozenset(held["runs"]))

    def _publish(self, number: int, folders, runs) -> bool:
        """Write manifest ``number``; False if someone else has."""
        draft, final = self._at(f"_manifests/.draft-{uuid.uuid4().hex}"), self._at(f"_manifests/{number:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"folders": folders, "runs": sorted(runs)}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            return False
        for name in self._names("_manifests"):
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) <= number - KEPT:
                self._fs.delete(self._at(f"_manifests/{name}"), False)
        return True

    def commit(self, change: Callable[[Live], tuple[list, set] | None], attempts: int = 10) -> bool:
        """Publish what ``change`` makes of the newest list; it is asked again if another commit came first, and
        returns None to leave the table as it is."""
        for _ in range(attempts):
            now = self.live()
            wanted = change(now)
            if wanted is None:
                return False
            if self._publish(now.number + 1, *wanted):
                return True
        raise RuntimeError(f"other commits came first {attempts} times")

    def stage(self, rows: DataFrame, parts: list[str], **options) -> list[str]:
        """Write rows, partitioned by ``parts``, to a new folder; returns the leaf folders, live for nobody yet."""
        top = f"run={uuid.uuid4().hex}"
        rows.write.options(**options).partitionBy(*parts).parquet(f"{self.path}/data/{top}")
        found = [top]
        for part in parts:
            found = [f"{f}/{n}" for f in found for n in self._names(f"data/{f}") if n.startswith(f"{part}=")]
        return sorted(found)

    def append(self, rows: DataFrame, run: str, parts: list[str] | None = None, **options) -> bool:
        """Add rows under a run key. A key that was committed before adds nothing and writes nothing."""
        if run in self.live().runs:
            return False
        folders = self.stage(rows, parts or [], **options)
        return self.commit(lambda now: None if run in now.runs else ([*now.folders, *((f, run) for f in folders)], {*now.runs, run}))

    def swap(self, old: list[str], new: list[str], run: str) -> bool:
        """Put ``new`` folders in the place of ``old`` ones; False, and nothing changes, if an old one is gone."""

        def change(now: Live):
            if not set(old) <= {f for f, _ in now.folders}:
                return None
            return [*((f, r) for f, r in now.folders if f not in set(old)), *((f, run) for f in new)], now.runs

        return self.commit(change)

    def undo(self, run: str) -> bool:
        """Go back to the list before the newest commit, if that was made by ``run``."""
        live = self.live()
        if run not in live.runs or live.number < 1:
            return False
        older = self.live(live.number - 1)
        if run in older.runs:
            raise RuntimeError(f"other commits came after {run}")
        return self._publish(live.number + 1, older.folders, older.runs)

    def read(self, columns: StructType | str, wanted: Callable[[str], bool] = lambda folder: True) -> DataFrame:
        """The live rows of the folders that ``wanted`` takes, with these columns, partition columns included."""
        columns = StructType.fromDDL(columns) if isinstance(columns, str) else columns
        folders = [f"{self.path}/data/{f}" for f, _ in self.live().folders if wanted(f)]
        if not folders:
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows.select(*columns.fieldNames())

    def compact(self, columns: StructType | str, parts: list[str], least: int = 2, run: str | None = None) -> int:
        """Rewrite every partition that has ``least`` folders or more as one; returns how many folders went."""
        now = self.live()
        by: dict[str, list[str]] = {}
        for f, _ in now.folders:
            by.setdefault("/".join(f.split("/")[1:]), []).append(f)
        old = [f for folders in by.values() if len(folders) >= least for f in folders]
        if not old:
            return 0
        rows = self.read(columns, set(old).__contains__)
        new = self.stage(rows.repartitionByRange(*parts) if parts else rows.repartition(1), parts)
        if not self.swap(old, new, run or "compaction"):
            return 0
        return len(old) - len(new)

    def vacuum(self) -> int:
        """Delete data folders that no kept manifest names. For quiet times: readers of older lists lose them."""
        live = {f for f, _ in self.live().folders}
        tops = {f.split("/")[0] for f in live}
        gone = 0
        for name in self._names("data"):
            if name.startswith("run=") and name not in tops:
                self._fs.delete(self._at(f"data/{name}"), True)
                gone += 1
        return gone
