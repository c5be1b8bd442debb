"""A keyed table with versions: deltas are committed, merged on reading, compacted; every version that is kept can be read and restored.

Data are Parquet folders that never change. A version is a small manifest that names them, so a commit is one rename, a run that stops
leaves nothing behind that is read, and restoring is a manifest too.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.store import latest


class Conflict(Exception):
    """Another writer has made this version."""


@dataclass
class Versions:
    """`path` is in a folder that the cluster shares. Records have a key, a number `seq` and perhaps `_deleted` (a tombstone)."""

    spark: SparkSession
    path: str
    key: str
    seq: str

    def _fs(self):
        to = self.spark._jvm.org.apache.hadoop.fs.Path
        return to, to(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        to, fs = self._fs()
        folder = to(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """That of a version (None: the newest; an empty one before the first commit)."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "folders": [], "runs": []}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"there is no version {version}")
        to, fs = self._fs()
        stream = fs.open(to(f"{self.path}/manifest/{version:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> int:
        to, fs = self._fs()
        made, name = to(f"{self.path}/manifest/{uuid.uuid4().hex}.tmp"), to(f"{self.path}/manifest/{manifest['version']:012}.json")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(name) or not fs.rename(made, name):
            fs.delete(made, False)
            raise Conflict(f"version {manifest['version']} exists")
        return manifest["version"]

    def _stored(self, rows: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, delta: DataFrame, run: str | None = None) -> int:
        """The version with these records on top. A `run` that is committed already (a repeated micro-batch) is left out."""
        before = self.manifest()
        if run is not None and run in before["runs"]:
            return before["version"]
        runs = [*before["runs"], *([run] if run is not None else [])][-100:]
        return self._put({"version": before["version"] + 1, "folders": [*before["folders"], self._stored(delta)], "runs": runs})

    def records(self, version: int | None = None) -> DataFrame:
        """The last record of each key, tombstones too. Equal seq: as store.latest() has it."""
        folders = self.manifest(version)["folders"]
        if not folders:
            raise ValueError("nothing is committed")
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        return latest(rows, self.key, self.seq)

    def read(self, version: int | None = None) -> DataFrame:
        """Live records."""
        rows = self.records(version)
        return rows.where(~F.coalesce("_deleted", F.lit(False))).drop("_deleted") if "_deleted" in rows.columns else rows

    def compact(self, horizon: int | None = None) -> int:
        """The same records as one folder, dealt and ordered by key. Tombstones with a seq below `horizon` go: no older record may come after that."""
        before, rows = self.manifest(), self.records()
        if horizon is not None and "_deleted" in rows.columns:
            rows = rows.where(~(F.coalesce("_deleted", F.lit(False)) & (F.col(self.seq) < horizon)))
        folder = self._stored(rows.repartition(self.key).sortWithinPartitions(self.key))
        return self._put({"version": before["version"] + 1, "folders": [folder], "runs": before["runs"]})

    def restore(self, version: int) -> int:
        """A new version with the records of an old one."""
        old, last = self.manifest(version), self.manifest()
        return self._put({"version": last["version"] + 1, "folders": old["folders"], "runs": last["runs"]})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all versions but the newest `keep`, and the folders that only they name (so none that a commit is just writing)."""
        known = self.versions()
        old, kept = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        used = {f for v in kept for f in self.manifest(v)["folders"]}
        gone = sorted({f for v in old for f in self.manifest(v)["folders"]} - used)
        to, fs = self._fs()
        for v in old:
            fs.delete(to(f"{self.path}/manifest/{v:012}.json"), False)
        for f in gone:
            fs.delete(to(f"{self.path}/{f}"), True)
        return gone
