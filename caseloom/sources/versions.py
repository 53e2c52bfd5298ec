"""Tables published in versions: a folder of data each, seen only once a manifest names it.

A version is written to a folder of its own. Then its manifest, a small file, is moved
to the name of the next version by one rename that does not replace: this is the commit.
So a writer that is killed before leaves nothing to be seen, of two writers that
started from the same version one gets a conflict, and a reader holds what it
opened, since no folder is ever changed. To restore a version is to commit a manifest
that names its folder: no data move.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Someone else has published the version that was to be published."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, in order."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self._newest() if version is None else version
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the newest by default."""
        held = self.manifest(version)
        return self.spark.read.schema(held["schema"]).parquet(f"{self.root}/{held['folder']}")

    def publish(self, rows: DataFrame, expected: int | None = None) -> int:
        """Publish ``rows`` as the version after ``expected`` (by default the newest when the call begins)."""
        parent = self._newest(0) if expected is None else expected
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._commit(parent, {"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "restores": None})

    def restore(self, version: int, expected: int | None = None) -> int:
        """Publish an earlier version again, by its folder."""
        held = self.manifest(version)
        parent = self._newest() if expected is None else expected
        return self._commit(parent, {"folder": held["folder"], "schema": held["schema"], "restores": version})

    def _newest(self, default: int | None = None) -> int:
        found = self.versions()
        if not found and default is None:
            raise LookupError(f"nothing is published at {self.root}")
        return found[-1] if found else default

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:08d}.json"

    def _commit(self, parent: int, content: dict) -> int:
        version = parent + 1
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        try:
            out.write(bytearray(json.dumps({"version": version, "parent": parent, **content}).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no option: an existing name is kept
        try:
            context.rename(self._path(draft), self._path(self._manifest(version)), never)
        except Exception as error:
            self._fs.delete(self._path(draft), False)
            if version in self.versions():
                raise VersionConflict(f"version {version} of {self.root} is there already") from error
            raise
        return version
