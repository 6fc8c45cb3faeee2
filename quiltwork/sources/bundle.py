"""Several tables that change together: a version is a manifest, and it is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Bundle:
    """Tables under ``path``, in any file system that Spark reaches.

    ``push`` writes each table to a folder of its own and only then one small manifest, which is put in place by a rename;
    readers follow the latest manifest, so they see all tables of one version or all of another.  A write that fails in
    between leaves folders that no manifest names.  ``restore`` writes a manifest that names an older version's folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict[str, str]:
        source = self._files.open(self._jvm.org.apache.hadoop.fs.Path(self._root, str(version)))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()

    def _commit(self, tables: dict[str, str]) -> int:
        version = max(self.versions(), default=0) + 1
        draft = self._jvm.org.apache.hadoop.fs.Path(self._root, f".draft-{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        final = self._jvm.org.apache.hadoop.fs.Path(self._root, str(version))
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {version} was written by somebody else meanwhile")
        return version

    def push(self, **tables: DataFrame) -> int:
        """Writes the named tables as a new version; tables that aren't named stay as they are in the last one."""
        last = self.versions()
        paths = self._manifest(last[-1]) if last else {}
        for name, df in tables.items():
            folder = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            paths = paths | {name: folder}
        return self._commit(paths)

    def restore(self, version: int) -> int:
        """All tables as they were in a version, as a new version."""
        return self._commit(self._manifest(version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(self._manifest(version)[name])
