"""A keyed table in a folder: parts by hash of the key, and manifests that name the files of each part.

A delivery rewrites the parts that its keys fall into and no others. Its files count from the moment the next manifest is put in
place, by a rename that fails where that manifest is already there: of two writers at once one does its merge again, on what the other left. A
crash at any point leaves the last manifest as it was; files that no manifest names are rubbish. Nothing depends on marks that a
committer may or may not leave.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.sink import upserted


class Conflict(Exception):
    """Another writer was faster each time."""


@dataclass
class KeyedStore:
    """spark, path, key and version columns; `parts` counts only for a store that is not there yet, and the first delivery that
    holds rows sets the schema; later ones may add columns."""

    spark: SparkSession
    path: str
    key: str
    version: str
    parts: int = 64

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        found = self._system().globStatus(self._file("manifests/*.json")) or []
        return sorted(int(x.getPath().getName()[:-5]) for x in found)

    def manifest(self, number: int | None = None) -> dict:
        """{number, parts, files: {part: [folder, rows]}, schema}: the last one, or that of a number."""
        known = self._numbers()
        if not known:
            return {"number": -1, "parts": self.parts, "files": {}, "schema": None}
        number = known[-1] if number is None else number
        return json.loads(self.spark.read.text(self._file(f"manifests/{number:012d}.json").toString(), wholetext=True).first()[0])

    def _schema(self, manifest: dict) -> StructType:
        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, parts: list[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of all parts, or of some; null if there are none. A reader that has begun keeps the files of its manifest."""
        now = manifest or self.manifest()
        folders = sorted({now["files"][p][0] for p in (now["files"] if parts is None else parts) if p in now["files"]})
        if not folders:
            return None
        return self.spark.read.schema(self._schema(now)).parquet(*(f"{self.path}/{f}" for f in folders))

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest is in place; false if one of its number was there."""
        name, whole = f"manifests/{manifest['number']:012d}.json", json.dumps(manifest).encode()
        waiting = self._file(f"manifests/.{uuid.uuid4().hex}")
        out = self._system().create(waiting, False)
        out.write(whole)
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._system().makeQualified(waiting), self._system().makeQualified(self._file(name)), none)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise
            self._system().delete(waiting, False)
            return False
        return True

    def upsert(self, new: DataFrame, tries: int = 5, before_publishing=None) -> dict:
        """Delivers rows: of each key that of the greatest version stays, of equals the new one; of equal new ones the greatest by content.

        Delivering twice changes nothing. Rows with a null key are no records and are refused. Returns the manifest in place.
        `before_publishing` is called with each manifest that is about to be put in place.
        """
        fine = new.where(F.col(self.key).isNotNull())
        for _ in range(tries):
            now = self.manifest()
            part = F.pmod(F.xxhash64(self.key), F.lit(now["parts"])).cast("string")
            touched = [r[0] for r in fine.select(part).distinct().collect()]  # no more than there are parts
            if not touched:
                return now
            stored = self.read(touched, now)
            if stored is None:
                stored = self.spark.createDataFrame([], self._schema(now)) if now["schema"] else fine.limit(0)
            rows = upserted(stored, fine, self.key, self.version)
            folder = f"data/{now['number'] + 1:012d}-{uuid.uuid4().hex}"
            dealt = rows.withColumn("store_part", part)
            dealt.repartition(min(len(touched), 200), "store_part").write.partitionBy("store_part").parquet(f"{self.path}/{folder}")
            made = self.spark.read.parquet(f"{self.path}/{folder}").groupBy(F.col("store_part").cast("string")).count().collect()
            files = now["files"] | {p: [f"{folder}/store_part={p}", n] for p, n in made}
            then = {"number": now["number"] + 1, "parts": now["parts"], "files": files, "schema": rows.schema.json()}
            if before_publishing:
                before_publishing(then)
            if self._publish(then):
                return then
            self._system().delete(self._file(folder), True)
        raise Conflict(self.path)

    def clean(self, keep: int = 2) -> None:
        """Deletes manifests before the newest `keep`, and data that no remaining manifest names. Call it when no writer is at work."""
        known = self._numbers()
        for number in known[: max(0, len(known) - keep)]:
            self._system().delete(self._file(f"manifests/{number:012d}.json"), False)
        named = {f.split("/")[1] for n in known[-keep:] for f, _ in self.manifest(n)["files"].values()}
        for found in self._system().globStatus(self._file("data/*")) or []:
            if found.getPath().getName() not in named:
                self._system().delete(found.getPath(), True)
