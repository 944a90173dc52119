"""Tables in versioned folders, named by a manifest that changes in one step.

A version is written in full before a manifest names it.  Manifests are small
files with rising numbers; a new one appears through a rename of a finished
file, so a reader sees the old version or the new one and always a whole
table.  Old versions stay for readers that have begun until they expire.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = re.compile(r"manifest-(\d{12})\.json").fullmatch


@dataclass(frozen=True)
class Folder:
    """A folder in whatever store Spark reads."""

    spark: SparkSession
    path: str

    def _at(self, name: str = ""):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):  # noqa: ANN202
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, of: str = "") -> list[str]:
        """What lies in the folder, sorted; nothing if it is not there."""
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._at(of))) if fs.exists(self._at(of)) else []

    def text(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """A new file with all of its text at once; False if another has taken the name."""
        staged = f".{name}-{uuid.uuid4().hex}"
        fs = self._fs()
        out = fs.create(self._at(staged))
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(self._at(name)) and fs.rename(self._at(staged), self._at(name)):
            return True
        fs.delete(self._at(staged), False)
        return False

    def delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)


@dataclass(frozen=True)
class Manifests:
    """The rising manifests of a folder."""

    folder: Folder

    def numbers(self) -> list[int]:
        return [int(m.group(1)) for m in map(MANIFEST, self.folder.names()) if m]

    def current(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 and nothing before the first."""
        while numbers := self.numbers():
            try:
                return numbers[-1], json.loads(self.folder.text(f"manifest-{numbers[-1]:012d}.json"))
            except Py4JJavaError as e:  # it has expired since: then there is a newer one
                if "FileNotFound" not in str(e) or self.numbers()[-1:] == numbers[-1:]:
                    raise
        return 0, {}

    def follow(self, number: int, content: dict) -> None:
        """Makes ``content`` the manifest after ``number``; an error if somebody else has written that one."""
        if not self.folder.put(f"manifest-{number + 1:012d}.json", json.dumps(content)):
            raise RuntimeError(f"{self.folder.path} was changed meanwhile")

    def expire(self, keep: int) -> None:
        for n in self.numbers()[:-keep]:
            self.folder.delete(f"manifest-{n:012d}.json")


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep: int = 3) -> int:
    """Writes ``df`` as the table's next version, lets readers see it, and deletes all but the last ``keep`` versions.

    Returns the version's number.
    """
    folder = Folder(df.sparkSession, path)
    manifests = Manifests(folder)
    number, _ = manifests.current()
    name = f"v{number + 1:012d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    manifests.follow(number, {"table": name})
    manifests.expire(keep)
    last = {f"v{n:012d}" for n in manifests.numbers()}
    for old in folder.names():
        if old.startswith("v") and old.split("-")[0] not in last:
            folder.delete(old)
    return number + 1


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or a given one that has not expired."""
    folder = Folder(spark, path)
    if version is None:
        name = Manifests(folder).current()[1].get("table")
    else:
        name = json.loads(folder.text(f"manifest-{version:012d}.json"))["table"]
    if name is None:
        raise FileNotFoundError(f"nothing was published under {path}")
    return spark.read.parquet(f"{path}/{name}")


@dataclass(frozen=True)
class Segments:
    """A table that grows by numbered batches and stays readable.

    Each batch is a folder; ``fan`` folders next to one another are merged into
    one segment, ``fan`` segments into a larger one, and so on, so that the
    folders to read grow with the logarithm of the number of batches and a row
    is rewritten as often.  Segments are partitioned by ``by``.  A batch that
    runs again replaces its folder.
    """

    folder: Folder
    by: str
    fan: int = 8

    def write(self, df: DataFrame, batch: int) -> None:
        if "schema.json" not in self.folder.names():
            self.folder.put("schema.json", df.schema.json())
        df.write.mode("overwrite").parquet(f"{self.folder.path}/raw/batch={batch}")

    def _read(self, name: str) -> DataFrame:
        """A folder's rows; also of one without files, which an empty table may be."""
        kind = StructType.fromJson(json.loads(self.folder.text("schema.json")))
        if not name.startswith("raw"):
            kind = kind.add("batch", "long")
        return self.folder.spark.read.schema(kind).parquet(f"{self.folder.path}/{name}")

    def _layout(self) -> tuple[int, list[dict]]:
        number, content = Manifests(self.folder).current()
        return number, content.get("segments", [])

    def raw(self, before: int | None) -> list[int]:
        """Batches that are in no segment and come before ``before``."""
        upto = max([s["last"] for s in self._layout()[1]], default=-1)
        batches = sorted(int(n.split("=")[1]) for n in self.folder.names("raw") if n.startswith("batch="))
        return [b for b in batches if b > upto and (before is None or b < before)]

    def read(self, before: int | None = None) -> DataFrame | None:
        """Rows of all batches, or those before one, with their ``batch``; None if there are none."""
        parts = [self._read(s["name"]) for s in self._layout()[1]] + [self.batch(b) for b in self.raw(before)]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def batch(self, batch: int) -> DataFrame:
        """The rows of one batch that is in no segment yet."""
        return self._read(f"raw/batch={batch}").withColumn("batch", F.lit(batch).cast("long"))

    def compact(self, before: int) -> None:
        """Merges full runs of batches, then of segments, all from before batch ``before``; deletes what a manifest has replaced."""
        while True:
            number, segments = self._layout()
            raw = self.raw(before)
            if len(raw) >= self.fan:
                chosen = raw[: self.fan]
                parts, level, rest = [self.batch(b) for b in chosen], 1, segments
                last, gone = chosen[-1], [f"raw/batch={b}" for b in chosen]
            else:
                level = next((v for v in sorted({s["level"] for s in segments}) if sum(s["level"] == v for s in segments) >= self.fan), None)
                if level is None:
                    return
                chosen = [s for s in segments if s["level"] == level][: self.fan]
                parts, rest = [self._read(s["name"]) for s in chosen], [s for s in segments if s not in chosen]
                last, gone, level = chosen[-1]["last"], [s["name"] for s in chosen], level + 1
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            name = f"segment-{number + 1:012d}-{uuid.uuid4().hex}"
            whole.repartition(self.by).write.partitionBy(self.by).parquet(f"{self.folder.path}/{name}")
            Manifests(self.folder).follow(number, {"segments": sorted([*rest, {"name": name, "level": level, "last": last}], key=lambda s: s["last"])})
            Manifests(self.folder).expire(2)
            for g in gone:
                self.folder.delete(g)
