"""A log of numbered commits: what is in it counts, what isn't does not.

A commit is a file whose name is its number, made only if no such file exists; so of
two writers that want one number one gets it and the other takes the next.  Data
are written first, in a folder of the commit's own, and count once the log names the
folder: a crash in between leaves files that nobody reads.  A commit may carry a source
and a batch; of several with the same ones the first counts, so a batch that is
written again after a crash changes nothing.

On one machine's disk the file appears whole, by a link; elsewhere the file system must
make files exclusively (as HDFS does).  Reading lists the log's folder on the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENTRY = "number long, at timestamp, kind string, commit string, project_id string, row map<string,string>, source string, batch long"
_DIGITS = 20


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._at):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at))

    def _checkpoint(self, names: list[str]) -> tuple[int, str | None]:
        """The number up to which entries lie in a folder, and the folder."""
        done = [x for x in names if x.endswith(".checkpoint")]
        if not done:
            return -1, None
        text = self.spark.read.text(f"{self.path}/{done[-1]}").first()[0]
        return int(done[-1].split(".")[0]), text

    @staticmethod
    def _last(names: list[str]) -> int:
        return max((int(x.split(".")[0]) for x in names if x.endswith((".json", ".checkpoint"))), default=-1)

    def create_once(self, name: str, text: str) -> bool:
        """Makes a file with this text, unless there is one of that name."""
        if self._fs.getScheme() == "file":
            folder = self._at.toUri().getPath()
            os.makedirs(folder, exist_ok=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, f"{folder}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            out = self._fs.create(self._hadoop.Path(f"{self.path}/{name}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def commit(self, kind: str, project_id: str | None = None, commit: str | None = None, row: dict | None = None, once: tuple[str, int] | None = None) -> int:
        """The number that the entry got."""
        entry = {"kind": kind, "project_id": project_id, "commit": commit, "row": {k: str(v) for k, v in (row or {}).items() if v is not None}}
        if once:
            entry |= {"source": once[0], "batch": once[1]}
        n = self._last(self._names()) + 1
        while not self.create_once(f"{n:0{_DIGITS}d}.json", json.dumps(entry | {"at": datetime.now(UTC).isoformat()})):
            n += 1
        return n

    def entries(self) -> DataFrame:
        """ENTRY rows, of each source and batch the first."""
        names = self._names()
        upto, folder = self._checkpoint(names)
        own = self.spark.createDataFrame([], ENTRY)
        if folder:
            own = own.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.path}/{folder}"))
        if files := [f"{self.path}/{x}" for x in names if x.endswith(".json") and int(x.split(".")[0]) > upto]:
            number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).cast("long")
            rows = self.spark.read.schema(ENTRY).json(files).withColumn("number", number)
            own = own.unionByName(rows.filter("kind is not null"))  # one that is being written has no kind yet
        first = W.partitionBy("source", "batch").orderBy("number")
        return own.withColumn("_n", F.when(F.col("source").isNull(), 1).otherwise(F.row_number().over(first))).filter("_n = 1").drop("_n")

    def has(self, once: tuple[str, int]) -> bool:
        return not self.entries().filter((F.col("source") == once[0]) & (F.col("batch") == once[1])).isEmpty()

    def compact(self) -> None:
        """Moves all entries into one table, which readers take instead; who is reading the old files meanwhile must read again."""
        names = self._names()
        last, (upto, old) = self._last(names), self._checkpoint(names)
        if last <= upto:
            return
        folder = f"upto-{last}-{uuid.uuid4().hex}"
        self.entries().filter(F.col("number") <= last).coalesce(1).write.parquet(f"{self.path}/{folder}")
        if self.create_once(f"{last:0{_DIGITS}d}.checkpoint", folder):
            gone = [x for x in names if x.endswith((".json", ".checkpoint"))] + [old] * bool(old)
            for x in gone:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{x}"), True)
        else:
            self._fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
