"""Written tables of a run's stages: what makes runs repeatable, and lets them be taken up again."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import work_folder


def config_hash(config: object, leave_out: tuple[str, ...] = ("version", "log_level", "debug_mode")) -> str:
    """16 hex digits of a configuration's canonical JSON, without fields that don't change results."""

    def plain(x: object) -> object:
        if is_dataclass(x):
            x = asdict(x)
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items() if k not in leave_out}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return hashlib.sha256(json.dumps(plain(config), sort_keys=True, default=str).encode()).hexdigest()[:16]


class StageStore:
    """Tables at <folder>/<run>/<stage>; a stage with a _SUCCESS mark is read instead of made.

    Without a run's name it is a new run each time. folder: by default in the shared work folder.
    """

    def __init__(self, spark: SparkSession, run: str | None = None, folder: str | None = None, watch: Callable[[str, float], None] | None = None):
        """watch(stage, seconds) is told of each stage that was made."""
        self.spark, self.watch = spark, watch
        self.folder = (folder or f"{work_folder(spark)}/sparkloom/runs").rstrip("/")
        self.run = run or uuid.uuid4().hex
        self.made_now: list[str] = []

    def path(self, stage: str) -> str:
        return f"{self.folder}/{self.run}/{stage}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, stage: str) -> bool:
        fs, p = self._fs(self.path(stage) + "/_SUCCESS")
        return fs.exists(p)

    def made(self, stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made now if it isn't there whole. A half-written one is written over."""
        if not self.exists(stage):
            began = time.monotonic()
            make().write.mode("overwrite").option("compression", "zstd").parquet(self.path(stage))
            self.made_now.append(stage)
            if self.watch:
                self.watch(stage, time.monotonic() - began)
        return self.spark.read.parquet(self.path(stage))

    def prune(self, keep: int = 3) -> list[str]:
        """Remove all but the newest runs of the folder; returns the names removed."""
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return []
        runs = sorted(((s.getModificationTime(), s.getPath()) for s in fs.listStatus(p) if s.isDirectory()), key=lambda x: (-x[0], str(x[1])))
        for _, old in runs[keep:]:
            fs.delete(old, True)
        return [r.getName() for _, r in runs[keep:]]


def documents_hash(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "path", "title", "text", "sections")) -> str:
    """16 hex digits of a set of documents, whatever the order of rows: any change to one gives another."""
    row = F.to_json(F.struct(*[c for c in columns if c in docs.columns]))
    n, one, two = docs.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}/{one}/{two}".encode()).hexdigest()[:16]


def pending(docs: DataFrame, done: DataFrame, key: str = "doc_hash") -> DataFrame:
    """Documents that aren't among the done ones."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def latest(checkpoints: DataFrame, key: str = "document_id", at: str = "saved_at_timestamp") -> DataFrame:
    """Each document's newest checkpoint row."""
    rest = [c for c in checkpoints.columns if c != key]
    return checkpoints.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "processed_chunk_count") if "processed_chunk_count" in rest else F.col(at)).alias("r")).select(key, "r.*")


def read_questions(spark: SparkSession, path: str, schema: str = "question_id string, question string, answer string, chunk_id string, context string, category string") -> tuple[DataFrame, DataFrame]:
    """(questions, bad): JSON lines that fit, with all required fields, and the raw text of those that don't."""
    lines = spark.read.text(path).withColumn("q", F.from_json("value", schema))
    need = F.col("q.question").isNotNull() & F.col("q.answer").isNotNull() & F.col("q.chunk_id").isNotNull()
    return lines.where(need).select("q.*"), lines.where(~F.coalesce(need, F.lit(False))).select("value")
