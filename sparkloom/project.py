"""Project folders, and the façade that runs a project's documents."""

from __future__ import annotations

import logging
import os
import sys
import time
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.errors import ConfigurationError, DocumentError
from sparkloom.operators import completion, routing
from sparkloom.plans import prompts, qa
from sparkloom.progress import Progress
from sparkloom.sources import files, sinks
from sparkloom.sources.stages import StageStore, config_hash, documents_hash

FOLDERS = ("config", "config/prompts", "input", "output", "checkpoints", "logs", "temp")
MARK = "config/loom.yaml"
#: Written parts of a named run's stages that ask services.
PARTS = 4


def logger(level: str = "INFO", file: str | None = None) -> logging.Logger:
    log = logging.getLogger("sparkloom")
    log.setLevel(level.upper())
    if not log.handlers:
        log.addHandler(logging.StreamHandler(sys.stderr))
        if file:
            log.addHandler(logging.FileHandler(file, encoding="utf-8"))
        for h in log.handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    return log


def create(path: str = ".") -> Path:
    """A project's folders, its default configuration and prompts; what exists stays."""
    root = Path(path).resolve()
    for d in FOLDERS:
        (root / d).mkdir(parents=True, exist_ok=True)
    C.write_default(str(root / MARK))
    prompts.write_defaults(str(root / "config/prompts"))
    return root


def find(start: str = ".") -> Path | None:
    """The project that holds a folder, if any."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / MARK).is_file()), None)


@dataclass
class Timers:
    """Seconds by stage."""

    seconds: dict[str, float]

    @classmethod
    def new(cls) -> "Timers":
        return cls({})

    def time(self, name: str, f):
        began = time.monotonic()
        try:
            return f()
        finally:
            self.seconds[name] = round(self.seconds.get(name, 0) + time.monotonic() - began, 2)


class Project:
    """process() reads and runs documents; save() writes their questions. Relative paths: as they are, else in input/ or output/."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: C.Config | None = None, factory: completion.Factory | None = None, progress: Progress | None = None):
        self.progress = progress or Progress()
        found = Path(root).resolve() if root else find()
        self.spark, self.root = spark, found
        self.config = config or (C.load(str(found / MARK)) if found and (found / MARK).is_file() else C.load())
        self.prompts, self.prompt_failures = prompts.load(str(found / "config/prompts") if found else None)
        self.factory, self.timers = factory or self._factory(), Timers.new()

    def _factory(self) -> completion.Factory:
        services = {n: s for n, s in self.config.services().items() if s.enabled}
        if not services:
            return completion.Offline
        by_prompt = {p: routing.service_for(t, services) for p, t in {"analysis": "analysis", "generation": "generation", "faithfulness": "validation", "standalone": "validation", "rewrite": "validation"}.items()}
        share = self.spark.sparkContext.defaultParallelism
        return lambda: Routed({p: completion.Http(s, share) for p, s in by_prompt.items()})

    def model(self) -> str:
        """The name of the model that writes questions; 'offline' without a service."""
        services = {n: s for n, s in self.config.services().items() if s.enabled}
        return routing.service_for("generation", services).model if services else "offline"

    def where(self, path: str) -> str:
        if "://" in path or os.path.isabs(path) or Path(path).exists():
            return path
        inside = self.root / "input" / path if self.root else None
        if inside and inside.exists():
            return str(inside)
        raise FileNotFoundError(path)

    def process(self, path: str, run: str | None = None) -> qa.Result:
        """All documents of a file, folder or pattern at once; rejects are in `rejects`."""
        docs, self.rejects = self.timers.time("loading", lambda: files.read(self.spark, self.where(path)))
        self.progress.reached("documents")
        if docs.isEmpty():
            first = self.rejects.first()
            raise DocumentError(first["error"] if first else "the document is empty", {"path": path})
        return self.process_documents(docs, run)

    def process_documents(self, docs: DataFrame, run: str | None = None) -> qa.Result:
        """Checkpoints are on with a run's name: the same name, configuration, documents and folder go on where they ended."""
        keep = self.config.processing
        # the documents are a part of the name: a changed, added or removed one makes it another run
        name = f"{run}-{config_hash(self.config)}-{documents_hash(docs)}" if run and keep.enable_checkpoints else None

        def watch(stage: str, seconds: float) -> None:
            self.timers.seconds[f"questions/{stage}"] = round(seconds, 2)
            self.progress.reached(stage)

        store = StageStore(self.spark, name, watch=watch)
        settings = replace(self.config.settings(), parts=PARTS) if name else self.config.settings()
        result = self.timers.time("questions", lambda: qa.run(docs, self.factory, settings, store, self.prompts))
        return result

    def process_input(self, format: str | None = None) -> dict:
        """The input folder, each file's failure its own; counts and the failed files' reasons."""
        if not self.root:
            raise ConfigurationError("there is no project here")
        result = self.process(str(self.root / "input"))
        self.save(result, "questions", format)
        done = result.document_stats.count()
        bad = [r.asDict() for r in self.rejects.collect()]
        return {"processed": done, "failed": len(bad), "failed_files": bad, "seconds": self.timers.seconds}

    def statistics(self, result: qa.Result) -> dict:
        """Sums over all documents."""
        sums = [c for c, t in result.document_stats.dtypes if t == "bigint"]
        row = result.document_stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
        return row.asDict() | {"seconds": self.timers.seconds}

    def records(self, result: qa.Result) -> DataFrame:
        q = result.questions
        out = q.select(F.col("question_id").alias("id"), "question", "answer", "chunk_id", "context", "category")
        if self.config.output.include_metadata:
            # chunks and analyses are as many as there are texts asked about; both meet the questions by chunk_id
            chunk = result.chunks.select("chunk_id", F.struct("title", F.array_join("section_path", " > ").alias("section_path"), *[F.col(f"text_stats.{c}").alias(c) for c in ("char_count", "word_count", "sentence_count")]).alias("source"))
            told = result.analyses.select("chunk_id", F.struct("information_density", "topic_coherence", "complexity", "key_concepts").alias("analysis"))
            q = q.join(chunk, "chunk_id", "left").join(told, "chunk_id", "left").withColumn("model", F.lit(self.model()))
            meta = F.struct("generation_index", "model", "source", "analysis", F.col("outcome").alias("repair"), F.struct("is_valid", F.round("diversity", 4).alias("diversity"), *[c for c in ("factual_accuracy", "answer_completeness", "standalone")]).alias("validation"))
            out = q.select(F.col("question_id").alias("id"), "question", "answer", "chunk_id", "context", "category", meta.alias("metadata"))
        return out

    def save(self, result: qa.Result, path: str, format: str | None = None, layout: str | None = None) -> str:
        """Write the questions; returns the path. json is one object, jsonl and csv are folders of part files."""
        o = self.config.output
        kind = (format or o.format).lower()
        full = path if "://" in path or os.path.isabs(path) else str((self.root or Path.cwd()) / o.output_dir / path)
        full = full if full.endswith(f".{kind}") else f"{full}.{kind}"
        options: dict = {"layout": layout or o.fine_tuning_format, "statistics": self.statistics(result) if o.include_statistics else None, "mode": "overwrite"}
        options |= {"csv": {"delimiter": o.csv_delimiter, "quote": o.csv_quotechar, "include_document": o.csv_include_document_info}, "json": {"indent": o.json_indent, "ensure_ascii": o.json_ensure_ascii}, "jsonl": {"ensure_ascii": o.json_ensure_ascii}}.get(kind, {})
        self.timers.time("writing", lambda: sinks.write(self.records(result), full, kind, **options))
        return full

    def dump_failures(self, result: qa.Result, path: str) -> str:
        """Chunks and questions whose calls failed, as JSON lines."""
        result.failures.write.mode("overwrite").json(path)
        return path


class Routed(completion.Completer):
    """Calls the completer of the task that a prompt's first line names, else the first."""

    def __init__(self, by_task: dict[str, completion.Completer]):
        self.by_task = by_task

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        task = prompt.partition("\n")[0].strip("[] ").lower()
        return self.by_task.get(task, next(iter(self.by_task.values()))).complete(prompt, system, json_mode)

    def close(self) -> None:
        for c in self.by_task.values():
            c.close()
