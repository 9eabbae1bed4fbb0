"""Configuration: a file or a dict, values from the environment, checked before anything runs."""

from __future__ import annotations

import os
import re
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from sparkloom.errors import ChunkingError, ConfigurationError
from sparkloom.operators import budget as budget_
from sparkloom.operators import chunking as chunking_
from sparkloom.operators import routing

PREFIX = "SPARKLOOM_"


@dataclass(frozen=True)
class Document:
    normalize_whitespace: bool = True
    fix_encoding_issues: bool = True
    fix_formatting_issues: bool = True
    readers: tuple[str, ...] = ("text", "markdown", "docx", "pdf")


@dataclass(frozen=True)
class Chunks:
    strategy: str = "semantic"
    target_chunk_size: int = 1500
    overlap_size: int = 150
    preserve_headings: bool = True
    min_chunk_size: int = 500
    max_chunk_size: int = 2500
    own_heading: bool = True
    split_long_sections: bool = False


@dataclass(frozen=True)
class Generation:
    categories: dict[str, dict[str, float]] = field(default_factory=lambda: {"factual": {"min_questions": 2, "weight": 1.0}, "inferential": {"min_questions": 2, "weight": 1.2}, "conceptual": {"min_questions": 1, "weight": 1.5}})
    max_questions_per_chunk: int = 10
    adaptive_generation: bool = True
    ignore_categories: bool = False


@dataclass(frozen=True)
class Validation:
    factual_accuracy: float = 0.7
    answer_completeness: float = 0.7
    question_clarity: float = 0.7
    diversity: float = 0.85
    diversity_enabled: bool = True
    leak_filter: bool = True
    scan_answer_for_drop: bool = True


@dataclass(frozen=True)
class Decontextualization:
    enabled: bool = True
    max_attempts: int = 1


@dataclass(frozen=True)
class Output:
    format: str = "json"
    fine_tuning_format: str = "default"
    include_metadata: bool = True
    include_statistics: bool = True
    output_dir: str = "./output"
    json_indent: int | None = 2
    json_ensure_ascii: bool = False
    csv_delimiter: str = ","
    csv_quotechar: str = '"'
    csv_include_document_info: bool = False


@dataclass(frozen=True)
class Processing:
    concurrency: int = 3
    enable_checkpoints: bool = True
    checkpoint_dir: str = "./checkpoints"
    keep_runs: int = 3
    log_level: str = "INFO"
    debug_mode: bool = False


@dataclass(frozen=True)
class Config:
    version: str = "1.0"
    document: Document = Document()
    chunking: Chunks = Chunks()
    llm_services: dict[str, dict[str, Any]] = field(default_factory=dict)
    question_generation: Generation = field(default_factory=Generation)
    validation: Validation = Validation()
    decontextualization: Decontextualization = Decontextualization()
    output: Output = Output()
    processing: Processing = Processing()

    def __post_init__(self):
        self.settings_of_chunks()
        g, v, d, o, p = self.question_generation, self.validation, self.decontextualization, self.output, self.processing
        for n, c in g.categories.items():
            _need(c.get("min_questions", 0) >= 0 and c.get("weight", 1) > 0, f"category {n!r} needs min_questions >= 0 and weight > 0")
        _need(g.max_questions_per_chunk > 0, "max_questions_per_chunk must be positive")
        for n in ("factual_accuracy", "answer_completeness", "question_clarity", "diversity"):
            _need(0 <= getattr(v, n) <= 1, f"validation.{n} must be within 0..1")
        _need(1 <= d.max_attempts <= 3, "decontextualization.max_attempts must be within 1..3")
        _need(o.format.lower() in ("json", "jsonl", "csv"), f"output.format {o.format!r} is none of json, jsonl, csv")
        _need(o.fine_tuning_format.lower() in ("default", "openai_chat", "openai_legacy", "standard"), f"output.fine_tuning_format {o.fine_tuning_format!r} isn't known")
        _need(p.concurrency > 0, "processing.concurrency must be positive")
        _need(p.log_level.upper() in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), f"processing.log_level {p.log_level!r} isn't known")
        routing.check_services(self.services())

    def settings_of_chunks(self) -> chunking_.Chunking:
        c = self.chunking
        _need(c.strategy in chunking_.STRATEGIES, f"chunking.strategy {c.strategy!r} isn't known; there are {sorted(chunking_.STRATEGIES)}")
        try:
            return chunking_.Chunking(c.strategy, c.target_chunk_size, c.overlap_size, c.min_chunk_size, c.max_chunk_size, c.preserve_headings, c.own_heading, c.split_long_sections)
        except ChunkingError as e:
            raise ConfigurationError(str(e)) from e

    def services(self) -> dict[str, routing.Service]:
        known, out = {f.name for f in fields(routing.Service)}, {}
        for name, x in self.llm_services.items():
            named = {"url": "api_base", "rate_limit_tokens_per_minute": "tokens_per_minute", "rate_limit_tokens": "tokens_per_minute", "rate_limit_requests": "requests_per_minute"}
            own = {named.get(k, k): v for k, v in x.items() if v is not None}
            own.pop("api_key", None)  # stays in the environment: api_key_env names the variable
            extra = tuple((k, v) for k, v in own.items() if k not in known | {"custom_headers"})
            kept = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known}
            out[name] = routing.Service(**{"name": name, "model": "default", **kept, "headers": tuple((own.get("custom_headers") or {}).items()), "extra": extra})
        return out

    def settings(self):
        """Settings of the pipeline."""
        from sparkloom.plans.qa import Settings

        g, v, d = self.question_generation, self.validation, self.decontextualization
        return Settings(
            self.settings_of_chunks(),
            budget_.Budget({n: budget_.Category(int(c.get("min_questions", 0)), float(c.get("weight", 1.0))) for n, c in g.categories.items()}, g.max_questions_per_chunk, g.adaptive_generation, g.ignore_categories),
            (("factual_accuracy", v.factual_accuracy), ("answer_completeness", v.answer_completeness), ("standalone", v.question_clarity)),
            v.diversity if v.diversity_enabled else None, v.leak_filter, v.scan_answer_for_drop, d.max_attempts if d.enabled else 0, True, self.processing.concurrency,
            self.document.normalize_whitespace, self.document.fix_encoding_issues, self.document.fix_formatting_issues,
        )


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigurationError(why)


def _overlaps(c: Config) -> list[str]:
    return ["overlap_size is above min_chunk_size"] if c.chunking.overlap_size > c.chunking.min_chunk_size > 0 else []


def warnings(c: Config) -> list[str]:
    """What is allowed but probably not meant."""
    return _overlaps(c)


def interpolate(x: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} within strings from the environment; '' where it isn't set."""
    env = os.environ if env is None else env
    if isinstance(x, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), x)
    if isinstance(x, dict):
        return {k: interpolate(v, env) for k, v in x.items()}
    return [interpolate(v, env) for v in x] if isinstance(x, list) else x


def _override(tree: dict, env: dict[str, str]) -> dict:
    """PREFIX_A__B=value sets a.b; a single '_' belongs to the name."""
    import yaml

    for k, v in env.items():
        if k.startswith(PREFIX) and k != f"{PREFIX}CONFIG":
            at, parts = tree, k.removeprefix(PREFIX).lower().split("__")
            for p in parts[:-1]:
                at = at.setdefault(p, {})
            at[parts[-1]] = None if v == "" else yaml.safe_load(v)
    return tree


def _build(kind: type, tree: Any, where: str = "") -> Any:
    if not isinstance(tree, dict):
        raise ConfigurationError(f"{where or 'the configuration'} must be a mapping")
    own = {f.name: f for f in fields(kind)}
    unknown = set(tree) - set(own)
    if unknown and not where:
        raise ConfigurationError(f"unknown fields: {', '.join(sorted(unknown))}")
    args = {}
    for n, v in tree.items():
        f = own.get(n)
        if f is None or (v is None and n != "json_indent"):
            continue
        default = f.default if f.default is not MISSING else f.default_factory()
        if is_dataclass(default):
            args[n] = _build(type(default), v, f"{where}{n}.")
            continue
        if isinstance(default, bool) and not isinstance(v, bool) or isinstance(default, (int, float)) and not isinstance(default, bool) and (isinstance(v, bool) or not isinstance(v, (int, float))) or isinstance(default, str) and not isinstance(v, str) or isinstance(default, dict) and not isinstance(v, dict):
            raise ConfigurationError(f"{where}{n} must be like {default!r}, not {v!r}")
        args[n] = tuple(v) if isinstance(default, tuple) else v
    return kind(**args)


def load(path: str | None = None, tree: dict | None = None, env: dict[str, str] | None = None) -> Config:
    """From a YAML file or a dict, not both; without either from the file that PREFIX + CONFIG names, else defaults."""
    import yaml

    env = dict(os.environ) if env is None else env
    if path and tree is not None:
        raise ConfigurationError("give a file or a dict, not both")
    path = path or (env.get(f"{PREFIX}CONFIG") if tree is None else None)
    if path:
        if not Path(path).is_file():
            raise ConfigurationError(f"there is no file {path}")
        try:
            tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        except yaml.YAMLError as e:
            raise ConfigurationError(f"{path} is no YAML: {e}") from e
    return _build(Config, _override(interpolate(dict(tree or {}), env), env))


def dump(c: Config) -> str:
    """As YAML; no secrets are ever held in a configuration."""
    import yaml

    def plain(x: Any) -> Any:
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return yaml.safe_dump(plain(asdict(c)), sort_keys=False)


def write_default(path: str) -> bool:
    """Write the default configuration, never over an existing file; whether it was written."""
    p = Path(path)
    if p.exists():
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("# Values may be ${VARIABLES} of the environment.\n" + dump(Config()), encoding="utf-8")
    load(path, env={})
    return True
