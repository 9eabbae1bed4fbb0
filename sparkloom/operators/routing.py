"""Which service does a task, and how much a service was asked within a minute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import CompletionError, ConfigurationError
from sparkloom.functions import text as T

TASKS = ("analysis", "generation", "validation")


@dataclass(frozen=True)
class Service:
    """provider: 'openai', 'azure', 'openrouter' or 'local'; api_key comes from the environment where requests are made."""

    name: str
    model: str
    preferred_tasks: tuple[str, ...] = ()
    enabled: bool = True
    provider: str = "openai"
    api_base: str | None = None
    api_version: str | None = None
    api_key_env: str | None = None
    organization: str | None = None
    timeout: int = 120
    max_retries: int = 3
    initial_delay: float = 1.0
    max_delay: float = 60.0
    requests_per_minute: int = 0
    tokens_per_minute: int = 0
    temperature: float = 0.7
    max_tokens: int | None = None
    headers: tuple[tuple[str, str], ...] = ()
    extra: tuple[tuple[str, object], ...] = ()


def check_services(services: dict[str, Service]) -> None:
    """At least one is enabled, no task is preferred twice, and Azure has a base and a version."""
    if not services:
        return
    on = [s for s in services.values() if s.enabled]
    if not on:
        raise ConfigurationError("all completion services are disabled")
    seen: dict[str, str] = {}
    for s in on:
        for t in s.preferred_tasks:
            if t in seen:
                raise ConfigurationError(f"task {t!r} is preferred by both {seen[t]} and {s.name}")
            seen[t] = s.name
        if s.provider == "azure" and not (s.api_base and s.api_version):
            raise ConfigurationError("Azure needs api_base and api_version")
        if s.max_delay < s.initial_delay:
            raise ConfigurationError("max_delay is below initial_delay")


def service_for(task: str, services: dict[str, Service]) -> Service:
    """The first enabled service that prefers the task, else the remote one, else any."""
    on = {n: s for n, s in services.items() if s.enabled}
    for s in on.values():
        if task in s.preferred_tasks:
            return s
    if not on:
        raise CompletionError(f"no service for task {task!r}")
    return on.get("remote") or on.get("local") or next(iter(on.values()))


def route(task: Column | str, services: dict[str, Service]) -> Column:
    """The name of each task's service."""
    col, names = T._col(task), {t: s.name for s in services.values() if s.enabled for t in s.preferred_tasks}
    out = F.lit(service_for("", services).name)
    for t, n in names.items():
        out = F.when(col == t, n).otherwise(out)
    return out


def rate_window(requests: DataFrame, service: str, at: str, tokens: Column, limit: int, seconds: int = 60) -> DataFrame:
    """Adds requests, tokens (of this and the requests within so many seconds before it) and waits (more than limit).

    The range is over microseconds, so one sort per service serves it.
    """
    w = Window.partitionBy(service).orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    df = requests.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp")))
    df = df.withColumns({"requests": F.count("*").over(w), "tokens": F.sum(tokens).over(w)})
    return df.withColumn("waits", F.col("requests") > limit).drop("__us")
