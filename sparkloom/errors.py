"""Errors by what failed."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable


class LoomError(Exception):
    """Base of this library's errors; details holds more about the case."""

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details or {}


class ConfigurationError(LoomError): ...


class DocumentError(LoomError): ...


class ChunkingError(LoomError): ...


class AnalyzerError(LoomError): ...


class CompletionError(LoomError):
    """A completion service failed; retryable says whether another attempt may help."""

    def __init__(self, message: str, details: dict | None = None, retryable: bool = False, retry_after: float | None = None):
        super().__init__(message, details)
        self.retryable, self.retry_after = retryable, retry_after


class ValidationError(LoomError): ...


class OutputError(LoomError): ...


class CheckpointError(LoomError): ...


def backoff(attempt: int, initial: float = 1.0, most: float = 60.0, seed: int | None = None) -> float:
    """Seconds before the attempt after this one: doubled each time, capped, 10 % off either way."""
    return min(initial * 2**attempt, most) * random.Random(seed).uniform(0.9, 1.1)


def retried(retries: int = 3, initial: float = 1.0, most: float = 60.0, on: tuple[type[Exception], ...] = (CompletionError,), sleep: Callable[[float], None] = time.sleep):
    """Call again after retryable errors, up to so many times; the last error is raised."""

    def around(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            for attempt in range(retries + 1):
                try:
                    return f(*args, **kwargs)
                except on as e:
                    if attempt == retries or not getattr(e, "retryable", True):
                        raise
                    after = getattr(e, "retry_after", None)
                    sleep(min(after, 120) if after is not None else backoff(attempt, initial, most))

        return call

    return around
