"""Completion services: offline, replayed from a table, or over HTTP, called from Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparkloom.errors import CompletionError, ConfigurationError, retried
from sparkloom.operators.routing import Service
from sparkloom.session import give_back


class Completer:
    """complete() takes a prompt and a system prompt and returns text; close() ends connections.

    waits: calls wait for another machine, so that several at once are quicker.
    """

    waits = True

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        raise NotImplementedError

    def count_tokens(self, text: str) -> int:
        """About four characters a token."""
        return -(-len(text) // 4)

    def close(self) -> None:
        return None


class Offline(Completer):
    """Replies made from the prompt alone, the same every time: for tests, dry runs and counting calls.

    What it does follows the prompt's first line, which the built-in prompts begin with the task's name.
    """

    waits = False

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        task = prompt.partition("\n")[0].strip("[] ").lower()
        _, _, rest = prompt.partition("\n---\n")
        body, ends, _ = rest.partition("\n---\n")
        text = body if ends else prompt
        seed = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
        words = re.findall(r"\w+", text) if task in ("analysis", "generation") else []
        if task == "analysis":
            return json.dumps({"information_density": seed % 100 / 100, "topic_coherence": 0.8, "complexity": 0.5, "estimated_question_yield": {"factual": 1 + len(words) // 120, "inferential": len(words) // 200, "conceptual": len(words) // 400}, "key_concepts": sorted(sorted(set(words)), key=len, reverse=True)[:3], "notes": "offline"})
        if task == "generation":
            counts = dict(re.findall(r"(factual|inferential|conceptual): (\d+)", prompt))
            out = []
            for kind, n in counts.items():
                for i in range(int(n)):
                    at = (seed + 7 * len(out)) % max(1, len(words))
                    topic = " ".join(words[at : at + 4]) or "nothing"
                    ask = ["What is known of {}?", "How does {} come about?", "According to the passage, what is {}?", "Which of the following is {}?"][(seed + i) % 4]
                    out.append({"question": ask.format(topic), "answer": f"It is {topic}.", "category": kind})
            return json.dumps(out)
        if task == "faithfulness":
            return json.dumps({"factual_accuracy": {"score": 0.95 if seed % 10 else 0.3, "reason": "offline"}, "answer_completeness": {"score": 0.9, "reason": "offline"}, "suggested_improvements": None})
        if task == "standalone":
            return json.dumps({"standalone": {"score": 0.9 if seed % 4 else 0.4, "reason": "offline"}, "suggested_improvements": "name what is meant"})
        if task == "rewrite":
            q, a = (re.search(rf"^{k}: (.*)$", prompt, re.M) for k in ("Question", "Answer"))
            if seed % 5 == 0 or not (q and a):
                return json.dumps({"question": None, "answer": None})
            return json.dumps({"question": re.sub(r"(?i)according to the passage, |which of the following is", "what is", q[1]).capitalize(), "answer": a[1]})
        return json.dumps({"echo": seed})


class Scripted(Completer):
    """Replies from a function of the prompt, for tests."""

    def __init__(self, reply: Callable[[str], str]):
        self.reply = reply

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        return self.reply(prompt)


class RateLimit:
    """At most so many requests and tokens within any 60 seconds; take() waits until there's room. 0: no limit."""

    def __init__(self, requests: int = 0, tokens: int = 0, seconds: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.requests, self.tokens, self.seconds, self.clock, self.sleep = requests, tokens, seconds, clock, sleep
        self.seen: deque[tuple[float, int]] = deque()
        self.lock = threading.Lock()

    def take(self, tokens: int) -> None:
        while True:
            with self.lock:
                now = self.clock()
                while self.seen and now - self.seen[0][0] >= self.seconds:
                    self.seen.popleft()
                full = (self.requests and len(self.seen) >= self.requests) or (self.tokens and self.seen and sum(n for _, n in self.seen) + tokens > self.tokens)
                if not full:
                    self.seen.append((now, tokens))
                    return
                wait = self.seconds - (now - self.seen[0][0])
            self.sleep(wait * 1.05)


def parse_chat(body: str) -> str:
    """The reply's text: a chat completion, one local reply, or lines of local replies (the done one, else the first)."""
    try:
        found = json.loads(body)
        rows = [found] if isinstance(found, dict) else []
    except ValueError:
        rows = []
        for line in body.strip().splitlines():
            try:
                rows.append(json.loads(line))
            except ValueError:
                continue
    rows = [r for r in rows if isinstance(r, dict)]
    for r in [x for x in reversed(rows) if x.get("done") is True] + rows:
        if r.get("choices"):
            return (r["choices"][0].get("message", {}).get("content") or "").strip()
        if "message" in r:
            return (r["message"].get("content") or "").strip()
    raise CompletionError("the service's reply holds no message", {"body": body[:500]})


def retry_after(value: str | None) -> float | None:
    """Seconds from a Retry-After header, which may be a number or a date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - time.time())
    except (TypeError, ValueError):
        return None


class Http(Completer):
    """A chat service over HTTP. The API key is read where the request is made and never travels in a table."""

    RETRYABLE = (429, 500, 502, 503, 504)

    def __init__(self, service: Service, share: int = 1, token: Callable[[], str] | None = None):
        """share: among how many tasks at once the service's limits are divided. token: gives a bearer token, for directory logins."""
        self.s, self.token = service, token
        self.limit = RateLimit(-(-service.requests_per_minute // share), -(-service.tokens_per_minute // share))

    def request(self, prompt: str, system: str | None, json_mode: bool) -> tuple[str, dict, dict]:
        s = self.s
        if not s.api_base:
            raise ConfigurationError(f"service {s.name} has no api_base")
        base = s.api_base.rstrip("/")
        body: dict = {"model": s.model, "messages": [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}], "temperature": s.temperature}
        if s.max_tokens:
            body["max_tokens"] = s.max_tokens
        if json_mode:
            body["response_format"] = {"type": "json_object"}
        body |= dict(s.extra)
        headers = {"Content-Type": "application/json", **dict(s.headers)}
        key = self.token() if self.token else os.environ.get(s.api_key_env or "", "")
        if s.provider == "azure":
            url = f"{base}/openai/deployments/{s.model}/chat/completions?api-version={s.api_version}"
            headers |= {"Authorization": f"Bearer {key}"} if self.token else {"api-key": key}
        elif ":11434" in base and "/v1" not in base:
            url = base + ("/chat" if base.endswith("/api") else "/api/chat")
            body["stream"] = False
        else:
            url = f"{base}/chat/completions"
        if key and "api-key" not in headers:
            headers["Authorization"] = f"Bearer {key}"
        if s.organization:
            headers["OpenAI-Organization"] = s.organization
        return url, headers, body

    def _once(self, url: str, headers: dict, body: dict) -> str:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.s.timeout) as r:
                return parse_chat(r.read().decode())
        except urllib.error.HTTPError as e:
            raise CompletionError(f"{self.s.name} replied {e.code}", {"status": e.code}, e.code in self.RETRYABLE, retry_after(e.headers.get("Retry-After"))) from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise CompletionError(f"{self.s.name} can't be reached: {e}", retryable=True) from e

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        self.limit.take(self.count_tokens(prompt))
        return retried(self.s.max_retries, self.s.initial_delay, self.s.max_delay)(self._once)(*self.request(prompt, system, json_mode))


Factory = Callable[[], Completer]


#: Bytes of prompts that are Python objects at once.
SLICE = 1 << 20


def complete(requests: DataFrame, factory: Factory, prompt: str = "prompt", system: str | None = None, concurrency: int = 3, json_mode: bool = True, tasks: int | None = None) -> DataFrame:
    """Adds reply and error to each request; a failed call leaves reply null and the run goes on.

    A column of arrays of prompts gets arrays of replies and errors. The requests are dealt out to `tasks` tasks (as many
    as there are cores, by default; 0: they stay where they are), since a few bytes may be much work. One completer for a
    task of Spark, which makes `concurrency` calls at once if they wait for another machine. The caller must write the
    result before using it twice, since calls would be made again.
    """
    many = isinstance(requests.schema[prompt].dataType, ArrayType)
    kind = ArrayType(StringType()) if many else StringType()
    schema = StructType([*requests.schema.fields, StructField("reply", kind), StructField("error", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        completer = factory()

        def one(p: str | None) -> tuple[str | None, str | None]:
            if p is None:
                return None, "there is no prompt"
            try:
                reply = completer.complete(p, system, json_mode)
                return (reply, None) if reply else (None, "the reply is empty")
            except Exception as e:  # one request's failure is that row's error
                return None, f"{type(e).__name__}: {e}"

        def answered(part: pa.RecordBatch, call) -> pa.RecordBatch:
            asked = part.column(prompt)
            got = list(call(one, (asked.flatten() if many else asked).to_pylist()))
            added = [pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]
            if many:
                sizes = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                added = [pa.ListArray.from_arrays(offsets, x) for x in added]
            return pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "reply", "error"])

        try:
            with ThreadPoolExecutor(max(1, concurrency)) as pool:
                for batch in batches:
                    for part in _slices(batch, prompt, many):
                        yield answered(part, pool.map if completer.waits else map)
        finally:
            completer.close()
            give_back()

    if tasks != 0:
        requests = requests.repartition(tasks or requests.sparkSession.sparkContext.defaultParallelism)
    return requests.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, prompt: str, many: bool) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE bytes of prompts each."""
    asked = batch.column(prompt)
    size = pc.fill_null(pc.binary_length(asked.flatten() if many else asked), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    if many:
        ends = np.concatenate([[0], ends])[np.cumsum(pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False))]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def request_hash(prompt: str = "prompt", task: str = ""):
    return F.sha2(F.concat_ws("|", F.lit(task), F.coalesce(F.col(prompt), F.lit(""))), 256)


def complete_with_replay(requests: DataFrame, replay: DataFrame, factory: Factory, task: str, **options) -> tuple[DataFrame, DataFrame]:
    """(answered, new): requests answered from a table of (request_hash, reply) where it has them, else by a call.

    Each distinct prompt is asked once. new holds (request_hash, reply) of successful calls, to be appended to the table.
    """
    from sparkloom.session import materialize

    keyed = requests.withColumn("request_hash", request_hash(options.get("prompt", "prompt"), task))
    missing = keyed.join(replay.select("request_hash"), "request_hash", "left_anti").select("request_hash", options.get("prompt", "prompt")).dropDuplicates(["request_hash"])
    fresh = materialize(complete(missing, factory, **options), f"replies-{task}").select("request_hash", "reply", "error")
    known = replay.select("request_hash", "reply", F.lit(None).cast("string").alias("error")).dropDuplicates(["request_hash"]).unionByName(fresh)
    return keyed.join(known, "request_hash", "left").drop("request_hash"), fresh.where("reply is not null").select("request_hash", "reply")
