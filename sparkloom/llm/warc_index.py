"""WARC capture index by external merge of locally sorted runs.

Every partition of captures is sorted by URL key, timestamp, capture id and digest: a run, written as a table. A sample of
the runs cuts the order into ranges of about RANGE_ROWS captures or RANGE_BYTES. The cuts are whole positions in the
order (key, time, id, digest, run, place in the run), which are all different, so that a hot URL, or one capture repeated
any number of times, is cut like anything else and no range is large. Each range goes to one partition and merges its
slices of all runs with a loser tree, at one path of log2(k) comparisons for each capture; the partitions' order is the
order of the whole. A URL's history that began in earlier ranges goes on with their count and last digest, which
are gathered for the URLs at the cuts only.

What the driver gets is 16 sampled rows and one carried row a range: one range for RANGE_BYTES of index.

The URL key has the host's parts reversed (com,example), without scheme, port, user, "www" or "m", then the path
in lower case without a final slash, and the sorted query; the fragment is dropped.

Nulls and odd input: a null or empty URL has the key '' and sorts first, as one history. A captured_at column, where
there is one, may be whole numbers (seconds), timestamps, dates, or strings of either kind; a string that is
neither, and any other type, is a null timestamp. Without the column the time follows from the page's number. A null
timestamp sorts before all others. page_ids of other types than whole numbers count by a 64-bit hash. A null body has
the digest of an empty one. Captures equal in key and time are ordered by capture id, nulls first, then by digest;
repeated rows all stay. An empty table gives an empty index. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.textvec import id_key
from sparkloom.session import materialize

#: Captures of the pages table have no time of their own: theirs follows from the page's number.
EPOCH, YEAR = 1_700_000_000, 31_536_000
#: A range's captures and bytes of index, on average; sampled rows that place one cut.
RANGE_ROWS, RANGE_BYTES, SAMPLES = 200_000, 32 << 20, 16


def url_key(url: Column) -> Column:
    """The sort key of a URL; '' for null."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(low, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(host, r"^(www[0-9]*|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")), "&")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(low == "", "").otherwise(key)


def seconds(pages: DataFrame) -> Column:
    """captured_at as seconds, by its type; see the module."""
    own, kind = F.col("captured_at"), pages.schema["captured_at"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return own.cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(own.cast("timestamp"))
    if isinstance(kind, T.StringType):
        return F.coalesce(own.try_cast("bigint"), F.unix_timestamp(own.try_cast("timestamp")))
    return F.lit(None).cast("bigint")


def captures(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html[, captured_at]) to (urlkey, captured_at, page_id, digest, bytes)."""
    page = id_key(pages, "page_id")
    when = seconds(pages) if "captured_at" in pages.columns else F.lit(EPOCH).cast("bigint") + F.pmod(F.pmod(page, F.lit(YEAR)) * 7_919, F.lit(YEAR))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(url_key(F.col("url").cast("string")).alias("urlkey"), when.alias("captured_at"), page.alias("page_id"), F.md5(body).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"))


class LoserTree:
    """Merges sorted iterators; ties go to the earlier one. Inner nodes hold losers, node 0 the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head: list[Any] = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        """Run i goes up from its leaf; the loser of each match stays, the winner goes on."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner  # waits for its opponent
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.tree[0]] is not None:
            w = self.tree[0]
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._play(w)


_COLUMNS = ("urlkey", "captured_at", "page_id", "digest", "bytes")
_PLACE = ("urlkey", "captured_at", "page_id", "digest", "run", "nth")
_LEAST = -(1 << 63)


def _place(key: str, when: int | None, page: int | None, digest: str, run: int, nth: int) -> tuple:
    """A capture's position in the whole order, as something to compare."""
    return key.encode(), when is not None, when or 0, page is not None, page or 0, digest, run, nth


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are of one run each."""
    run = b.column("run").to_numpy()
    at = 0
    for to in [*(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]:
        yield b.slice(at, to - at)
        at = to


def _ranged(cuts: list[tuple]):
    """Sorted runs to the same with the range of each row: the number of cuts at or before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole) if whole.num_rows else ():
                cols = [b.column(c) for c in _PLACE]

                def place(i: int) -> tuple:
                    return _place(*(c[i].as_py() for c in cols))

                number, at = [], 0
                low, high = bisect_right(cuts, place(0)), bisect_right(cuts, place(b.num_rows - 1))
                for r in range(low, high + 1):
                    to = b.num_rows if r == high else bisect_left(range(b.num_rows), cuts[r], at, key=place)
                    number += [r] * (to - at)
                    at = to
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int32())], names=[*b.schema.names, "range"])

    return run


def _merge(carried: dict[int, tuple[int, str]]):
    """One range, sorted by run: the slices of all runs through a loser tree, to numbered histories."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one range: about RANGE_BYTES
        if not parts:
            return
        got = pa.Table.from_batches(parts)
        run, number = got.column("run").to_numpy(), got.column("range")[0].as_py()
        cut = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        step = max(64, 65_536 // len(cut))

        def rows(a: int, b: int) -> Iterator[tuple]:
            for at in range(a, b, step):
                part = got.slice(at, min(step, b - at))
                key, when, page, digest, size = (part.column(c).to_pylist() for c in _COLUMNS)
                for i in range(len(key)):
                    # by bytes, as Spark sorts; the run's number breaks ties by being earlier
                    yield key[i].encode(), (when[i] is not None, when[i] or 0), (page[i] is not None, page[i] or 0), digest[i], size[i], key[i]

        out: list[list] = [[] for _ in range(7)]
        nth, before = carried.get(number, (0, None))
        last = None

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            b = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*_COLUMNS, "capture_no", "changed"])
            for c in out:
                c.clear()
            return b

        for raw, when, page, digest, size, key in LoserTree([rows(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]):
            nth = nth + 1 if last is None or raw == last else 1
            for c, v in zip(out, (key, when[1] if when[0] else None, page[1] if page[0] else None, digest, size, nth, nth == 1 or digest != before), strict=True):
                c.append(v)
            last, before = raw, digest
            if len(out[0]) >= 8192:
                yield flush()
        if out[0]:
            yield flush()

    return merge


def _cuts(runs: DataFrame, rows: int, size: int) -> list[tuple]:
    """Where ranges begin, from a sample by hash of SAMPLES rows a range."""
    ranges = max(-(-rows // RANGE_ROWS), -(-size // RANGE_BYTES))
    if ranges < 2:
        return []
    every = max(1, rows // (ranges * SAMPLES))
    taken = runs.where(F.pmod(F.xxhash64("run", "nth"), F.lit(every)) == 0).select(*_PLACE).toArrow()
    places = sorted(_place(*r.values()) for r in taken.to_pylist())
    return sorted({places[len(places) * i // ranges] for i in range(1, ranges)}) if places else []


def _carried(ranged: DataFrame, cuts: list[tuple]) -> dict[int, tuple[int, str]]:
    """For each range that begins inside a URL's history, the captures before it and the last one's digest."""
    if not cuts:
        return {}
    spark = ranged.sparkSession
    keys = spark.createDataFrame([(k.decode(),) for k in sorted({c[0] for c in cuts})], "urlkey string")
    some = ranged.join(F.broadcast(keys), "urlkey")  # at most one key a cut
    latest = F.struct(F.coalesce("captured_at", F.lit(_LEAST)), F.coalesce("page_id", F.lit(_LEAST)), "digest")
    sums = some.groupBy("urlkey", "range").agg(F.count("*").alias("n"), F.max(latest).alias("m")).select("urlkey", "range", "n", F.col("m.digest").alias("digest"))
    over = "(partition by urlkey order by range)"
    table = sums.selectExpr("urlkey", "range", f"sum(n) over {over} as upto", "digest").toArrow().to_pylist()
    by: dict[str, list[dict]] = {}
    for r in sorted(table, key=lambda r: r["range"]):
        by.setdefault(r["urlkey"], []).append(r)
    out = {}
    for i, c in enumerate(cuts, 1):  # range i begins at cuts[i - 1], which is a capture
        own = by[c[0].decode()]
        at = bisect_left(own, i, key=lambda r: r["range"])
        if at:
            out[i] = (own[at - 1]["upto"], own[at - 1]["digest"])
    return out


def histories(pages: DataFrame) -> DataFrame:
    """Captures in global order with their number in the URL's history and whether the content changed."""
    runs = captures(pages).sortWithinPartitions("urlkey", F.asc_nulls_first("captured_at"), F.asc_nulls_first("page_id"), "digest")
    # the runs are a written table: a repeated task reads the same run again
    runs = materialize(runs.withColumn("run", F.spark_partition_id().cast("bigint")).withColumn("nth", F.monotonically_increasing_id()), "runs")
    rows, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("urlkey") + 64), F.lit(0))).first()
    cuts = _cuts(runs, rows, size)
    ranged = runs.mapInArrow(_ranged(cuts), runs.schema.simpleString()[7:-1].replace(":", " ") + ", range int")
    # a partition a range, in order; sorted by run, each slice comes as its run has it
    dealt = ranged.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("run", "nth")
    return dealt.mapInArrow(_merge(_carried(ranged, cuts)), "urlkey string, captured_at bigint, page_id bigint, digest string, bytes bigint, capture_no bigint, changed boolean")


def op6_warc_index(spark, sf_dir: str) -> DataFrame:
    """The index of all pages' captures, globally ordered."""
    return histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_LOW = "lower(trim(coalesce(url, '')))"
_BARE = f"regexp_replace(regexp_replace({_LOW}, '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '')"
_HOST = f"regexp_replace(regexp_replace(regexp_replace(regexp_extract({_BARE}, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^(www[0-9]*|m)\\.', '')"
_PATH = f"regexp_replace(regexp_extract({_BARE}, '^[^/?]*([^?]*)', 1), '/+$', '')"
_QUERY = f"array_to_string(list_sort(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&')), '&')"
ORACLE = f"""
with c as (select case when {_LOW} = '' then '' else concat(array_to_string(list_reverse(string_split({_HOST}, '.')), ','), ')',
    case when {_PATH} = '' then '/' else {_PATH} end, case when {_QUERY} = '' then '' else concat('?', {_QUERY}) end) end as urlkey,
  ({EPOCH} + (page_id * 7919) % {YEAR})::bigint as captured_at, page_id, md5(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as bytes from pages)
select *, row_number() over w as capture_no, coalesce(digest <> lag(digest) over w, true) as changed
from c window w as (partition by urlkey order by captured_at nulls first, page_id nulls first, digest)"""
