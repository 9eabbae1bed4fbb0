"""Best-fit packing of documents into bins of a fixed number of tokens, improved by swap-based local search.

A document longer than a bin is cut into whole bins and a rest. The pieces of one shard start in best-fit decreasing
order. Then local search takes two underfull bins and moves a piece, exchanges one for one, or one for two in
either direction, whichever raises the sum of squared fills most, until bins empty out and no such step is
left between any two bins. Every step raises the integer sum, so it ends; a bin is looked at again only after it changed.

A shard is a run of rows of one input partition: SHARD_DOCS documents or SHARD_BYTES of text, whichever is reached
first. Nothing is shuffled, no task holds more than a shard (a longer text makes one by itself), and at most a few
bins of each shard stay underfull. Which documents share a shard follows from how the table is laid out in files.
Tokens are separated by ASCII white space.

Nulls and odd input: a null, empty or white text has no tokens and is in no bin. Rows with a null doc_id are packed
like others. Ids may be of any type. Repeated rows are packed as often as they stand there. Ties go by place in the
shard. An empty table gives no bins. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textvec

CAPACITY, SHARD_DOCS, SHARD_BYTES = 2048, 8192, 12 << 20


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit in the given order; sizes are at most capacity. Bins of positions."""
    bins: list[list[int]] = []
    at: dict[int, list[int]] = {}  # open bins by free space
    free = 0  # bit s: a bin with s free
    for i, n in enumerate(sizes):
        fit = free >> n
        if fit:
            space = n + (fit & -fit).bit_length() - 1
            b = at[space].pop()
            if not at[space]:
                free &= ~(1 << space)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        rest = space - n
        if rest:
            at.setdefault(rest, []).append(b)
            free |= 1 << rest
    return bins


class _Sums:
    """What each underfull bin can give, as flat arrays of sums, their first parts, bins and these bins' fills."""

    def __init__(self, capacity: int):
        self.gone = 4 * capacity + 1  # the fill of entries that no longer count
        self.n, self.live = 0, 0
        self.sum, self.part, self.bin, self.fill = (np.zeros(1024, np.int64) for _ in range(4))
        self.at: dict[int, tuple[int, int]] = {}

    def put(self, b: int, fill: int, sums: np.ndarray, parts: np.ndarray) -> None:
        self.drop(b)
        k = len(sums)
        if self.n + k > len(self.sum):
            keep = np.flatnonzero(self.fill[: self.n] != self.gone)
            size = max(1024, 2 * (len(keep) + k))
            for name in ("sum", "part", "bin", "fill"):
                new = np.zeros(size, np.int64)
                new[: len(keep)] = getattr(self, name)[keep]
                setattr(self, name, new)
            self.n = len(keep)
            cut = np.flatnonzero(np.diff(self.bin[: self.n], prepend=-1, append=-1))
            self.at = {int(self.bin[x]): (int(x), int(y)) for x, y in zip(cut[:-1], cut[1:], strict=True)}
        lo, hi = self.n, self.n + k
        self.sum[lo:hi], self.part[lo:hi], self.bin[lo:hi], self.fill[lo:hi] = sums, parts, b, fill
        self.at[b], self.n = (lo, hi), hi

    def drop(self, b: int) -> None:
        lo, hi = self.at.pop(b, (0, 0))
        self.fill[lo:hi] = self.gone

    def best(self, b: int, own: np.ndarray, fill: int, capacity: int) -> tuple[int, int, int]:
        """Largest gain of giving one of the own sums for an entry of another bin: (gain, own position, entry)."""
        lo, hi = self.at.get(b, (0, 0))
        self.fill[lo:hi] = self.gone
        top = (0, 0, 0)
        sums, fills = self.sum[: self.n], self.fill[: self.n]
        step = max(1, (1 << 20) // max(self.n, 1))
        for at in range(0, len(own) if self.n else 0, step):
            more = own[at : at + step, None] - sums[None]  # what the other bin gains
            gain = more * (fills - fill + more)
            gain[(fills + more > capacity) | (fill - more > capacity)] = 0
            k = int(gain.argmax())
            i, j = divmod(k, self.n)
            if gain[i, j] > top[0]:
                top = (int(gain[i, j]), at + i, j)
        self.fill[lo:hi] = fill
        return top


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search until no move, one-for-one or one-for-two exchange of two bins raises the sum of squared fills."""
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    items: dict[int, dict[int, list[int]]] = {}  # bin: size: positions
    fill: dict[int, int] = {}
    ones, twos = _Sums(capacity), _Sums(capacity)
    for b in bins:
        total = sum(sizes[i] for i in b)
        if total < capacity:
            own: dict[int, list[int]] = {}
            for i in b:
                own.setdefault(sizes[i], []).append(i)
            items[len(items)], fill[len(fill)] = own, total

    def singles(b: int) -> np.ndarray:
        return np.array([0, *sorted(items[b])], np.int64)

    def pairs(b: int) -> tuple[np.ndarray, np.ndarray]:
        """Different sums of two of the bin's pieces, with the smaller piece."""
        size = np.array(sorted(items[b]), np.int64)
        i, j = np.triu_indices(len(size), 1)
        twice = size[[len(items[b][int(n)]) > 1 for n in size]] if len(size) else size
        sums, first = np.unique(np.concatenate([size[i] + size[j], 2 * twice]), return_index=True)
        return sums, np.concatenate([size[i], twice])[first]

    def enter(b: int) -> None:
        own = singles(b)
        ones.put(b, fill[b], own, own)
        twos.put(b, fill[b], *pairs(b))

    def hand(a: int, b: int, given: list[int]) -> None:
        """Pieces of these sizes go from a to b."""
        for n in given:
            if n:
                own = items[a][n]
                items[b].setdefault(n, []).append(own.pop())
                if not own:
                    del items[a][n]
                fill[a] -= n
                fill[b] += n

    def settle(b: int) -> None:
        if 0 < fill[b] < capacity:
            enter(b)
            heapq.heappush(queue, (fill[b], b))
            return
        ones.drop(b)
        twos.drop(b)
        if fill[b]:
            full.append([i for v in items[b].values() for i in v])
        del items[b], fill[b]

    for b in items:
        enter(b)
    queue = [(f, b) for b, f in fill.items()]
    heapq.heapify(queue)
    while queue:
        f, b = heapq.heappop(queue)
        if fill.get(b) != f:
            continue  # it changed and is queued again, or is gone
        own = singles(b)
        gain, i, j = ones.best(b, own, f, capacity)
        given, taken = [int(own[i])], [int(ones.sum[j])]
        table = ones
        if not gain:
            gain, i, j = twos.best(b, own, f, capacity)
            given, taken, table = [int(own[i])], [], twos
            if gain:
                taken = [int(twos.part[j]), int(twos.sum[j] - twos.part[j])]
            else:
                sums, parts = pairs(b)
                gain, i, j = ones.best(b, sums, f, capacity)
                if not gain:
                    continue
                given, taken, table = [int(parts[i]), int(sums[i] - parts[i])], [int(ones.sum[j])], ones
        a = int(table.bin[j])
        hand(b, a, given)
        hand(a, b, taken)
        settle(a)
        settle(b)
    return full + [[i for v in own.values() for i in v] for own in items.values()]


def pack(tokens: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (document, first token, tokens) for documents of so many tokens each."""
    pieces = [(d, s, min(capacity, n - s)) for d, n in enumerate(tokens) for s in range(0, n, capacity)]
    pieces.sort(key=lambda p: -p[2])
    sizes = [p[2] for p in pieces]
    bins = improve(best_fit(sizes, capacity), sizes, capacity)
    return [sorted(pieces[i] for i in b) for b in sorted(bins, key=min)]


def token_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places where tokens begin and end, and each text's number of tokens."""
    solid = textvec.SOLID[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = solid[edge]  # a text's own first byte
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def _chunks(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows of so many documents or bytes of text."""
    held: list[pa.RecordBatch] = []
    rows = total = 0
    for b in textvec.slices(batches, "text", max(1, size // 8)):
        for at in range(0, b.num_rows, docs):
            part = b.slice(at, docs)
            if held and (rows + part.num_rows > docs or total + part.nbytes > size):
                yield held
                held, rows, total = [], 0, 0
            held.append(part)
            rows, total = rows + part.num_rows, total + part.nbytes
    if held:
        yield held


def _bins(capacity: int, with_text: bool, docs: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for nth, held in enumerate(_chunks(batches, docs, size)):
            t = pa.Table.from_batches(held)
            ids = t.column("doc_id").combine_chunks()
            data, offsets = textvec.raw(t.column("text"))
            start, end, counts = token_edges(data, offsets)
            before = np.cumsum(counts) - counts
            bins = pack(counts.tolist(), capacity)
            for at in range(0, len(bins), 256):
                some = bins[at : at + 256]
                cut = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in some])]), pa.int32())
                doc, first, n = (np.array([p[k] for b in some for p in b], np.int64) for k in range(3))
                listed = lambda x: pa.ListArray.from_arrays(cut, x)  # noqa: E731, B023
                cols = [
                    pa.array([base + nth] * len(some), pa.int64()),
                    pa.array(range(at, at + len(some)), pa.int32()),
                    pa.array([sum(p[2] for p in b) for b in some], pa.int32()),
                    listed(ids.take(pa.array(doc))),
                    listed(pa.array(first)),
                    listed(pa.array(n)),
                ]
                names = ["shard", "bin", "tokens", "doc_ids", "starts", "lengths"]
                if with_text:
                    # a whole document with its white space, a piece from its first to its last token
                    whole = n == counts[doc]
                    a = np.where(whole, offsets[doc], start[before[doc] + first])
                    z = np.where(whole, offsets[doc + 1], end[before[doc] + first + n - 1])
                    cols.append(listed(pa.array([data[x:y].tobytes().decode() for x, y in zip(a, z, strict=True)], pa.string())))
                    names.append("texts")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, with_text: bool = False, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Bins (shard, bin, tokens, doc_ids, starts, lengths[, texts]): the i-th piece is lengths[i] tokens of
    doc_ids[i] from token starts[i] on; texts has the pieces themselves."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"shard bigint, bin int, tokens int, doc_ids array<{kind}>, starts array<bigint>, lengths array<bigint>" + (", texts array<string>" if with_text else "")
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(_bins(capacity, with_text, shard_docs, shard_bytes), kinds)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every bin with its documents' pieces."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
