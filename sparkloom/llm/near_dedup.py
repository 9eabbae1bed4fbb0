"""MinHash near-duplicate groups from HyperMinHash registers.

Each text's word shingles are hashed once. The top bits of a hash choose a bucket, and the bucket keeps its
smallest remainder as a 16-bit register: the count of leading zeros and 10 mantissa bits. Bands of registers
(empty ones are filled from other buckets, so that short texts band like long ones) give candidates; the
collision-corrected Jaccard estimate of the registers thins them; exact Jaccard over the shingle sets
decides. Groups are the connected components of the verified pairs; links counts the rows that a row is near to.

No band and no group is capped, or gathered in one row or task. Texts of equal words are one node with a weight from the
start. Bands of the same members are told by sums over hashes of these and looked at once. A band of more than
MEMBERS nodes is divided into parts that visit each other; in a part a node is compared with the first members of the
sets so far, then with the rest of those it didn't join, so n copies cost about n comparisons. Candidate components are
verified in blocks of about BLOCK_DOCS texts or BLOCK_SHINGLES shingles, each two blocks of a component in one task,
by products of their shingle matrices: all pairs of a component are compared, and none is written, only
link counts and a spanning forest. So memory is bounded at any size; in a component of m blocks each text is
sent m times.

Nulls and odd input: a null or empty text, or one without any word, is in no group and always stays. Rows
with a null doc_id stay as they are and join no group. Ids that aren't whole numbers count by a 64-bit hash. Rows that
share a doc_id but not the words are different documents. Repeated rows are copies of each other, and one of them
stays. Of a group the smallest doc_id stays (of equal ids, the one with the smallest hash of its text). Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec
from sparkloom.llm.graph import components
from sparkloom.session import materialize

BUCKET_BITS, MANTISSA = 7, 10
BUCKETS = 1 << BUCKET_BITS
EMPTY = np.uint16(0xFFFF)
SHINGLE, THRESHOLD, BAND = 3, 0.5, 3
#: The most nodes in a part of a band; texts and shingles in a block of a component, on average.
MEMBERS, BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1024, 2 << 20
#: Lists of ids of at most so many rows, as counted, are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 400_000

_rng = np.random.default_rng(77)
_PROBE = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])  # the order in which bucket j borrows


def registers(h: np.ndarray, doc: np.ndarray, docs: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """(docs, 2**bits) registers: leading zeros in the top 6 bits, mantissa in the low 10; EMPTY without a shingle."""
    step = (1 << 20) >> bits
    if docs > step:  # so many texts at a time, to bound memory; doc ascends
        cut = np.searchsorted(doc, np.arange(0, docs + step, step))
        return np.concatenate([registers(h[a:b], doc[a:b] - i * step, min(step, docs - i * step), bits) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
    least = np.full(docs << bits, np.uint64(2**64 - 1))
    np.minimum.at(least, (doc << bits) + (h >> np.uint64(64 - bits)).astype(np.int64), h << np.uint64(bits) | np.uint64(1))
    m, e = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - e, 62)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((m * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.uint16)
    out[least == np.uint64(2**64 - 1)] = EMPTY
    return out.reshape(docs, 1 << bits)


def densify(regs: np.ndarray) -> np.ndarray:
    """Fill each empty register from the first occupied one in its own fixed order."""
    out = regs.copy()
    rows, cols = np.nonzero((regs == EMPTY) & (regs != EMPTY).any(1)[:, None])
    for t in range(BUCKETS):
        if not len(rows):
            break
        found = regs[rows, _PROBE[cols, t]]
        ok = found != EMPTY
        out[rows[ok], cols[ok]] = found[ok]
        rows, cols = rows[~ok], cols[~ok]
    return out


def band_keys(dense: np.ndarray) -> np.ndarray:
    """(docs, bands) int64 keys of BAND registers each; the band's number is in the key."""
    n, bands = len(dense), BUCKETS // BAND
    key = np.zeros((n, bands), np.uint64)
    for j in range(BAND):
        key = textvec.mix(key * np.uint64(31) + dense[:, j : bands * BAND : BAND] + np.arange(1, key.shape[1] + 1, dtype=np.uint64) * np.uint64(0x10000))
    return key.view(np.int64)


def levels(n: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """For sets of n shingles, the chances that a register has 0, 1, ... leading zeros."""
    level = 2.0 ** -np.arange(0, 40)
    at = np.exp(-(np.asarray(n, float)[:, None] / buckets) * level)
    return at[:, 1:] - at[:, :-1]


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that two unrelated registers agree, of sets with these levels(): one with many, or as many."""
    return (b @ a if a.ndim == 1 else (a * b).sum(1)) / (1 << MANTISSA)


def estimate(one: np.ndarray, la: np.ndarray, many: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of one register row (or as many) with many, and the buckets that tell; la and lb are their levels()."""
    there = many != EMPTY
    used = ((one != EMPTY) | there).sum(1)
    same = ((one == many) & there).sum(1)
    c = collision_rate(la, lb)
    return np.clip((same / np.maximum(used, 1) - c) / (1 - c), 0, 1), used


def plausible(est: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    """Estimates within three standard errors of the threshold, or above."""
    return est >= threshold - 3 * np.sqrt(0.25 / np.maximum(used, 1)) * np.where(used >= 64, 0.9, 1)


def _sketches(k: int):
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("n", pa.int32()), ("regs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textvec.slices(batches, "text", 1 << 20):
            w = textvec.words(*textvec.raw(pc.utf8_lower(b.column("text").cast(pa.large_string()))))
            keep = np.flatnonzero(w.per_doc)
            if not len(keep):
                continue
            h, doc = textvec.shingles(w, k)
            regs = registers(h, doc, len(w.per_doc))[keep]
            first = np.cumsum(w.per_doc) - w.per_doc
            order = np.arange(len(w.hash)) - first[w.doc]
            fp = [np.add.reduceat(textvec.mix(w.hash ^ textvec.mix(order.astype(np.uint64) * np.uint64(2) + np.uint64(s))), first[keep]).view(np.int64) for s in (0, 1)]
            n = np.bincount(doc, minlength=len(w.per_doc))[keep]
            own = [b.column(c).take(pa.array(keep)) for c in ("id", "h")]
            yield pa.record_batch([*own, pa.array(fp[0]), pa.array(fp[1]), pa.array(n.astype(np.int32)), pa.array([r.tobytes() for r in regs], pa.binary())], schema=schema)

    return run


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 4096):
            t = b.slice(s, 4096)
            keys = band_keys(densify(_registers_of(t.column("regs"))))
            yield pa.record_batch({"band": keys.ravel(), "node": np.repeat(t.column("node").to_numpy(), keys.shape[1])})


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key, from batches in which such rows are adjacent."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1])
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            at = int(cut[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held, b = [], b.slice(at)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)
    textvec.give_back()


def bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def clusters(n: int, links: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Positions 0..n-1 joined where they are linked: the joins made (earlier, later), and each one's set by its first member.

    links(i, others, own) gives, for each set in own (the sets of the others, all before i), one that i is linked
    with, if any. The sets' first members are tried before the rest of the sets that are still apart, and nothing
    within a set: so n copies take about n trials, however many they are.
    """
    joins, first = [], np.arange(n)
    for i in range(1, n):
        own = first[:i]
        head = own == np.arange(i)
        tops = np.flatnonzero(head)
        found = links(i, tops, tops)
        rest = np.flatnonzero(~head & ~np.isin(own, found)) if len(found) else np.flatnonzero(~head)
        if len(rest):
            found = np.concatenate([found, links(i, rest, own[rest])]).astype(np.int64)
        if len(found):
            joins += [(int(j), i) for j in found]
            near = own[found]
            if len(near) > 1:
                own[np.isin(own, near)] = near.min()
            first[i] = near.min()
    return joins, first


def _proposals(threshold: float):
    """Parts of bands (sorted by band, part, role) to edges whose estimate is plausible, none within what is already connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "place"):
            ids, n, role = (t.column(c).to_numpy() for c in ("node", "n", "role"))
            regs, rate = _registers_of(t.column("regs")), levels(n)
            cut = bounds(t.column("place").to_numpy())
            size = np.diff(cut)
            twos = cut[:-1][(size == 2) & (role[np.minimum(cut[:-1] + 1, len(role) - 1)] == 0)]
            a, b = [], []
            if len(twos):
                ok = plausible(*estimate(regs[twos], rate[twos], regs[twos + 1], rate[twos + 1]), threshold)
                a.append(ids[twos[ok]])
                b.append(ids[twos[ok] + 1])
            done = set(twos.tolist())
            for s, z in zip(cut[:-1].tolist(), size.tolist(), strict=True):
                if z < 2 or s in done:
                    continue
                own, p = regs[s : s + z], rate[s : s + z]
                homes = int((role[s : s + z] == 0).sum())

                def links(i: int, others: np.ndarray, sets: np.ndarray) -> np.ndarray:
                    ok = plausible(*estimate(own[i], p[i], own[others], p[others]), threshold)
                    return others[ok][np.unique(sets[ok], return_index=True)[1]]

                joins, first = clusters(homes, links)
                tops = np.flatnonzero(first == np.arange(homes))
                for i in range(homes, z):  # visitors: the first members of all sets, then the rest of the other sets
                    got = links(i, tops, tops)
                    rest = np.flatnonzero((first != np.arange(homes)) & ~np.isin(first, first[got]))
                    joins += [(int(j), i) for j in got]
                    joins += [(int(j), i) for j in links(i, rest, first[rest])] if len(rest) else []
                joined = np.array(joins, np.int64).reshape(-1, 2)
                a.append(ids[s + joined[:, 0]])
                b.append(ids[s + joined[:, 1]])
            if a:
                yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _sets(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Each text's different shingles, ascending."""
    sets: list[np.ndarray] = []
    for b in textvec.slices(iter(pa.table({"text": texts}).to_batches()), "text", 1 << 20):
        w = textvec.words(*textvec.raw(pc.utf8_lower(b.column("text").cast(pa.large_string()))))
        h, doc = textvec.shingles(w, k)
        cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
        sets += [np.unique(h[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    return sets


def _tiles(sets: list[np.ndarray], most: int = 64_000) -> list[tuple[int, int]]:
    """Runs of sets with at most so many shingles, of 256 sets at most."""
    out, at, total = [], 0, 0
    for i, s in enumerate(sets):
        if i > at and (total + len(s) > most or i - at >= 256):
            out.append((at, i))
            at, total = i, 0
        total += len(s)
    return [*out, (at, len(sets))] if sets else []


def common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of two lists, by a product of 0-1 matrices over the shingles both lists have."""
    if len(one) * len(two) <= 4 or max(map(len, one)) * max(map(len, two)) > 1 << 34:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in two] for x in one])
    x, y = np.concatenate(one), np.concatenate(two)
    i, j = np.repeat(np.arange(len(one)), [len(s) for s in one]), np.repeat(np.arange(len(two)), [len(s) for s in two])
    shared = np.intersect1d(x, y)
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(shared), 8192):
        part = shared[at : at + 8192]
        sides = []
        for h, row, rows in ((x, i, len(one)), (y, j, len(two))):
            pos = np.searchsorted(part, h)
            hit = np.flatnonzero(part[np.minimum(pos, len(part) - 1)] == h)
            m = np.zeros((rows, len(part)), np.float32)
            m[row[hit], pos[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def near_pairs(one: list[np.ndarray], two: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of sets that reach the threshold; within one list (i < j) if two is None."""
    left, right = [], []
    for ta, (a, b) in enumerate(_tiles(one)):
        for c, d in _tiles(one if two is None else two)[ta if two is None else 0 :]:
            x, y = one[a:b], (one if two is None else two)[c:d]
            nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            both = common(x, y)
            i, j = np.nonzero((both > 0) & (both >= threshold * (nx[:, None] + ny[None] - both)))
            if two is None and a == c:
                i, j = i[i < j], j[i < j]
            left.append(i + a)
            right.append(j + c)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _verified(k: int, threshold: float):
    """Texts of one or two blocks of a component, sorted by place and role, to links by node (kind 0) and a forest's edges (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "place"):
            cut = bounds(t.column("place").to_numpy())
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = t.slice(s, e - s)
                node, copies, role = (own.column(c).to_numpy() for c in ("node", "copies", "role"))
                h = int((role == 1).sum())
                if len(role) < 2 or (role[0] and h in (0, len(role))):
                    continue
                sets = _sets(own.column("text"), k)
                if role[0] == 0:
                    i, j = near_pairs(sets, None, threshold)
                else:
                    i, j = near_pairs(sets[:h], sets[h:], threshold)
                    j = j + h
                links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
                some = np.flatnonzero(links)
                up = np.arange(len(sets))  # a forest is enough for the groups
                edges = []
                while len(i):
                    key, at = np.unique(np.maximum(up[i], up[j]), return_index=True)
                    edges.append(np.stack([i[at], j[at]], 1))
                    low = np.minimum(up[i[at]], up[j[at]])
                    table = np.arange(len(sets))
                    table[key] = low
                    while (table != table[table]).any():
                        table = table[table]
                    up = table[up]
                    apart = up[i] != up[j]
                    i, j = i[apart], j[apart]
                tree = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
                kind = np.concatenate([np.zeros(len(some), np.int8), np.ones(len(tree), np.int8)])
                yield pa.record_batch({"kind": kind, "a": np.concatenate([node[some], node[tree[:, 0]]]), "b": np.concatenate([links[some].astype(np.int64), node[tree[:, 1]]])})

    return run


def _listed(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _meetings(df: DataFrame) -> DataFrame:
    """Members of bands in parts: each lives in one part (role 0) and visits half of the others (role 1), so that each two parts meet once."""
    out = df.selectExpr("*", "pmod(xxhash64(node, 7), parts) as home", "explode(sequence(0, parts div 2)) as step").where("step = 0 or 2 * step <> parts or home < parts div 2")
    return out.selectExpr("xxhash64(band, pmod(home + step, parts)) as place", "cast(step > 0 as tinyint) as role", "node", "n", "regs")


def _blocks(df: DataFrame) -> DataFrame:
    """Texts of components in blocks: each block by itself (role 0), and each two blocks (roles 1 and 2)."""
    out = df.selectExpr("*", "pmod(xxhash64(node, 7), parts) as home", "explode(sequence(0, parts - 1)) as other")
    role = "cast(case when home = other then 0 when home < other then 1 else 2 end as tinyint) as role"
    return out.selectExpr("xxhash64(component, least(home, other), greatest(home, other)) as place", role, "node", "copies", "text")


def _readable(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(textvec.id_key(docs).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).where("id is not null and text is not null and text <> ''")


def found(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(id, h, lead, links) of every row with a near duplicate: lead is the (id, h) of the row that stays, h a text's hash.

    threshold: least Jaccard similarity of the sets of k-word shingles. 42 bands of 3 registers find a pair at
    0.5 with chance 0.996, and at 0.6 with 0.99996.
    """
    read = _readable(docs)
    sketches = materialize(read.mapInArrow(_sketches(k), "id bigint, h bigint, fp1 bigint, fp2 bigint, n int, regs binary"), "sketches")
    # rows of equal words: one node; aggregated before the shuffle
    nodes = sketches.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("id", "h")).alias("lead"), F.count("*").alias("copies"), F.first("regs").alias("regs"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "regs").mapInArrow(_bands, "band bigint, node bigint")
    sums = bands.groupBy("band").agg(F.count("*").alias("z"), F.expr("bit_xor(xxhash64(node, 1))").alias("s"), F.expr("bit_xor(xxhash64(node, 2))").alias("x")).where("z > 1")
    # copies meet in many bands; each set of members is looked at once
    chosen = materialize(sums.groupBy("z", "s", "x").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("z") / MEMBERS).cast("int").alias("parts")), "bands")
    members = bands.join(_listed(chosen), "band").join(nodes.select("node", "n", "regs"), "node")
    edges = _meetings(members).repartition("place").sortWithinPartitions("place", "role", "node").mapInArrow(_proposals(threshold), "a bigint, b bigint")
    coarse = materialize(components(edges).join(nodes.select("node", "lead", "copies", "n"), "node"), "coarse")
    sizes = coarse.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    asked = materialize(coarse.join(sizes, "component").selectExpr("lead.id as id", "lead.h as h", "node", "copies", "component", "parts"), "asked")
    texts = read.join(_listed(asked), ["id", "h"])
    if not sketches.groupBy("id", "h").count().where("count > 1").isEmpty():  # of repeated rows, one
        texts = texts.groupBy("node", "copies", "component", "parts").agg(F.first("text").alias("text"))
    blocks = _blocks(texts)
    exact = materialize(blocks.repartition("place").sortWithinPartitions("place", "role", "node").mapInArrow(_verified(k, threshold), "kind byte, a bigint, b bigint"), "exact")
    links = exact.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    parts = components(exact.where("kind = 1").select("a", "b"))
    leads = parts.join(nodes.select("node", "lead"), "node").groupBy("component").agg(F.min("lead").alias("lead"))
    of = parts.join(leads, "component").select("node", F.col("lead").alias("top"))
    known = nodes.select("node", "fp1", "fp2", "n", "copies", "lead").join(of, "node", "left").join(links, "node", "left").where("copies > 1 or top is not null")
    known = materialize(known.selectExpr("fp1", "fp2", "n", "coalesce(top, lead) as lead", "coalesce(links, 0) + copies - 1 as links"), "known")
    return materialize(sketches.select("id", "h", "fp1", "fp2", "n").join(_listed(known), ["fp1", "fp2", "n"]).select("id", "h", "lead", "links"), "groups")


def groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id, links, is_kept) of every row that has a near duplicate; group_id is the group's smallest doc_id."""
    return found(docs, threshold, k).selectExpr("id as doc_id", "lead.id as group_id", "links", "id = lead.id and h = lead.h as is_kept")


def dedup(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """docs without the near duplicates: of each group, the smallest doc_id stays; see the module on odd rows."""
    own = found(docs, threshold, k)
    drop = materialize(own.where("id <> lead.id or h <> lead.h").select("id", "h").distinct(), "drop")
    again = materialize(own.where("id = lead.id and h = lead.h").groupBy("id", "h").count().where("count > 1").select("id", "h"), "again")
    marked = docs.withColumns({"__id": textvec.id_key(docs), "__h": F.xxhash64(F.col("text").cast("string"))})
    on = lambda t: (F.col("__id") == t["id"]) & (F.col("__h") == t["h"])
    left = marked.join(_listed(drop), on(drop), "left_anti")
    # a kept row that stands there several times: one of them
    repeated = left.join(_listed(again), on(again), "left_semi").dropDuplicates(["__id", "__h"])
    return left.join(_listed(again), on(again), "left_anti").unionByName(repeated).drop("__id", "__h")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with a near duplicate, its group, its number of links, and whether it is the one that stays."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
