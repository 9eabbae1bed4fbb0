"""Embedding near-duplicates by an exact subspace pigeonhole join: each vector's class and number of links.

Unit vectors with cosine at least c are within squared distance D = 2 - 2c. Vectors are rotated onto the principal axes of
the table, the axes are dealt to blocks of BLOCK dimensions, and D is divided among the blocks in proportion to their
variance. A pair within D is within its share in at least one block, so a range join of each block finds all pairs. In a
block, points fall into grid cells as wide as its radius, over its leading axes (GRID at most, and only those that are
spread out enough for cells to divide the pairs), and visit half of the neighbouring cells that their ball touches.
Candidates of a block are then verified on the whole vectors, where they are found: a pair counts in the first block
in whose share it is. Only pairs within rounding of the threshold go on, to be decided from the vectors as given.

No pair is written. A task keeps the links of its points by number and its graph as a spanning forest; sums and
connected components over these give the result: one row a vector, with the smallest vec_id it is linked to
directly or through others (class_id) and the number of other vectors that are near it (links). Equal vectors are
one node with a weight from the start. Crowded cells are divided into parts of about CELL_ROWS points, and points
visit half of the other parts, so no task holds more than a part. Comparisons inside one crowded ball are
quadratic, since all links count, and vectors spread alike in all directions are divided little (README).

Nulls and odd input: rows with a null vec_id give no row. A null or empty embedding, one with a null, NaN or infinite
element, and one of norm 0 are near nothing: a class of their own with no links. Vectors of different lengths are
never near; every length is compared. Rows that share vec_id and vector are one; a vec_id with several vectors has a row
for each. Ids that aren't whole numbers count by a 64-bit hash. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.graph import components
from sparkloom.llm.textvec import id_key, mix
from sparkloom.session import materialize

COSINE, BLOCK, GRID, CELL_ROWS = 0.95, 16, 2, 8192
#: Added to every squared budget, and the width on either side of the threshold in which the given vectors decide.
SLACK = 4e-6
#: Only so many of the most frequent lengths, and none over so many dimensions, are rotated; others keep their own axes.
ROTATED, WIDEST = 4, 1024
#: Vectors with more copies than this are few, so they are broadcast when copies get their results.
HOT = 100_000


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) to (id, key, d, v): a digest of the vector, its length, and the unit vector as bytes; d = 0 if it can't be near anything."""
    for b in batches:
        column = b.column("v")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is NaN here
        at = np.concatenate([[0], np.cumsum(size)])
        key, dims, unit = [], [], []
        for i in range(b.num_rows):
            x = flat[at[i] : at[i + 1]] + 0.0
            top = np.abs(x).max() if len(x) else 0.0
            if top > 0 and np.isfinite(top):
                y = x / top
                unit.append((y / math.sqrt(float(y @ y))).tobytes())
                dims.append(len(x))
            else:
                unit.append(b"")
                dims.append(0)
            key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
        yield pa.record_batch([b.column("id"), pa.array(key, pa.binary()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], names=["id", "key", "d", "v"])


def _units(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a batch of nodes: it, the rows, and their unit vectors."""
    dims = b.column("d").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, np.frombuffer(b"".join(b.column("v").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), d)


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            for _, at, x in _units(b):
                n, s, ss = n + len(at), s + x.sum(0), ss + x.T @ x
        yield pa.record_batch({"m": pa.array([np.concatenate([[n], s, ss.ravel()])], pa.list_(pa.float64()))})

    return run


class Space:
    """One length's rotation, blocks, squared budgets and grid axes."""

    def __init__(self, d: int, cosine: float, axes: np.ndarray | None = None, var: np.ndarray | None = None):
        blocks = -(-d // BLOCK)
        self.axes = axes
        self.own = [np.arange(b, d, blocks) for b in range(blocks)]
        var = np.full(d, 1 / d) if var is None else np.maximum(var, 1e-12)
        share = np.array([var[a].sum() for a in self.own])
        self.total = 2 - 2 * cosine
        self.budget = self.total * share / share.sum()
        self.radius = np.sqrt(np.maximum(self.budget, 0) + SLACK)
        # cells three wide hold so much of an axis's differences; those that hold nearly all divide nothing
        held = [[math.erf(1.5 * self.radius[k] / (2 * math.sqrt(var[j]))) for j in a[:GRID]] for k, a in enumerate(self.own)]
        self.grid = [sum(h < 0.7 for h in x) for x in held]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x if self.axes is None else x @ self.axes).astype(np.float32)


def space(nodes: DataFrame, d: int, cosine: float, rotate: bool) -> Space:
    if not rotate:
        return Space(d, cosine)
    parts = nodes.where(F.col("d") == d).mapInArrow(_moments(d), "m array<double>")
    # summed by position in the JVM: one row of d^2 numbers reaches the driver
    total = parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toArrow().sort_by("i").column("x").to_numpy()
    n, mean = total[0], total[1 : d + 1] / total[0]
    cov = total[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    var, axes = np.linalg.eigh((cov + cov.T) / 2)
    return Space(d, cosine, axes[:, ::-1], var[::-1])


def _offsets(g: int) -> np.ndarray:
    """Half of the neighbours of a grid cell in g dimensions: of each two opposite ones, one."""
    grid = np.stack(np.meshgrid(*[[-1, 0, 1]] * g, indexing="ij"), -1).reshape(-1, g) if g else np.zeros((1, 0), int)
    return grid[len(grid) // 2 + 1 :]


def _codes(d: int, block: int, cell: np.ndarray) -> np.ndarray:
    code = np.full(len(cell), np.uint64(d * 65_536 + block))
    for j in range(cell.shape[1]):
        code = mix(code * np.uint64(31) + cell[:, j].astype(np.int64).view(np.uint64))
    return mix(code).view(np.int64)


def _visits(sp: Space, d: int, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(block, rows, cells' codes, role): where points live (role 0) and which cells they visit (role 1)."""
    for k, a in enumerate(sp.own):
        r, sub = sp.radius[k], y[:, a[: sp.grid[k]]].astype(np.float64)
        cell = np.floor(sub / r)
        inside = sub - cell * r
        yield k, np.arange(len(y)), _codes(d, k, cell), 0
        for o in _offsets(sp.grid[k]):
            gap = np.where(o == 1, r - inside, np.where(o == -1, inside, 0))
            near = np.flatnonzero((gap * gap).sum(1) <= r * r + SLACK)
            if len(near):
                yield k, near, _codes(d, k, cell[near] + o), 1


def _homes(spaces: dict[int, Space]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, x in _units(b):
                for _, _, code, role in _visits(spaces[d], d, spaces[d].rotated(x)):
                    if role == 0:
                        cell, n = np.unique(code, return_counts=True)
                        yield pa.record_batch({"cell": cell, "n": n})

    return run


def _points(spaces: dict[int, Space], crowded: dict[int, int]):
    """Nodes to (cell, part, role, d, block, node, copies, v), v being the rotated vector as float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                ids, copies = b.column("node").to_numpy(), b.column("copies").to_numpy()
                for d, at, x in _units(b):
                    y = spaces[d].rotated(x)
                    packed = np.array([z.tobytes() for z in y], object)
                    for k, rows, code, role in _visits(spaces[d], d, y):
                        node = ids[at[rows]]
                        parts = np.array([crowded.get(c, 1) for c in code.tolist()])
                        home = (mix(node.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                        out = [(rows, code, home if role == 0 else np.zeros(len(rows), np.int64), np.full(len(rows), role))]
                        for step in range(1, int(parts.max())):
                            # a visitor goes to all parts; a resident to half of the others, each two parts meeting once
                            there = step < parts if role else (step <= parts // 2) & ((2 * step != parts) | (home < parts // 2))
                            i = np.flatnonzero(there)
                            out.append((rows[i], code[i], np.full(len(i), step) if role else (home[i] + step) % parts[i], np.ones(len(i), np.int64)))
                        r, c, p, kind = (np.concatenate([o[j] for o in out]) for j in range(4))
                        yield pa.record_batch(
                            [pa.array(c), pa.array(p.astype(np.int32)), pa.array(kind.astype(np.int8)), pa.array(np.full(len(r), d, np.int32)), pa.array(np.full(len(r), k, np.int32)), pa.array(ids[at[r]]), pa.array(copies[at[r]]), pa.array(packed[r], pa.binary())],
                            names=["cell", "part", "role", "d", "block", "node", "copies", "v"],
                        )

    return run


class _Part:
    """One part of a cell: its residents, what they are linked with, and the forest of their links."""

    def __init__(self, sp: Space, block: int, d: int):
        self.sp, self.block, self.d = sp, block, d
        self.node, self.copies, self.links, self.label = (np.zeros(0, np.int64) for _ in range(4))
        self.sub, self.full = np.zeros((0, len(sp.own[block])), np.float32), np.zeros((0, d), np.float32)

    def near(self, x: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, resident) of the pairs that count in this block, and those for the given vectors to decide. own: rows' place among the residents, or -1."""
        sp, k = self.sp, self.block
        sub = x[:, sp.own[k]]
        d2 = (sub * sub).sum(1)[:, None] + (self.sub * self.sub).sum(1)[None] - 2 * (sub @ self.sub.T)
        p, q = np.nonzero(d2 <= sp.budget[k] + SLACK)
        if own >= 0:
            p, q = p[q < p + own], q[q < p + own]
        sure, open_ = [], []
        for at in range(0, len(p), 1 << 15):
            i, j = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
            gap = (x[i] - self.full[j]).astype(np.float64)
            gap *= gap
            total = gap.sum(1)
            ok = (total <= sp.total + SLACK) & (gap[:, sp.own[k]].sum(1) <= sp.budget[k] + SLACK / 2)
            for earlier in range(k):  # another block has it
                ok &= gap[:, sp.own[earlier]].sum(1) > sp.budget[earlier] + SLACK / 2
            close = total > sp.total - SLACK
            sure.append(np.flatnonzero(ok & ~close) + at)
            open_.append(np.flatnonzero(ok & close) + at)
        s, o = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (sure, open_))
        return p[s], q[s], np.stack([p[o], q[o]], 1)

    def add(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray, resident: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Compares points with the residents; gives (kind, a, b): 1 edges, 2 pairs to decide, 0 links of visitors."""
        base = len(self.node)
        if resident:
            self.node, self.copies = np.concatenate([self.node, node]), np.concatenate([self.copies, copies])
            self.links, self.label = np.concatenate([self.links, np.zeros(len(node), np.int64)]), np.concatenate([self.label, np.arange(base, base + len(node))])
            self.sub, self.full = np.concatenate([self.sub, x[:, self.sp.own[self.block]]]), np.concatenate([self.full, x])
        elif not base:
            return
        p, q, open_ = self.near(x, base if resident else -1)
        if len(open_):
            yield 2, node[open_[:, 0]], self.node[open_[:, 1]]
        if not len(p):
            return
        np.add.at(self.links, q, copies[p])
        mine = np.zeros(len(node), np.int64)
        np.add.at(mine, p, self.copies[q])
        # one edge from a point to each tree of the forest that it touches
        key, first = np.unique(p * (base + len(node) + 1) + self.label[q], return_index=True)
        a, b = p[first], q[first]
        yield 1, node[a], self.node[b]
        if not resident:
            some = np.flatnonzero(mine)
            yield 0, node[some], mine[some]
            return
        self.links[base:] += mine
        up = {}

        def root(z: int) -> int:
            while z in up:
                z = up[z]
            return z

        for i, j in zip((a + base).tolist(), self.label[b].tolist(), strict=True):
            i, j = root(int(self.label[i])), root(j)
            if i != j:
                up[max(i, j)] = min(i, j)
        if up:
            table = np.arange(len(self.label))
            for z in up:
                table[z] = root(z)
            self.label = table[self.label]

    def rest(self) -> tuple[int, np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.links)
        return 0, self.node[some], self.links[some]


def _near(spaces: dict[int, Space]):
    """Sorted points of each part of a cell, residents first, to (kind, a, b) as of _Part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, None

        def table(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"kind": np.full(len(a), kind, np.int8), "a": a, "b": b})

        for b in batches:
            if not b.num_rows:
                continue
            cell, place, role, dims, block, node, copies = (b.column(c).to_numpy() for c in ("cell", "part", "role", "d", "block", "node", "copies"))
            change = (cell[1:] != cell[:-1]) | (place[1:] != place[:-1]) | (role[1:] != role[:-1]) | (dims[1:] != dims[:-1]) | (block[1:] != block[:-1])
            cut = np.concatenate([[0], np.flatnonzero(change) + 1, [len(cell)]])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                now, d = (cell[s], place[s], dims[s], block[s]), int(dims[s])
                if now != key:
                    if part:
                        yield table(*part.rest())
                    key, part = now, _Part(spaces[d], int(block[s]), d)
                for at in range(s, e, 1024):
                    to = min(e, at + 1024)
                    x = np.frombuffer(b"".join(b.column("v").slice(at, to - at).to_pylist()), np.float32).reshape(to - at, d)
                    for got in part.add(x, node[at:to], copies[at:to], role[s] == 0):
                        yield table(*got)
        if part:
            yield table(*part.rest())

    return run


def _decide(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
            ok = [float(np.frombuffer(x) @ np.frombuffer(y)) >= cosine for x, y in zip(va, vb, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, class_id, links) of every vector; see the module."""
    read = vectors.select(id_key(vectors, "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null")
    keyed = read.mapInArrow(_keys, "id bigint, key binary, d int, v binary")
    # first by id and vector, then by vector: both aggregate before they shuffle, so that copies cost one row a task
    rows = materialize(keyed.groupBy("id", "key").agg(F.first("d").alias("d"), F.first("v").alias("v")), "vectors")
    nodes = rows.where("d > 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("d").alias("d"), F.first("v").alias("v"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lengths = nodes.groupBy("d").count().orderBy(F.desc("count"), "d").collect()  # as many rows as different lengths
    spaces = {r.d: space(nodes, r.d, cosine, i < ROTATED and r.d <= WIDEST) for i, r in enumerate(lengths)}
    some = nodes.select("node", "copies", "d", "v")
    homes = some.mapInArrow(_homes(spaces), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    crowded = {r.cell: -(-r.n // CELL_ROWS) for r in homes.where(F.col("n") > CELL_ROWS).collect()}  # one row for more than CELL_ROWS points of a block
    points = some.mapInArrow(_points(spaces, crowded), "cell bigint, part int, role byte, d int, block int, node bigint, copies bigint, v binary")
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sum(crowded.values()))
    dealt = points.repartition(min(tasks, 50_000), "cell", "part").sortWithinPartitions("cell", "part", "d", "block", "role")
    found = materialize(dealt.mapInArrow(_near(spaces), "kind byte, a bigint, b bigint"), "links")
    side = lambda name, v: nodes.select(F.col("node").alias(name), F.col("v").alias(v), F.col("copies").alias(f"n{name}"))
    asked = found.where("kind = 2").select("a", "b").join(side("a", "va"), "a").join(side("b", "vb"), "b").select("a", "b", "va", "vb")
    decided = materialize(asked.mapInArrow(_decide(cosine), "a bigint, b bigint"), "decided")
    weight = nodes.select(F.col("node").alias("other"), F.col("copies").alias("links"))
    more = decided.union(decided.select("b", "a")).toDF("node", "other").join(weight, "other").select("node", "links")
    links = found.where("kind = 0").selectExpr("a as node", "b as links").unionByName(more).groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("kind = 1").select("a", "b").union(decided))
    named = parts.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))
    of = parts.join(named, "component").select("node", "class_id")
    known = nodes.select("key", "node", "id", "copies").join(of, "node", "left").join(links, "node", "left")
    known = materialize(known.select("key", "copies", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "known")
    hot = known.where(F.col("copies") > HOT).select("key", F.col("class_id").alias("c"), F.col("links").alias("l"))
    first = rows.select("id", "key", "d").join(F.broadcast(hot), "key", "left")  # at most 1 / HOT of the rows
    rest = first.where("c is null").select("id", "key").join(known.where(F.col("copies") <= HOT), "key", "left")
    lone = rest.select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return lone.unionByName(first.where("c is not null").selectExpr("id as vec_id", "c as class_id", "cast(l as bigint) as links"))


def op10_embedding_pairs(spark, sf_dir: str) -> DataFrame:
    """Every vector with its class of near duplicates and its number of links."""
    return classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(cosine: float = COSINE) -> str:
    return f"""
with recursive links as materialized (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {cosine}),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
class as (select a as vec_id, min(b) as class_id from reach group by a),
n as (select a as vec_id, count(*) as links from links group by a)
select vec_id, class_id, coalesce(links, 0)::bigint as links from class left join n using (vec_id)"""


ORACLE = oracle()
