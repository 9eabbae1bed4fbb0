import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embedding_dedup as ed


def brute(rows, cosine):
    """{(id, vector): (class, links)} of distinct rows."""
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None}, key=lambda r: r[0])
    x = np.array([v for _, v in own], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(own))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(own))])
        if (new == label).all():
            break
        label = new
    return sorted((own[i][0], own[label[i]][0], int(near[i].sum())) for i in range(len(own)))


@pytest.mark.parametrize("cosine, cell", [(0.95, 8192), (0.35, 8192), (0.3, 40)])
def test_against_sql(spark, monkeypatch, cosine, cell):
    monkeypatch.setattr(ed, "CELL_ROWS", cell)
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.sql("select vec_id, class_id, links from (" + ed.oracle(cosine) + ")").fetchall())
    got = sorted((r.vec_id, r.class_id, r.links) for r in ed.classes(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), cosine).collect())
    assert got == want
    assert cosine == 0.95 or sum(r[2] for r in want) > 400


def planted(rng, dims, clusters=6, each=25):
    """Tight clusters with spread leading axes, chains between some of them, and noise."""
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=dims) * np.geomspace(3, 0.2, dims)
        rows += [centre + rng.normal(size=dims) * rng.choice([0.01, 0.1]) for _ in range(each)]
    rows += list(rng.normal(size=(60, dims)) * np.geomspace(3, 0.2, dims))
    a, b = rows[0], rows[each]
    rows += [a + (b - a) * t for t in np.linspace(0, 1, 12)]
    return rows


def test_planted_clusters_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELL_ROWS", 16)
    monkeypatch.setattr(ed, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(planted(rng, 12))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.class_id, r.links) for r in ed.classes(df, 0.97).collect()) == brute(rows, 0.97)


def test_odd_rows_lengths_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=11) + 3 * np.eye(11)[i % 4]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(0, rows[0][1]), (0, rows[1][1])]
    short = [(200, [1.0, 0.0]), (201, [2.0, 0.0]), (202, [0.0, 1.0])]
    odd = [(None, rows[0][1]), (900, None), (901, []), (903, [0.0] * 11), (904, [float("nan")] * 11), (905, [None] * 11), (906, [float("inf")] + [1.0] * 10)]
    df = spark.createDataFrame(rows + short + odd, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("key", F.lit("x"))
    got = sorted((r.vec_id, r.class_id, r.links) for r in ed.classes(df, 0.8).collect())
    want = brute(rows, 0.8) + [(200, 200, 1), (201, 200, 1), (202, 202, 0)] + [(i, i, 0) for i, _ in odd if i is not None]
    assert got == sorted(want)
    assert ed.classes(df.limit(0)).count() == 0


def test_first_block_rule_counts_each_pair_once():
    """Every pair of a dense set is found in exactly one block, through cells, parts and neighbours."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 32)), 5, 0) * np.geomspace(2, 0.05, 32) + rng.normal(size=(300, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    sp = ed.Space(32, 0.97, np.eye(32), x.var(0))
    assert sum(sp.grid) > 0
    y, seen = sp.rotated(x), np.zeros((300, 300), int)
    by = {}
    for k, rows, code, role in ed._visits(sp, 32, y):
        for r, c in zip(rows, code):
            by.setdefault((k, c), ([], []))[role].append(r)
    for (k, _), (home, visit) in by.items():
        part = ed._Part(sp, k, 32)
        for group, resident in ((home, True), (visit, False)):
            for at in range(0, len(group), 64):
                i = np.array(group[at : at + 64])
                base = len(part.node)
                if resident:
                    part.node = np.concatenate([part.node, i])
                    part.sub, part.full = np.concatenate([part.sub, y[i][:, sp.own[k]]]), np.concatenate([part.full, y[i]])
                if base or resident:
                    p, q, o = part.near(y[i], base if resident else -1)
                    np.add.at(seen, (i[p], part.node[q]), 1)
                    np.add.at(seen, (i[o[:, 0]], part.node[o[:, 1]]), 1)
    want = x @ x.T >= 0.97
    np.fill_diagonal(want, False)
    assert ((seen + seen.T) == want).all() and want.sum() > 100
