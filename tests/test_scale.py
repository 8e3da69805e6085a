"""Operators that must not gather a group: against plain answers, with the plan or the work asserted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from confora.operators import proximity, quantiles, scores, screening


# quantiles
VALUES = {
    "many": lambda rng: [rng.gauss(0, 1) for _ in range(300)],
    "ties": lambda rng: [float(rng.randrange(3)) for _ in range(400)],
    "two": lambda rng: [1.0, 2.0],
    "one": lambda rng: [7.5],
    "same": lambda rng: [4.0] * 300,
    "wide": lambda rng: [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-8, 9) for _ in range(100)],
    "outlier": lambda rng: [rng.random() * 1e-6 for _ in range(300)] + [1.7e308, -1.7e308],
    "nan": lambda rng: [1.0, float("nan"), float("inf"), 2.0, -3.0, 0.0],
}


def test_refined_quantiles_equal_the_built_in(spark):
    rng = random.Random(1)
    rows = [(k, v) for k, f in VALUES.items() for v in f(rng)] + [("many", None), (None, 3.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4).cache()
    wanted = {"median": 0.5, "p10": 0.1, "least": 0.0, "most": 1.0, "third": 1 / 3}
    built_in = {r.k: tuple(r)[1:] for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(f)).alias(n) for n, f in wanted.items()]).collect()}
    for hot in (0, 120):
        got = {r.k: tuple(r)[1:] for r in quantiles.quantiles(df, ["k"], "v", wanted, hot).collect()}
        assert got.keys() == built_in.keys()
        for k in got:
            np.testing.assert_array_equal(got[k], built_in[k], err_msg=f"{k} {hot}")
    assert quantiles.quantiles(df.limit(0), ["k"], "v", wanted, 0).collect() == []


def test_summaries_are_the_same_with_hot_groups(spark):
    rng = random.Random(2)
    rows = [(i % 5 if i % 5 < 4 else None, rng.choice("AB") if i % 5 != 2 else "B", rng.choice([None, *map(float, range(9))])) for i in range(600)]
    df = spark.createDataFrame(rows, "s int, kind string, v double")
    for preferred in (None, F.col("kind") == "A"):
        plain = scores.score_summary(df, ["s"], "v", preferred).collect()
        refined = scores.score_summary(df, ["s"], "v", preferred, hot=10)
        assert refined.columns == ["s", "mean", "median", "p10", "min", "max", "n_values"]
        assert sorted(map(str, plain)) == sorted(map(str, refined.collect()))
    contacts = spark.createDataFrame([(i, i % 7, rng.random()) for i in range(500)] + [(1, 9, None)], "s int, r int, d double")
    structures = contacts.select("s")
    tell = lambda hot: sorted(map(str, screening.residue_frequency(contacts, structures, "s", "r", F.col("d") < 0.3, "d", hot).collect()))
    assert tell(3) == tell(None) and len(tell(None)) == 8


# nearest neighbours
def cloud(rng, n, size, spread=1.0):
    return rng.uniform(0, size, (n, 3)) * spread


def test_nearest_equals_all_pairs(spark):
    """Far, near and coinciding points, ties, structures without a partner, nulls and units of several points."""
    rng = np.random.default_rng(3)
    left = [(s, int(u), *map(float, p)) for s in (1, 2, 3) for u, p in zip(rng.integers(0, 25, 60), cloud(rng, 60, 50 if s == 1 else 400))]
    left += [(4, 1, 0.0, 0.0, 0.0), (1, 99, 5000.0, -5000.0, 0.0), (2, 98, None, 1.0, 1.0), (2, 97, float("nan"), 1.0, 1.0), (None, 5, 0.0, 0.0, 0.0)]
    right = [(s, int(i), *map(float, p)) for s in (1, 2, 3) for i, p in enumerate(cloud(rng, 12, 60))]
    right += [(1, 50, *left[0][2:]), (1, 40, *left[0][2:]), (5, 1, 0.0, 0.0, 0.0), (3, 77, None, 0.0, 0.0)]
    kind = "s int, {} int, x double, y double, z double"
    got = proximity.nearest_in_rings(spark.createDataFrame(left, kind.format("u")), spark.createDataFrame(right, kind.format("i")), ["s"], ["u"], "i", 1.5)
    want = {}
    ok = lambda p: all(c is not None and c == c for c in p)
    for s, u, *p in left:
        for s2, i, *q in right:
            if s == s2 and s is not None and ok(p) and ok(q):
                found = (((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2), i)
                want[s, u] = min(want.get((s, u), (float("inf"), 0)), found)
    assert {(r.s, r.u): (round(r.min_distance, 9), r.nearest_id) for r in got.collect()} == {k: (round(d**0.5, 9), i) for k, (d, i) in want.items()}
    assert proximity.nearest_in_rings(spark.createDataFrame([], kind.format("u")), spark.createDataFrame(right, kind.format("i")), ["s"], ["u"], "i").collect() == []


def test_nearest_compares_fewer_pairs(spark):
    """A structure of 20,000 atoms with 4,000 ligand atoms in one corner: a small share of the 80 million pairs."""
    rng = np.random.default_rng(4)
    points = lambda n, size, name: spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(cloud(rng, n, size))], f"s int, {name} int, x double, y double, z double")
    left, right, compared = points(20_000, 60, "u"), points(4_000, 30, "i"), []
    got = proximity.nearest_in_rings(left, right, ["s"], ["u"], "i", compared=compared)
    p, q = (np.array([r[2:] for r in d.collect()]) for d in (left, right))
    least = np.array([((q - x) ** 2).sum(1).min() ** 0.5 for x in p])
    assert {r.u: round(r.min_distance, 6) for r in got.collect()} == {i: round(float(d), 6) for i, d in enumerate(least)}
    assert len(compared) > 2 and sum(compared) < 20_000 * 4_000 / 4


# global order
def test_numbers_without_one_task(spark, tmp_path):
    """Ties in the first columns, nulls, descending order, more ranges than rows, and an empty table; no plan gathers all rows."""
    from confora.operators.ordering import globally_numbered
    from confora.plans import catalog, workflow
    from confora.sources import tables

    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    for order, key in (([F.col("a").asc_nulls_first(), "b"], lambda r: (r[0] is not None, r[0] or 0, r[1])), ([F.desc_nulls_last("a"), F.desc("b")], lambda r: (r[0] is None, -(r[0] or 0), -r[1]))):
        for n in (5, 16):
            got = globally_numbered(df, *order, partitions=n).collect()
            assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=key) and {r.position for r in got} == set(range(1, 1001))
    assert globally_numbered(df.limit(0), "a").collect() == []
    assert [r.position for r in globally_numbered(df.limit(2), "b", first=0).orderBy("b").collect()] == [0, 1]
    for i in (10, 2, 1):
        (tmp_path / f"m_{i}.pdb").write_text("END\n")
    files = tables.files(spark, str(tmp_path))
    assert [r.file for r in files.orderBy("input_order").collect()] == ["m_1.pdb", "m_2.pdb", "m_10.pdb"]
    ranked = workflow.ranked_models(spark.createDataFrame([("x_rank_10",), ("x_rank_2",), ("y",)], "structure_id string"))
    for plan in (files, ranked, catalog.QUERIES["q41_sort_nulls_last"](spark, "/root/testdata/sf0.001")):
        assert "SinglePartition" not in plan._jdf.queryExecution().toString()


# components
def test_a_star_is_spread_evenly(spark, monkeypatch):
    """A hub with 20,000 leaves, greatest or least of all: its edges stay spread over the tasks that hold them."""
    from confora.operators import graphs

    monkeypatch.setattr(graphs, "HUB", 2_000)
    n = 20_000
    for hub in (n + 1, -1):
        star = spark.range(0, n, 1, 8).select(F.col("id").alias("u"), F.lit(hub).cast("long").alias("v"))
        chain = spark.createDataFrame([(10**9 + i, 10**9 + i + 1) for i in range(50)], "u long, v long")
        found = graphs.components(star.unionByName(chain))
        assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {(min(hub, 0), n + 1), (10**9, 51)}
    rows = star.select(F.col("v").alias("x"), F.col("u").alias("y"))
    values, hubs = rows.groupBy("x").agg(F.min("y").alias("m")), spark.createDataFrame([(-1,)], "x long")
    sizes = [r["count"] for r in graphs.with_values(rows, values, "x", hubs).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= n / 8


# placement
def test_obstacles_by_voxel_equal_all_pairs():
    from confora.operators.placement import Obstacles, collisions

    rng = np.random.default_rng(5)
    for n, m, size, threshold in ((500, 30, 12, 2.0), (0, 4, 5, 1.0), (60, 1, 3, 4.0), (3000, 60, 40, 2.5)):
        there, ligand = rng.uniform(-size, size, (n, 3)), rng.uniform(-size * 1.5, size * 1.5, (m, 3))
        d = np.sqrt(((ligand[None] - there[:, None]) ** 2).sum(axis=2))
        near = d < threshold
        push = ((ligand[None] - there[:, None]) / np.maximum(d, 1e-12)[..., None] * np.where(near, threshold - d, 0)[..., None]).sum(axis=(0, 1))
        count, depth, away = collisions(Obstacles(there, threshold), ligand, threshold)
        assert count == near.sum() and depth == pytest.approx(np.where(near, threshold - d, 0).sum())
        np.testing.assert_allclose(away, push / np.linalg.norm(push) if count else np.zeros(3), atol=1e-9)
        assert len(Obstacles(there, threshold).near(ligand)[0]) <= n * m
    assert len(Obstacles(there, threshold).near(ligand)[0]) < n * m / 50  # a trial costs the neighbourhood


# alignment
def by_full_matrix(a, b, mode, match, mismatch, gap):
    """The whole matrix, entry by entry, and the way back through it."""
    local = mode == "local"
    s = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                s[i][j] = max(s[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), s[i - 1][j] + gap, s[i][j - 1] + gap, *([0] if local else []))
            elif not local:
                s[i][j] = gap * (i + j)
    i, j = len(a), len(b)
    if local:
        best = max(max(r) for r in s)
        i, j = next((i, j) for i, r in enumerate(s) for j, x in enumerate(r) if x == best)
    score, pairs = s[i][j], []
    while i and j and not (local and s[i][j] == 0):
        if s[i][j] == s[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif s[i][j] == s[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return float(score), pairs[::-1]


def test_alignment_equals_the_full_matrix():
    from confora.operators.seqalign import SCORES, align

    rng = random.Random(8)
    for _ in range(250):
        a, b = ("".join(rng.choice("AB" if rng.random() < 0.5 else "ACDE") for _ in range(rng.randrange(40))) for _ in range(2))
        for mode, scores in SCORES.items():
            assert align(a, b, mode, *scores) == by_full_matrix(a, b, mode, *scores)


def test_long_alignment_in_little_memory():
    """20,000 letters a side: the whole matrix would be 1.6 GB even in 32 bits."""
    import tracemalloc

    from confora.operators.seqalign import SCORES, align

    rng = random.Random(9)
    a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    b = a[:5_000] + a[5_010:12_000] + "WWWWW" + a[12_000:]
    tracemalloc.start()
    score, pairs = align(a, b, "global", *SCORES["global"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score >= 2 * 19_990 - 2 * 15 and len(pairs) >= 19_985 and peak < 120e6


# bonds
def test_bonds_by_element(spark):
    """Disulfide, carbon-iodine and phosphorus-oxygen bonds; a hydrogen near an oxygen, a crowded carbon, a metal and a blank element."""
    from confora.operators.interactions import ligand_bonds

    def atoms(*rows, residue=1):
        return [("s", i, name, "LIG", "A", residue, element, x, y, 0.0) for i, name, element, x, y in rows]

    rows = atoms((1, "S1", "S", 0, 0), (2, "S2", "S", 2.05, 0), (3, "C1", "C", 0, 1.8), (4, "I1", "I", 0, 3.94))
    rows += atoms((10, "P1", "P", 0, 0), (11, "O1", "O", 1.6, 0), (12, "MG", "MG", 1.6, 2.0), residue=2)
    rows += atoms((20, "C1", "C", 0, 0), (21, "H1", "H", 1.09, 0), (22, "O1", "O", 2.45, 0), residue=3)  # 1.36 from the hydrogen, within the radii and the slack
    rows += atoms((30, "C1", "", 0, 0), *((31 + k, f"C{k}", "", 1.5 * np.cos(k * 1.2) + 0.01 * k, 1.5 * np.sin(k * 1.2)) for k in range(5)), residue=4)
    rows = [tuple(float(v) if i > 6 else v for i, v in enumerate(r)) for r in rows]
    frame = spark.createDataFrame(rows, "structure_id string, serial int, atom_name string, resname string, chain string, resseq int, element string, x double, y double, z double")
    got = {(r.u, r.v) for r in ligand_bonds(frame, spark.createDataFrame([], "structure_id string, u int, v int")).collect()}
    assert {p for p in got if p[0] < 30} == {(1, 2), (1, 3), (3, 4), (10, 11), (20, 21)}
    assert sum(30 in p for p in got) == 4  # carbon keeps its four nearest of five
