"""Edit distances against all mappings, leader classes against visiting graphs one by one."""

import glob
import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from confora.operators import leaders
from confora.operators.edit_distance import assignment, degree_bound, edit_distance, edit_distances, searched
from confora.operators.leaders import degrees_by_label, group_of, leader_classes, refined_key


def by_all_mappings(na, ea, nb, eb):
    """Every partial one-to-one mapping of the vertices."""
    best, a, slots = 99, list(na), list(nb) + [None] * len(na)
    sa, sb = {frozenset(e) for e in ea}, {frozenset(e) for e in eb}
    for p in set(itertools.permutations(slots, len(a))):
        to = dict(zip(a, p, strict=True))
        image = {frozenset(to[x] for x in e) for e in sa if None not in [to[x] for x in e]}
        vertices = sum(1 if y is None else na[x] != nb[y] for x, y in to.items()) + len(set(nb) - set(p))
        best = min(best, vertices + len(sa) + len(sb) - 2 * len(image & sb))
    return best


def by_permutations(na, ea, nb, eb):
    sa, sb = {frozenset(e) for e in ea}, {frozenset(e) for e in eb}
    images = itertools.permutations(nb)
    return min(sum(na[x] != nb[y] for x, y in zip(na, p)) + len({frozenset(dict(zip(na, p))[x] for x in e) for e in sa} ^ sb) for p in images)


def random_graph(rng, n, share, kinds="CCN"):
    nodes = {i: rng.choice(kinds) for i in range(n)}
    return nodes, [e for e in itertools.combinations(nodes, 2) if rng.random() < share]


def test_assignment_is_least():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 6):
        for _ in range(30):
            cost = rng.integers(0, 9, (n, n)).tolist()
            total, column = assignment(cost)
            assert sorted(column) == list(range(n)) and total == sum(cost[i][c] for i, c in enumerate(column))
            assert total == min(sum(cost[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(n)))
    assert assignment([]) == (0, [])


@pytest.mark.parametrize("kinds", ["C", "CCN", "CNOP"])
def test_distance_equals_all_mappings(kinds):
    rng = random.Random(len(kinds))
    for _ in range(80):
        a, b = random_graph(rng, rng.randrange(5), 0.5, kinds), random_graph(rng, rng.randrange(5), 0.5, kinds)
        want = by_all_mappings(*a, *b)
        assert searched(*a, *b)[:2] == (want, "exact") == searched(*b, *a)[:2]
        assert degree_bound(a[1], b[1]) <= want
        assert searched(*a, *b, limit=want)[:2] == (float("inf"), "beyond") and edit_distance(*a, *b, limit=want) == float("inf")
    for n in (6, 7):
        for _ in range(8):
            a, b = random_graph(rng, n, 0.4, kinds), random_graph(rng, n, 0.4, kinds)
            assert edit_distance(*a, *b) == by_permutations(*a, *b)


def test_a_hard_pair_ends():
    """Two random graphs of 30 equal vertices: given up within the budget, and told apart from a distance beyond a limit."""
    rng = random.Random(3)
    a, b = random_graph(rng, 30, 0.5, "C"), random_graph(rng, 30, 0.5, "C")
    began = time.time()
    found = searched(*a, *b, budget=300)
    assert found == (float("inf"), "over_budget", 300) and time.time() - began < 20
    assert searched(*a, *b, limit=0.5, budget=300).status == "beyond"
    assert searched(*a, *a, budget=0).value == 0


def test_loops_and_repeated_edges():
    n = {0: "C", 1: "C"}
    assert edit_distance(n, [(0, 1), (1, 0), (0, 1)], n, [(0, 1)]) == 0
    assert edit_distance(n, [(0, 0)], n, []) == 1 and edit_distance(n, [(0, 0)], n, [(1, 1)]) == 0
    assert edit_distance({}, [], {}, []) == 0 and edit_distance({}, [], n, [(0, 1)]) == 3


def test_pairs_as_rows(spark):
    """Equal pairs are searched once, and a column may set the budget."""
    rng = random.Random(7)
    graph = lambda: random_graph(rng, 4, 0.5)
    pairs = [(graph(), graph(), 1000) for _ in range(20)]
    pairs += [(random_graph(random.Random(8), 12, 0.5, "C"), random_graph(random.Random(9), 12, 0.5, "C"), 1)]
    rows = [(i, *[x for n, e in (a, b) for x in ([{"id": k, "label": v} for k, v in n.items()], [{"u": u, "v": v} for u, v in e])], k) for i, (a, b, k) in enumerate(pairs * 3)]
    graph_type = lambda s: f"nodes_{s} array<struct<id: int, label: string>>, edges_{s} array<struct<u: int, v: int>>"
    frame = spark.createDataFrame(rows, f"k int, {graph_type('a')}, {graph_type('b')}, budget int")
    got = {r.k: (r.distance, r.status) for r in edit_distances(frame).collect()}
    want = {i: searched(*a, *b, budget=k)[:2] for i, (a, b, k) in enumerate(pairs * 3)}
    assert got == want and {s for _, s in want.values()} == {"exact", "over_budget"}
    assert edit_distances(frame.limit(0)).count() == 0


LABELS = {f"L{i}": "CCCCNNO"[i] for i in range(7)} | {f"R{i}": f"R{i // 2}" for i in range(6)}


def bipartite(rng, n, edges):
    return [sorted(rng.sample([(x, y) for x in LABELS if x[0] == "L" for y in LABELS if y[0] == "R"], edges)) for _ in range(n)]


def test_signatures_hold_for_near_graphs():
    """Graphs some edits apart differ in at most two labels an edit, and share a group's degrees; equal graphs share their key."""
    rng = random.Random(5)
    for _ in range(100):
        a = bipartite(rng, 1, 6)[0]
        to = dict(zip(LABELS, LABELS))
        for label in set(LABELS.values()):
            same = [x for x in LABELS if LABELS[x] == label]
            to |= dict(zip(same, rng.sample(same, len(same))))
        moved = [(to[u], to[v]) for u, v in a]
        assert refined_key(LABELS, a) == refined_key(LABELS, moved)
        b = list(moved)
        b[rng.randrange(6)] = rng.choice([("L0", "R5"), ("L6", "R0"), b[0]])
        most = int(edit_distance(LABELS, a, LABELS, b))
        x, y = degrees_by_label(LABELS, a), degrees_by_label(LABELS, b)
        changed = [k for k in set(x) | set(y) if x.get(k) != y.get(k)]
        assert len(changed) <= 2 * most
        assert len({group_of(k, 2 * most + 1) for k in changed}) < 2 * most + 1


def one_by_one(rows, labels, threshold):
    out, led = {}, {}
    for sid, edges in rows:
        for lead, lead_edges in led.get(len(edges), []):
            d = edit_distance(labels, lead_edges, labels, edges, threshold)
            if d < threshold:
                out[sid] = (lead, d)
                break
        else:
            led.setdefault(len(edges), []).append((sid, edges))
            out[sid] = (sid, 0.0)
    return out


def framed(spark, rows):
    return spark.createDataFrame([(i, [{"u": u, "v": v} for u, v in e], len(e)) for i, e in rows], "id int, edges array<struct<u:string,v:string>>, edge_count int")


@pytest.mark.parametrize("threshold", [0, 1, 2, 2.5, 4])
def test_leaders_equal_visiting_one_by_one(spark, monkeypatch, threshold):
    monkeypatch.setattr(leaders, "TILE", 8)  # several tiles in every bucket
    rng = random.Random(6)
    rows = list(enumerate(bipartite(rng, 70, 3) + bipartite(rng, 40, 2) + bipartite(rng, 40, 5) + [[]] * 3))
    got = {r.id: (r.leader, r.distance) for r in leader_classes(framed(spark, rows).repartition(5), "id", LABELS, [F.col("id")], threshold).collect()}
    if threshold:
        assert got == one_by_one(rows, LABELS, threshold)
    else:  # equal edges alone
        assert got == {i: (min(j for j, f in rows if f == e), 0.0) for i, e in rows}
    assert threshold < 2 or {d for _, d in got.values()} >= {0.0, 2.0} or threshold == 2


def test_given_up_pairs_are_counted(spark):
    rows = list(enumerate(bipartite(random.Random(1), 30, 6)))
    out = leader_classes(framed(spark, rows), "id", dict.fromkeys(LABELS, "C"), [F.col("id")], 4.0, budget=1).collect()
    assert len(out) == 30 and sum(r.n_over_budget for r in out) > 0


def test_ten_thousand_graphs_of_one_edge_count(spark):
    """Distance 0 over repeated labels is an equal form under all renamings of equal labels; tasks get even shares."""
    rng = random.Random(9)
    labels = {f"L{i}": "N" if i == 3 else "C" for i in range(4)} | {f"R{i}": f"R{i // 2}" for i in range(12)}
    pool = [(x, y) for x in labels if x[0] == "L" for y in labels if y[0] == "R"]
    rows = []
    seen = set()
    while len(rows) < 10_000:
        e = tuple(sorted(rng.sample(pool, 4)))
        if e not in seen:
            seen.add(e)
            rows.append((len(rows), list(e)))

    def form(edges):  # least image under renaming L0 to L2 among themselves and the two residues of each label
        best = None
        for p in itertools.permutations("012"):
            to = {f"L{i}": f"L{x}" for i, x in enumerate(p)} | {"L3": "L3"}
            pairs = {}
            for u, v in edges:
                pairs.setdefault(int(v[1:]) // 2, []).append((int(v[1:]) % 2, to[u]))
            image = sorted((k, min(sorted(x), sorted((1 - i, u) for i, u in x))) for k, x in pairs.items())
            best = image if best is None else min(best, image)
        return repr(best)

    first = {}
    for i, e in rows:
        first.setdefault(form(e), i)
    out = leader_classes(framed(spark, rows).repartition(8), "id", labels, [F.col("id")])
    assert {r.id: r.leader for r in out.collect()} == {i: first[form(e)] for i, e in rows}
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    told = spark.read.parquet(max(glob.glob(f"{shared}/equal-*"), key=os.path.getmtime))
    shares = [r["count"] for r in told.groupBy(F.input_file_name()).count().collect()]
    assert max(shares) < 3 * sum(shares) / 8 or len(shares) == 1
