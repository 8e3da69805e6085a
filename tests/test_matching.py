"""Template matching."""

from test_workflow import a, frame

from confora.operators import matching as M


def test_matching(spark):
    names = ["ALA", "CYS", "ASP", "GLU", "GLY"]
    template = M.residues(frame(spark, [a("t", i, "CA", n, i, float(i)) for i, n in enumerate(names, 1)]))
    rows = [a("s", i, "CA", n, i + 100, float(i) + 5) for i, n in enumerate(names[1:], 1)]
    target = M.residues(frame(spark, rows + [a("s", 9, "CB", "GLY", 104, 0.0)]))
    pairs = M.by_sequence(template, target)
    assert {(r.mx, r.fx) for r in pairs.collect()} == {(2.0, 6.0), (3.0, 7.0), (4.0, 8.0), (5.0, 9.0)}
    assert pairs.first().identity == 1.0
    assert {(r.mx, r.fx) for r in M.by_order(template, target).collect()} == {(1.0, 6.0), (2.0, 7.0), (3.0, 8.0), (4.0, 9.0)}
    assert M.by_key(template, target).count() == 0
    assert not M.compatible(template, target).first().compatible and M.compatible(template, template).first().compatible


def test_chain_pairing():
    out = M.chain_pairs({"A": "ACDEFG", "B": "WWYYVV"}, {"X": "WWYYVV", "Y": "ACDEFG"})
    assert [(x[0], x[1], x[2]) for x in out] == [("A", "Y", 1.0), ("B", "X", 1.0)]
