import random
import sys

import numpy as np
import pytest

from dagloom.operators import exact, graph as G, identity as I
from dagloom.operators.views import rewrite

#: 13 nodes: sharing, parallel operands, an unobserved node
REFS = {0: [], 1: [], 2: [], 3: [], 4: [1, 2, 3], 5: [0, 2, 4, 2], 6: [0, 2, 4, 2, 3], 7: [], 8: [], 9: [7, 8], 10: [], 11: [0, 10], 12: []}


def edges(spark, refs):
    return spark.createDataFrame([(p, k, c) for p, r in refs.items() for k, c in enumerate(r)], "parent long, pos int, child long")


def brute(refs, root):
    def walk(n):
        yield n
        for c in refs[n]:
            yield from walk(c)

    return list(walk(root))


def test_measures_match_naive_walks(spark):
    rng = random.Random(1)
    refs = {n: [rng.randrange(n) for _ in range(rng.randrange(4))] if n else [] for n in range(25)}
    roots = [20, 22, 24]
    deep = max(I.depths(refs).values())
    reach = G.closure(G.path_levels(spark.createDataFrame([(r,) for r in roots], "root long"), edges(spark, refs), deep))
    got = {r.root: r for r in G.measure_roots(reach).collect()}
    share = {r.root: r for r in G.sharing(reach, edges(spark, refs)).collect()}
    for r in roots:
        nodes = brute(refs, r)
        assert (got[r].expanded, got[r].distinct, got[r].depth) == (len(nodes), len(set(nodes)), I.depths(refs)[r])
        into = [c for n in set(nodes) for c in refs[n]]
        assert share[r].refs == len(into) and share[r].shared == sum(into.count(n) > 1 for n in set(into))


def test_measures_do_not_depend_on_partitions(spark):
    r = spark.createDataFrame([(5,), (6,)], "root long")
    a = G.measure_roots(G.closure(G.path_levels(r.repartition(1), edges(spark, REFS).repartition(1), 4)))
    b = G.measure_roots(G.closure(G.path_levels(r.repartition(8), edges(spark, REFS).repartition(8), 4)))
    assert sorted(a.collect()) == sorted(b.collect())


def test_frequency_totals_of_a_doubling_chain():
    chain = {0: [], **{n: [n - 1, n - 1] for n in range(1, 1101)}}
    sizes = I.expanded_sizes(chain)
    assert sizes[1100] == 2**1101 - 1 and I.depths(chain)[1100] == 1101
    f = I.frequencies(chain, {1100: 1})
    assert sum(x[2] for x in f.values()) == 2**1101 - 1 and sum(x[1] for x in f.values()) == 1101


def test_fragments_are_the_same_under_renumbering():
    ids = sorted(REFS)
    new = {n: k for k, n in enumerate([2, 3, 1, 0, 4, 5, 7, 8, 10, 6, 9, 11, 12])}
    other = {new[n]: [new[c] for c in r] for n, r in REFS.items()}
    for n in ids:
        for d in (1, 2, 3):
            assert I.fragments(REFS, [n], [d])[0][2:4] == I.fragments(other, [new[n]], [d])[0][2:4]


def test_a_cut_node_is_not_a_leaf():
    assert I.region({0: [], 1: [0], 2: [1]}, 2, 1)[1] == [[1], None]
    assert I.region({0: [], 1: [0]}, 1, 1)[1] == [[1], []]


def test_alpha_identity():
    nodes = {0: ("Const", "f", []), 1: ("Fvar", "7", []), 2: ("Fvar", "8", []), 3: ("App", None, [0, 1, 1]), 4: ("App", None, [0, 1, 2]), 5: ("App", None, [0, 2, 1])}
    a = {n: I.alpha_identity(nodes, n) for n in (3, 4, 5)}
    assert a[3] != a[4] and a[4] == a[5]


def test_alpha_identity_keeps_scalars(spark):
    rows = [("a", 0, "NatLiteral", None, "1", None, []), ("a", 1, "NatLiteral", None, "2", None, []), ("a", 2, "Bvar", 0, None, None, []), ("a", 3, "Bvar", 1, None, None, []), ("a", 4, "Sort", None, None, '{"mvar":3}', []), ("a", 5, "Sort", None, None, '{"succ":{"mvar":3}}', []), ("a", 6, "Fvar", 7, None, None, []), ("a", 7, "Fvar", 8, None, None, []), ("a", 8, "App", None, None, None, [0, 6, 7]), ("a", 9, "App", None, None, None, [0, 7, 7]), ("a", 10, "App", None, None, None, [4, 5])]
    other = [("b", i, k, {7: 70, 8: 80}.get(x, x), v, w and w.replace("3", "9"), r) for _, i, k, x, v, w, r in rows]
    got = I.identities(spark.createDataFrame(rows + other, "thm string, id long, kind string, idx long, val string, level string, refs array<long>")).collect()
    a, b = ({r.id: r.alpha for r in got if r.thm == t} for t in "ab")
    assert a == b and a[6] == a[7] and len(set(a.values())) == 10


def test_closures_equal_paths(spark):
    r = np.random.default_rng(1)
    pairs = [(int(p), 0, int(c)) for p in range(1, 30) for c in r.integers(0, p, r.integers(0, 4))]
    edges = spark.createDataFrame(pairs, "parent long, pos int, child long")
    roots = spark.createDataFrame([(k,) for k in (29, 28, 5, 0, 99)], "root long")
    key = lambda df: sorted((x.root, x.node, x.paths, x.depth) for x in df.collect())
    assert key(G.closures(roots, edges)) == key(G.closure(G.path_levels(roots, edges, 40)))
    inner = G.closures(edges.select(edges.child.alias("root")), edges)
    assert key(G.extend(roots, edges, inner)) == key(G.closures(roots, edges))
    with pytest.raises(ValueError):
        G.closures(roots, edges, 2)
    with pytest.raises(ValueError):
        G.path_levels(roots, edges, 2)


def test_views():
    nodes = {0: ("Const", "Coe.coe", []), 1: ("Sort", None, []), 2: ("Const", "x", []), 3: ("App", None, [0, 1, 1, 1, 2]), 4: ("Const", "HAdd.hAdd", []), 5: ("App", None, [4, 1, 1, 1, 1, 3, 2])}
    assert rewrite(nodes, "original")[0] == nodes
    hidden, _ = rewrite(nodes, "instances")
    assert hidden[3][2] == [0, 1, 1, 2] and hidden[5][2] == [4, 1, 1, 1, 3, 2]
    compact, _ = rewrite(nodes, "compact")
    assert compact[3] == ("Marker", "value-coercion", [1, 1, 2])
    erased, alias = rewrite(nodes, "erased")
    assert alias[3] == 2 and erased[5][2] == [4, 1, 1, 1, 2, 2]


def test_exact_sums(spark):
    sys.set_int_max_str_digits(0)
    big = 2**15000
    df = spark.createDataFrame([("a", str(big)), ("a", str(big)), ("a", "5"), ("b", "7"), ("b", None)], "k string, v string")
    assert {r.k: int(r.exact) for r in exact.exact_sum(df, ["k"], "v").collect()} == {"a": 2 * big + 5, "b": 7}
    assert df.select(exact.log10_exact(df.v).alias("x")).first().x == pytest.approx(15000 * 0.30102999566)


def test_reduced_sizes(spark):
    e = edges(spark, REFS)
    exp = spark.createDataFrame([(4, 4), (2, 1)], "node long, expanded long")
    got = G.reduced_sizes(spark.createDataFrame([(5,)], "root long"), e, exp, spark.createDataFrame([(4, 2), (2, 1)], "node long, cost int"), 4).first()
    assert (got.reduced_tree, got.reduced_dag, got.novel) == (1 + 1 + 1 + 2 + 1, 1 + 1 + 1 + 2, 2)
