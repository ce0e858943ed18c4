"""Queries and kernels on what the smallest tables do not hold."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dagloom.operators import graph as G, identity as I, models as M, totals as T
from dagloom.operators.views import view_rows
from dagloom.plans import catalog, oracle

DATA = os.environ.get("DAGLOOM_TEST_DATA", "/root/testdata/sf0.001")


def test_bounded_paths_leave_out_longer_ones(spark):
    edges = spark.createDataFrame([(3, 0, 2), (3, 1, 1), (2, 0, 1), (1, 0, 0)], "parent long, pos int, child long")
    roots = spark.createDataFrame([(3,)], "root long")
    got = G.path_levels(roots, edges, 2, whole=False).collect()
    assert sorted((r.node, r.depth, r.paths) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 1, 1)]
    with pytest.raises(ValueError):
        G.path_levels(roots, edges, 2)


def test_sums_of_keys_whose_products_pass_64_bits(spark, tmp_path):
    rows = {"P": [5, 7], "F": [10**16, 10**17], "O": [1 << 23], "T": [(1 << 23) - 1], "N": [None], "M": [-(1 << 23), 1 << 60, -(1 << 60)]}
    df = spark.createDataFrame([(k, x) for k, v in rows.items() for x in v], "o_orderstatus string, o_orderkey long")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["overflow_safe_sum"](spark, str(tmp_path)).select("o_orderstatus", "fast", "exact").collect()
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(oracle.SQL["overflow_safe_sum"]).fetchall())


def _random_theorems(spark):
    """Node rows with sharing, unreached nodes, literals, variables, levels and rule heads; and some alike but for numbering."""
    r = random.Random(3)
    rows = []
    for thm in range(40):
        step, n = r.choice([1, 3]), r.randrange(1, 14)
        made = []
        for k in range(n):
            refs = [r.randrange(k) * step for _ in range(r.randrange(4))] if k else []
            kind = "App" if refs else r.choice(["Const", "Fvar", "Sort", "ExprMvar"])
            name = r.choice(["Coe.coe", "Neg.neg", "Int.ofNat", "x", "y"]) if kind == "Const" else None
            level = r.choice(['{"mvar":1}', '{"mvar":2}', '{"succ":{"mvar":1}}', '"z"']) if kind == "Sort" else None
            made.append((k * step, kind, name, r.randrange(3) if kind in ("Fvar", "ExprMvar") else None, level, refs))
        rows += [(thm, *x) for x in made] + [(thm + 100, *x) for x in made]
        r.shuffle(rows)
    return spark.createDataFrame(rows, "thm long, id long, kind string, name string, idx long, level string, refs array<long>")


def test_totals_equal_rows_of_every_theorem(spark):
    exprs = _random_theorems(spark).repartition(3)
    graphs = T.gather(exprs)
    key = lambda df, like: sorted(map(tuple, df.select(*like.columns).collect()), key=str)

    def same(got, want):
        assert key(got, want) == key(want, want)

    same(T.fragment_totals(graphs, (1, 2, 9)), I.mine_fragments(exprs, (1, 2, 9)).groupBy("depth", "ident").agg(F.count("*").alias("occurrences"), F.count_distinct("thm").alias("theorems"), F.max(F.size("nodes")).alias("positions")))
    same(T.pattern_totals(graphs, (1, 3)), I.local_patterns(exprs, (1, 3)).groupBy("radius", "flavour", "digest").agg(F.count("*").alias("n")))
    each = I.identities(exprs)
    same(T.signature_totals(graphs), each.groupBy("topology", "labelled").agg(F.count("*").alias("n")))
    same(T.alpha_totals(graphs), each.groupBy("alpha").agg(F.count("*").alias("n"), F.count_distinct("thm").alias("theorems"), F.min("topology").alias("topology")))
    short = exprs.select("thm", "id", "kind", "name", F.when(F.col("kind") == "App", F.concat(F.col("refs"), F.col("refs"), F.col("refs"))).otherwise(F.col("refs")).alias("refs"))
    same(T.view_totals(T.gather(short)), view_rows(short).groupBy("view").agg(F.count("refs").alias("nodes"), F.sum(F.coalesce(F.size("refs"), F.lit(0))).alias("refs"), F.count_if(F.col("alias") != F.col("id")).alias("aliased")))


def test_theorems_that_differ_by_numbering_are_worked_out_once():
    a = T.shape([0, 1, 2, 3], {0: [], 1: [], 2: [0, 1], 3: [2]}, dict.fromkeys(range(4), "k"))
    b = T.shape([0, 5, 7, 8], {0: [], 5: [], 7: [5, 0], 8: [7]}, dict.fromkeys((0, 5, 7, 8), "k"))
    c = T.shape([0, 1, 2, 3], {0: [], 1: [], 2: [0, 0], 3: [2]}, dict.fromkeys(range(4), "k"))
    assert a[0] == b[0] != c[0] and a[1] == [3, 2, 0, 1] and b[1] == [8, 7, 5, 0]
    assert T.shape([0, 1], {0: [], 1: [0]}, {0: "k", 1: "k"})[0] != T.shape([0, 1], {0: [], 1: [0]}, {0: "j", 1: "k"})[0]


@pytest.mark.parametrize("name", ["fragments", "alpha_identities", "topology_signatures", "local_patterns", "rewritten_views"])
def test_many_theorems_make_few_rows(spark, name):
    """No theorem is a Python group of its own: one plan node reads them in batches."""
    df = catalog.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def _sparse(rows, width, density, seed=0):
    r = np.random.default_rng(seed)
    dense = r.normal(size=(rows, width)) * (r.random((rows, width)) < density)
    at = [np.flatnonzero(x) for x in dense]
    col = np.concatenate(at).astype(np.int64)
    return dense, M.Sparse(np.concatenate(([0], np.cumsum([len(a) for a in at]))), col, np.concatenate([x[a] for x, a in zip(dense, at, strict=True)]), width, np.arange(rows) % 3)


@pytest.mark.parametrize("density", [0.0, 0.02, 0.9])
def test_products_go_block_by_block(density, monkeypatch):
    dense, x = _sparse(300, 40, density)
    w, g = np.random.default_rng(1).normal(size=(40, 5)), np.random.default_rng(2).normal(size=(300, 5))
    for block in (1, 97, 1 << 20):
        monkeypatch.setattr(M, "BLOCK", block)
        assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.outer(g), dense.T @ g)
        assert np.allclose(M.max_abs(x), np.where(np.abs(dense).max(0) > 0, np.abs(dense).max(0), 1))
        model = M.Mlp([(w, np.zeros(5)), (np.eye(5), np.zeros(5))], np.ones(40))
        assert np.allclose(model.probabilities(x), M.softmax(np.maximum(dense @ w, 0)))
        one = M.Logistic(w, np.zeros(5), np.ones(40)).probabilities(x)
        sure = 1 / (1 + np.exp(-dense @ w))
        assert np.allclose(one, sure / sure.sum(1, keepdims=True))


def test_a_matrix_lies_in_files(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_ROWS", 7)
    rows = [(k, c, float(k + c)) for k in range(100) for c in range(k % 4)]
    f = spark.createDataFrame(rows, "row long, col int, val float").repartition(5)
    labels = spark.createDataFrame([(k, k % 3) for k in reversed(range(100)) if k % 5], "row long, label long")
    x = M.load_matrix(f, labels, 4)
    kept = [k for k in range(100) if k % 5]
    assert x.label.tolist() == [k % 3 for k in kept] and np.diff(x.ptr).tolist() == [k % 4 for k in kept]
    assert [*zip(x.col.tolist(), x.val.tolist(), strict=True)] == [(c, v) for k, c, v in rows if k % 5]
    assert isinstance(x.col, np.memmap) and isinstance(x.val, np.memmap)
    assert len(M.load_matrix(f, labels.limit(0), 4)) == 0
    with pytest.raises(ValueError):
        M.load_matrix(f, labels, 4, 10)


def test_an_encoder_that_grows_gives_the_library_s_ids():
    import pyarrow as pa
    from dagloom.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, tokenizer_path

    r = random.Random(5)
    words = ["".join(r.choices("abcdeäß1.,", k=r.randrange(1, 13))) for _ in range(90_000)]
    for name in (WORD_BPE, BYTE_BPE):
        e = Encoder(tokenizer_path(name))
        for lo in (0, 30_000, 0, 60_000):
            texts = [" ".join(words[k : k + 100]) for k in range(lo, lo + 30_000, 100)]
            ids, at = e.encode(pa.array(texts))
            want = e._raw(texts)
            assert ids.tolist() == [x for w in want for x in w] and np.diff(at).tolist() == [len(w) for w in want]
        assert isinstance(e.start, np.ndarray) and len(e.known) > 1 << 16


def test_plain_words_are_learnt_by_the_model_alone_and_without_their_marks():
    import pyarrow as pa
    from dagloom.llm.tokens import WORD_BPE, Encoder, tokenizer_path

    text = "Anblewh anblewh, über über. zuß### (àéÿ) anblewh!! a.b-c,über"
    e = Encoder(tokenizer_path(WORD_BPE))
    want, whole, given = e._raw([text, ""]), e._raw, []
    e._raw = lambda chunks: given.extend(chunks) or whole(chunks)
    ids, at = e.encode(pa.array([text, ""]))
    assert ids.tolist() == want[0] and at.tolist() == [0, len(want[0]), len(want[0])]
    assert sorted(given) == ["", "!!", "###", "(àéÿ", ")", ",", ".", "a.b-c,über"] and "anblewh," not in e.known


def test_a_letter_that_ends_in_a_mark_once_normalized_keeps_what_follows():
    import pyarrow as pa
    from dagloom.llm.tokens import WORD_BPE, Encoder, tokenizer_path

    e = Encoder(tokenizer_path(WORD_BPE))
    texts = ["reİ:", "aabİ, aab", "xक़.", "abיִ!", "àé: é."]
    ids, at = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == e._raw(texts)
