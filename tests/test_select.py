import json
import numpy as np
import pytest

from dagloom.operators import distribution as D, evaluate as V, features as X, models as M, selection as C, splits as P
from dagloom.sources.lean_files import parse_file_list, sample_names, words_outside
from dagloom.sources.policies import Split, parse_policy
from dagloom.sources.store import Store
from dagloom.sources.theorems import KINDS, FormatError, expr_table, parse, read_theorems, transition_table, violations
from dagloom.streaming.ingest import ingest

THEOREMS = [
    """{"name":"t1","module":"m","srcSpan":[0,9],"exprs":[{"const":{"name":"f","universes":[{"succ":{"param":"u"}}]}},{"fvar":7},{"app":{"fn":0,"args":[1,1]}}],"trns":[{"tactic":{"kind":"exact","src":"exact h"},"srcSpan":[3,9],"openGoalCount":1,"state":{"target":2,"locals":[{"id":7,"type":0,"kind":"default","isInstance":false,"binderInfo":"default"}],"mvars":[],"lvlMvars":[]}}]}""",
    """{"name":"t2","module":"m","srcSpan":null,"exprs":[{"natural":184467440737095516160}],"trns":[{"tactic":{"kind":"rfl","src":"rfl"},"srcSpan":[1,1],"openGoalCount":2,"state":{"target":0,"locals":[],"mvars":[],"lvlMvars":[]}}]}""",
]
EVERY = {
    "name": "all", "module": "m", "srcSpan": [1, 2],
    "exprs": [
        {"bvar": 2}, {"fvar": 1}, {"mvar": 3}, {"sort": {"max": ["zero", {"mvar": 4}]}}, {"const": {"name": "c", "universes": [{"imax": [{"param": "u"}, "zero"]}]}},
        {"app": {"fn": 4, "args": [1, 0]}}, {"lambda": {"names": ["x", "y"], "type": 3, "body": 5, "binderInfo": "implicit"}}, {"forall": {"names": ["x"], "type": 3, "body": 6, "binderInfo": "instImplicit"}},
        {"let": {"name": "z", "type": 3, "val": 4, "body": 7, "nondep": True}}, {"natural": 0}, {"string": "é"}, {"metadata": {"data": {"k": "v"}, "expr": 10}}, {"projection": {"typeName": "S", "idx": 1, "struct": 11}},
    ],
    "trns": [{"tactic": {"kind": "k", "src": ""}, "srcSpan": [0, 5], "openGoalCount": 3, "state": {
        "target": 12,
        "locals": [{"id": 0, "type": 3, "kind": "auxiliary", "isInstance": True, "val": 9, "nondep": False}],
        "mvars": [{"id": 0, "decl": {"type": 12, "locals": [{"id": 1, "type": 4, "kind": "default", "isInstance": False, "binderInfo": "strictImplicit"}], "kind": "natural"}, "assignment": None, "delayedAssign": {"fvars": [1], "pending": 2}}, {"id": 5, "decl": None, "assignment": 11, "delayedAssign": None}],
        "lvlMvars": [{"id": 4, "decl": {"depth": 1, "idx": 2}, "assignment": {"succ": "zero"}}, {"id": 6, "decl": None, "assignment": None}],
    }}],
}


def test_cover_is_feasible_and_not_redundant(spark):
    rng = np.random.default_rng(0)
    rows = [(int(r) % 5, int(r), f"s{s}") for r in range(40) for s in rng.choice(9, 3, replace=False)]
    inc = C.incidence(spark.createDataFrame(rows, "thm long, root long, shape string"))
    cost = {f"s{k}": 1 + k for k in range(9)}
    chosen = C.greedy_cover(inc, cost, first="s8")
    of = {r: {s for _, x, s in rows if x == r} for r in range(40)}
    assert chosen[0] == "s8" and all(of[r] & set(chosen) for r in of)
    assert all(any(not of[r] & (set(chosen) - {s}) for r in of) for s in chosen if s != "s8")


def test_enrichment_keeps_the_budget():
    scores = {"a": {"x": 1.0, "y": 0.1}, "b": {"x": 0.9}, "c": {"y": 0.8}}
    got = C.enrich(scores, {"a": 1, "b": 1, "c": 1}, lambda a, b: 1.0 if {a, b} == {"a", "b"} else 0.0, [], 2)
    assert got == ["a", "c"]


def test_splits_keep_theorems_whole():
    counts = {t: {"exact": 2} if t % 3 == 0 else {"simp": 1} if t % 3 == 1 else {"exact": 1, "rw": 1} for t in range(8)}
    got = P.grouped_holdout(counts, 0.3, 1)
    assert got.feasible and not set(got.test) & set(got.train) and len(got.test) + len(got.train) == 8
    for side in (got.test, got.train):
        assert {k for t in side for k in counts[t]} == {"exact", "simp", "rw"}
    assert not P.grouped_holdout({0: {"a": 1}, 1: {"b": 1}}, 0.5).feasible
    folds = P.stratified_folds(counts | {9: {}}, 3, 0)
    assert set(folds) == set(counts) | {9} and set(folds.values()) == {0, 1, 2}


def test_layout_and_scaling(spark):
    lay = X.layout(spark.createDataFrame([(0, 2), (1, 3)], "entry long, positions long"))
    assert [r.offset for r in lay.orderBy("entry").collect()] == [0, 26]
    f = spark.createDataFrame([(0, 0, 3.0), (1, 0, 1.0), (0, 1, -4.0)], "row long, col long, val double")
    got = {(r.row, r.col): r.scaled for r in X.scale_columns(f, "maxabs", 2).collect()}
    assert got == {(0, 0): 1.0, (1, 0): pytest.approx(1 / 3), (0, 1): -1.0}
    v = np.log1p([3.0, 1.0])
    std = {(r.row, r.col): r.scaled for r in X.scale_columns(f.where("col = 0"), "log_standard", 2).collect()}
    assert std[0, 0] == pytest.approx(v[0] / v.std())


def test_distributions(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 5, 10)], "v long")
    q = D.nearest_rank(df, [], "v", [0.5, 0.9]).first()
    assert (q.p50, q.p90) == (2, 10)
    e = D.entropy(spark.createDataFrame([("k", 1), ("k", 1), ("k", 2)], "k string, w long"), ["k"], "w").first()
    assert e.singletons == 2 and e.entropy == pytest.approx(1.5)


def test_early_stopping(spark):
    rows = [("a", k, x) for k, x in enumerate([1.0, 0.9, 0.95, 0.94, 0.1])] + [("b", 0, 2.0)]
    got = {r.run: (r.best_epoch, r.stop_epoch) for r in V.early_stopping(spark.createDataFrame(rows, "run string, epoch long, loss double"), 0.01, 2).collect()}
    assert got == {"a": (1, 3), "b": (0, None)}


def _matrix(n, classes, seed):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    col = np.concatenate([[k, classes] for k in y])
    val = np.concatenate([[2.0, 1.0] for _ in y]) + rng.normal(0, 0.01, 2 * n)
    return M.Sparse(np.arange(n + 1) * 2, col, val, classes + 1, y)


def test_models_learn_separable_classes(spark):
    train, valid = _matrix(120, 4, 0), _matrix(40, 4, 1)
    for model, h in (M.fit_logistic(train, valid, 5, epochs=5, batch=32), M.fit_mlp(train, valid, 5, hidden=(16,), rate=0.02, epochs=15, batch=32, weights="balanced")):
        assert (model.probabilities(valid).argmax(1) == valid.label).all()
        assert h.losses[h.best] == min(h.losses)
    f = spark.createDataFrame([(0, 1, 2.0), (0, 4, 1.0)], "row long, col long, val double")
    p = {r.cls: r.p for r in M.score(f, model, 5, 5).collect()}
    assert max(p, key=p.get) == 1 and sum(p.values()) == pytest.approx(1)


def test_class_weights():
    w = M.class_weights(np.array([0, 0, 0, 1]), 3, "inverse_sqrt")
    assert w[2] == 0 and (w[0] * 3 + w[1]) / 4 == pytest.approx(1)


def test_theorem_source(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join([*THEOREMS, json.dumps(EVERY)]) + "\n")
    t = read_theorems(spark, str(tmp_path / "a.ndjson"))
    e = {(r.thm, r.id): r for r in expr_table(t).collect()}
    assert e["t1", 2].refs == [0, 1, 1] and e["t2", 0].refs == [] and e["t2", 0].val == "184467440737095516160"
    assert transition_table(t).count() == 3 and violations(t).count() == 0
    own = [e["all", k] for k in range(13)]
    assert [r.kind for r in own] == KINDS
    assert [r.idx for r in own[:3]] == [2, 1, 3] and own[3].level == '{"max":["zero",{"mvar":4}]}' and (own[4].name, own[4].level) == ("c", '[{"imax":[{"param":"u"},"zero"]}]')
    assert (own[6].names, own[6].binder_info, own[6].refs) == (["x", "y"], "implicit", [3, 5]) and (own[8].name, own[8].nondep, own[8].refs) == ("z", True, [3, 4, 7])
    assert (own[10].val, own[11].meta, own[11].refs) == ("é", '{"k":"v"}', [10]) and (own[12].name, own[12].idx, own[12].refs) == ("S", 1, [11])
    x = transition_table(t).where("thm = 'all'").first()
    assert (x.tactic, x.start, x.stop, x.open_goals, x.target) == ("k", 0, 5, 3, 12) and (x.locals[0].val, x.locals[0].binder_info, x.locals[0].nondep) == (9, None, False)
    assert (x.mvars[0].decl_type, x.mvars[0].decl_locals[0].binder_info, x.mvars[0].fvars, x.mvars[0].pending, x.mvars[1].assignment) == (12, "strictImplicit", [1], 2, 11)
    assert (x.lvl_mvars[0].depth, x.lvl_mvars[0].assignment, x.lvl_mvars[1].assignment) == (1, '{"succ":"zero"}', None)
    bad = [(THEOREMS[0].replace('"args":[1,1]', '"args":[1,5]'), "operand out of order"), (THEOREMS[1].replace('"target":0', '"target":1'), "target out of range"), (json.dumps(EVERY | {"name": "x"}).replace('"pending": 2', '"pending": 13'), "metavariable out of range"), (THEOREMS[0].replace('"t1"', '"t3"').replace('"type":0', '"type":9'), "local out of range")]
    (tmp_path / "b.ndjson").write_text("\n".join(x for x, _ in bad) + "\n")
    assert {r.what for r in violations(read_theorems(spark, str(tmp_path / "b.ndjson"))).collect()} == {w for _, w in bad}
    (tmp_path / "c.ndjson").write_text(THEOREMS[0] + "\n{broken\n")
    with pytest.raises(Exception):
        read_theorems(spark, str(tmp_path / "c.ndjson")).collect()


@pytest.mark.parametrize("old, new, at", [
    ('"universes":', '"junk":1,"universes":', "$.exprs[0].const: unknown fields ['junk']"),
    ('"module":"m",', "", "$: missing fields ['module']"),
    ('{"fvar":7}', '{"fvar":-1}', "$.exprs[1].fvar: expected a natural"),
    ('{"fvar":7}', '{"fvar":true}', "$.exprs[1].fvar"),
    ('{"fvar":7}', '{"gvar":7}', "$.exprs[1].gvar: no such expression"),
    ('{"fvar":7}', '{"fvar":7,"bvar":1}', "$.exprs[1]: expected an object with one field"),
    ('"args":[1,1]', '"args":[]', "$.exprs[2].app.args"),
    ('"srcSpan":[3,9]', '"srcSpan":[9,3]', "$.trns[0].srcSpan: ends before"),
    ('"openGoalCount":1', '"openGoalCount":0', "$.trns[0].openGoalCount"),
    ('"binderInfo":"default"}', '"binderInfo":"other"}', "$.trns[0].state.locals[0].binderInfo"),
    ('{"param":"u"}', '{"param":1}', "$.exprs[0].const.universes[0].succ.param"),
    ('"name":"t1"', '"name":""', "$.name"),
])
def test_records_are_checked_strictly(old, new, at):
    assert old in THEOREMS[0]
    with pytest.raises(FormatError) as e:
        parse(THEOREMS[0].replace(old, new, 1))
    assert str(e.value).startswith(at)
    for line in ("", "[]", "{"):
        with pytest.raises(FormatError):
            parse(line)


def test_streaming_ingest_reads_each_file_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    src.mkdir()
    (src / "a.ndjson").write_text(THEOREMS[0] + "\n")
    ingest(spark, str(src), str(out), str(cp))
    (src / "b.ndjson").write_text(THEOREMS[1] + "\n")
    ingest(spark, str(src), str(out), str(cp))
    assert spark.read.parquet(f"{out}/exprs").count() == 4


def test_store_publishes_and_resumes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([("x",)], "path string")
    assert not s.done("one")
    s.publish("one", {"files": df}, {"k": 1})
    assert s.done("one", {"k": 1}) and not s.done("one", {"k": 2})
    more = spark.createDataFrame([("x",), ("y",)], "path string")
    assert [r.path for r in s.remaining(more, "one", "files").collect()] == ["y"]


def test_policies_and_lists():
    p = parse_policy('{"kinds": {"a": "x", "b": "y"}, "unmapped": "other", "other_label": "z"}')
    assert p.labels == ["x", "y", "z"]
    for bad in ('{"kinds": {"a": "x", "a": "y"}}', '{"kinds": {}, "more": 1}', '{"kinds": {}, "unmapped": "other"}'):
        with pytest.raises(ValueError):
            parse_policy(bad)
    with pytest.raises(ValueError):
        Split({"train": ("a",), "test": ("a",)})
    assert Split({"train": ("a", "b")}).id == Split({"train": ("b", "a")}).id
    assert parse_file_list("# c\n\na\nb\n") == ["a", "b"]
    with pytest.raises(ValueError):
        parse_file_list("a\na\n")
    assert len(sample_names(list("abcdef"), 3, 1)) == 3
    assert words_outside('theorem x /- by /- n -/ by -/ "by" r#"by"# -- by\n lemma') == {"theorem", "x", "lemma"}


def test_shared_folder_has_a_scheme(spark, tmp_path):
    from dagloom.operators import tables

    assert tables.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert tables.qualified(spark, f"file:{tmp_path}/") == f"file://{tmp_path}"
    assert "://" in tables.shared_dir(spark)


def test_pattern_coverage_takes_geometric_ranks_over_all(spark):
    from dagloom.plans.pipelines import pattern_coverage

    n = [int(1000 / (k + 1)) + 1 for k in range(400)]
    d = spark.createDataFrame([(1, 0, f"p{k}", x) for k, x in enumerate(n)], "radius int, flavour int, digest string, n long")
    got = {r["rank"]: r.share for r in pattern_coverage(d, 20).collect()}
    assert max(got) == 400 and 1 in got and 10 <= len(got) <= 21 and got[400] == pytest.approx(1)
    for rank, share in got.items():
        assert share == pytest.approx(sum(sorted(n, reverse=True)[:rank]) / sum(n))


def test_vocabulary_covers_deep_roots_and_rare_shapes(spark):
    from dagloom.plans.pipelines import FitConfig, fit_vocabulary

    rows = []
    for t in range(4):  # a chain of 30 nodes, its leaf a shape of its own
        rows += [(f"t{t}", k, "App" if k else "Const", [k - 1] if k else []) for k in range(30)]
        rows += [(f"t{t}", 30, "App", [0, 0, 0]), (f"t{t}", 31, "App", [29, 30])]
    exprs = spark.createDataFrame(rows, "thm string, id long, kind string, refs array<long>")
    roots = spark.createDataFrame([(f"t{t}", k) for t in range(4) for k in (31, 0)], "thm string, root long")
    got = fit_vocabulary(exprs, roots, FitConfig(depths=(1, 2), min_support=2, dims=60))
    assert "[[]]" in {r.edges for r in got.collect()}


@pytest.mark.parametrize("text", ['{"kinds":{}}', '{"kinds":{"":"a"}}', '{"kinds":{"k":""}}', '{"kinds":{"k":1}}', '{"kinds":["k"]}', '{"kinds":{"k":"a"},"unmapped":"other","other_label":""}'])
def test_policies_without_kinds_or_labels_are_rejected(text):
    with pytest.raises(ValueError):
        parse_policy(text)
