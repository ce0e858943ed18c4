"""The corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from dagloom.llm import common as C, dac, decontaminate, jaccard_join, language_id, license_scan, packing, pii, quality_rules, secret_scan, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
RNG = np.random.default_rng(5)
VOCAB = ["the", "of", "ant", "bel", "cat", "dor", "end", "fig", "gal", "hut", "ink", "jam", "kin", "lot", "map"]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(VOCAB, r.integers(1, 4))) for _ in range(n))


EDGE = [None, "", "   \n\t ", "one", "two words", "é É ß ﬁ 𝒳", "x" * 20_000, "a\x0bb\x0cc", "the " * 300, "<|endoftext|> mid  double   space \n end \n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with exact and near copies, ties, nulls and a clashing column name."""
    texts = list(EDGE)
    for k in range(40):
        texts.append(prose(60 + k, k))
    base = prose(300, 99)
    words = base.split()
    for k in range(12):
        w = list(words)
        for j in range(k):
            w[10 + 25 * j] = f"new{k}x{j}"
        texts.append(" ".join(w))
    texts += [base, base.upper(), base + "\n"]
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, spans string").repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    top = {i: i for i in s}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in s:
        for j in s:
            if i < j and s[i] and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]) and s[j]:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return {i: (len(s[i]), root(i)) for i in s}


def test_jaccard_join(docs, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    words = prose(200, 7).split()
    texts = {}
    for k in range(60):
        w, r = list(words), np.random.default_rng(k)
        for j in r.choice(198, r.integers(0, 9), replace=False):
            w[j] = f"n{k}_{j}"
        texts[k] = " ".join(w)
    got = jaccard_join.jaccard_components(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts)


def test_jaccard_join_gives_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    words, texts = prose(200, 7).split(), {}
    for k in range(40):
        w, r = list(words), np.random.default_rng(k)
        for j in r.choice(198, r.integers(0, 3), replace=False):
            w[j] = f"n{k}_{j}"
        texts[k] = " ".join(w)
    texts |= {40: texts[3], 41: "", 42: prose(90, 23), 43: prose(90, 24), 44: prose(90, 24) + " end"}
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    first = {}
    for i, s in sets.items():
        first.setdefault(s or i, i)
    linked = {(first[s], first[t]) for s in first for t in first if isinstance(s, frozenset) and isinstance(t, frozenset) and first[s] < first[t] and 100 * len(s & t) >= 90 * len(s | t)}
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    pairs = [tuple(sorted((r.a, r.b))) for r in jaccard_join.jaccard_pairs(d).collect()]
    assert len(linked) > 200 and len(pairs) == len(linked) and set(pairs) == linked
    n = collections.Counter(x for p in linked for x in p)
    brute = brute_components(texts)
    for r in jaccard_join.jaccard_join(d).collect():
        own = first[sets[r.doc_id] or r.doc_id]
        assert (r.n_shingles, r.class_id, r.n_links, r.component_id) == (brute[r.doc_id][0], own, n[own], brute[r.doc_id][1])


def test_regions_divide_recursively_and_count_every_link_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 10)
    r, sets = np.random.default_rng(2), []
    for c in range(8):  # clusters, each overlapping the next one by half
        base = np.arange(100 * c, 100 * c + 200)
        for _ in range(20):
            sets.append(np.unique(np.where(r.random(200) < 0.04, r.integers(10_000, 10**9, 200), base)).astype(np.uint64))
    ids = r.permutation(len(sets))
    members = spark.createDataFrame([(1, int(i), x.tobytes()) for i, x in zip(ids, sets, strict=True)], "g long, cid long, s binary")
    told: list = []
    tasks = jaccard_join.regions(members, keep=told)
    found = [tuple(sorted(x)) for t in tasks for x in jaccard_join._verify(t, True).collect()]
    by = dict(zip(ids.tolist(), sets, strict=True))
    want = {(i, j) for i in by for j in by if i < j and 100 * len(np.intersect1d(by[i], by[j])) >= 90 * len(np.union1d(by[i], by[j]))}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    assert len(told) > 1 and told[0][1] < 3 * told[0][0]


def test_a_region_of_equally_far_sets_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 5)
    base = np.arange(200)
    sets = [np.unique(np.append(base[k % 3 :], 1000 + k)).astype(np.uint64) for k in range(31)]
    tasks = jaccard_join.regions(spark.createDataFrame([(1, k, x.tobytes()) for k, x in enumerate(sets)], "g long, cid long, s binary"))
    found = [tuple(sorted(x)) for t in tasks for x in jaccard_join._verify(t, True).collect()]
    assert len(found) == len(set(found)) == 31 * 30 // 2
    rows = [r for t in tasks for r in t.groupBy("task").count().collect()]
    through: list = []
    left = jaccard_join.regions(spark.createDataFrame([(1, k, x.tobytes()) for k, x in enumerate(sets)], "g long, cid long, s binary"), through=through)
    joined = {tuple(sorted(x)) for t in left for x in jaccard_join._verify(t, True).collect()} | {tuple(sorted(x)) for t in through for x in t.collect()}
    assert joined <= set(found) and len(joined) < 31 * 7 and {k for x in joined for k in x} == set(range(31))
    assert max(r["count"] for r in rows) <= 20  # blocks are dealt by hash, so they are about even


def test_jaccard_join_of_texts_that_share_an_id(spark):
    near, far = prose(300, 21), prose(300, 22)
    rows = [(5, near), (5, far), (5, far), (6, near + " end"), (7, far + " end"), (8, prose(90, 23))]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5)] * 3 + [(6, 5), (7, 5), (8, 8)]
    parts = [{r.part for r in got if r.doc_id == i and r.n_shingles == n} for i, n in ((5, got[0].n_shingles), (8, 88))]
    assert {r.part for r in got if r.doc_id == 8} == {None} and {r.part for r in got if r.doc_id == 6} != {r.part for r in got if r.doc_id == 7}
    assert all(r.n_links == (0 if r.doc_id == 8 else 1) for r in got) and len(parts) == 2


def test_jaccard_join_of_nulls_repeats_and_other_columns(spark, monkeypatch):
    near = prose(300, 31)
    rows = [(None, near, 1, "a"), (None, near + " end", 2, "a"), (None, near + " end", 2, "a"), (4, near + " end", 3, "b"), (None, None, 4, "c"), (7, "", 5, "c"), (7, "", 5, "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, d1 long, part string")
    for most in (C.BROADCAST_ROWS, 0):
        monkeypatch.setattr(C.join_small, "__defaults__", (most, 4))
        got = jaccard_join.jaccard_join(d).collect()
        assert sorted(((r.doc_id or 0, r.n_shingles > 0, r.class_id or 0, r.n_links, r.component_id or 0) for r in got)) == [(0, False, 0, 0, 0)] + [(0, True, 0, 1, 4)] + [(0, True, 4, 1, 4)] * 2 + [(4, True, 4, 1, 4)] + [(7, False, 7, 0, 7)] * 2


@pytest.mark.parametrize("rule", [jaccard_join.NEAR_DUPLICATE, jaccard_join.Rule(2, 70, 100)])
def test_components_by_other_rules(spark, rule):
    words, texts = prose(120, 8).split(), {}
    for k in range(40):
        w, r = list(words), np.random.default_rng(k)
        for j in r.choice(118, r.integers(0, 9), replace=False):
            w[j] = f"n{k}_{j}"
        texts[k] = " ".join(w[: 120 - k % 7])
    texts[40] = prose(70, 77)
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + rule.width]) for k in range(len(w) - rule.width + 1)}
    top = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if rule.linked(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])):
                    top[i] = top[j] = min(top[i], top[j])
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = jaccard_join.jaccard_join(d, rule)
    kinds = {frozenset(x) for x in sets.values()}
    n = {i: sum(sets[i] != x and rule.linked(len(sets[i]), len(x), len(sets[i] & x)) for x in kinds) for i in sets}
    rows = got.collect()
    assert {r.doc_id: r.component_id for r in rows} == top and {r.doc_id: r.n_links for r in rows} == n and len(set(top.values())) > 1


@pytest.mark.parametrize("rule", [jaccard_join.LINKED, jaccard_join.NEAR_DUPLICATE, jaccard_join.Rule(2, 2, 3)])
def test_every_set_is_done_with_some_cut(rule):
    rings = jaccard_join.Rings(rule)
    for n in [*range(1, 400), 5000]:
        for r in rings.of(n):
            k, equal = rings.slices(r)
            assert k == 1 or k - min(k, n) < equal
    with pytest.raises(ValueError):
        jaccard_join.Rule(3, 1, 2)


def test_every_linked_pair_meets_in_a_region():
    rings = jaccard_join.Rings()
    for n in (10, 19, 20, 57, 200, 1000):
        for _ in range(20):
            a = np.unique(RNG.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int((100 - 90) * 2 * len(a) / 190 / 2)
            b = np.unique(np.concatenate((a[drop:], RNG.integers(0, 1 << 63, drop).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if both * 100 >= (len(a) + len(b) - both) * 90 and jaccard_join.digest(a) != jaccard_join.digest(b):
                assert set(jaccard_join.signatures(a, rings)) & set(jaccard_join.signatures(b, rings))


def test_connected_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)] + [(100, k) for k in range(101, 160)]
    got = C.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 100 for k in range(100, 160)}


def test_quality_base(docs, rows, empty):
    got = {r.doc_id: r for r in quality_rules.quality(docs, []).collect()}
    for i, t in rows.items():
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert quality_rules.quality(empty, []).count() == 0


def test_rules_find_a_planted_conjunction(spark):
    x = RNG.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 1] > 0.7) & (x[:, 4] <= 0.4)
    rules = quality_rules.fit_rules(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._covers(r, x)
    assert rules and (hit == bad).mean() > 0.98
    assert quality_rules.fit_rules(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0, bool)) == []


@pytest.mark.parametrize("name", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_encoder_equals_the_library(name, rows):
    from tokenizers import Tokenizer

    special = ["lead <|endoftext|> tail", "<|endoftext|>", "a<|endoftext|>b<|startoftext|><|ENDOFTEXT|> c", " <|endoftext|>\n\n x "]
    texts = [t or "" for t in rows.values()] + ["  a  b", "a\n\n b", " lead", "trail ", "don't 's it'll", "é́ É", "a　 　b", "\x85 x"] + special
    for plain in (False, True):
        e, own = tokens.Encoder(tokens.tokenizer_path(name), plain=plain), Tokenizer.from_file(tokens.tokenizer_path(name))
        own.encode_special_tokens = plain
        ids, at = e.encode(pa.array(texts, pa.large_string()))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == own.encode(t, add_special_tokens=False).ids


def brute_ids(rows, name, end, plain=False):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.tokenizer_path(name))
    own.encode_special_tokens = plain
    return {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in rows.items()}


def test_packing(docs, rows, empty):
    want = brute_ids(rows, tokens.WORD_BPE, 2)
    seqs, seen = collections.defaultdict(dict), collections.defaultdict(int)
    for r in sorted(packing.pack(docs).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes()
        seen[r.doc_id] += r.length
        seqs[r.sequence_id][r.offset] = r.length
    assert seen == {i: len(x) for i, x in want.items()}
    padding = 0
    for s in seqs.values():
        at = 0
        for o in sorted(s):
            assert o == at
            at += s[o]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * sum(map(len, want.values()))
    assert packing.pack(empty).count() == 0


def test_cuts_fit_their_classes():
    for n in [1, 2, 127, 128, 129, 1365, 1366, 2048, 4095, 4096, 4097, 50_000]:
        parts = packing.cut(n)
        assert sum(x for x, _ in parts) == n and all(0 < x * k <= 4096 for x, k in parts)


def test_dac_round_trip_and_random_access(docs, rows, empty):
    ids = RNG.integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::3] %= 200
    from dagloom.llm.files import load

    at = f"{C.shared_dir(docs.sparkSession)}/one.dac"
    dac.save_shard(at, np.array([7, 9]), np.array([0, 3000, 5000]), ids)
    d = dac.Dac(load(at))
    assert len(d) == 5000 and [d[i] for i in range(0, 5000, 37)] == ids[::37].tolist()
    for a, b in ((0, 5000), (511, 513), (1000, 1000), (4999, 5000), (3, 700)):
        assert (d.ids(a, b) == ids[a:b]).all()
    want, start = brute_ids(rows, tokens.BYTE_BPE, 2), 0
    for r in sorted(dac.round_trip(docs).collect()):
        assert r.start == start and bytes(r.ids) == want[r.doc_id].tobytes()
        start += len(want[r.doc_id])
    assert dac.round_trip(empty).count() == 0


def test_token_counts(docs, rows, empty):
    want = brute_ids(rows, tokens.BYTE_BPE, token_counts.SEPARATOR, plain=True)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {i: len(x) for i, x in want.items()}
    assert token_counts.count_tokens(empty).count() == 0


def test_token_files_of_repeated_rows_and_null_ids(spark):
    given = [(None, "no id"), (3, "three a"), (None, None), (3, "three a"), (3, "b <|endoftext|>"), (1, ""), (-4, prose(50, 1))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in given], "doc_id long, text string, ids long, start string").repartition(3)
    ids = {k: x for k, x in zip(range(len(given)), brute_ids({k: t for k, (_, t) in enumerate(given)}, tokens.BYTE_BPE, 2).values(), strict=True)}
    got = sorted(dac.round_trip(d).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -4, 1, 3, 3, 3]
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i or 0, ids[k].tobytes()) for k, (i, _) in enumerate(given))
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) // 4 for r in got])[:-1].tolist()
    plain = brute_ids({k: t for k, (_, t) in enumerate(given)}, tokens.BYTE_BPE, token_counts.SEPARATOR, plain=True)
    counted = token_counts.count_tokens(d).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == sorted((i or 0, len(plain[k])) for k, (i, _) in enumerate(given))
    packed = brute_ids({k: t for k, (_, t) in enumerate(given)}, tokens.WORD_BPE, 2)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in packing.pack(d).where("start = 0").collect()) == sorted((i or 0, len(packed[k])) for k, (i, _) in enumerate(given))


def test_components_of_hubs_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_ROWS", 50)
    pairs = [(0, k) for k in range(1, 1500)] + [(k, 5000) for k in range(1500, 3000)] + [(2999, 1)] + [(10_000 + k, 10_001 + k) for k in range(300)]
    got = C.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = {k: 0 for k in range(3000)} | {5000: 0} | {10_000 + k: 10_000 for k in range(301)}
    assert {r.id: r.component for r in got.collect()} == want


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    pairs = [(k, k + 1) for k in range(64)] + [(100, k) for k in range(101, 140)]
    shuffles, write = [], C.write_out

    def told(df, what):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, what)

    monkeypatch.setattr(C, "write_out", told)
    for most, each in ((C.BROADCAST_ROWS, 1), (50, 4)):
        monkeypatch.setattr(C, "BROADCAST_ROWS", most)
        shuffles.clear()
        got = C.connected_components(spark.createDataFrame(pairs, "a long, b long"))
        assert {r.id: r.component for r in got.collect()} == {k: 0 for k in range(65)} | {k: 100 for k in range(100, 140)}
        assert len(shuffles) > 9 and max(shuffles) <= each


def test_components_of_no_edges_loops_and_random_graphs(spark, monkeypatch):
    assert C.connected_components(spark.createDataFrame([(7, 7), (None, 3)], "a long, b long")).collect() == []
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(-300, 300, (330, 2))] + [(5, 5), (1, None)]
    top = {}
    for a, b in (p for p in pairs * 600 if None not in p and p[0] != p[1]):
        low = min(top.get(a, a), top.get(b, b))
        if top.get(a) == low == top.get(b):
            continue
        top[a] = top[b] = low
    for most in (C.BROADCAST_ROWS, 50):
        monkeypatch.setattr(C, "BROADCAST_ROWS", most)
        rows = C.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert len(rows) == len(top) and {x.id: x.component for x in rows} == top and len(set(top.values())) > 20


def test_join_of_a_large_keyed_table(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(90)], "k long, v long")
    keyed = C.write_out(spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string"), "keyed")
    for most in (0, 10):
        assert sorted(C.join_small(rows, keyed, ["k"], "left_anti", most).collect()) == [(2, k) for k in range(90) if k % 3 == 2]
        assert C.join_small(rows, keyed, ["k"], "inner", most).count() == 60


def test_separators_are_stitched_across_blocks(spark):
    from dagloom.llm.files import save

    ids = np.array([5, 5, 9, 9, 5, 5, 5, 5, 5, 9, 5, 5], "<u2")
    at = f"{C.shared_dir(spark)}/few.bin"
    save(at, ids)
    for block in (1, 2, 3, 5, 100):
        got = token_counts.scan_flat(spark.createDataFrame([(at, 12)], "file string, ids long"), 9, block=block).collect()
        assert sorted((r.number, r.start, r.n_tokens) for r in got) == [(0, 0, 3), (1, 3, 1), (2, 4, 6), (3, 10, 2)]


def test_language_id_on_held_out_text(spark):
    r = np.random.default_rng(1)
    own = {"aa": ["ka", "lo", "mi", "tu", "ra"], "bb": ["sch", "ung", "ber", "ist", "ein"], "cc": ["eau", "tion", "ment", "oi", "que"]}
    rows = [(i, " ".join("".join(r.choice(own[k], r.integers(1, 4))) for _ in range(30)), k) for i, k in enumerate(list(own) * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(d.where("doc_id < 90"))
    got = {x.doc_id: x for x in language_id.predict(d, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows if i >= 90)
    odd = spark.createDataFrame([(0, None), (1, "123 !"), (2, "x" * 5000), (2, "schung")], "doc_id long, text string")
    out = sorted((x.doc_id, x.lang_pred, x.score) for x in language_id.predict(odd, model).collect())
    assert [o[1] for o in out[:2]] == ["und", "und"] and all(0 <= o[2] <= 1 for o in out) and len(out) == 4
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = ["_", "a", "ab", "b", "ba"]
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.25], [0.0]])
    p = dict(zip(vocabulary, table[:5, 0], strict=True))

    def brute(w):
        return 1.0 if not w else sum(p[w[:k]] * brute(w[k:]) for k in (1, 2) if w[:k] in p and k <= len(w))

    model = language_id.Model(("x",), tuple(vocabulary), table)
    for w in ("_ab", "_abba", "_baab"):
        assert model.word_scores([w], language_id.Lattice(vocabulary))[0, 0] == pytest.approx(math.log(brute(w)))


def test_long_words_are_summed_whole(monkeypatch):
    vocabulary = ["_", "a", "ab", "b", "ba", "abba", "bbaabbaab"]
    table = np.vstack((RNG.random((7, 2)) / 7, np.zeros((1, 2))))
    lattice, model = language_id.Lattice(vocabulary), language_id.Model(("x", "y"), tuple(vocabulary), table)
    words = ["_" + "".join(RNG.choice(list("abc"), n, p=[0.48, 0.48, 0.04])) for n in (3, 20, 29, 29)]
    whole = model.word_scores(words, lattice)
    monkeypatch.setattr(language_id, "STEP", 7)
    for w, want in zip(words, whole, strict=True):
        assert language_id._long_score(w, table, lattice) == pytest.approx(want)
    long = language_id._long_score("_" + "ab" * 50_000, table, lattice)
    assert np.isfinite(long).all() and (long < -10_000).all()


def test_vocabulary_keeps_every_piece_of_letters():
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(language_id.VOCABULARY))
    letters = {w for k in range(p.get_piece_size()) if (w := p.id_to_piece(k).replace("▁", "_").lower()).removeprefix("_").isalpha()}
    assert letters <= set(language_id.pieces())


def test_prediction_by_brute_force_with_ties_and_carried_columns(spark):
    vocabulary, table = ["_", "a", "b", "ab", "c"], np.array([[0.2, 0.2, 0.2], [0.2, 0.3, 0.2], [0.3, 0.2, 0.3], [0.2, 0.1, 0.2], [0.1, 0.2, 0.1], [0, 0, 0]])
    model = language_id.Model(("l1", "l2", "l3"), tuple(vocabulary), table)

    def brute(w, k):
        return 1.0 if not w else sum(table[vocabulary.index(w[:m]), k] * brute(w[m:], k) for m in (1, 2) if w[:m] in vocabulary and m <= len(w))

    given = [(1, "ab abc", 7, "x"), (1, "ab abc", 7, "x"), (None, "C c-c", 8, "y"), (2, None, 9, "z"), (3, "1 2", 9, "z"), (4, "b " * 3000, 1, "w")]
    d = spark.createDataFrame(given, "doc_id long, text string, score int, lang_pred string")
    got = language_id.predict(d, model, carry=True)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in got.collect():
        words = re.findall(r"[a-z]+", (r.text or "").lower())
        logs = [sum(math.log(brute("_" + w, k)) for w in words) for k in range(3)]
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        best = max(range(3), key=lambda k: (round(logs[k], 9), -k))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs))


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


PERSONAL = ["a@b.c_d@e.f x@y", "a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 12", "+1 (017) 555-7713 +12", "é x@y.zz 10.0.0.1+123456789.", " ".join(f"u{i}@m{i}.com" for i in range(200)), "+1((((", "1 (017) 555-7713 bob (at) site (dot) com", "𝒳𝒳 x@y.zz", "9" * 3000]


def test_pii(spark, docs, rows):
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string"))
    texts = rows | {1000 + i: t for i, t in enumerate(PERSONAL)}
    from dagloom.llm.boosting import fit

    x = RNG.random((400, 22)) * 20
    for model in (None, fit(x, x[:, 0] > 10)):
        for r in pii.find(d, model).select("doc_id", pii.told("base").alias("b"), pii.told("spans").alias("s")).collect():
            assert r.b == brute_pii(texts[r.doc_id] or "")
            assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    out = {r.doc_id: r.text for r in pii.redact(d, None).collect()}
    assert out[1000] == "[EMAIL][EMAIL] x@y" and out[0] is None and out[1] == "" and out[1005] == "é [EMAIL] [IP][PHONE]."
    assert pii.find(docs.limit(0), None).count() == 0 and pii.redact(docs.limit(0), None).columns == docs.columns


def redacted(text, spans):
    """By letters: everything that a span covers goes, a name for each run of overlapping spans."""
    out, at, i = "", 0, 0
    spans = sorted(spans)
    while i < len(spans):
        a, k, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b, i = max(b, spans[i][2]), i + 1
        out, at = out + text[at:a] + f"[{pii.KINDS[k].upper()}]", b
    return out + text[at:]


def test_redaction_covers_the_union_of_spans(spark):
    texts = ["call +1 10.0.0.1 23456 now", "+1 10.0.0.1 23456", "4111 1111 1111 1111 10.0.0.1", "a@b.c " * 100 + "é +1 (017) 555-7713", "x +1 4111 1111 1111 1111 y a@b.c", "", None, "+1 10.0.0.1 23456 é " * 50]
    d = spark.createDataFrame([(k % 5, t, t, k, "s") for k, t in enumerate(texts)], "doc_id long, text string, email string, spans long, `a.b` string")
    found = {r.i: [(s.start, s.kind, s.end) for s in r.spans] for r in pii.find(d.select(F.col("spans").alias("doc_id"), "text"), None).withColumnRenamed("doc_id", "i").collect()}
    got = pii.redact(d, None)
    assert got.columns == d.columns
    for r in got.collect():
        t = texts[r.spans]
        assert r.text == (None if t is None else redacted(t, found[r.spans])) and r.email == t and r["a.b"] == "s"
    assert got.where("spans = 0").first().text == "call [PHONE] now"


def test_trees_as_columns_equal_their_scores(spark):
    from dagloom.llm.boosting import fit

    x = RNG.random((600, 4))
    m = fit(x, (x[:, 0] > 0.5) ^ (x[:, 2] > 0.3), trees=9)
    d = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "i long, f0 double, f1 double, f2 double, f3 double")
    got = dict(d.select("i", m.column(lambda f: F.col(f"f{f}"))).collect())
    assert [got[k] for k in range(len(x))] == pytest.approx(m.score(x).tolist())


@pytest.fixture(scope="module")
def personal(spark):
    r, rows = np.random.default_rng(3), []
    for k in range(240):
        text = prose(60, 5000 + k)
        n = "".join(map(str, r.integers(0, 10, 10)))
        extra = [f"{text.split()[0]}.{k}@mail.example.com", f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", f"10.{k}.3.{k % 9}", "4111 1111 1111 1111", ""][k % 5]
        rows.append((k, f"{text} {extra} end"))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_corrupted_spans_are_found_in_other_documents(personal):
    model = pii.learn(personal.where("doc_id < 160"))
    rows = pii.measure(personal.where("doc_id >= 160"), model).collect()
    hit = {y: sum(r.found for r in rows if r.y == y) / sum(r.n for r in rows if r.y == y) for y in (0, 1)}
    assert hit[1] >= 0.95 and hit[0] <= 0.1 and {r.form.split()[0] for r in rows if r.y} == set(pii.KINDS[:4])
    assert all(r.found >= 0.8 * r.n for r in rows if r.y)
    d = personal.sparkSession.createDataFrame([(1, "reach bob (at) site (dot) com today", 1), (1, "reach bob (at) site (dot) com today", 2), (None, "on 2024-03-15 we saw 3.14159265", 3)], "doc_id long, text string, number long")
    got = sorted((r.doc_id or 0, r.s) for r in pii.find(d, model).select("doc_id", pii.told("spans").alias("s")).collect())
    assert got == [(0, ""), (1, "handle:6:29"), (1, "handle:6:29")]
    assert pii.redact(d, model).where("number = 1").first().text == "reach [HANDLE] today"


def test_candidates_of_any_length(spark):
    long = "a" * 300 + " (at) " + "b" * 300 + " (dot) c" + "d" * 80
    digits = " ".join(["12"] * 500)
    d = spark.createDataFrame([(1, f"x {long} y"), (2, f"x {digits}, y")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.candidates(pii.base_spans(d)).collect()}
    assert [(s.start, s.end) for s in got[1].handle] == [(2, 2 + len(long))] and [(s.start, s.end) for s in got[2].number] == [(2, 2 + len(digits))]


def test_personal_data_of_a_corpus_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.learn(none) is None and pii.learn(spark.createDataFrame([(None, None)], "doc_id long, text string")) is None


def test_boosting():
    from dagloom.llm.boosting import fit

    x = RNG.random((2000, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    m = fit(x, y, precision=0.9)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95 and m.threshold >= 0.5
    assert fit(x[:5], y[:5]) is None


def test_license_scan(spark, docs, rows, empty):
    lines = ["Licensed under CC BY-NC 4.0.", "All rights reserved", "x_cc by", "GNU General Public License, version 3", "Released under the MIT License.", "the MIT licence", "rights reserved all", "Copyright (c) 2019 Foo", "CC Attribution: Creative Commons Attribution-ShareAlike 4.0", MIT]
    texts = rows | {1000 + i: t for i, t in enumerate(lines)}
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    for i, t in texts.items():
        w = license_scan.WORD.findall((t or "").translate(LOW))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert got[1000].labels == "cc-by,cc-by-nc" and got[1003].labels == "gpl,gpl-3" and got[1004].labels == "mit" and got[1005].labels == ""
    assert (got[1007].labels, got[1008].labels, got[1009].labels) == ("copyright", "cc-by", "copyright,mit-text")
    assert license_scan.scan(empty).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2021-2023 Jane Q. Doe and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def labels_of(text):
    a = license_scan.Automaton(license_scan.TEMPLATES)
    return {x for x, _, _ in license_scan.scan_words(license_scan.WORD.findall(text.translate(LOW)), a)[1]}


def test_whole_license_texts():
    assert labels_of(MIT) == {"mit", "mit-text", "copyright"} - {"mit"}
    # replaceable and optional regions may differ, mandatory wording may not
    assert "mit-text" in labels_of(MIT.replace("Jane Q. Doe and others", "ACME").replace("(MIT)", "").replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"))
    for a, b in (("free of charge", "for a fee"), ("without restriction", "with care"), ("AS IS", "AS WAS"), ("sublicense, ", ""), ("DEALINGS IN", "DEALINGS NOT IN")):
        assert a in MIT and "mit-text" not in labels_of(MIT.replace(a, b))
    assert "mit-text" not in labels_of(MIT[: MIT.index("THE SOFTWARE IS")] + " You may not sell it.")


@pytest.mark.parametrize("label, markup", [x for x in license_scan.TEMPLATES])
def test_every_template_accepts_its_own_wording_only(label, markup):
    """Texts drawn from the template match; without any one mandatory word they do not (against a regex of the markup)."""
    def draw(parts, r):
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(p)
            elif p[0] == "any":
                out += ["zzz"] * int(r.integers(p[1], p[2] + 1))
            elif p[0] == "year":
                out.append(str(r.integers(1900, 2100)))
            elif p[0] == "one":
                out += draw(p[1][r.integers(len(p[1]))], r)
            elif r.random() < 0.5:
                out += draw(p[1], r)
        return out

    def pattern(parts):
        out = ""
        for p in parts:
            if isinstance(p, str):
                out += p + " "
            elif p[0] == "any":
                out += rf"(?:\S+ ){{{p[1]},{p[2]}}}"
            elif p[0] == "year":
                out += r"(?:19|20)\d\d "
            elif p[0] == "one":
                out += "(?:" + "|".join(pattern(w) for w in p[1]) + ")"
            else:
                out += f"(?:{pattern(p[1])})?"
        return out

    parts, r = license_scan.parse(markup), np.random.default_rng(len(markup))
    a, brute = license_scan.Automaton([(label, markup)]), re.compile(pattern(parts))
    key = license_scan._key_words([(label, markup)])
    for _ in range(6):
        w = draw(parts, r)
        assert any(b == 0 and e == len(w) for _, b, e in a.matches(w)) and (key is None or key & set(w))
        for k in r.choice(len(w), min(len(w), 12), replace=False):
            less = w[:k] + w[k + 1 :]
            got = {b for _, b, _ in a.matches(less)}
            assert got == {i for i in range(len(less)) if brute.match(" ".join(less[i:]) + " ")}


def test_templates_without_a_mandatory_word_and_other_columns(spark):
    d = spark.createDataFrame([(1, "red house", 3, "x"), (1, "red house", 4, "x"), (None, "blue cc", 5, "y"), (2, "a by b", 6, "z")], "doc_id long, text string, n_words long, labels string")
    got = sorted((r.doc_id or 0, r.labels) for r in license_scan.scan(d, [("c", "<red|blue> <house|cc>")]).collect())
    assert got == [(0, "c"), (1, "c"), (1, "c"), (2, "")]
    assert [r.labels for r in license_scan.scan(d, [("c", "cc {x}")]).where("doc_id is null").collect()] == ["c"]


def test_template_automaton():
    a = license_scan.Automaton([("t", "one {two} <1-2> <x|y z> end")])
    ok = lambda s: any(e == len(s.split()) for _, b, e in a.matches(s.split()) if b == 0)
    assert ok("one two q x end") and ok("one q r y z end") and ok("one q x end")
    assert not ok("one x end") and not ok("one q r s x end") and not ok("one q z end")


def test_secret_scan(spark, docs, rows, empty):
    given = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "PASSWORD: abcdef", "api_key=x", "AKIA" + "A" * 16, "AKIAA", 'x = "hunter2hunter2Z9"\nDB_PWD = x', "é secret = longvalue1"]
    texts = rows | {1000 + i: t for i, t in enumerate(given)}
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(d).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in texts.items():
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i].base == secret_scan.told(s) and (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in s) for k in range(3))
    assert got[1005].spans == "literal:5:21"
    assert secret_scan.scan(empty).count() == 0


SECRET = "Zk39fjslQ0pWm2xT"


@pytest.mark.parametrize("text, found", [
    (f'x = "{SECRET}"\ny = x\nDB_PWD = y', [SECRET]),
    ('a = "Zk39fj" + "slQ0pWm2xT"\ncredential = a', ["Zk39fj", "slQ0pWm2xT"]),
    ('p = "Zk39fj"\nq = "slQ0pWm2xT"\ndb_pwd = p + q', ["Zk39fj", "slQ0pWm2xT"]),
    (f"config.db.pwd = '{SECRET}'", [SECRET]),
    (f"BASE='{SECRET}'\nself.pwd = BASE", [SECRET]),
    (f'SETTINGS.KEY_A = "{SECRET}"\nbearer = KEY_A', [SECRET]),
    (f'config["pwd"] = "{SECRET}"', [SECRET]),
    (f'pwd = "ab\\"{SECRET}"', [f'ab\\"{SECRET}']),
    (f'pwd = """{SECRET}\nabc"""', [f"{SECRET}\nabc"]),
    (f"pwd = <<-EOF\n{SECRET}\n  EOF\nx", [f"{SECRET}\n"]),
    ('pwd = "Zk39fj" \\\n  "slQ0pWm2xT"', ["Zk39fj", "slQ0pWm2xT"]),
    (f"run --pwd={SECRET} now", [SECRET]),
    (f"export DB_PWD={SECRET}; x", [SECRET]),
    ("pwd = a\nnote: the cat sat", []),
    (f'name = "{SECRET}"\nother = name', []),
    ('x = "ab"\n' + "x = x + x\n" * 300 + "pwd = x", []),
])
def test_constants_reach_sensitive_names(text, found):
    base, added = secret_scan.find_in(text)
    assert not base and [text[a:b] for a, _, b in added] == found


def test_literals_by_brute_force():
    """Against an interpreter that keeps every name's literals as a list."""
    r = np.random.default_rng(4)
    names, terms, some = ["a", "b", "db_pwd", "auth_token", "c.key"], ['"Zk39fj"', "'slQ0pWm2xT'", "a", "b", "key", "plain99"], 0
    for _ in range(300):
        lines = [(str(r.choice(names)), [str(x) for x in r.choice(terms, r.integers(1, 4))]) for _ in range(6)]
        text = "\n".join(f"{n} = " + " + ".join(t) for n, t in lines)
        env, best, at = {}, {}, 0
        for n, t in lines:
            at, got = at + len(n) + 3, []
            for k, x in enumerate(t):
                if x[0] in "\"'":
                    got.append((at + 1, at + len(x) - 1))
                elif x in env:
                    got += env[x]
                elif k == 0:
                    got = [(at, at + len(x))]
                    at += sum(map(len, t)) + 3 * len(t) - 3
                    break
                at += len(x) + (3 if k + 1 < len(t) else 0)
            at += 1
            env[n] = env[n.split(".")[-1]] = got
            letters = collections.Counter("".join(text[i:j] for i, j in got))
            score = secret_scan.sensitivity(n) * (0.4 + 0.6 * secret_scan.randomness(letters))
            if score >= secret_scan.THRESHOLD and letters.total() >= 6:
                for span in got:
                    best[span] = max(score, best.get(span, 0))
        assert {(i, j): pytest.approx(s) for i, j, s in secret_scan.literals(text)} == best
        some += bool(best)
    assert some > 100


@pytest.mark.parametrize("text", ['a="' * 40_000, "pwd='\'\'" * 20_000, "a=b+" * 50_000, "pwd = <<A\n" * 8_000, "a.b.c-" * 60_000, 'pwd="' + "\\" * 100_001, " --a" * 50_000, 'pwd = "a"\n' + 'pwd = pwd + "b"\n' * 20_000])
def test_long_odd_texts_take_linear_time(text):
    import time

    began = time.time()
    secret_scan.find_in(text)
    assert time.time() - began < 5


def test_secret_scan_of_repeated_rows_and_other_columns(spark):
    d = spark.createDataFrame([(1, f"pwd = {SECRET}", 5, "x"), (1, f"pwd = {SECRET}", 6, "x"), (None, "AKIA" + "B" * 16, 7, "y")], "doc_id long, text string, base long, spans string")
    got = sorted((r.doc_id or 0, r.spans) for r in secret_scan.scan(d).collect())
    assert got == [(0, "access:0:20"), (1, "literal:6:22"), (1, "literal:6:22")]


@pytest.mark.parametrize("name", ["private_key", "pwd", "x" * 100 + "_credential"])
def test_long_secrets_are_found_whole(name):
    value = "Zk39fjslQ0pWm2xT" * 125
    for text, at in ((f'{name} = "{value}"', len(name) + 4), (f"{name} = {value} x", len(name) + 3), (f"{name}: '{value}' + '{value}'", len(name) + 3)):
        base, added = secret_scan.find_in(text)
        assert not base and added[0] == (at, 3, at + 2000)
        assert len(added) == text.count(value)


def test_nothing_is_found_where_the_filter_says_no(rows):
    given = ['DB_PWD2 = "hunter2hunter2Z9"', 'pwd2="Zk39fjslQ0pWm2xT"', "pwd.\t:=\t_Zk39fjslQ0pWm2xT", "pwd- => .Zk39fjslQ0pWm2xT", "'pwd9': =Zk39fjslQ0pWm2xT"]
    parts = ["pwd", "pwd2", "pwd_", "x", "9", ".", "-", '"', "'", " ", "\t", "\n", ":", "=", ">", "+", "/", "é", "hunter2hunter2Z9", "AKIA", "secret"]
    r = np.random.default_rng(8)
    texts = given + [t for t in rows.values() if t] + ["".join(r.choice(parts, 8)) for _ in range(4000)]
    for t, hit in zip(texts, pc.match_substring_regex(pa.array(texts), secret_scan._ANY).to_pylist(), strict=True):
        assert hit or secret_scan.find_in(t) == ([], []) and secret_scan.pairs(t) == []
    assert all(secret_scan.find_in(t)[1] for t in given)


def test_decontamination(spark, docs, empty):
    q = "A farmer named Bob bought 12 sheep for 30 dollars each and later sold 12 of the animals at twice that price"
    bench = spark.createDataFrame([(1, q), (2, "short one here"), (3, None), (4, "")], "item_id long, text string")
    other = q.replace("12", "17").replace("30", "45").replace("Bob", "Ann")
    mixed = q.replace("sold 12", "sold 15")
    texts = [q, "intro. " + other + " end.", mixed.replace("12", "99"), prose(80, 3), "well. short one here now", None, "", q[:40]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.find(d, bench).collect()}
    assert [got[k] for k in (0, 1, 3, 4, 5, 6, 7)] == [True, True, False, True, False, False, False]
    assert {r.doc_id for r in decontaminate.clean(d, bench).collect()} == {k for k, v in got.items() if not v}
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(d, bench.limit(0)).where("contaminated").count() == 0


def test_slots_must_be_consistent():
    item = "if x has 5 red and y has 5 blue then z has 7 more than 5 of the whole lot there"
    assert benchmark_score(item, item.replace("5", "8")) and benchmark_score(item, item)
    assert benchmark_score(item, "if x has 1 red and y has 2 blue then z has 3 more than 4 of the whole lot there") < 1


def benchmark_words(text):
    """Canonical words by their definition: (lower-case form, number, name, unit, spelled)."""
    out = []
    for raw in WORD.findall(text or ""):
        s = raw if raw.isalnum() else decontaminate._EDGE.sub("", raw)
        if any(c.isalnum() for c in s):
            low = s.lower()
            number = bool(decontaminate._NUMBER.fullmatch(low))
            out.append((low, number, not number and s[0].isupper() and s[1:].islower(), bool(not number and out and out[-1][1] and low in decontaminate.UNITS), not number and low in decontaminate.SPELLED))
    return out


def benchmark_score(item, text):
    """The share by brute force: every window of the item against every one of the text."""
    a, b = benchmark_words(item), benchmark_words(text)
    n = min(5, len(a))
    if not n:
        return 0
    most = n - min(n, 3)

    def meet(x, y):
        if sum(w[1] for w in x) > most and sum(w[1] for w in y) > most and all(v[0] == w[0] for v, w in zip(x, y)):
            return True
        slots = 0
        for v, w in zip(x, y):
            if v[1] or w[1]:
                same, slot = (v[1] or v[4]) and (w[1] or w[4]), 1
            else:
                same, slot = (True, 0) if v[0] == w[0] else ((v[2] and w[2]) or (v[3] and w[3]) or (v[4] and w[4]), 1)
            if not same:
                return False
            slots += slot
        return slots <= most

    found = [(d, p) for p in range(len(a) - n + 1) for d in range(len(b) - n + 1) if meet(a[p : p + n], b[d : d + n])]
    by_form = [sum(w[1] for w in a[p : p + n]) <= most for p in range(len(a) - n + 1)]
    name = [(f, tuple(("#" if w[1] and f else w[0]) for w in a[p : p + n])) for p, f in enumerate(by_form)]
    share = lambda of: max(len(of & s) / len(s) if s else 0 for s in ({x for x in name if x[0]}, set(name)))
    if share({name[p] for _, p in found}) < 0.8:
        return 0
    slots = [[(v[0], w[0]) for v, w in zip(a[p : p + n], b[d : d + n]) if any(v[1:])] for d, p in found]
    count = collections.defaultdict(collections.Counter)
    for x in slots:
        for v, w in x:
            count[v][w] += 1
    top = {v: max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for v, c in count.items()}
    mine = {"same": set(), "most": set()}
    for (_, p), x in zip(found, slots, strict=True):
        if all(v == w for v, w in x):
            mine["same"].add(name[p])
        if all(top[v] == w for v, w in x):
            mine["most"].add(name[p])
    got = max(share(mine["same"]), share(mine["most"]))
    return got if got >= 0.8 else 0


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = np.random.default_rng(11)
    plain, odd = ["ant", "bee", "cow", "dog", "elk", "fox", "gnu"], ["Ann", "Bob", "Zoe", "5", "12", "7.5", "two", "nine", "kg", "Days", "--"]
    say = lambda n: " ".join(r.choice(plain + odd, n, p=[0.1] * 7 + [0.3 / 11] * 11))
    items = [(k, say(int(r.integers(1, 14)))) for k in range(30)] + [(3, say(9)), (None, say(8)), (31, None), (32, "--"), (7, "one two 3 four 5")]
    texts = [say(60) for _ in range(20)] + ["lead " + t.replace("Ann", "Bob").replace("5", "6").replace("two", "4") + " end" for _, t in items if t] + [None, "", "--"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, texts[25], 1, "x"), (1, texts[30], 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_items long, t1 string").repartition(3)
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, n_items int")
    want = []
    for k, t, *_ in rows:
        by = {}
        for i, x in items:
            if s := benchmark_score(x, t):
                by[i] = max(s, by.get(i, 0))
        best = min(by.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or 0), default=(None, None))
        want.append((k, bool(by), len(by), *best))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for most in (C.BROADCAST_ROWS, 0):
        monkeypatch.setattr(C.join_small, "__defaults__", (most, 4))
        got = [tuple(x) for x in decontaminate.find(d, bench).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        kept = decontaminate.clean(d, bench)
        assert kept.columns == d.columns and sorted((x[0] or -1, x[1] or "") for x in kept.collect()) == sorted((x[0] or -1, x[1] or "") for x, w in zip(rows, want, strict=True) if not w[1])
    assert any(w[1] for w in want[:20]) or sum(w[1] for w in want) > 20


def engine_score(item, text):
    """The operator's own share of one item in one text, without Spark."""
    row = decontaminate.item_row(item)
    keys = collections.defaultdict(list)
    for h, p in set(zip(row["h"], row["place"], strict=True)):
        keys[h].append(p)
    batch = pa.record_batch([pa.array([1]), pa.array([1]), pa.array([text])], ["t1", "t2", "text"])
    got = decontaminate._survivors(batch, [row["width"]], np.full(1 << 10, -1))
    found = {(r["at"], p, tuple(r["words"])) for r in got.to_pylist() for p in keys.get(r["h"], [])} if got else set()
    s = decontaminate.share_of(row, sorted(found))
    assert (s if s >= 0.8 else 0) == pytest.approx(benchmark_score(item, text))
    return s if s >= 0.8 else 0


@pytest.mark.parametrize("item", ["What is the capital of France?", "Name the longest river in all Asia", "Which of the planets has most moons now?"])
@pytest.mark.parametrize("before", ["Question: ", "a line\n", "thin a Haen a to, ", "- ", "end. ", "12. ", ""])
def test_a_passage_is_found_whatever_precedes_it(item, before):
    assert engine_score(item, before + item + " and so on") == 1
    assert engine_score(item, before + item.lower()) == 1


def test_a_unit_that_opens_a_passage():
    item = "Days of the week are seven"
    assert engine_score(item, "Question 12: " + item) == 1


def test_names_that_open_sentences_are_slots():
    item = "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. Natalia sold how many?"
    assert engine_score(item, "Q: " + item.replace("Natalia", "Maria").replace("48", "36")) == 1
    assert engine_score(item, "Q: Maria sold tins to 3 of her aunts in June. Maria ran home") == 0


@pytest.mark.parametrize("item, other", [("What is 12 + 30?", "What is 13 + 30?"), ("Alice met Bob", "Carol met Dan"), ("12 30 45 7 8 9", "12 30 45 7 8 1"), ("Add 3 4 5 6 7 8", "Add 3 4 5 6 7 9")])
def test_items_of_few_words_besides_slots_are_found_exactly(item, other):
    assert engine_score(item, "Question: " + item) == 1 and engine_score(item, "a b " + item.lower() + " c") == 1
    assert engine_score(item, "Question: " + other) == 0


def test_spelled_numbers_are_numbers():
    item = "Tom has three apples and gives 2 of the apples to his aunt"
    assert engine_score(item, item.replace("three", "7").replace("2", "five")) == 1
    assert engine_score(item, item.replace("apples", "pears")) == 0


def test_numbers_of_an_item_with_few_forms_may_change():
    item = "1 2 3 4 5 6 are the six numbers that he wrote down"
    assert engine_score(item, item) == 1 and engine_score(item, item.replace("5 6", "8 9").replace("1 2", "3 3")) >= 0.8


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = prose(120, 50)
    rows = [(0, text, "en", "a", 0), (1, text, "en", "a", 0), (2, "12 34", "en", "a", 0), (3, prose(90, 51) + " write to bob@mail.com now", None, "b", 0), (4, "lead in. " + prose(30, 52), "de", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(30, 52))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = C.write_out(stage(spark, d, str(tmp_path)), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in d.collect()))
    assert kept == [[0, 1, 3, 4], [0, 3, 4], [0, 3], [0, 3]]
    assert "[EMAIL]" in d.where("doc_id = 3").first().text
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {0, 3}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, prose(30, 52)), (None, prose(20, 53)), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return dict(corpus_pipeline.STAGES), at


ODD = "doc_id long, text string, lang string, source string, n_chars long, _k1 long, lang_pred string, score double, t1 long, d1 string, spans string, c0 int, email map<string,int>"


def odd_rows(spark, given):
    rows = [(i, t, x, "s", len(t or ""), k, "lp", 0.5, 3, "d", "sp", 7, {"a": 1}) for k, (i, t, x) in enumerate(given)]
    return spark.createDataFrame(rows, ODD).repartition(3)


LONG = prose(9000, 60)
CASES = [(None, prose(70, 61), "en"), (5, prose(70, 62), "en"), (5, prose(70, 63), None), (3, prose(70, 62), "en"), (9, prose(70, 63) + " end", "de"), (9, prose(70, 63) + " end", "de"), (6, None, "en"), (7, "", None), (7, "", None), (8, "12 34 --", "en"), (10, LONG, "en"), (11, LONG, "en"), (12, "tail " + prose(30, 52) + " end", "fr"), (13, prose(20, 53), None), (14, "write a@b.c or +1 10.0.0.1 23456 now " + prose(60, 64), "en")]


def test_stages_keep_columns_and_empty_tables(spark, stages):
    d = odd_rows(spark, CASES)
    for name, stage in list(stages[0].items())[:-1]:
        got = stage(spark, d, stages[1])
        assert got.columns == d.columns and [t for _, t in got.dtypes] == [t for _, t in d.dtypes]
        for r in got.where("doc_id is not null and text is not null").collect():
            assert (r.lang_pred, r.score, r.t1, r.d1, r.spans, r.c0, r.email) == ("lp", 0.5, 3, "d", "sp", 7, {"a": 1}) and name
        assert stage(spark, d.limit(0), stages[1]).count() == 0
    assert stages[0]["harmonic_packing"](spark, d.limit(0), stages[1]).count() == 0


def test_language_stage(spark, stages):
    d = odd_rows(spark, CASES)
    got = sorted((r["_k1"], r.lang) for r in stages[0]["language_id"](spark, d, stages[1]).collect())
    kept = [k for k, (_, t, _) in enumerate(CASES) if re.search(r"[a-z]", t or "")]
    assert [k for k, _ in got] == kept and all(x == CASES[k][2] or CASES[k][2] is None and x in ("en", "de", "fr") for k, x in got)
    none = odd_rows(spark, [(1, "words", None)])
    assert stages[0]["language_id"](spark, none, stages[1]).count() == 0


def near_duplicates(given):
    """By brute force: the rows that stay, of rows (doc_id, text, ...) as a sorted list of their numbers' sets."""
    sets = [shingles(t) for _, t, *_ in given]
    top = list(range(len(given)))
    for _ in given:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    out = []
    for c in sorted(set(top)):
        group = [k for k in range(len(given)) if top[k] == c]
        least = min((given[k][0] is None, given[k][0] or 0) for k in group)
        out.append({k for k in group if (given[k][0] is None, given[k][0] or 0) == least})
    return out


def test_duplicate_stage_by_brute_force(spark, stages, monkeypatch):
    base = prose(80, 65).split()
    given = CASES + [(20 + k % 7, " ".join(base[:j] + [f"x{k}"] + base[j + 1 :]), "en") for k, j in enumerate(RNG.integers(0, 80, 20))] + [(20, " ".join(base), "en")] * 2
    for most in (C.BROADCAST_ROWS, 0):
        monkeypatch.setattr(C.join_small, "__defaults__", (most, 4))
        kept = sorted(r["_k1"] for r in stages[0]["ngram_jaccard_join"](spark, odd_rows(spark, given), stages[1]).collect())
        want = near_duplicates(given)
        assert len(kept) == len(want) and all(len(w & set(kept)) == 1 for w in want)
    same = spark.createDataFrame([(5, "W " * 3 + prose(70, 62), 1)] * 2 + [(5, prose(70, 63), 2), (3, "W " * 3 + prose(70, 62), 3), (9, prose(70, 63), 4), (9, prose(70, 63), 4), (None, "once more " + prose(9, 1), 5), (None, "once more " + prose(9, 1), 5)], "doc_id long, text string, n long")
    got = sorted((r.n, r.doc_id or 0) for r in stages[0]["ngram_jaccard_join"](spark, same, stages[1]).collect())
    assert got == [(2, 5), (3, 3), (5, 0)]


def test_benchmark_and_personal_stages(spark, stages):
    d = odd_rows(spark, CASES)
    got = sorted(r["_k1"] for r in stages[0]["benchmark_decontamination"](spark, d, stages[1]).collect())
    assert got == [k for k in range(len(CASES)) if k not in (12, 13)]
    text = {r["_k1"]: (r.text, r.n_chars) for r in stages[0]["pii"](spark, d, stages[1]).collect()}
    assert len(text) == len(CASES)
    for k, (_, t, _) in enumerate(CASES):
        want = None if t is None else t.replace("a@b.c", "[EMAIL]").replace("+1 10.0.0.1 23456", "[PHONE]")
        assert text[k] == (want, len(want or ""))


def test_sha_of_no_spans(docs):
    got = docs.where("doc_id = 0").select(F.sha2(F.lit(""), 256).alias("h")).first().h
    assert got == hashlib.sha256(b"").hexdigest() and zlib.crc32(b"") == 0
