from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import cover_tree, lexical_index, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, key string, parent string, length string"


def talk(*convs):
    return [(c, t, *turn, "x", "x", "x", "x") for c, turns in convs for t, turn in turns]


def plain_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    paths = {c: tuple(own.get(c - int(math.fmod(c, 5)), [])[: h[c]] + own[c][h[c]:]) if rebuild else tuple(own[c]) for c in own}
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    found = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = hashlib.sha256(",".join(str(c) for c in m if paths[c] == p).encode()).hexdigest()
        found.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(1 for q in under if not children[q]), saved, ends))
    return found


def odd_talk():
    a, b, n = ("user", "é same"), ("assistant", "b"), (None, None)
    long = [(i, ("user", f"turn {i}")) for i in range(40)]
    return talk(
        (0, [(None, a), (0, b), (1, n), (2, ("user", ""))]), (1, [(0, a), (1, b)]), (2, [(0, a), (1, b)]), (3, [(5, a), (5, a), (5, b)]), (4, [(0, n)]), (7, long), (8, long), (9, long[:39] + [(40, a)]), (-3, [(0, a)]), (-50, [(1, a), (0, b)]),
        (11, [(0, ("ab", "c"))]), (12, [(0, ("a", "bc"))]), (None, [(0, a), (None, b)]), (100, [(0, ("user", "x" * 50_000)), (1, b)]), (101, [(i, a) for i in range(12)]), (102, [(i, a) for i in range(12)]),
    )


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_is_that_of_all_prefixes(spark, rebuild):
    rows = odd_talk()
    got = prefix_trie.trie_of(spark.createDataFrame(rows, TURNS).repartition(3), rebuild)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie_of(spark.createDataFrame([], TURNS), True).count() == 0
    assert prefix_trie.trie_of(spark.createDataFrame(talk((None, [(0, ("a", "b"))])), TURNS)).count() == 0


def test_ends_of_a_large_class_are_hashed_in_order(spark):
    n = 3 * prefix_trie.IDS_IN_CHUNK + 5
    classes = spark.range(n).select((F.lit(n) - F.col("id")).alias("conv_id"), F.lit(1).cast("long").alias("rep"), F.lit(n).cast("long").alias("weight"), F.lit(1).alias("length"))
    (row,) = prefix_trie.end_digests(classes.repartition(7)).collect()
    assert row["ends"] == hashlib.sha256(",".join(map(str, range(1, n + 1))).encode()).hexdigest()


def test_rounds_follow_what_differs_not_the_longest(spark, monkeypatch):
    """Copies of a long conversation are one class, so they need no round for each turn."""
    rows = talk(*[(c, [(i, ("u", str(i))) for i in range(200)]) for c in (1, 2, 3)], (4, [(0, ("u", "0")), (1, ("u", "other"))]))
    paths = []
    real = prefix_trie.new_path
    monkeypatch.setattr(prefix_trie, "new_path", lambda s, name: paths.append(real(s, name)) or paths[-1])
    assert {tuple(r) for r in prefix_trie.trie_of(spark.createDataFrame(rows, TURNS)).collect()} == plain_trie(rows, False)
    levels = next(p for p in paths if "levels" in p)
    assert spark.read.parquet(levels).agg(F.max("depth")).first()[0] == 2


# ---- lexical search

def plain_search(docs, items, k):
    cut = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    bags = [(i, Counter(cut(t))) for i, t in docs if i is not None]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= {*cut(t)}
    found = []
    for item, terms in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scores = [(-sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 8 * (10 + 90 * sum(b.values()) * n_docs // n_terms))) for t in w if t in b), i) for i, b in bags]
        found += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(found)


def test_search_equals_all_scores(spark, odd, documents, monkeypatch):
    items = [(1, "One TWO words ☃😀"), (2, None), (3, "..."), (4, "ÀÉ five same here word"), (5, "nothinglikethis"), (1, "the"), (None, "one"), (6, "x " * 50), (7, "three spaces end the and a of")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, w int")
    monkeypatch.setattr(lexical_index, "RUN_BYTES", 2000)
    for docs in (odd, documents):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        for k in (1, 4):
            assert sorted(tuple(r) for r in lexical_index.top_documents(docs, table, k).collect()) == plain_search(rows, items, k)
    monkeypatch.setattr(lexical_index, "PAIRS_IN_BLOCK", 4)  # more than one reading of the index
    assert sorted(tuple(r) for r in lexical_index.top_documents(documents, table, 4).collect()) == plain_search(rows, items, 4)


def test_search_in_nothing(spark, empty, documents):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_index.top_documents(empty, items).count() == 0
    assert lexical_index.top_documents(documents, items.limit(0)).count() == 0


def test_bytes_bound_the_exact_scores():
    tfs, m = np.arange(1, 400).repeat(50), np.tile(10 + np.arange(50) ** 4, 399)
    exact = lexical_index._exact(tfs.astype(np.int64), m)
    high = -(-exact // lexical_index.STEP)
    assert high.max() <= 255 and (high * lexical_index.STEP >= exact).all() and ((high - 1) * lexical_index.STEP < exact).all()


# ---- nearest vectors

def plain_top(rows, k, every):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, v), v)
    found = []
    for q in best:
        if math.fmod(q, every) == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(best[q], v, strict=False)))), i) for i, v in best.items() if i != q)
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<double>, score string, cell string")


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_all_products(spark, monkeypatch, small):
    if small:  # many groups, pairs that are dropped, trees of several levels
        for name, value in (("DATA_GROUP", 16), ("QUERY_GROUP", 4), ("LEAF", 4), ("FIRST", 1)):
            monkeypatch.setattr(cover_tree, name, value)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centers[i % 6] * (1 + i % 3) + rng.normal(size=8) * 0.05).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(40)]  # one very common vector
    rows += [(1000, None), (1001, [1.0, None, 1.0]), (1002, [1.0, float("nan")]), (1003, [float("inf")] * 8), (None, [1.0] * 8), (1004, []), (1005, [2.0, 1.0]), (-100, [0.3] * 8), (50, [9.0] * 8), (7, [-9.0] * 8), (8, rows[8][1])]
    got = sorted(tuple(r) for r in cover_tree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect())
    assert got == plain_top(rows, 5, 50)


def test_top_k_of_few_and_of_huge(spark):
    rows = [(0, [1e12, 1.0]), (1, [1e12, -5.0]), (2, [-1e12, 3.0]), (3, [3e6, 7.3])]
    assert sorted(tuple(r) for r in cover_tree.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()) == plain_top(rows, 5, 50)
    for few in ([], rows[:1], rows[1:]):
        assert cover_tree.top_k(vectors(spark, few), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_node_balls_cover_their_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 4)) * 0.01 + c for c in rng.normal(size=(9, 4)) * 10])
    todo, seen = [cover_tree.Node(x, np.arange(len(x)))], 0
    while todo:
        node = todo.pop()
        seen += 1
        assert cover_tree._distances(x[node.rows], node.center).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(r for c in node.children for r in c.rows) == sorted(node.rows)
        todo += node.children
    assert seen > 9
