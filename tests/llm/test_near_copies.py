"""The pipeline's near-copy stage against all pairs by brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F

from docframe.llm import near_copies

MIDDLE = "/root/testdata/sf0.01"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def survivors(rows):
    """doc_ids that stay: the smallest of each component of pairs of similarity 0.8 or more."""
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t), []).append(d)
    nodes = list(sets)
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i, x in enumerate(nodes):
        for j in range(i):
            y = nodes[j]
            both = len(x & y) if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) else 0
            if both and 5 * both >= 4 * (len(x) + len(y) - both):
                parent[root(i)] = root(j)
                pairs += 1
    least = {}
    for i, x in enumerate(nodes):
        for d in sets[x]:
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values()), pairs


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    want, pairs = survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    kept = corpus_pipeline.drop_near_copies(spark, docs, MIDDLE)
    assert pairs > 0 and kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_planted_chain_and_odd_rows(spark, odd, empty):
    base = [f"w{i}" for i in range(200)]
    planted = [(500 + k, " ".join([*base[: 200 - 5 * k], *(f"x{k}y{i}" for i in range(5 * k))])) for k in range(9)] + [(None, " ".join(base[2:]))]
    docs = odd.unionByName(spark.createDataFrame([(d, t, "", "", 0, "", "", "", "", "", "") for d, t in planted], odd.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = near_copies.keep_one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == survivors(rows)[0]
    assert kept.filter("doc_id is null").count() == sum(d is None for d, _ in rows)
    assert near_copies.keep_one_of_each(empty).isEmpty()


def test_no_pair_of_a_group_is_lost(spark):
    """Four pairs of near copies in one group of one key: at most two of them hold one of the group's representatives."""
    texts = [" ".join(f"w{f}x{i}" for i in range(60)) + tail for f in range(4) for tail in (" end", " fin")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies._nodes(docs, 5).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("fp", F.xxhash64("node"))
    nodes = near_copies.materialize(nodes, "test-nodes")
    names = {r["node"]: r["doc_id"] for r in nodes.collect()}
    assert sorted(sorted((names[r["a"]], names[r["b"]])) for r in near_copies.links(docs, nodes).collect()) == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_a_large_group_is_not_paired_with_itself(spark, monkeypatch):
    """Sixty texts that share over half of their words and one key, of which two alone are near copies: one pair is compared, not 1,770."""
    shared = [f"s{i}" for i in range(70)]
    texts = [" ".join([*shared, *(f"t{k}x{i}" for i in range(50))]) for k in range(59)]
    texts.append(texts[7] + " end")
    write, counts = near_copies.materialize, {}

    def counted(df, name):
        made = write(df, name)
        counts[name] = made.count()
        return made

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies._nodes(docs, 5).withColumn("bands", F.array(F.lit(1).cast("long"))).withColumn("fp", F.xxhash64("node"))
    nodes = near_copies.materialize(nodes, "test-nodes")
    names = {r["node"]: r["doc_id"] for r in nodes.collect()}
    monkeypatch.setattr(near_copies, "materialize", counted)
    assert [sorted((names[r["a"]], names[r["b"]])) for r in near_copies.links(docs, nodes).collect()] == [[7, 59]]
    assert counts["near-rest"] <= 1


def test_bound_loses_no_pair(spark):
    """Random sets around the threshold, all of different roots: every pair of similarity 0.8 is a candidate."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = [rng.choice(1 << 40, 60, replace=False) for _ in range(3)]
    sets = [np.unique(np.concatenate([rng.choice(base[k % 3], 60 - int(rng.integers(0, 14)), replace=False), rng.integers(0, 1 << 40, int(rng.integers(0, 8)))])) for k in range(90)]
    rows = spark.createDataFrame([(k, k, s.tolist()) for k, s in enumerate(sets)], "node long, root long, hashes array<long>")
    found = {(r["a"], r["b"]) for r in near_copies._apart(rows, 0.8).collect()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    want = {(i, j) for j in range(90) for i in range(j) if 5 * both(i, j) >= 4 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    assert want and want <= found


def test_exploded_keys_and_hashes_are_not_broadcast(spark, monkeypatch):
    """Spark takes a node's band keys and a set's hashes for one row each: their joins are sorted, whatever size it supposes."""
    write, plans = near_copies.materialize, {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(20)], "doc_id long, text string")
    nodes = near_copies.materialize(near_copies._nodes(docs, 5), "test-nodes")
    monkeypatch.setattr(near_copies, "materialize", seen)
    near_copies.links(docs, nodes).collect()
    for name, key in (("near-shared", "key"), ("near-early", "hash")):
        assert f"SortMergeJoin [{key}#" in plans[name] and f"BroadcastHashJoin [{key}#" not in plans[name]
