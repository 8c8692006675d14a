"""SimHash, components and sketches against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docframe.llm import components, simhash, sketch


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    found = {}
    for i, d in enumerate(ids):
        if d is not None:
            found[root(i)] = min(d, found.get(root(i), d))
    return [found.get(root(i)) for i in range(len(ids))]


def near_copies(spark, odd):
    random.seed(4)
    base = [f"w{random.randrange(500)}" for _ in range(900)]
    rows = [(100 + k, " ".join(w if random.random() > 0.001 * k else "changed" for w in base)) for k in range(12)] + [(200 + k, " ".join(base)) for k in range(30)]
    extra = [(d, t, "", "", 0, "", "", "", "", "", "") for d, t in rows]
    return odd.unionByName(spark.createDataFrame(extra, odd.schema))


def test_components_equal_brute_force(spark, odd, empty):
    docs = near_copies(spark, odd)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [fingerprint(t) for _, t in rows]
    want = sorted((str(d), f"{p:016x}", str(c)) for (d, _), p, c in zip(rows, prints, smallest_reachable([d for d, _ in rows], prints), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.components(docs).collect()) == want
    assert simhash.components(empty).isEmpty()


def test_links_of_random_fingerprints(spark):
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = set(base)
    for p in base:
        for many in (1, 2, 3):
            q = p
            for b in random.sample(range(64), many):
                q ^= 1 << b
            prints.add(q)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = {frozenset((r["a"], r["b"])) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(50)) and len(got) == 90


def test_one_of_each_stays(spark, odd):
    docs = near_copies(spark, odd)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    named = simhash.components(docs).filter("doc_id = component_id").select("doc_id").distinct().count()
    assert kept.filter("doc_id is not null").count() == named and kept.filter("doc_id is null").count() == 2


def exact(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_sketches(spark, odd, empty, documents):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(documents.limit(60).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in sketch.fingerprint_documents(docs, k=128).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = exact(text), exact(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[name] - true) < (1e-9 if len(a | b) <= 128 else 0.2), (d, name)
        assert len(r["sketch"]) == min(128, len(exact(text)))
    assert sketch.fingerprint_documents(empty).isEmpty()


def test_sketch_merge_and_containment(spark):
    texts = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(2000)), " ".join(f"a{i}" for i in range(1000)))], "doc_id long, big string, small string")
    rows = sketch.with_sketch(sketch.with_sketch(texts, F.col("big"), "b"), F.col("small"), "s")
    r = rows.select(sketch.containment(F.col("s"), F.col("b")).alias("c"), sketch.distinct_shingles(F.col("b")).alias("n"), (sketch.merge(F.col("s"), F.col("b")) == F.col("b")).alias("same")).first()
    assert r["c"] > 0.7 and 1400 < r["n"] < 2700 and r["same"]
    parts = rows.select("doc_id", F.explode(F.array("b", "s")).alias("part"))
    assert sketch.merge_groups(parts, ["doc_id"], "part").first()["part"] == rows.first()["b"]


def test_plan_has_no_python(spark, documents):
    plan = sketch.fingerprint_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_probes_are_not_broadcast(spark):
    """Each fingerprint has dozens of probes, which Spark takes for one: neither side of the grid join is sent to the driver."""
    rows = simhash.materialize(spark.range(500).select(F.xxhash64("id").alias("fp")), "test-prints")
    plan = simhash.fingerprint_links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
