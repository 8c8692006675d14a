"""Language model, quality, toxicity and the pipeline: contracts, held-out accuracy, and odd rows."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docframe.llm import context_mixing, near_copies, quality, spelling, toxicity, training, word_bits

from test_near_copies import survivors

MIDDLE = "/root/testdata/sf0.01"


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def tokens(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0d]+", lowered), b""]


def test_language_model_contract(spark, odd, empty, documents):
    docs = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = Counter()
    for d, t in rows:
        if remainder(d, 5) != 1:
            counts.update(tokens(t))
    many = sum(counts.values())
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (many + 0.5 * (len(counts) + 1))) for w in tokens(t))
    want = sorted((str(d), remainder(d, 5) == 1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(base(t), 4)) for d, t in rows)
    got = context_mixing.score_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == many and r["score"] < 0 for r in got)
    assert context_mixing.score_documents(empty).isEmpty()


def test_spellings_are_a_probability():
    """All words of one byte, with all continuations, have at most the probability 1."""
    words, kinds = [b"a", b"ab", b"b"], np.zeros(3, np.int32)
    counts = np.zeros((spelling.PREDICTORS << 12, 2), np.uint32)
    spelling.count(words, kinds, 12, counts)
    speller = spelling.Speller.fresh(counts)
    speller = speller.with_fit(speller.fitted(words, kinds))
    assert (2.0 ** speller.log2([bytes([b]) for b in range(256)], np.zeros(256, np.int32))).sum() <= 1.0001
    likely, rare, long = speller.log2([b"a", b"q", b"x" * 5000], kinds)
    assert likely > rare > long


def test_tokens_by_their_definition(odd):
    texts = [r["text"] or "" for r in odd.collect()]
    found = word_bits.tokens_of(texts)
    raw, words = found.raw.tobytes(), iter(zip(found.starts, found.ends, strict=True))
    names = {}
    for k, text in enumerate(texts):
        want = tokens(text)
        assert found.first[k + 1] - found.first[k] == len(want) and found.sizes[k] == len(text.encode())
        for t, word in enumerate(want[:-1], start=int(found.first[k])):
            a, b = next(words)
            assert raw[a:b] == word and names.setdefault(word, found.hashes[t]) == found.hashes[t]
        assert found.hashes[found.first[k + 1] - 1] == word_bits.END_HASH
    assert len(set(names.values())) == len(names) and word_bits.END_HASH not in names.values()
    places = word_bits.Places(np.array(list(names.values())[::2], np.uint64))
    assert places.of(np.array(list(names.values()), np.uint64)).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(names))]


def word_model(texts):
    found = word_bits.tokens_of(texts)
    hashes, uses = np.unique(found.hashes[found.place], return_counts=True)
    code = word_bits.WordCode(hashes[:6], uses[:6].astype(float), len(texts), np.ones(word_bits.KINDS))
    counts = np.zeros((2, 1 << 12, 2), np.uint32)
    word_bits.count(code, found, 12, counts)
    return found, code, counts


def test_bits_of_words_bit_by_bit():
    """The mixer in step against one that takes bit after bit of each run, written from its description."""
    texts = ["the cat and the dog " * 70, "", "a dog the odd", "THE the and\ta"]
    found, code, counts = word_model(texts)
    mixer = word_bits.Mixer.fresh(word_bits.packed_counts(counts))
    trained = np.array([True, True, False, True])
    got, _, _, symbols = word_bits.mix(code, mixer, found, trained)
    assert all(0 <= s < code.words + 1 + word_bits.KINDS for s in symbols)
    contexts = word_bits.contexts(symbols, found.first)
    for k in range(len(texts)):
        total, span = 0.0, range(int(found.first[k]), int(found.first[k + 1]))
        for n, t in enumerate(span):
            if n % word_bits.RUN == 0:
                weights, refined, offsets = mixer.weights.copy(), mixer.refined.copy(), {}
            begin = code.begin[symbols[t]]
            for d in range(code.lengths[symbols[t]]):
                node, bit, x, gate = code.nodes[begin + d], int(code.bits[begin + d]), [code.stretched[code.nodes[begin + d]]], min(d, word_bits.DEPTHS - 1)
                for c in range(2):
                    slot = int(word_bits.slots_of(contexts[c][t : t + 1], word_bits._of_nodes(np.array([node])), 12)[0])
                    held = counts[c][slot].astype(int).tolist()
                    if trained[k]:
                        held[bit] = max(0, held[bit] - 1)
                    x.append(math.log((held[1] + 0.4) / (held[0] + 0.4)))
                    gate += word_bits.DEPTHS * (c == 0 and sum(held) > 3)
                place = node % word_bits.OWN
                z = float(np.clip(weights[gate] @ np.array(x) + offsets.get(place, 0.0), -7.9, 7.9))
                p = 1 / (1 + math.exp(-z))
                cell = int(z * 2 + 16.5)
                q = float(refined[gate, cell])
                total += math.log2(0.5 * (p + q) if bit else 1 - 0.5 * (p + q))
                weights[gate] += word_bits.RATE * (bit - p) * np.array(x)
                offsets[place] = offsets.get(place, 0.0) + float(word_bits.OWN_RATE) * (bit - p)
                refined[gate, cell] = q + float(word_bits.REFINE) * (bit - q)
        assert got[k] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_words_are_a_probability():
    """After a given start, all next symbols together have the probability 1."""
    found, code, counts = word_model(["the cat and the dog " * 5, "a dog"])
    mixer = word_bits.Mixer.fresh(word_bits.packed_counts(counts))
    text = word_bits.tokens_of(["the cat"])
    start = code.symbols(text)
    total = 0.0
    for symbol in range(code.words + 1 + word_bits.KINDS):
        code.symbols = lambda _, s=symbol: np.array([*start[:2], s], np.int32)
        total += 2.0 ** word_bits.mix(code, mixer, text, np.zeros(1, bool))[0][0]
    code.symbols = lambda _: start[:2]
    text.first = np.array([0, 2])
    assert total == pytest.approx(2.0 ** word_bits.mix(code, mixer, text, np.zeros(1, bool))[0][0], rel=1e-3)


def test_tables_grow_and_sums_are_whole(spark):
    assert context_mixing._table_bits(10, 22) == 12 and context_mixing._table_bits(1 << 18, 22) == 18 and context_mixing._table_bits(1 << 40, 22) == 22
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 9, (5000, 2)).astype(np.uint32) for _ in range(7)]
    rows = [(r["shard"], bytes(r["counts"])) for p in parts for b in context_mixing._shards(p) for r in b.to_pylist()]
    got = context_mixing.summed(spark.createDataFrame(rows, "shard long, counts binary"), 5000)
    assert (got == sum(p.astype(int) for p in parts)).all()
    assert word_bits.packed_counts(np.array([[1 << 40, 1 << 39]])).tolist() == [[65535, 32767]]


def test_model_is_better_than_the_base(spark):
    """On text that it did not learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = context_mixing.score_documents(docs).collect()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.fixture(scope="module")
def middle(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_quality_held_out(middle):
    docs, labels = middle
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 30 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(remainder(r["doc_id"], 5) == 0 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_held_out(middle):
    docs, labels = middle
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    score, label = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    better = (score[label == 1][:, None] > score[label == 0][None]).mean() + 0.5 * (score[label == 1][:, None] == score[label == 0][None]).mean()
    assert better > 0.75
    assert all(remainder(r["doc_id"], 3) == 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    net = toxicity.GatedNetwork()
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    x = rng.normal(0, 1, (3, 5, toxicity.INPUTS))
    x[:, :, -1] = 1
    x[1, 3:] = 0
    grads = net.gradients(x, np.ones(3))
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        old, e = w[at], 1e-4
        w[at] = old + e
        up = net.forward(x)[0].sum()
        w[at] = old - e
        down = net.forward(x)[0].sum()
        w[at] = old
        assert abs((up - down) / (2 * e) - grads[name][at]) < 1e-2, name


def test_odd_rows_and_no_labels(spark, odd, empty, documents, labels):
    none = labels.limit(0)
    for score in (quality.score_documents, toxicity.score_documents):
        assert score(odd, none).count() == odd.count() and score(empty, labels).isEmpty()
        rows = score(odd.select(documents.columns).unionByName(documents), labels).collect()
        assert len(rows) == odd.count() + documents.count() and all(0 <= r["score"] <= 1 for r in rows)
        same = {r["score"] for r in rows if r["doc_id"] in (6, 7)}
        assert same
    assert quality.keep_good(odd, none).count() == odd.count() and toxicity.keep_clean(odd, none).count() == odd.count()


def test_windows_cover_every_word():
    for many in (0, 1, 31, 32, 33, 48, 49, 1000):
        inputs = np.zeros((many, toxicity.INPUTS), np.float32)
        inputs[:, -1], inputs[:, 0] = 1, np.arange(many)
        x = toxicity.windows(inputs)
        seen = {int(v) for w in x for v, m in zip(w[:, 0], w[:, -1], strict=True) if m}
        assert seen == set(range(many)) and x.shape[1] == toxicity.WINDOW


def test_pipeline(spark):
    import corpus_pipeline

    from docframe.llm import packing

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]
    kept = corpus_pipeline.drop_toxic(spark, docs, MIDDLE)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in toxicity.score_documents(docs, labels).filter("predicted = 1").collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
    want, _ = survivors([(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, kept, MIDDLE).select("doc_id").collect()) == want
    out = corpus_pipeline.run(spark, MIDDLE).collect()
    good = {r["doc_id"] for r in quality.keep_good(kept, labels).collect()}
    left, _ = survivors([(r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] in good])
    assert sorted({r["doc_id"] for r in out}) == left
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    text = {r["doc_id"]: r["text"] for r in kept.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    pieces = {(r["doc_id"], r["start"]): r for r in out}
    for doc_id in left[:150]:
        ids = np.array([*library.encode(text[doc_id], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        while at < len(ids):
            r = pieces[doc_id, at]
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]


def test_pipeline_odd_rows(spark, odd, empty, documents):
    """Every stage keeps the columns of documents, and takes nulls, empty and very long texts, ties, repeated rows and an empty table."""
    import corpus_pipeline

    for docs in (odd, empty, odd.select(documents.columns).unionByName(documents)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, "/root/testdata/sf0.001")
            assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    twice = odd.select("doc_id", "text").unionByName(odd.selectExpr("doc_id", "'other ' || text || ' words that differ' AS text"))
    kept = near_copies.keep_one_of_each(twice).filter("doc_id is not null").collect()
    want, _ = survivors([(r["doc_id"], r["text"]) for r in twice.collect()])
    assert sorted(r["doc_id"] for r in kept) == want


def test_folder_of_a_local_session(tmp_path):
    """Without spark.checkpoint.dir a local session writes to a temporary folder of its own."""
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from docframe.llm import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert shared.shared_dir(spark) == shared.shared_dir(spark)
assert shared.materialize(spark.range(3), "x").count() == 3
"""
    (tmp_path / "spark-defaults.conf").write_text("")
    subprocess.run([sys.executable, "-c", code], check=True, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, timeout=120)


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(500).selectExpr("7L AS doc_id", "concat('text ', id % 300) AS text")
    labels = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    assert training.unlabelled_sample(docs, 20).count() == 20
    assert training.labelled_sample(docs, labels, "toxic", 20, 3, 2 if remainder(7, 3) != 2 else 1).count() == 20


def test_long_runs_become_steps():
    run = "a" * 30 + "-idiot_" + "b" * 50 + "/x"
    pieces = toxicity.pieces_of(f"short {run} end")
    assert pieces[0] == "short" and pieces[-1] == "end" and "idiot" in pieces and max(map(len, pieces)) <= 24
    assert sum(p.count("b") for p in pieces) >= 50 and toxicity.pieces_of("") == []


def test_buckets_of_words_do_not_depend_on_their_company() -> None:
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé漢😀"), n)) for n in (1, 2, 3, 4, 5, 9, 10, 24, 31) for _ in range(3)]
    together = toxicity.buckets_of(words)
    for word, row in zip(words, together, strict=True):
        alone, held = toxicity.buckets_of([word])[0], row[row >= 0]
        assert alone[alone >= 0].tolist() == held.tolist()
        assert len(held) == 2 + len(range(2, min(len(word), 9) + 1)) + max(0, len(word) - 3)
    inner = toxicity.buckets_of(["xxabcdyy", "zabcdz"])
    assert set(inner[0, -5:].tolist()) & set(inner[1, -5:].tolist()) - {-1}
    assert toxicity.buckets_of([]).shape[0] == 0


def test_every_training_document_and_word_is_fitted(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i} alpha alpha") for i in range(6)], "doc_id long, text string").withColumn("out", F.lit(False))
    skipped = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) != 0)  # those that a share of one in 16 left out
    code = word_bits.WordCode(np.zeros(0, np.uint64), np.zeros(0), 6, np.ones(word_bits.KINDS))
    start, found = word_bits.Mixer.fresh(np.zeros((2, 1 << 12, 2), np.uint16)), context_mixing.train_words(skipped, code, 24)
    assert skipped.count() > 0 and not np.array_equal(found.weights, start.weights)
    words = spark.createDataFrame([(i, 0, f"word{i}".encode(), 1) for i in range(6)], "hash long, kind int, word binary, trained long").filter(F.pmod(F.xxhash64("hash"), F.lit(16)) != 0)
    speller = context_mixing.train_spelling(words, 6)
    assert not np.array_equal(speller.weights, spelling.Speller.fresh(speller.counts).weights)
