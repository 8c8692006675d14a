from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docframe.operators import chunks, corpus, edit_log, layout, search
from docframe.streaming import flows

OPS = "doc_id long, counter long, actor long, ts_ms long, op string, left_counter long, left_actor long, target_counter long, target_actor long, content string"


def log(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], OPS)


ROWS = [
    (1, 1, 10, "insert", None, None, None, None, "a"),
    (2, 1, 20, "insert", 1, 1, None, None, "b"),
    (2, 2, 30, "insert", 1, 1, None, None, "c"),
    (3, 2, 40, "replace", None, None, 1, 1, "A"),
    (4, 1, 50, "delete", None, None, 2, 1, None),
    (5, 2, 60, "replace", None, None, 2, 1, "late"),
    (6, 1, 70, "insert", 9, 9, None, None, "root"),
]


def test_edit_log_laws(spark):
    random.seed(3)
    first, second = log(spark, ROWS[:4]), log(spark, random.sample(ROWS, len(ROWS)))
    one, two = edit_log.merge(first, second), edit_log.merge(second, first, first)
    read = lambda ops: [(r["content"], r["position"]) for r in edit_log.ordered(ops).orderBy("position").collect()]
    assert read(one) == read(two) == [("root", 0), ("A", 1), ("c", 2)]
    assert edit_log.next_counter(one).first()["next_counter"] == 7
    actors = spark.createDataFrame([(1, 2, "bot", True)], "doc_id long, id long, name string, is_agent boolean")
    assert {(r["content"], r["author"]) for r in edit_log.attribution(one, actors).collect()} == {("A", "bot"), ("c", "bot"), ("root", None)}


def test_seed_chain(spark):
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate("xyz")], "doc_id long, block long, text string")
    assert [r["content"] for r in edit_log.ordered(edit_log.from_blocks(blocks)).orderBy("position").collect()] == ["x", "y", "z"]


def test_chunk_contract():
    made = chunks.fold([(1, "a b c"), (1, "d e"), (2, "f g h i j k l")], 4, 1)
    assert [c[0] for c in made] == ["a b c", "c d e", "e f g h i j k l"]
    assert [c[1] for c in made] == [[1], [1], [2]] and made[-1][3] == 0.5 and made[0][3] == 0.65
    assert chunks.fold([], 4, 1) == [] and chunks.clamp(1, 900) == (50, 25)


def test_chunk_fragments_follow_pages(spark):
    rows = spark.createDataFrame([(1, p, i, "w " * 40) for p in (1, 2) for i in range(2)], "doc_id long, page_number int, frag_idx int, text string")
    got = chunks.chunk_fragments(rows, 100, 10).orderBy("chunk_id").collect()
    assert [r["page_numbers"] for r in got] == [[1], [2]] or got[0]["page_numbers"][0] == 1


def test_blank_queries_find_nothing(spark):
    rows = spark.createDataFrame([(1, "review")], "doc_id long, text string")
    index = search.postings(rows, ["doc_id"], "text")
    assert search.search_index(index, ["doc_id"], " ").isEmpty() and search.search_index(index, ["doc_id"], "!!").isEmpty() and search.search_scan(rows, "  ").isEmpty()
    assert search.search_index(index, ["doc_id"], "rev").isEmpty() and search.search_scan(rows, "REV").count() == 1
    with pytest.raises(ValueError):
        search.search_pattern(rows, "x" * 65)


def test_written_index_prunes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i} common") for i in range(50)], "doc_id long, text string")
    search.write_index(search.postings(rows, ["doc_id"], "text"), str(tmp_path / "i"), 4)
    assert search.search_index(spark.read.parquet(str(tmp_path / "i")), ["doc_id"], "w7 common").first()["doc_id"] == 7


def test_nearest_drops_other_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in search.nearest(rows, [1.0, 0.0], 9).collect()] == [(1, 1.0), (2, 0.0), (5, 0.0), (3, -1.0)]


def fragments(spark, *rows):
    return spark.createDataFrame([(1, 1, i, *r, 10.0) for i, r in enumerate(rows)], "doc_id long, page_number int, frag_idx int, text string, x double, y double, width double, height double, font_size double")


def test_hidden_text(spark):
    rows = spark.createDataFrame([(1, 1, 0, "fine", 10.0, 10.0, 40.0, 12.0, 12.0), (1, 1, 1, "away", 5000.0, 10.0, 40.0, 12.0, 12.0), (1, 1, 2, "small", 10.0, 30.0, 40.0, 1.0, 0.5)], "doc_id long, page_number int, frag_idx int, text string, x double, y double, width double, height double, font_size double")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id long, page_number int, width double, height double")
    assert {(r["frag_idx"], r["reason"]) for r in layout.scan(rows, pages).collect()} == {(1, "off_page"), (2, "tiny_text")}
    assert layout.sanitized(rows, pages).count() == 1 and layout.page_range("2-3", 9) == (2, 3) and layout.page_range("x", 9) == (1, 9)


def test_ruled_table(spark):
    rows = fragments(spark, ("name", 10.0, 12.0, 30.0, 10.0), ("q1", 80.0, 12.0, 20.0, 10.0), ("north", 10.0, 32.0, 30.0, 10.0), ("5", 80.0, 32.0, 20.0, 10.0))
    rules = spark.createDataFrame([(1, 1, "h", 5.0, y, 120.0, y) for y in (8.0, 26.0, 48.0)], "doc_id long, page_number int, orientation string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["row"], r["col"]): r["text"] for r in layout.tables(rows, rules).collect()}
    assert got == {(0, 0): "name", (0, 1): "q1", (1, 0): "north", (1, 1): "5"}


def test_figures_one_to_one(spark):
    rows = fragments(spark, ("Figure 1: left", 10.0, 112.0, 80.0, 10.0), ("plain", 10.0, 300.0, 80.0, 10.0))
    images = spark.createDataFrame([(1, 1, "a", 10.0, 10.0, 80.0, 100.0), (1, 1, "b", 10.0, 130.0, 80.0, 50.0)], "doc_id long, page_number int, name string, x double, y double, width double, height double")
    assert {(r["name"], r["caption"]) for r in layout.figures(rows, images).collect()} == {("a", "Figure 1: left"), ("b", None)}


def test_two_columns(spark):
    rows = fragments(spark, *[(f"L{i}", 10.0, 10.0 + 14 * i, 100.0, 10.0) for i in range(5)], *[(f"R{i}", 200.0, 10.0 + 14 * i, 100.0, 10.0) for i in range(5)])
    got = layout.lines(rows).orderBy("column_idx", "line_idx").collect()
    assert [r["text"] for r in got] == [f"L{i}" for i in range(5)] + [f"R{i}" for i in range(5)]


def test_greedy_steps(spark):
    words = spark.createDataFrame([(d, k, "g") for d, ks in {1: "ab", 2: "abc", 3: "cd", 4: "bc"}.items() for k in ks], "doc_id long, keyword string, kind string")
    assert {(r["cluster"], r["doc_id"]) for r in corpus.clusters(words, "kind").collect()} == {(1, 1), (1, 2), (1, 4), (3, 3)}
    ranked = spark.createDataFrame([(1, 1, 60), (1, 2, 60), (1, 3, 30)], "doc_id long, rank int, token_count int")
    assert [r["rank"] for r in corpus.pick_context(ranked, 100).orderBy("rank").collect()] == [1, 3]


def test_stream_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, None), (3, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    flows.stream_ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck"), 50).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["type"]) for r in got] == [(1, "header"), (1, "chunk"), (1, "footer"), (2, "header"), (2, "footer"), (3, "header"), (3, "footer")]


def test_windows_on_stream_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "e")
    events.write.parquet(source)
    stream = flows.windowed(spark.readStream.schema(events.schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("docframe_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (str(r["window_start"]), r["event_type"], r["n"])
    assert sorted(map(key, spark.sql("select * from docframe_windows").collect())) == sorted(map(key, flows.windowed(events).collect()))
    assert flows.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_figures_of_many_pages_need_no_call_a_page(spark):
    """Image by image in order of names: a takes the caption that is nearest to it, b the one that is left, c none; pages stay in the JVM."""
    captions = [(0, "Figure 1: one", 10.0, 110.0), (1, "Figure 2: two", 10.0, 130.0)]
    rows = spark.createDataFrame([(d, 1, i, text, x, y, 50.0, 10.0) for d in range(3) for i, text, x, y in captions], "doc_id long, page_number int, frag_idx int, text string, x double, y double, width double, height double")
    images = spark.createDataFrame([(d, 1, n, 10.0, y, 50.0, 100.0) for d in range(3) for n, y in (("b", 8.0), ("a", 0.0), ("c", 5.0))], "doc_id long, page_number int, name string, x double, y double, width double, height double")
    found = layout.figures(rows, images)
    assert sorted((r["doc_id"], r["name"], r["kind"], r["caption"]) for r in found.collect()) == [(d, n, k, c) for d in range(3) for n, k, c in (("a", "figure", "Figure 1: one"), ("b", "figure", "Figure 2: two"), ("c", "image", None))]
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_topic_links_count_the_pairs(spark):
    """Sets of one to five topics: as many links as the pairs that are made one by one, and no pair is made."""
    rng = random.Random(5)
    rows = [(d, t) for d in range(150) for t in rng.sample("abcdefghijkl", rng.choice([1, 1, 2, 3, 4, 5, 5]))]
    found = spark.createDataFrame(rows, "doc_id long, topic string")
    for least in (0.2, 0.5):
        ends = [e for r in corpus.topic_pairs(found, least).collect() for e in (r["a"], r["b"])]
        got = corpus.topic_links(found, least).collect()
        assert len(got) == 150 and all(r["links"] == ends.count(r["class_id"]) for r in got) and sum(r["links"] for r in got) > 0
