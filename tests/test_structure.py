from __future__ import annotations

import random

from docframe.operators import structure


def plain_lists(items):
    """(block, level or None, ordered, start) to {block: (depth, parent, list, number)}, by appending to nested lists."""
    found, root = {}, []  # root: blocks of the document; a list is ["list", ordered, start, items]; an item [block, blocks]

    def append(blocks, block, level, ordered, start, depth, parent):
        last = blocks[-1] if blocks else None
        if level > 0 and last and last[0] == "list":
            append(last[3][-1][1], block, level - 1, ordered, start, depth + 1, last[3][-1][0])
            return
        if not (last and last[0] == "list" and last[1] == ordered):
            blocks.append(["list", ordered, start, []])
        into = blocks[-1]
        into[3].append([block, []])
        found[block] = (depth, parent, into[3][0][0], into[2] + len(into[3]) - 1 if ordered else None)

    for block, level, ordered, start in items:
        if level is None:
            root.append(["text"])
            found[block] = (None, None, None, None)
        else:
            append(root, block, max(0, min(8, level)), ordered, 1 if start is None else start, 0, None)
    return found


def test_nested_lists_equal_appending(spark):
    rng, rows, want = random.Random(4), [], {}
    for doc in range(40):
        items = [(b * 3, rng.choice([None, 0, 0, 1, 2, 2, 3, 5, 9, -1]), rng.random() < 0.4, rng.choice([None, 1, 4])) for b in range(rng.randrange(1, 40))]
        rows += [(doc, *i, "x") for i in items]
        want |= {(doc, b): v for b, v in plain_lists(items).items()}
    df = spark.createDataFrame(rows, "doc_id long, block int, level int, ordered boolean, start int, number_of string")
    got = {(r["doc_id"], r["block"]): (r["depth"], r["parent_item"], r["list"], r["number"]) for r in structure.nested_lists(df).collect()}
    assert got == want
    assert structure.nested_lists(df.limit(0)).count() == 0


def test_headings_hang_in_headings(spark):
    rows = [(1, 0, "paragraph", 0), (1, 1, "heading", 2), (1, 2, "paragraph", 0), (1, 3, "heading", 3), (1, 4, "heading", 1), (1, 5, "heading", 3), (1, 6, "heading", 2), (1, 7, "list_item", 4), (2, 0, "heading", None), (3, 0, None, None)]
    got = structure.heading_tree(spark.createDataFrame(rows, "doc_id long, block int, kind string, level int"))
    assert {(r["doc_id"], r["block"]): r["parent_heading"] for r in got.collect()} == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 1, (1, 4): None, (1, 5): 4, (1, 6): 4, (1, 7): 6, (2, 0): None, (3, 0): None}


def test_structure_nodes(spark):
    rows = [(1, 0, "heading", 1, None, None, "H"), (1, 1, "list_item", 0, False, None, "a"), (1, 2, "list_item", 1, True, 3, "b"), (1, 3, "list_item", 0, True, 1, "c"), (1, 4, "paragraph", 0, None, None, "p")]
    got = structure.structure_nodes(spark.createDataFrame(rows, "doc_id long, block int, kind string, level int, ordered boolean, start int, text string"))
    assert {(r["node"], r["parent"], r["kind"], r["text"]) for r in got.collect()} == {
        (0.0, None, "heading", "H"), (0.5, 0.0, "list", None), (1.0, 0.5, "list_item", "a"), (1.5, 1.0, "ordered_list", None), (2.0, 1.5, "list_item", "b"), (2.5, 0.0, "ordered_list", None), (3.0, 2.5, "list_item", "c"), (4.0, 0.0, "paragraph", "p"),
    }
