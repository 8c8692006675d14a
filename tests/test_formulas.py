from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions.formulas import attach_limits, to_latex, wrap_radicals
from docframe.operators import formulas

FRAGMENTS = "doc_id long, page_number int, frag_idx int, text string, x double, y double, width double, height double, font_size double, cell string, bar string"


def pages(spark, found):
    """{doc: (fragments (text, x, baseline[, width, size]), bars (x0, x1, y))}."""
    rows = [(d, 1, i, f[0], float(f[1]), float(f[2] - 8), float(f[3] if len(f) > 3 else 6), 8.0, float(f[4] if len(f) > 4 else 10), "x", "x") for d, (fs, _) in found.items() for i, f in enumerate(fs)]
    rules = [(d, 1, "h", float(a), float(y), float(b), float(y)) for d, (_, bs) in found.items() for a, b, y in bs]
    return spark.createDataFrame(rows, FRAGMENTS), spark.createDataFrame(rules, "doc_id long, page_number int, orientation string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([(d, 1, 600.0) for d in found], "doc_id long, page_number int, width double")


def test_fractions(spark):
    ab = [("a", 120, 480), ("b", 120, 495), ("c", 120, 512)]
    found = {
        1: ([("x + 1", 102, 494, 30), ("2", 116, 511)], [(100, 140, 500)]), 2: (ab, [(118, 128, 488), (116, 132, 500)]), 3: (ab, [(116, 132, 500), (118, 128, 488)]),
        4: ([("a", 120, 494), ("b", 120, 511), ("c", 120, 530)], [(116, 132, 500), (118, 128, 518)]), 5: ([("a", 120, 494)], [(116, 132, 500)]), 6: ([("a", 120, 494), ("b", 120, 511)], [(10, 250, 500)]),
        7: ([("a", 120, 494), ("b", 120, 511)], [(116, 132, 500), (116, 132, 700)]), 8: ([("one two three four five six", 102, 494, 30), ("2", 116, 511)], [(100, 140, 500)]), 9: ([("√", 118, 494), ("x", 124, 494), ("β", 120, 511), (None, 120, 494), (" ", 120, 494)], [(116, 132, 500)]),
        10: ([("p", 112, 464, 20), ("q", 112, 478, 20), ("r", 112, 494, 20), ("s", 112, 512, 20)], [(116, 128, 470), (110, 134, 484), (104, 142, 500)]),
    }
    got = {r["doc_id"]: r["latex"] for r in formulas.fractions(*pages(spark, found)).collect()}
    assert got == {1: "\\frac{x + 1}{2}", 2: "\\frac{\\frac{a}{b}}{c}", 3: "\\frac{\\frac{a}{b}}{c}", 4: "\\frac{a}{\\frac{b}{c}}", 9: "\\frac{\\sqrt x}{\\beta}", 10: "\\frac{\\frac{\\frac{p}{q}}{r}}{s}"}
    assert formulas.fractions(*pages(spark, found)).count() == len(got)


def test_matrices(spark):
    square = [("[", 10, 100, 4), ("a", 20, 94), ("b", 50, 94), ("c", 20, 110), ("d", 50, 110), ("]", 70, 100, 4)]
    found = {
        1: (square, []), 2: ([("(", 10, 100, 4), *square[1:5], ("1", 80, 94), ("σ", 80, 110), (")", 100, 100, 4)], []), 3: (square[:4] + square[5:], []), 4: (square[:-1], []), 5: (square[:-1] + [("]", 500, 100, 4)], []),
        6: (square[:-1] + [(")", 70, 100, 4)], []), 7: ([*square, ("x", 56, 94)], []), 8: ([("[", 10, 100, 4), ("prose", 20, 100), ("]", 70, 100, 4)], []), 9: ([*square, *[(t, x + 100, y) for t, x, y, *_ in square]], []),
    }
    got = sorted((r["doc_id"], r["open_idx"], r["n_rows"], r["n_cols"], r["latex"]) for r in formulas.matrices(pages(spark, found)[0]).collect())
    plain = "\\begin{bmatrix} a & b \\\\ c & d \\end{bmatrix}"
    assert got == [(1, 0, 2, 2, plain), (2, 0, 2, 3, "\\begin{pmatrix} a & b & 1 \\\\ c & d & \\sigma \\end{pmatrix}"), (7, 0, 2, 2, "\\begin{bmatrix} a & b x \\\\ c & d \\end{bmatrix}"), (9, 0, 2, 2, plain), (9, 6, 2, 2, plain)]


def test_radicals_and_limits(spark):
    radicals = {"\\sqrt x + 1": "\\sqrt{x} + 1", "a \\sqrt b": "a \\sqrt{b}", "\\sqrt a b \\leq c": "\\sqrt{a b} \\leq c", "\\sqrt x y z": "\\sqrt{x y z}", "\\sqrt": "\\sqrt", "\\sqrt + 1": "\\sqrt + 1", "\\sqrt {a} b": "\\sqrt{{a}} b", "\\sqrt 1 2 3 4 5 6 7": "\\sqrt{1 2 3 4 5 6} 7", "": "", "\\sqrt a = \\sqrt b": "\\sqrt{a} = \\sqrt{b}", None: None}
    limits = {"\\sum _{i} ^{n} x": "\\sum_{i}^{n} x", "\\int ^{1} _{0} f": "\\int_{0}^{1} f", "x ^{2}": "x ^{2}", "\\sum ^{n} y \\prod _{k}": "\\sum^{n} y \\prod_{k}", "\\summa _{i}": "\\summa _{i}", "\\sum _{i} _{j}": "\\sum_{i} _{j}", None: None}
    df = spark.createDataFrame([(t,) for t in {**radicals, **limits}], "t string").select("t", wrap_radicals(F.col("t")).alias("r"), attach_limits(F.col("t")).alias("l"))
    got = {r["t"]: r for r in df.collect()}
    assert {t: got[t]["r"] for t in radicals} == radicals and {t: got[t]["l"] for t in limits} == limits
    assert spark.createDataFrame([("2α+∑x",)], "t string").select(to_latex(F.col("t"))).first()[0] == "2 \\alpha + \\sum x"


def test_no_formulas(spark):
    frags, rules, sizes = pages(spark, {1: ([("a", 1, 1)], [(0, 5, 5)])})
    assert formulas.fractions(frags.limit(0), rules, sizes).count() == formulas.fractions(frags, rules.limit(0), sizes).count() == formulas.matrices(frags.limit(0)).count() == 0


def test_signs_are_counted_without_a_pattern(spark):
    """Every text is read for its signs, so they are counted by one pass over its characters."""
    from docframe.functions.formulas import math_signs

    rows = spark.createDataFrame([("a = b + \u00b1c",), ("none [^-]",), ("",), (None,)], "t string").select(math_signs(F.col("t")).alias("n"))
    assert [r["n"] for r in rows.collect()] == [3, 0, 0, None]
    assert "regexp" not in rows._jdf.queryExecution().toString()
