from __future__ import annotations

import math
import random
import unicodedata

from docframe.operators import tables
from docframe.operators.accents import MARKS, NEARBY, merge_positional_accents

FRAGMENTS = "doc_id long, page_number int, frag_idx int, text string, x double, y double, width double, height double, font_size double, row string, col string"
RULES = "doc_id long, page_number int, orientation string, x0 double, y0 double, x1 double, y1 double, region string"


def frames(spark, pages):
    """pages: {doc: (fragments (text, x, y[, width, size]), rules (o, x0, y0, x1, y1))}."""
    frags = [(d, 1, i, f[0], float(f[1]), float(f[2]), float(f[3] if len(f) > 3 else 10), 8.0, float(f[4] if len(f) > 4 else 8), "x", "y") for d, (fs, _) in pages.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(frags, FRAGMENTS), spark.createDataFrame([(d, 1, o, float(a), float(b), float(c), float(e), "x") for d, (_, rs) in pages.items() for o, a, b, c, e in rs], RULES)


def grids(found):
    out: dict = {}
    for r in found.collect():
        out.setdefault((r["doc_id"], r["table_idx"]), {})[r["row"], r["col"]] = r["text"]
    return {k: [[g[i, j] for j in range(1 + max(c for _, c in g))] for i in range(1 + max(a for a, _ in g))] for k, g in out.items()}


def runs(values, gap):
    out, last = [], None
    for v in sorted(values):
        if last is None or v - last > gap:
            out.append([])
        out[-1].append(v)
        last = v
    return [sum(g) / len(g) for g in out]


def plain_tables(frags, rules):
    """The same rules, page by page, with lists."""
    found, boxes = [], {}
    for o, x0, y0, x1, _ in rules:
        if o == "h":
            boxes.setdefault((math.floor(x0 / 8 + 0.5), math.floor(x1 / 8 + 0.5)), []).append((x0, y0, x1))
    regions = []
    for rs in boxes.values():
        ys = runs([r[1] for r in rs], 3)
        box = (ys[0], min(r[0] for r in rs), max(r[2] for r in rs), ys[-1])
        if len(ys) >= 2 and box[2] - box[1] >= 40 and box[3] - box[0] >= 4:
            regions.append(box)
    for top, x0, x1, bottom in sorted(regions):
        inside = [(f[2], i, *f) for i, f in enumerate(frags) if x0 - 2 <= f[1] + f[3] / 2 <= x1 + 2 and top - 2 <= f[2] + 4 <= bottom + 2]
        if len(inside) < 4:
            continue
        tol = max(3, max(4, sorted(f[6] for f in inside)[len(inside) // 2]) * 0.6)
        rows, anchor = [], None
        for f in sorted(inside):
            if anchor is None or abs(anchor - f[0]) > tol:
                rows.append([])
                anchor = f[0]
            rows[-1].append(f)
        parts = [[]]
        for row in rows:
            words = " ".join(f[2].strip() for f in sorted(row, key=lambda f: (f[3], f[1]))).strip().lower().split()
            if len(words) > 1 and words[0] in ("table", "figure", "fig.", "fig") and words[1][0].isdigit():
                parts.append([])
            else:
                parts[-1].append(row)
        for part in parts:
            if len(part) < 2:
                continue
            sizes = sorted(f[6] for row in part for f in row)
            least = max(3, max(4, sizes[len(sizes) // 2]) * 0.4)
            bounds = runs([r[1] for r in rules if r[0] == "v" and x0 - 2 <= r[1] <= x1 + 2 and max(r[2], r[4]) >= top - 2 and min(r[2], r[4]) <= bottom + 2], 3)
            split = None
            if len(bounds) < 3:
                data = [f for row in part if len(row) >= 2 for f in row]
                if not data:
                    continue
                xs = [x0 + k for k in range(int(x1 - x0) + 1)]
                free = [not any(f[3] - 0.5 <= x <= f[3] + f[5] + 0.5 for f in data) for x in xs]
                gaps, start = [], None
                for x, empty in zip(xs, free, strict=True):
                    if empty:
                        start = x if start is None else start
                    elif start is not None:
                        if x - start >= least:
                            gaps.append((start, x))
                        start = None
                if start is not None:
                    gaps.append((start, x1))
                left = gaps[0][1] if gaps and gaps[0][0] <= x0 + 1 else x0
                right = gaps[-1][0] if gaps and gaps[-1][1] >= x1 - 1 else x1
                inner = [g for g in gaps if g[0] > x0 + 1 and g[1] < x1 - 1]
                bounds = [left]
                for c in [*[(a + b) / 2 for a, b in inner], right]:
                    if abs(bounds[-1] - c) >= 1:
                        bounds.append(c)
                widths = [b - a for a, b in inner]
                if len(inner) >= 2 and max(widths) >= 2.5 * sorted(widths)[len(widths) // 2] and max(widths) >= 18:
                    i = len(widths) - 1 - widths[::-1].index(max(widths))
                    split = sum(inner[i]) / 2
            ranges = list(zip(bounds, bounds[1:], strict=False))
            if len(ranges) < 2:
                continue
            sides = [(ranges, None, None)]
            if split is not None:
                halves = [[c for c in ranges if c[1] <= split], [c for c in ranges if c[0] >= split]]
                if all(len(h) >= 2 for h in halves):
                    sides = [(halves[0], None, split), (halves[1], split, None)]
            for cols, low, high in sides:
                cells: dict = {}
                for i, row in enumerate(part):
                    for f in sorted(row, key=lambda f: (f[3], f[1])):
                        cx = f[3] + f[5] / 2
                        if (low is not None and cx < low) or (high is not None and cx >= high) or not f[2].strip():
                            continue
                        c = next((j for j, (a, b) in enumerate(cols) if a - 2 <= cx <= b + 2), None)
                        if c is None:
                            c = min(range(len(cols)), key=lambda j: (abs(sum(cols[j]) / 2 - cx), j))
                        cells.setdefault((i, c), []).append(f[2].strip())
                rows_left, cols_left = sorted({i for i, _ in cells}), sorted({c for _, c in cells})
                grid = [[" ".join(cells.get((i, c), [])) for c in cols_left] for i in rows_left]
                if len(grid) >= 2 and len(cols_left) >= 2 and sum(sum(1 for v in row if v) >= 2 for row in grid) >= 2:
                    found.append(grid)
    return found


def full(fs):
    return [(f[0], float(f[1]), float(f[2]), float(f[3] if len(f) > 3 else 10), float(f[4] if len(f) > 4 else 8)) for f in fs]


def h(y, a=0, b=120):
    return ("h", a, y, b, y)


def test_shapes_of_tables(spark):
    pages = {
        1: ([("Name", 5, 10), ("Score", 80, 10), ("Alice", 5, 26), ("90", 80, 26), ("Bob", 5, 36), ("75", 80, 36)], [h(0), h(20), h(50)]),
        2: ([(f"{c}{r}", x, y) for r, y in enumerate((10, 26, 36)) for c, x in (("a", 10), ("b", 60), ("c", 250), ("d", 300))], [h(0, 0, 360), h(20, 0, 360), h(50, 0, 360)]),
        3: ([("A", 10, 10), ("B", 70, 10), ("C", 10, 30), ("D", 70, 30)], [h(0), h(20), h(50), *[("v", x, 0, x, 50) for x in (0, 60, 61, 120)]]),
        4: ([("Table", 5, 8, 20), ("2:", 30, 8), ("k", 5, 20), ("v", 80, 20), ("a", 5, 32), ("1", 80, 32), ("Figure 3 x", 5, 44, 50), ("p", 5, 56), ("q", 80, 56), ("r", 5, 68), ("s", 80, 68)], [h(0), h(80)]),
        5: ([("x", 5, 10), ("y", 80, 10)], [h(0), h(50)]), 6: ([("prose only", 5, y, 110) for y in (5, 15, 25, 35)], [h(0), h(50)]), 7: ([("a", 5, 10), ("b", 80, 10), ("c", 5, 30), ("d", 80, 30)], [h(0), h(1)]), 8: ([("a", 1, 1)], []),
    }
    got = grids(tables.detect_tables(*frames(spark, pages)))
    assert got == {(1, 0): [["Name", "Score"], ["Alice", "90"], ["Bob", "75"]], (2, 0): [[f"a{i}", f"b{i}"] for i in range(3)], (2, 1): [[f"c{i}", f"d{i}"] for i in range(3)], (3, 0): [["A", "B"], ["C", "D"]], (4, 0): [["k", "v"], ["a", "1"]], (4, 1): [["p", "q"], ["r", "s"]]}


def test_tables_equal_the_plain_reckoning(spark):
    rng, pages = random.Random(5), {}
    for d in range(60):
        at = sorted(rng.sample(range(0, 300, 25), rng.randrange(2, 6)))
        frags = [(rng.choice(["a", "bb", "", "Table 4", "7", " w "]), x + rng.choice([0, 0, 0, 3, 11]), 10 + 12 * r + rng.choice([0, 0, 1, 4]), rng.choice([6, 10, 10, 22]), rng.choice([8, 8, 8, 12])) for r in range(rng.randrange(2, 9)) for x in at if rng.random() < 0.85]
        rules = [h(y, 0, 330) for y in (0, 60, 118)] + [("v", x, 0, x, 118) for x in rng.choice([[], [], [0, 90, 330], [0, 330]])]
        pages[d] = (frags, rules)
    got = grids(tables.detect_tables(*frames(spark, pages)))
    want = {(d, i): g for d, (fs, rs) in pages.items() for i, g in enumerate(plain_tables(full(fs), rs))}
    assert len(want) > 30 and got == want


def test_no_fragments(spark):
    frags, rules = frames(spark, {1: ([("a", 1, 1)], [h(0)])})
    assert tables.detect_tables(frags.limit(0), rules.limit(0)).count() == 0
    assert merge_positional_accents(frags.limit(0)).count() == 0


def plain_accents(frags):
    frags, gone = [list(f) for f in frags], set()
    for i, (t, x, y, w, _) in enumerate(frags):
        mark = MARKS.get((t or "").strip())
        if not mark:
            continue
        best = None
        for j, (bt, bx, by, bw, size) in enumerate(frags):
            bt = (bt or "").strip()
            if j == i or not bt or all(c in MARKS for c in bt) or not bx - 1 <= x + w / 2 <= bx + bw + 1 or not by - size <= y <= by + 0.3 * size:
                continue
            if best is None or abs(by - y) < best[0]:
                best = (abs(by - y), j)
        if best:
            text, bx, bw = frags[best[1]][0], frags[best[1]][1], frags[best[1]][3]
            at = int((x + w / 2 - bx) // max(0.1, bw / len(text)))
            for k in (at + d for d in NEARBY):
                if 0 <= k < len(text) and text[k].isalpha() and len(c := unicodedata.normalize("NFC", text[k].replace("ı", "i") + mark)) == 1:
                    frags[best[1]][0] = text[:k] + c + text[k + 1:]
                    gone.add(i)
                    break
    return {i: f[0] for i, f in enumerate(frags) if i not in gone}


def test_accents_join_their_letters(spark):
    rng, pages = random.Random(8), {1: ([("´", 20, 96, 4), ("cafe", 0, 100, 40, 12), ("¨", 31, 97, 2), ("´", 300, 96, 4), ("xyz", 0, 300, 30, 12), ("´", 11, 298, 3), (None, 0, 100, 40, 12), ("`´", 0, 100, 40, 12)], [])}
    for d in range(2, 30):
        pages[d] = ([(rng.choice(["´", "¨", "~", "cafe", "naıve", "x1", "`", "  ", "Äo"]), rng.randrange(0, 60), rng.randrange(0, 40), rng.choice([4, 20, 30]), rng.choice([8, 12])) for _ in range(rng.randrange(2, 25))], [])
    frags, _ = frames(spark, {**pages, 99: ([("a", 0, 0)], [h(0)])})
    got: dict = {}
    for r in merge_positional_accents(frags).filter("doc_id < 99").collect():
        got.setdefault(r["doc_id"], {})[r["frag_idx"]] = r["text"]
    assert got == {d: plain_accents(full(fs)) for d, (fs, _) in pages.items()}
    assert got[1][1] == "cáfë" and got[1][3] == "´" and got[1][4] == "xýz"  # f has no acute form, so the letter before it has it
