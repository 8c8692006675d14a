from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.llm import html_tree, media
from docframe.llm import progressive_jpeg as jpeg

PAGES = "page_id long, url string, html string, text string, host string, salt int"


def page(i, body, host="a.example"):
    return (i, f"https://{host}/{i}", f"<!DOCTYPE html><html><head><title>t</title><script>x('</p>')</script></head><body>{body}</body></html>", "x", "x", 0)


def test_article_without_what_is_not_its_text(spark):
    body = '<header>H</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">n</div><article><h1>T &amp; t</h1><p>a  <b>b</b> c<br>d<p>e&nbsp;f<form>g</form><aside>h</aside><section class="comments"><p>i</p></section><!-- j --></article><div id="sidebar">k</div><footer>l'
    rows = spark.createDataFrame([page(1, body), (2, None, None, "", "", 0), (3, "::bad", "", "", "", 0), page(1, body), page(4, "<p>plain</p>text"), (5, "https://b.example/", '<html><head><title>no end<style>p{}</style><body><div class="header">top</div><article class="has-comments"><header><h1>In</h1></header><p>text', "", "", 0)], PAGES)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_tree.extract_main_text(rows).collect())
    text = "T & t\na b c d\ne f"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "plain\ntext", 10), (5, "In\ntext", 7)]
    assert html_tree.extract_main_text(rows.limit(0)).isEmpty()


def test_branch_that_recurs_on_a_host_goes(spark):
    rows = [page(i, f'<main><div class="intro"><p>Welcome to our site</p></div><p>story {i} begins</p><p>and {i * 7} ends</p></main>') for i in range(20)]
    rows += [page(100 + i, '<main><div class="intro"><p>Welcome to our site</p></div><p>the same story</p></main>', "copies.example") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_tree.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "story 3 begins\nand 21 ends"
    assert got[105] == "Welcome to our site\nthe same story"  # copies are one page, which tells nothing


def test_real_pages(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_tree.extract_main_text(rows).collect()}
    for r in rows.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**31), st.sampled_from([0.0, 0.02, 0.3, 0.8, 1.0]), st.sampled_from([1, 2, 3, 20, 151]))
def test_coefficients_come_back(mcus, seed, density, most):
    rng = np.random.default_rng(seed)
    image = np.where(rng.random((mcus, 6, 64)) < density, rng.integers(-min(most, 104), most + 1, (mcus, 6, 64)), 0)
    (blocks, (wide, high), comment), *_ = jpeg.decode_images(jpeg.encode_images([image, image[:1]], [b"7", b"8"]))
    assert (blocks == image).all() and wide * high == mcus and comment == b"7"


def test_scans_are_progressive():
    file = jpeg.encode_images([np.ones((2, 6, 64), np.int16)], [b""])[0]
    parsed = jpeg._Parsed(file)
    heads = [(key[0], key[1], key[2], key[3]) for key, _ in parsed.scans]
    assert file[:2] == b"\xff\xd8" and b"\xff\xc2" in file and heads[0] == ((1, 2, 3), 0, 0, 0x01) and ((1,), 6, 63, 0x01) in heads and ((1,), 1, 63, 0x10) in heads and heads[-1] == ((1, 2, 3), 0, 0, 0x10)
    with pytest.raises(ValueError):
        jpeg.decode_images([b"nothing"])


def test_inverse_transform_against_its_definition():
    blocks = np.random.default_rng(1).integers(-90, 90, (1, 6, 64))
    rgb = jpeg.to_rgb(blocks)
    plain = np.zeros(64)
    plain[jpeg.ZIGZAG] = blocks[0, 0]
    cos = lambda x, u: (8**-0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    want = [[sum(plain[v * 8 + u] * cos(y, v) * cos(x, u) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    luma = np.clip(np.array(want) + 128, 0, 255)
    got = rgb[0, :8, :8].astype(float) @ [0.299, 0.587, 0.114]
    inside = (rgb[0, :8, :8].min(axis=2) > 0) & (rgb[0, :8, :8].max(axis=2) < 255)
    assert np.abs(got - luma)[inside].max(initial=0) < 2.5


def test_media_rows(spark, odd, empty, tmp_path):
    media.store(odd).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    got = media.read(stored).collect()
    want = {}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] = r["text"] or ""
    assert len(got) == odd.count() and {(r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got} == set(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in got)
    assert media.read(media.store(empty)).isEmpty()
