"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements (tag, first class, and whether its name speaks of a
menu, a notice, an advert or the like), and keeps how many different pages have it, its presentations (sequences of children, repeats as one) and its
contents (texts, and how much of them is links). All branches are in the tree, menus and footers too.

Importance of a node, with m different pages of the host and L = log(m + EVIDENCE):
    presentation  entropy of the node's presentations, as a share of L;
    content       mean over all characters under the node of (1 - entropy over pages of their text / L) * (1 - share in links);
    composite     prior * ((1 - DAMP^l) * presentation + DAMP^l * content), l being the number of presentations.
The prior is 1, and `prior` for nodes whose tag, role or class names noise on any site. Branches of a composite importance below
LEAST leave every page of the host. A text that is on all pages of a large host has a content importance of almost 0; few pages give little
evidence, as L is then above any entropy. A menu is all links, on one page as on many.

If a page has an article (or main) element with text, only text in it counts. Inside of it names are no prior, but for whole class names of
adverts and reader comments. Scripts, styles, hidden elements and the like are no content in HTML. Copies of a page count once. A page
that would lose all its text keeps what has no prior.

Each page is parsed once, into a row of blocks that is written to the shared folder; all statistics are sums over hashes, so no
task ever holds a host. Nodes deeper than DEEP differing levels belong to their ancestor there; runs of equal nested elements are one level;
parsing itself has no depth limit.

Defined cases: a null or empty html has the text ''; a null url belongs to the host ''; repeated pages give
repeated rows; an empty table gives an empty table; other columns of the input are ignored; very long html is one row, held once by its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import materialize

DAMP, LEAST, EVIDENCE, PRIOR, SALTS = 0.9, 0.15, 4, 0.1, 16
DEEP = 64

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_NO_CONTENT = frozenset("head script style noscript template iframe svg canvas object audio video map textarea".split())
_NOISE_TAGS = frozenset("nav footer aside form button select dialog menu".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense announcement aside banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus foot footer footers gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_NOISE_IN_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments replies sponsored".split())
_STATES = ("has-", "no-", "with-", "without-", "is-")
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_CLOSES_P = _BLOCK - {"option", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display:none|visibility:hidden")


class _Open:
    """An open element. box: it holds texts of its own; branch: ids of the tree's nodes from its box up to the root; kids: its presentation so far."""

    __slots__ = ("tag", "branch", "key", "noise", "article", "link", "silent", "box", "kids", "text", "linked")

    def __init__(self, tag: str, branch: tuple[int, ...], key: str, *, noise: bool = False, article: bool = False, link: bool = False, silent: bool = False, box: bool = False):
        self.tag, self.branch, self.key, self.noise, self.article, self.link, self.silent, self.box = tag, branch, key, noise, article, link, silent, box
        self.kids: list[str] = []
        self.text: list[str] = []
        self.linked = 0


class PageTree(HTMLParser):
    """Blocks of a page in order, as (branch, inside an article, noise by name, text, characters in links), and the presentations of each node."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple[int, ...], bool, bool, str, int]] = []
        self.shapes: Counter[tuple[int, int]] = Counter()
        root = _Open("", (0,), "", box=True)
        self._stack, self._boxes, self._open = [root], [root], Counter()
        self.feed(html)
        self.close()
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        box = self._boxes[-1]
        text = " ".join("".join(box.text).split())
        if text:
            self.blocks.append((box.branch, box.article, box.noise, text, min(len(text), box.linked)))
        box.text, box.linked = [], 0

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open[node.tag] -= 1
        if node.box:
            self._flush()
            self.shapes[node.branch[0], xxhash.xxh64_intdigest(" ".join(node.kids)) >> 1] += 1
            self._boxes.pop()

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        if not any(self._open[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k].tag
            if tag in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self._boxes[-1].text.append(" ")
            return
        given = dict(attrs)
        marks = [m for m in f"{given.get('class') or ''} {given.get('id') or ''}".lower().split() if not m.startswith(_STATES)]
        names = [n for m in marks for n in re.split(r"[^a-z0-9]+", m) if n]
        if tag in ("article", "main") and not _NOISE_NAMES.intersection(names):
            while self._stack[-1].noise:  # an unclosed menu does not swallow the article
                self._pop()
        block = tag in _BLOCK
        if block:
            self._flush()
            self._close(("head",))
            if tag in _CLOSES_P:
                self._close(("p",), ("table", "td", "th", "li", "blockquote", "div", "article", "section"))
            if tag in _SIBLINGS:
                self._close(_SIBLINGS[tag], _SCOPES[tag])
        if tag in _VOID:
            return
        top, box = self._stack[-1], self._boxes[-1]
        role, style = (given.get("role") or "").lower(), (given.get("style") or "").replace(" ", "").lower()
        if top.article:
            named = tag not in _PROSE and bool(_NOISE_IN_ARTICLE.intersection(marks))
        else:
            named = tag == "header" or tag not in ("html", "body") and ("header" in names or bool(_NOISE_NAMES.intersection(names)))
        noise = named or tag in _NOISE_TAGS or role in _NOISE_ROLES
        silent = top.silent or tag in _NO_CONTENT or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(style))
        key, branch = box.key, box.branch
        if block or noise:  # noise within a line is a branch of its own
            key = tag + (f".{names[0]}" if names and given.get("class") else "") + "!" * noise
            if not box.kids or box.kids[-1] != key:
                box.kids.append(key)
            if key != box.key and (len(branch) < DEEP or noise and not top.noise):
                branch = (xxhash.xxh64_intdigest(f"{branch[0]}/{key}") >> 2 << 1 | (top.noise or noise), *branch)
        if not block and (noise or silent):
            box.text.append(" ")
        opened = _Open(tag, branch, key, noise=top.noise or noise, article=top.article or tag in ("article", "main") or role == "main", link=top.link or tag == "a", silent=silent, box=block or noise)
        self._open[tag] += 1
        self._stack.append(opened)
        if opened.box:
            self._boxes.append(opened)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _VOID:
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        top, box = self._stack[-1], self._boxes[-1]
        if not top.silent:
            box.text.append(data)
            if top.link:
                box.linked += len(data.strip())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def _list(**fields: pa.DataType) -> pa.ListType:
    return pa.list_(pa.struct(list(fields.items())))


_CHARS_AT_ONCE = 4_000_000
_INT, _LONG = pa.int32(), pa.int64()
_ARROW = pa.schema({
    "page_id": _LONG, "url": pa.string(), "host": pa.string(), "page": _LONG, "nodes": pa.list_(pa.list_(_LONG)),
    "blocks": _list(node=_INT, article=pa.bool_(), noise=pa.bool_(), text=pa.string()),
    "texts": _list(node=_INT, feature=_LONG, uses=_INT, chars=_LONG, plain=pa.float64()), "shapes": _list(node=_LONG, feature=_LONG, uses=_INT),
})
PARSED = "page_id long, url string, host string, page long, nodes array<array<long>>, blocks array<struct<node:int,article:boolean,noise:boolean,text:string>>, texts array<struct<node:int,feature:long,uses:int,chars:long,plain:double>>, shapes array<struct<node:long,feature:long,uses:int>>"


def _parsed_row(page_id: int | None, url: str | None, html: str | None) -> dict:
    """nodes: the branches that hold texts; texts: each node's different texts, with how often, their characters and those outside links; shapes: presentations."""
    tree = PageTree(html or "")
    place: dict[tuple[int, ...], int] = {}
    blocks, texts = [], {}
    for branch, article, noise, text, linked in tree.blocks:
        node = place.setdefault(branch, len(place))
        feature = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
        blocks.append({"node": node, "article": article, "noise": noise, "text": text})
        held = texts.setdefault((node, feature), [0, 0, 0.0])
        held[0] += 1
        held[1] += len(text)
        held[2] += len(text) - linked
    page = xxhash.xxh64_intdigest("\n".join(str(f) for _, f in texts)) >> 1
    return {
        "page_id": page_id, "url": url, "host": host_of(url), "page": page, "nodes": [list(b) for b in place], "blocks": blocks,
        "texts": [{"node": n, "feature": f, "uses": u, "chars": c, "plain": p} for (n, f), (u, c, p) in texts.items()],
        "shapes": [{"node": n, "feature": f, "uses": u} for (n, f), u in tree.shapes.items()],
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """A row for each page, PARSED. Ids of nodes are hashes of their paths; a noise node's own id is odd, all others' even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                rows.append(_parsed_row(page_id.as_py(), url.as_py(), html.as_py()))
                held += len(html.as_py() or "")
                if held > _CHARS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, PARSED)


def importance(parsed: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, node, parent, importance of each node of each host's tree that has text under it. parsed: as parse_pages() gives it."""
    of_page = ["host", "page", "node", "feature"]
    texts = parsed.select("host", "page", "nodes", F.explode("texts").alias("t")).select("host", "page", F.expr("nodes[t.node][0]").alias("node"), "t.feature", "t.uses", "t.chars", "t.plain").dropDuplicates(of_page)
    by_text = texts.groupBy("host", "node", "feature").agg(F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.log("uses")).alias("weighted"), F.sum("chars").alias("chars"), F.sum("plain").alias("plain"))
    entropy = F.log("uses") - F.col("weighted") / F.col("uses")
    own = by_text.groupBy("host", "node").agg(F.sum("chars").alias("chars"), F.sum("plain").alias("plain"), F.sum(F.col("plain") * entropy).alias("spread"))
    branches = parsed.select("host", F.explode("nodes").alias("branch")).select("host", F.col("branch")[0].alias("node"), "branch").groupBy("host", "node").agg(F.first("branch").alias("branch"))
    above = own.join(branches, ["host", "node"]).select("host", F.posexplode("branch").alias("i", "node"), F.expr("get(branch, i + 1)").alias("parent"), "chars", "plain", "spread")
    # each node hands its sums to all its ancestors: a row for each level
    nodes = above.groupBy("host", "node", "parent").agg(F.sum("chars").alias("chars"), F.sum("plain").alias("plain"), F.sum("spread").alias("spread"))
    shapes = parsed.select("host", "page", F.explode("shapes").alias("s")).select("host", "page", "s.*").dropDuplicates(of_page)
    shapes = shapes.groupBy("host", "node", "feature").agg(F.sum("uses").alias("uses")).groupBy("host", "node").agg(F.count("*").alias("kinds"), F.sum("uses").alias("seen"), F.sum(F.col("uses") * F.log("uses")).alias("seen_weighted"))
    pages = parsed.groupBy("host").agg(F.log(F.countDistinct("page") + EVIDENCE).alias("scale"))
    both = nodes.join(shapes, ["host", "node"]).join(pages, "host")
    presentation = F.least(F.lit(1.0), (F.log("seen") - F.col("seen_weighted") / F.col("seen")) / F.col("scale"))
    content = F.greatest(F.lit(0.0), (F.col("plain") - F.col("spread") / F.col("scale")) / F.col("chars"))
    damped = F.pow(F.lit(DAMP), F.col("kinds"))
    named = F.when(F.col("node").bitwiseAND(F.lit(1)) == 1, prior).otherwise(1.0)
    return both.select("host", "node", "parent", (named * ((1 - damped) * presentation + damped * content)).alias("importance"))


def site_rules(parsed: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, low: ids of its topmost branches of low importance. A row for each host that has at least one; 8 bytes for each branch."""
    low = importance(parsed, prior).filter((F.col("importance") < LEAST) & (F.col("node") != 0)).select("host", "node", "parent")
    top = low.join(low.select("host", F.col("node").alias("parent")), ["host", "parent"], "left_anti")
    return top.groupBy("host").agg(F.collect_list("node").alias("low"))


def extract_main_text(pages: DataFrame, *, prior: float = PRIOR) -> DataFrame:
    """page_id, url, text, n_chars. prior: what the importance of nodes with a name of noise is multiplied by; 1 leaves all to the tree."""
    parsed = materialize(parse_pages(pages), "site-pages")
    rules = materialize(site_rules(parsed, prior), "site-rules")
    # each rule is copied to SALTS keys, so that a host with a third of all pages is dealt to many tasks
    rules = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    bad = F.transform("nodes", lambda n: F.coalesce(F.arrays_overlap(n, F.col("low")), F.lit(False)))
    article = F.exists("blocks", lambda b: b["article"] & ~b["noise"])
    kept = F.filter("blocks", lambda b: ~F.get(F.col("bad"), b["node"]) & (b["article"] | ~F.col("has_article")))
    plain = F.filter("blocks", lambda b: ~b["noise"] & (b["article"] | ~F.col("has_article")))
    rows = parsed.select("page_id", "url", "host", "nodes", "blocks", F.pmod(F.xxhash64("page_id", "page"), F.lit(SALTS)).cast("int").alias("salt")).join(rules, ["host", "salt"], "left")
    rows = rows.withColumns({"bad": bad, "has_article": article}).withColumn("kept", kept)
    rows = rows.withColumn("main", F.when(F.size("kept") > 0, F.col("kept")).otherwise(plain))
    text = F.array_join(F.transform("main", lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
