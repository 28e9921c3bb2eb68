"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: a node is the path of tags
and first classes from the root, with the zone that markup gives it. Its presentation
importance is the entropy of the child sequences that the host's pages show there, and its
content importance is one less the mean entropy, over the host's pages, of the texts found
there, both with logarithms to the base of the number of pages. Text that stands on every
page of a host has importance near 0, text of its own page 1. The two are weighted with
GAMMA by the number of child sequences. Copies of a page count once, and every node has
PRIOR_PAGES more pages of importance 1, as few pages say little about repetition.

Markup is a prior: the importance is multiplied by PRIOR of the node's zone. Zones are
boilerplate (branches under nav, footer, form, script and the like, or with class, id or
role words such as ad, cookie, sidebar or comments), what stands outside of the articles
or main part of a page that marks some, other unmarked text, main parts and articles.
Nodes below LEAST are removed; of one in a main part or article only the texts that stand
on more than one page of the host, so that a page's own text is kept.

Blocks are divided at block-level tags; br is white space. References are decoded, white
space inside a block becomes one space, and blocks are joined in page order by two
newlines. A null html or one without text gives an empty text. Broken markup is read
leniently: unclosed tags end with their parent, stray end tags are ignored. A null url
is a host of its own. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch

GAMMA = 0.9
LEAST = 0.3
#: Pages of importance 1 that every node is taken to have beside its own.
PRIOR_PAGES = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select textarea dialog menu title object canvas audio video".split()
)
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert"
    " newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments"
    " discussion disqus replies respond share sharing social related recommended popup modal widget masthead toolbar pagination contentinfo"
    " complementary search dialog".split()
)
HEADER_WORDS = frozenset("header topbar".split())
MAIN_WORDS = frozenset("main article post entry story".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
STOPS = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote".split())
BOILER, OUTSIDE, OTHER, MAIN, ARTICLE = range(5)
#: What markup leaves of the importance of a node, by zone.
PRIOR = (0.25, 0.25, 1.0, 1.0, 1.0)


def _key(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("/".join(parts)) - (1 << 63)


class Tree:
    """Open elements while one page is read: tag, style, zone; and the blocks found."""

    def __init__(self):
        self.open: list[tuple[str, str, int]] = []
        self.blocks: list[tuple[int, int, str]] = []  # path, zone, text
        self.children: dict[tuple[int, int], list[str]] = {}  # child styles by path and zone
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                zone = self.open[-1][2] if self.open else OTHER
                self.blocks.append((self.path(), zone, text))

    def path(self) -> int:
        return _key([x[1] for x in self.open if x[0] not in INLINE])

    def close(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1):  # what this tag ends without an end tag
                name = self.open[k][0]
                if name in CLOSES.get(tag, ("p",) if tag in STOPS else ()):
                    del self.open[k:]
                elif name in STOPS:
                    break
        zone = self.open[-1][2] if self.open else OTHER
        style = tag
        if zone != BOILER:
            words: set[str] = set()
            if attrs:
                for m in NAMED.finditer(attrs):
                    found = WORD.findall((m[2] or m[3] or m[4] or "").lower())
                    if m[1].lower() == "class" and found and style == tag:
                        style = f"{tag}.{found[0]}"
                    words.update(found)
            if tag in BOILER_TAGS or (words and words & BOILER_WORDS and tag not in ("html", "body", "article", "main")) or (
                tag == "article" and words & {"comment", "comments", "ad", "advert", "sponsored"}
            ) or (zone < MAIN and (tag == "header" or words & HEADER_WORDS) and tag not in ("html", "body", "article", "main")):
                zone = BOILER
            elif tag == "article":
                zone = ARTICLE
            elif zone < MAIN and (tag == "main" or (tag in ("div", "section") and words & MAIN_WORDS)):
                zone = MAIN
        if tag not in INLINE:
            self.children.setdefault((self.path(), self.open[-1][2] if self.open else OTHER), []).append(style)
        if tag not in VOID:
            self.open.append((tag, style, zone))


def blocks(html: str) -> tuple[list[tuple[int, int, str]], dict[int, list[str]]]:
    """(node, zone, text) of every text block in page order, and the child styles of every node."""
    found, children = _read(html)
    marked = max((z for _, z, _ in found), default=BOILER) >= MAIN
    zone = lambda z: OUTSIDE if marked and z == OTHER else z
    node = lambda p, z: _key([str(p), str(zone(z))])
    return [(node(p, z), zone(z), t) for p, z, t in found], {node(p, z): c for (p, z), c in children.items()}


def _read(html: str) -> tuple[list[tuple[int, int, str]], dict[tuple[int, int], list[str]]]:
    tree, at, n = Tree(), 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            tree.text.append(html[at:])
            break
        if m.start() > at:
            tree.text.append(html[at : m.start()])
        at, tag = m.end(), m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                tree.text.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in INLINE:
                tree.close(tag) if any(x[0] == tag for x in tree.open[-8:]) else None
            else:
                tree.flush()
                tree.close(tag)
            continue
        if tag == "br":
            tree.text.append(" ")
        tree.start(tag, m["attrs"])
        if tag in RAW and not m["attrs"].endswith("/"):
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            tree.close(tag)
            at = end.end() if end else n
    tree.flush()
    return tree.blocks, tree.children


def host_of(url: str | None) -> str | None:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else None


PARSED = "row long, page_id long, url string, host string, digest binary, blocks array<struct<path:long,zone:int,text:string,h:long>>, seen array<struct<path:long,kind:int,h:long>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [
        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(),
        pa.list_(pa.struct([("path", pa.int64()), ("zone", pa.int32()), ("text", pa.string()), ("h", pa.int64())])),
        pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("h", pa.int64())])),
    ]
    names = ["row", "page_id", "url", "host", "digest", "blocks", "seen"]
    for batch in batches:
        rows = []
        for row, page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            found, children = blocks(html or "")
            found = [(p, z, t, xxhash.xxh64_intdigest(t) - (1 << 63)) for p, z, t in found]
            seen = {(p, 0, z) for p, z, *_ in found} | {(p, 1, h) for p, _, _, h in found}
            seen |= {(p, 2, _key(c)) for p, c in children.items()}
            kept = [{"path": p, "zone": z, "text": t, "h": h} for p, z, t, h in found]
            seen = [{"path": p, "kind": k, "h": h} for p, k, h in sorted(seen)]
            rows.append((row, page_id, url, host_of(url), xxhash.xxh3_128_digest(html or ""), kept, seen))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _counts(parsed: DataFrame) -> DataFrame:
    """(host, path, kind, h, k): on how many distinct pages of its host each thing was seen."""
    once = parsed.groupBy("host", "digest").agg(F.first("seen").alias("seen"))
    return once.select("host", F.explode("seen").alias("s")).groupBy("host", "s.path", "s.kind", "s.h").agg(F.count("*").alias("k"))


def node_importance(parsed: DataFrame) -> DataFrame:
    """(host, path, zone, importance) of the style nodes that hold text."""
    return _importance(_counts(parsed))


def _importance(count: DataFrame) -> DataFrame:
    log = lambda x: F.log(x.cast("double"))
    k, kind = F.col("k"), F.col("kind")
    node = count.groupBy("host", "path").agg(
        F.max(F.when(kind == 0, k)).alias("m"), F.max(F.when(kind == 0, F.col("h"))).alias("zone"),
        F.sum(F.when(kind == 1, log(k))).alias("text_logs"), F.sum(F.when(kind == 1, 1)).alias("texts"),
        F.sum(F.when(kind == 2, k)).alias("shown"), F.sum(F.when(kind == 2, k * log(k))).alias("k_logs"), F.sum(F.when(kind == 2, 1)).alias("sequences"),
    )
    m = F.col("m")
    content = F.coalesce(1 - F.col("text_logs") / F.when(m > 1, F.col("texts") * log(m)), F.lit(1.0))  # one page shows no repetition
    # entropy of the child sequences; a node without children shows one way only
    shape = F.coalesce((log(F.col("shown")) - F.col("k_logs") / F.col("shown")) / F.when(F.col("shown") > 1, log(F.col("shown"))), F.lit(0.0))
    share = F.pow(F.lit(GAMMA), F.coalesce(F.col("sequences"), F.lit(1)).cast("double"))
    own = (m * (share * content + (1 - share) * shape) + PRIOR_PAGES) / (m + PRIOR_PAGES)
    prior = F.element_at(F.array(*(F.lit(x) for x in PRIOR)), F.col("zone").cast("int") + 1)
    return node.where("m IS NOT NULL").select("host", "path", "zone", (prior * own).alias("importance"))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    scratch = Scratch(spark, "html")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parsed = scratch.cut(rows.mapInArrow(_parse, PARSED), "parsed")
    count = scratch.cut(_counts(parsed), "count")
    poor = _importance(count).where(F.col("importance") < LEAST)
    poor = scratch.cut(poor.select(F.col("host").alias("poor_host"), F.col("path").alias("poor_path"), "zone"), "poor")
    at = lambda host, path: F.col("host").eqNullSafe(F.col(host)) & (F.col("path") == F.col(path))
    shared = count.where("kind = 1 AND k > 1").join(poor.where(F.col("zone") >= MAIN), at("poor_host", "poor_path"))
    shared = scratch.cut(shared.select("poor_host", "poor_path", F.col("h").alias("poor_h")), "shared")
    scratch.drop(count)

    # what each page loses: whole nodes, and shared texts of nodes in marked parts
    seen = parsed.select("row", "host", F.explode("seen").alias("s")).select("row", "host", "s.*")
    nodes = seen.where("kind = 0").join(poor.where(F.col("zone") < MAIN), at("poor_host", "poor_path"))
    texts = seen.where("kind = 1").join(shared, at("poor_host", "poor_path") & (F.col("h") == F.col("poor_h")))
    lost = nodes.select("row", "path", F.lit(None).cast("long").alias("h")).unionByName(texts.select("row", "path", "h"))
    lost = scratch.cut(lost.groupBy("row").agg(F.collect_list(F.struct("path", "h")).alias("lost")), "lost")
    gone = lambda b: F.exists("lost", lambda x: (x["path"] == b["path"]) & (x["h"].isNull() | (x["h"] == b["h"])))
    keep = F.filter("blocks", lambda b: F.col("lost").isNull() | ~gone(b))
    text = F.array_join(F.transform(keep, lambda b: b["text"]), "\n\n")
    judged = parsed.select("row", "page_id", "url", "blocks").join(lost, "row", "left")
    return judged.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
