"""Main text of web pages by paths that a host's pages agree on.

Pass 1 parses each page, scores its containers by the text that stands in their blocks outside links, and votes
for the best by their generalised path of tags and classes. Spark adds up votes for each host and path. Pass 2 parses the
page again and takes the text of the first of its host's paths that it has. In both, what stands around the best
container wins where it holds more of the article: an article element always, others by their text outside links.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

TOKEN = re.compile(r"""<(?:(?P<note>!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>)""", re.S)  # a quote opens a value only behind =
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NOTE = re.compile("<[!?]")
ROOT = "#"  # the path of the page itself
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text.
OPAQUE = frozenset("script style noscript template svg iframe object select textarea button canvas audio video math title head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
FOREIGN = ("svg", "math")  # inside them a slash ends an element
BARE_SLASH = re.compile(r"=\s*[^\s\"'=<>]+/$")  # a slash that belongs to a value
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What may hold an article, in place of being one of its blocks.
CONTAINER = frozenset("article body center div fieldset figure main section table tbody td html".split())
ASIDE = frozenset("nav aside footer form dialog menu".split())
CLOSES_P = BLOCK - frozenset("html body head option optgroup td th tr tbody thead tfoot caption".split())
#: start tag -> open elements that it ends, up to an element that stops the search
ENDS = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Words of class, id or role that mark what surrounds an article.
HINTS = frozenset("ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
#: Of them, those of readers' words, which may be longer than the article.
TALK = frozenset("comment comments discussion disqus replies reply respond".split())
#: And those of notices, which may be longer than a brief article.
NOTICES = frozenset("alert consent cookie cookies gdpr notice notices notification popup".split())
#: Beside one of these, a header is the article's own.
TITLED = frozenset("article entry headline post story".split())
HINT_FREE = frozenset("html body article main h1 h2 h3 h4 h5 h6 p b i em strong span a".split())
PATHS = 5


class Page:
    """Elements as parallel lists (parent before child), and blocks of text in page order. An element's path is a hash of the path
    around it and its own step, so that deep pages take no more memory than flat ones."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.out = ["#"], [-1], [ROOT], [False]
        # nearest block around; nearest open p that a new block ends; place in the stack
        self.near_block, self.near_p, self.depth = [0], [0], [0]
        self.hints: list[frozenset[str]] = [frozenset()]
        self.blocks: list[list] = []  # [element, parts, characters in links]; while parsing, parts are (element, text, in a link)
        self._parse(source)
        self._weigh()

    def _parse(self, source: str) -> None:
        stack, links, at, n = [0], 0, 0, len(source)
        last = source.rfind(">") + 1  # no tag ends behind it
        places: dict[str, list[int]] = defaultdict(list)  # tag -> its places in the stack, going up
        block: list | None = None

        def text(piece: str) -> None:
            nonlocal block
            if not piece or self.out[stack[-1]]:
                return
            if block is None:
                if piece.isspace():
                    return
                block = [self.near_block[stack[-1]], []]
                self.blocks.append(block)
            piece = html.unescape(piece) if "&" in piece else piece
            block[1].append((stack[-1], piece, links > 0))

        def close(k: int) -> None:
            nonlocal block, links
            for e in stack[k:]:
                links -= self.tag[e] == "a"
                places[self.tag[e]].pop()
                if self.tag[e] in BLOCK:
                    block = None
            del stack[k:]

        while at < n:
            m = TOKEN.search(source, at, last)
            if m is None:
                note = NOTE.search(source, max(at, last))  # one without an end
                text(source[at : note.start() if note else n])
                break
            text(source[at : m.start()])
            at = m.end()
            if m["note"]:
                if m["note"].startswith("!--") and not m["note"].endswith("-->"):
                    break
                continue
            tag = m["tag"].lower()
            if m["end"]:
                if places[tag]:
                    close(places[tag][-1])
                continue
            attrs = m["attrs"]
            foreign = [places[f][0] for f in FOREIGN if places[f]]
            if foreign and tag in BLOCK and not places["foreignobject"]:
                close(min(foreign))  # a block ends a drawing that was left open
                foreign = []
            if attrs.endswith("/") and (foreign or tag in OPAQUE) and not BARE_SLASH.search(attrs):
                continue
            if tag in CLOSES_P and (p := self.near_p[stack[-1]]):
                close(self.depth[p])
            if tag in ENDS:
                what, stop = ENDS[tag]
                at_most = max((places[t][-1] for t in stop if places[t]), default=0)
                inside = (places[t] for t in what if places[t] and places[t][-1] > at_most)
                if ended := min((p[bisect_right(p, at_most)] for p in inside), default=0):
                    close(ended)
            if tag in BLOCK:
                block = None
            elif tag == "br":
                text(" ")
            if tag in VOID:
                continue
            places[tag].append(len(stack))
            self._open(tag, attrs, stack, bool(places["article"] or places["main"]))
            links += tag == "a"
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at, max(at, last))
                if end is None:
                    at = n
                else:
                    at = end.end()
                close(len(stack) - 1)

    def _open(self, tag: str, attrs: str, stack: list[int], in_article: bool) -> None:
        up = stack[-1]
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if "=" in attrs else {}
        hints = {tag} if tag in ASIDE else set()
        if tag == "header" and not in_article:
            hints.add("header")
        if found and tag not in HINT_FREE:
            names = {w for v in found.values() for w in re.split(r"[^a-z]+", v.lower())}
            if names & HINTS:
                hints |= names & (HINTS | TITLED)
        # generalised: classes in order, numbers taken out
        names = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
        e = len(self.tag)
        self.depth.append(len(stack))
        self.near_block.append(e if tag in BLOCK else self.near_block[up])
        self.near_p.append(e if tag == "p" else 0 if tag in CONTAINER else self.near_p[up])
        stack.append(e)
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(xxhash.xxh64_hexdigest(f"{self.path[up]}>{'.'.join([tag, *names])}") if tag in BLOCK else self.path[up])
        self.out.append(self.out[up] or tag in OPAQUE)
        self.hints.append(frozenset(hints))

    def _weigh(self) -> None:
        """Sets out what hints mark, but for what holds (nearly) the whole page or is the article's header; all that is
        left without any text so is taken in again."""
        n = len(self.tag)
        size = [0] * n
        for _, parts in self.blocks:
            for e, piece, linked in parts:
                size[e] += 0 if linked else len(piece)
        mains, heads, titles, articles = ([t in of for t in self.tag] for of in (("main",), ("h1",), ("h1", "h2"), ("article",)))
        counts = (size, mains, heads, titles, articles)
        for e in range(n - 1, 0, -1):
            for c in counts:
                c[self.parent[e]] += c[e]
        inside = [False] * n
        out = list(self.out)
        for e in range(1, n):
            up = self.parent[e]
            inside[e] = inside[up] or self.tag[e] in ("article", "main")
            hints = self.hints[e]
            if hints - TITLED and not out[e]:
                half = 2 * size[e] >= size[0] > 0
                all_articles = 0 < articles[e] == articles[0]
                most = not hints & NOTICES and 5 * size[e] >= 4 * size[0] > 0
                whole = not hints & TALK and (most or mains[e] or half and (heads[e] or all_articles))
                own = hints - TITLED == {"header"} and (inside[up] or titles[e] and hints & TITLED)
                out[e] = not (whole or own)
            out[e] = out[e] or out[up]
        if not any(not out[e] and not linked and not piece.isspace() for _, parts in self.blocks for e, piece, linked in parts) and size[0]:
            out = self.out
        self.out = out
        blocks = ((e, [x for x in parts if not out[x[0]]]) for e, parts in self.blocks)
        self.blocks = [[e, [x[1] for x in parts], sum(len(x[1]) for x in parts if x[2])] for e, parts in blocks if parts]
        self._sum()

    def _sum(self) -> None:
        """For each path of containers: characters outside links, in links, and outside links in its own blocks; the path around it."""
        n = len(self.tag)
        holder = [0] * n
        for e in range(1, n):
            holder[e] = e if self.tag[e] in CONTAINER else holder[self.parent[e]]
        plain, linked, own = [0] * n, [0] * n, [0] * n
        for e, parts, in_links in self.blocks:
            size = sum(map(len, parts)) - in_links
            plain[e] += size
            linked[e] += in_links
            own[holder[e]] += size
        for e in range(n - 1, 0, -1):
            plain[self.parent[e]] += plain[e]
            linked[self.parent[e]] += linked[e]
        self.holder = holder
        self.sizes: dict[str, list[int]] = {}
        self.around: dict[str, tuple[str, str]] = {}  # path -> tag, path around it
        for e in range(n):
            if holder[e] == e:
                at = self.sizes.setdefault(self.path[e], [0, 0, 0])
                for k, c in enumerate((plain, linked, own)):
                    at[k] += c[e]
                self.around.setdefault(self.path[e], (self.tag[e], self.path[holder[max(self.parent[e], 0)]]))

    def climb(self, path: str, siblings: bool) -> str:
        """The path around that holds the rest of the article: its nearest article element; else the last one
        whose further text is mostly outside links and its own, or, with siblings, a fourth of what is inside."""
        if path not in self.around:
            return path
        p = path
        while p != ROOT:
            if self.around[p][0] == "article":
                return p
            p = self.around[p][1]
        p = best = path
        while p != ROOT and self.around[p][0] != "main":
            p = self.around[p][1]
            plain, linked = (self.sizes[p][k] - self.sizes[best][k] for k in (0, 1))
            top = self.around[p][0] in ("#", "html", "body")
            if plain > 0 and plain >= linked and (2 * self.sizes[p][2] >= plain or (siblings and not top and 4 * plain >= self.sizes[best][0])):
                best = p
        return best

    def scores(self) -> dict[int, float]:
        """Container -> characters of its blocks outside links; the container around it gets half."""
        got: dict[int, float] = defaultdict(float)
        for e, parts, linked in self.blocks:
            size = sum(map(len, parts)) - 2 * linked
            own = self.holder[e]
            weight = 1.5 if self.tag[own] in ("article", "main") else 1.0
            got[own] += size * weight
            if own > 0:
                got[self.holder[self.parent[own]]] += size / 2
        return got

    def text_of(self, chosen: set[int]) -> str:
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            inside[e] = e in chosen or (e > 0 and inside[self.parent[e]])
        blocks = (" ".join("".join(parts).split()) for e, parts, _ in self.blocks if inside[e])
        return "\n".join(b for b in blocks if b)

    def votes(self) -> list[tuple[str, float]]:
        """(path, share of the best score) of the page's containers."""
        got: dict[str, float] = defaultdict(float)
        for e, s in self.scores().items():
            if s > 0:
                got[self.path[e]] += s
        best = max(got.values(), default=0)
        if got:
            top = self.climb(max(got, key=got.__getitem__), True)
            below, under = [False] * len(self.tag), set()
            for e in range(1, len(self.tag)):
                up = self.parent[e]
                below[e] = below[up] or self.path[up] == top != self.path[e]
                if below[e]:
                    under.add(self.path[e])
            got = {p: s for p, s in got.items() if p not in under} | {top: best}
        return [(p, s / best) for p, s in got.items() if s >= 0.1 * best]

    def having(self, path: str) -> set[int]:
        return {e for e, p in enumerate(self.path) if p == path and (self.tag[e] in CONTAINER or not e) and not self.out[e]}

    def main_text(self, paths: list[str]) -> str:
        """By the first of the paths with text, else by the page's own best path, else all."""
        own = self.votes()
        for path in [p for p in paths if p != ROOT] + ([max(own, key=lambda x: x[1])[0]] if own else []):
            if self.text_of(self.having(path)):
                return self.text_of(self.having(self.climb(path, False)))
        got = self.scores()
        return self.text_of({max(got, key=lambda e: (got[e], -e))} if got else {0})


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, shares = [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for path, share in Page(source.as_py() or "").votes():
                hosts.append(host)
                paths.append(path)
                shares.append(round(1000 * share))
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], ["host", "path", "share"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(x.as_py() or "").main_text(p.as_py() or []) for x, p in zip(b.column(2), b.column(3), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, n_paths: int = PATHS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html, ...).

    A null or empty html gives an empty text. Pages whose url is null or names no host share one nameless host.
    Rows that repeat stay rows, and vote as often. n_paths: how many paths a host's pages try in turn.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = pages.select("page_id", "url", "html").withColumn("host", host)
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, share long")
    votes = votes.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_paths)
    winners = stored(ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")))
    joined = pages.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of the whole pages table."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
