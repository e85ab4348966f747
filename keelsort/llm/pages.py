"""Main text of web pages by consensus paths of hosts.

Each page's containers are scored by the text of their blocks less that of links. A
page votes for the generalised tag-class path of its best container; votes are summed
per host in Spark. Pages are then extracted again with their host's winning paths, and
with their own best container where none of those is in the page.
"""

from __future__ import annotations

import html as _html
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from keelsort.llm.common import settle

#: Paths of a host that are tried in order of their votes.
PATHS = 3
#: Rows of the table of winning paths up to which it is broadcast; beyond it is joined by host.
BROADCAST_ROWS = 20_000

# Element names and class words, by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
NOISE_TAGS = frozenset("nav header footer aside form button dialog menu head".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies responses "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words before a noise word that make the name a state of a wrapper, and parts of an article whose header belongs to it.
STATES = frozenset("has have no not non without with is hide hides show shows enable disable".split())
CONTENT = frozenset("article post entry story content main body page".split())
HEADERS = frozenset("header banner masthead".split())
#: Words after a noise word that name a wrapper's form and not a piece of noise.
FORMS = frozenset("layout free less open visible enabled disabled wrapper page".split())
#: Text outside noise is negligible where it has, net of links, fewer characters than this and a smaller share of the noise's text than that.
NEGLIGIBLE, NEGLIGIBLE_SHARE = 30, 0.1
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody table ul ol dl figcaption figure summary".split())
CLOSES_P = BLOCKS - {"body", "html"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: What ends a tag, or begins a quoted value in it.
_END = re.compile(r">|=\s*([\"'])")
#: One attribute, its value consumed: names are found at attribute-name positions only.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_ASKED = frozenset("class id role hidden aria-hidden".split())
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def noise_name(name: str) -> bool:
    """Whether a class or id in lower case names noise: as a whole, or by its first or last word; a word within does not count."""
    words = _WORD.findall(name)
    if not words or len(words) == 1:
        return bool(words) and words[0] in NOISE_WORDS
    if words[0] in STATES:
        return False
    if words[-1] in NOISE_WORDS:
        return not (words[-1] in HEADERS and words[0] in CONTENT - {"main", "page"})
    return words[0] in NOISE_WORDS and words[-1] not in FORMS


def tags(source: str):
    """(start, end, name or None, whether it closes, attributes) of each tag, comment and declaration; one scan of the page.

    A quote that nothing closes is a character like others. What begins like a tag and
    never ends is text.
    """
    at, unclosed = 0, set()
    while (m := _OPEN.search(source, at)) is not None:
        start, name = m.start(), m[3]
        if m[1]:
            end = source.find("-->", m.end())
            at = len(source) if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        end = -1
        if name is not None:
            k = m.end()
            while (e := _END.search(source, k)) is not None:
                if e[1] is None:
                    end = e.start()
                    break
                k = e.end()
                if e[1] not in unclosed:
                    close = source.find(e[1], k)
                    if close < 0:
                        unclosed.add(e[1])
                    else:
                        k = close + 1
        if end < 0:
            end = source.find(">", m.end())
            if end < 0:
                return
        at = end + 1
        own = yield start, at, name, bool(m[2]), source[m.end() : end] if name is not None else ""
        if own is not None:
            # the reader has gone on within the page
            at = own
            yield None


def path_digest(path: str) -> int:
    """Digest of a path, as elements have it."""
    digest = 0
    for segment in path.split("/")[1:]:
        digest = xxhash.xxh3_64_intdigest(segment, digest)
    return digest


class Page:
    """Blocks of text of a page and the elements around them, in page order.

    An element has its parent, its own segment and a digest of its path, so a page needs
    memory in proportion to its length, however deep it is.
    """

    def __init__(self, source: str):
        self.segments: list[str] = [""]
        self.digests: list[int] = [0]
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["#root"]
        self.ends: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters of links
        self.aside: list[tuple[int, int, str, int]] = []  # blocks of noise, each with the number of blocks before it
        self._parse(source)
        clean = sum(max(0, len(t) - 2 * links) for _, t, links in self.blocks)
        if clean < NEGLIGIBLE and clean < NEGLIGIBLE_SHARE * sum(max(0, len(t) - 2 * links) for _, _, t, links in self.aside):
            # the page's text is in what looked like noise
            ranked = [(k, 1, b) for k, b in enumerate(self.blocks)] + [(k, 0, (o, t, n)) for k, o, t, n in self.aside]
            self.blocks = [b for _, _, b in sorted(ranked, key=lambda x: x[:2])]

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # tag, element (of the nearest block for inline tags), noise
        open_tags: dict[str, int] = {}
        text: list[str] = []
        noise_text: list[str] = []
        links, noise_links, in_link = 0, 0, 0
        owner = 0

        def flush():
            nonlocal links, noise_links
            if noise_text:
                block = " ".join("".join(noise_text).split())
                if block:
                    self.aside.append((len(self.blocks), owner, block, noise_links))
                noise_text.clear()
            noise_links = 0
            if text:
                block = " ".join("".join(text).split())
                if block:
                    self.blocks.append((owner, block, links))
                text.clear()
            links = 0

        def add(raw: str):
            nonlocal links, noise_links
            if not raw:
                return
            raw = _html.unescape(raw)
            if stack[-1][2]:
                noise_text.append(raw)
                if in_link:
                    noise_links += len(raw)
            else:
                text.append(raw)
                if in_link:
                    links += len(raw)

        def pop():
            nonlocal owner, in_link
            tag, at, _ = stack.pop()
            open_tags[tag] -= 1
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS:
                flush()
                self.ends[at] = len(self.parents)
                owner = stack[-1][1]

        at, found_tags, known = 0, tags(source), {}
        for start, end, name, closing, attrs in found_tags:
            add(source[at:start])
            at = end
            if name is None:
                continue
            name = name.lower()
            if closing:
                if open_tags.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                elif name in ("br", "p"):
                    add(" ")
                continue
            if name in RAW:
                if not attrs.endswith("/") or name in ("script", "style", "textarea", "title"):
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = close.end() if close else len(source)
                    found_tags.send(at)
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                add(" ")
                continue
            if name in CLOSES_P and open_tags.get("p"):
                while stack[-1][0] != "p":
                    pop()
                pop()
            if name in CLOSED_BY and any(open_tags.get(t) for t in CLOSED_BY[name]):
                scope = SCOPES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in scope:
                        break
                    if stack[depth][0] in CLOSED_BY[name]:
                        while len(stack) > depth:
                            pop()
                        break
            found = {}
            if attrs:
                for a in _ATTR.findall(attrs):
                    key = a[0].lower()
                    if key in _ASKED:
                        found.setdefault(key, a[1] or a[2] or a[3])
            noise = stack[-1][2] or name in NOISE_TAGS
            if found and not noise and name not in ("body", "html"):
                names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
                noise = any(map(noise_name, names)) or found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
            if name in BLOCKS:
                flush()
                classes = ".".join(sorted({_DIGITS.sub("#", c) for c in found.get("class", "").lower().split()}))
                parent = stack[-1][1]
                segment = f"{name}{'.' + classes if classes else ''}".replace("/", "|")
                self.segments.append(known.setdefault(segment, segment))
                self.digests.append(xxhash.xxh3_64_intdigest(segment, self.digests[parent]))
                self.parents.append(parent)
                self.tags.append(name)
                self.ends.append(-1)
                owner = len(self.parents) - 1
                stack.append((name, owner, noise))
            else:
                if name == "a":
                    in_link += 1
                stack.append((name, stack[-1][1], noise))
            open_tags[name] = open_tags.get(name, 0) + 1
        add(source[at:])
        while len(stack) > 1:
            pop()
        flush()
        self.ends = [len(self.parents) if e < 0 else e for e in self.ends]

    def path(self, at: int) -> str:
        """Segments from the root to an element, each after a slash."""
        out = []
        while at > 0:
            out.append(self.segments[at])
            at = self.parents[at]
        return "".join("/" + segment for segment in reversed(out))

    def scores(self) -> dict[int, float]:
        """Score of each container: the text of its own blocks, and half of that one level below."""
        own: dict[int, float] = {}
        for owner, text, links in self.blocks:
            at = owner
            while self.tags[at] in LEAVES and self.parents[at] >= 0:
                at = self.parents[at]
            gain = len(text) - 2.0 * links
            own[at] = own.get(at, 0.0) + gain
        total = dict(own)
        for at, gain in own.items():
            up = self.parents[at]
            if up >= 0 and self.tags[up] not in ("html", "#root"):
                total[up] = total.get(up, 0.0) + gain / 2
        return {at: x * (1.5 if self.tags[at] in ("article", "main") else 1.0) for at, x in total.items()}

    def best(self) -> int | None:
        """The container of the highest score, the first of equals."""
        found = self.scores()
        return min(found, key=lambda at: (-found[at], at)) if found else None

    def text(self, containers: list[int]) -> str:
        """Blocks within any of the containers, in page order."""
        inside = [0] * (len(self.parents) + 1)
        for c in containers:
            inside[c] += 1
            inside[self.ends[c]] -= 1
        inside = list(itertools.accumulate(inside))
        return "\n\n".join(t for owner, t, _ in self.blocks if inside[owner])


def extract(source: str, paths: list[str]) -> str:
    """Main text by the first of ``paths`` that has text in the page, else by the page's own best container."""
    page = Page(source)
    for path in paths:
        digest = path_digest(path)
        at = [i for i, p in enumerate(page.digests) if p == digest]
        if at and (text := page.text(at)):
            return text
    best = page.best()
    return "" if best is None else page.text([best])


def _votes(batches):
    for batch in batches:
        hosts, paths, weights = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            at = page.best()
            if at is not None:
                hosts.append(host)
                paths.append(page.path(at))
                weights.append(1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())], names=["host", "path", "votes"])


def host_of(url):
    """Host of a URL column, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, paths): each host's winning paths in order of their votes, ties by path.

    Each row of ``pages`` votes once, repeated ones too; null and empty html and pages
    without text have no vote; pages without a host share the empty host.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_votes, "host string, path string, votes long")
    counted = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # partial top lists are cut per task before the exchange: a host with very many paths sends PATHS rows a task
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("r") <= PATHS)
    return ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages``.

    Null html counts as empty and gives empty text; pages without a host share the empty
    host. Repeated rows give a row each; other columns are not read. The table of
    winning paths is broadcast only while it has at most BROADCAST_ROWS rows.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    winners = settle(host_paths(own))
    few = winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = own.withColumn("host", host_of(F.col("url"))).join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            text = [extract(h or "", p or []) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
