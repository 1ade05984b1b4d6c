"""Main text of web pages by consensus paths of their hosts.

1. Every page is parsed and its containers are scored by the running text right inside them
   (and in part by that of their children). The page votes for the generalised path of its
   best container: the tags and classes from the root, digits dropped.
2. Spark adds the votes by host and path and takes the winning path of each host.
3. Every page is parsed again and read at the winning path of its host; a page that has no
   such container is read at its own best one.

What stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments is left out, known by tags, roles, hiding styles and the words of an element's own classes and ids. A
name is a hint only: words that may be content ("share", "related") count if the whole name speaks so, and an element that holds
most of the page's running text stays whatever its name has beside. A title (h1) in front of the winning container
is kept. Character references are decoded once, white space in a block becomes one space, blocks are joined by two
line ends in page order.

Defined cases: null, empty and text-free pages give an empty text; broken or cut markup is read
as far as it goes (what is open at the end counts as closed there); a null or hostless url has
the host ''. Repeated rows and ids keep a row each. Ties between paths go to the greater score,
then to the path first in order. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, per_slice

#: Hosts up to which the table of winning paths is broadcast; beyond, it is joined by a shuffle.
BROADCAST_HOSTS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("aside audio button datalist dialog embed head iframe input menu nav noscript option optgroup script select style svg template textarea title video".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: One of these in a name speaks for a part that is left out, whatever stands beside it, unless a word of ``NOT_SO`` does.
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot advertorial sponsored cookie cookies gdpr newsletter popup sidebar sidebars sidenav nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer footers comment comments commentlist disqus pagination pager".split()
)
#: These may also name what an article is about, so every word of a name has to be one of them or of ``BESIDE_WORDS``.
OUT_WORDS = SURE_WORDS | frozenset(
    "sponsor sponsors promo promos promotion promoted banner consent notice notices notification notifications subscribe subscription signup modal overlay masthead respond replies share sharing shares social related recommended recommendations toolbar widget widgets login search".split()
)
#: What may stand beside a word of those in the name of a part that is left out.
BESIDE_WORDS = frozenset("site page main post posts article articles entry blog top bottom left right inner outer header head title list item items link links button buttons bar box block area section container wrapper wrap content row slot unit text icon icons form panel card feed group set stories story news topics media prompt message user google".split())
NOT_SO = frozenset("with without has no not is enabled disabled layout".split())
MAIN_WORDS = frozenset("article articles content post posts entry story main text body".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: How a name speaks for leaving its element out: in all its words, in all but with none of ``SURE_WORDS``, or in some.
FULLY, UNSURE, PARTLY = 1, 2, 3
#: Characters of running text that a page must have without what is named in part, else the largest of that is read.
LEAST_TEXT = 25


def named_out(names: list[list[str]]) -> int:
    """Whether one of an element's names (in words) speaks for leaving it out, and how."""
    found = 0
    for words in names:
        told = [w for w in words if len(w) > 1]
        if any(w in OUT_WORDS for w in told) and all(w in OUT_WORDS or w in BESIDE_WORDS for w in told):
            return FULLY if any(w in SURE_WORDS for w in told) else UNSURE
        if any(w in SURE_WORDS for w in told) and not any(w in NOT_SO for w in told):
            found = PARTLY
    return found


class Page:
    """Elements of a page (parent, generalised name, whether it is left out) and its blocks (element, text, characters in links)."""

    def __init__(self, source: str) -> None:
        self.parents, self.names, self.out = [-1], [""], [False]
        self.tags, self.main, self.named = [""], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        #: Open elements, for each the innermost around it (itself included) that is no inline one, and for each tag where it stands open.
        self._open, self._solid, self._at = [0], [0], {}
        self._text, self._links, self._in_link = [], 0, 0
        self._read(source)
        self._leave_out()

    def _leave_out(self) -> None:
        """Drops the blocks of elements that are left out by their names.

        A name is a hint: an element whose name speaks in part only stays if it holds over half of
        the running text, and so does the largest of those where nothing else has text.
        """
        if not any(self.named):
            return
        mass, headed = [0] * len(self.names), [tag in ("article", "main", "h1") for tag in self.tags]
        for at, text, links in self.blocks:
            mass[at] += len(text) - links
        own = mass[:]
        for k in range(len(mass) - 1, 0, -1):
            mass[self.parents[k]] += mass[k]
            headed[self.parents[k]] |= headed[k]
        hints = [k for k, n in enumerate(self.named) if n == PARTLY or n == UNSURE and headed[k]]
        left_out = {k for k, n in enumerate(self.named) if n} - {k for k in hints if 2 * mass[k] > mass[0]}
        while True:
            out = [False] * len(mass)
            for k in range(1, len(mass)):
                out[k] = k in left_out or out[self.parents[k]]
            most = max((mass[k] for k in hints if k in left_out), default=0)
            if not most or sum(m for m, gone in zip(own, out, strict=True) if not gone) >= LEAST_TEXT:
                break
            left_out -= {k for k in hints if mass[k] == most}
        self.blocks = [block for block in self.blocks if not out[block[0]]]

    def _end_block(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._solid[-1], text, min(self._links, len(text))))
            self._text, self._links = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        inline = tag in INLINE
        if not inline:
            self._end_block()
            self._close(("p",), ("article", "blockquote", "body", "button", "div", "section", "table", "td", "th"))
            if tag in CLOSES:
                closed, within = CLOSES[tag]
                self._close(closed.split(), within)
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        classes = [x for x in (re.sub(r"[\d_-]*\d[\d_-]*", "", c).lower() for c in found.get("class", "").split()) if x]
        parts = [[x.lower() for x in _PARTS.findall(name)] for name in f"{found.get('class', '')} {found.get('id', '')}".split()]
        words = {w for part in parts for w in part}
        above = self._open[-1]
        in_article = bool(self._at.get("article") or self._at.get("main"))
        out = self.out[above] or tag in LEFT_OUT or found.get("role", "").lower() in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))
        named = 0
        if tag not in ("html", "body", "main"):
            out = out or tag == "footer" or (tag == "header" and not in_article)
            named = named_out(parts) or (PARTLY if tag == "form" or ("header" in words and not (in_article or words & MAIN_WORDS)) else 0)
        self.named.append(named)
        out = out or (inline and named == FULLY)
        self.parents.append(above)
        self.names.append(".".join([tag, *sorted(set(classes))]))
        self.tags.append(tag)
        self.out.append(out)
        self.main.append(tag in ("article", "main") or bool(words & MAIN_WORDS))
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.names) - 1)
        self._solid.append(self._solid[-1] if inline else len(self.names) - 1)
        self._in_link += tag == "a"

    def _pop(self, k: int) -> None:
        for at in self._open[k:]:
            self._at[self.tags[at]].pop()
            self._in_link -= self.tags[at] == "a"
        del self._open[k:], self._solid[k:]

    def _innermost(self, tags: tuple[str, ...] | list[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _close(self, tags: tuple[str, ...] | list[str], within: tuple[str, ...]) -> None:
        """Closes the innermost open element of ``tags`` that no element of ``within`` lies around closer."""
        k = self._innermost(tags)
        if k and k > self._innermost([t for t in within if t not in tags]):
            self._pop(k)

    def _end(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        if k := self._innermost((tag,)):
            self._pop(k)

    def _add(self, text: str) -> None:
        if text and not self.out[self._open[-1]]:
            self._text.append(text)
            if self._in_link:
                self._links += len(text)

    def _read(self, source: str) -> None:
        at, find = 0, _MARKUP.search
        while m := find(source, at):
            self._add(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if m[1] or m[4]:
                self._end(tag)
            elif tag in ("script", "style"):
                end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag:
                self._start(tag, m[3] or m[6] or "")
        self._add(source[at:])
        self._end_block()

    def path(self, at: int) -> str:
        """The generalised names from the page down; no name holds a blank."""
        names = []
        while at > 0:
            names.append(self.names[at])
            at = self.parents[at]
        return " ".join(reversed(names))

    def _on(self, path: str) -> set[int]:
        """The elements at a path; one pass, as parents come before their children."""
        names, depth = path.split(" "), [0] * len(self.names)  # how much of the path leads to an element, -1 if none does
        for k in range(1, len(self.names)):
            above = depth[self.parents[k]]
            depth[k] = above + 1 if 0 <= above < len(names) and names[above] == self.names[k] else -1
        return {k for k, d in enumerate(depth) if d == len(names)}

    def best(self) -> tuple[int, float]:
        """The container with the highest score (the first of equals), and the score; 0 is the page itself."""
        scores: dict[int, float] = {}
        for at, text, links in self.blocks:
            while self.tags[at] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "ul", "ol", "dl", "dt", "dd"):
                at = self.parents[at]
            own = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            for share in (1, 0.5):
                if at > 0:
                    scores[at] = scores.get(at, 0.0) + share * own
                    at = self.parents[at]
        return max(((k, s * (1.5 if self.main[k] else 1)) for k, s in scores.items()), key=lambda x: (x[1], -x[0]), default=(0, 0.0))

    def text(self, path: str | None) -> str:
        """The blocks in the containers at ``path``, or in the page's best one where there are none; before them the page's title, if it stands beside."""
        inside = (self._on(path) if path else set()) or {self.best()[0]}
        within = [False] * len(self.names)
        for k in range(len(self.names)):
            within[k] = k in inside or (k > 0 and within[self.parents[k]])
        kept = [k for k, (at, _, _) in enumerate(self.blocks) if within[at]]
        titles = [k for k, (at, _, _) in enumerate(self.blocks) if self._in_title(at)]
        if kept and titles and not any(within[self.blocks[k][0]] for k in titles):
            kept = [k for k in titles if k < kept[0]][-1:] + kept
        return "\n\n".join(self.blocks[k][1] for k in kept)

    def _in_title(self, at: int) -> bool:
        while at > 0 and self.tags[at] != "h1":
            at = self.parents[at]
        return at > 0


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of a host vote for. Votes are added before they are shuffled."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("score", pa.float64())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py() or "")
                best, score = page.best()
                if best:
                    sums = votes.setdefault((host, page.path(best)), [0, 0.0])
                    sums[0] += 1
                    sums[1] += round(score, 3)
            rows = [(h, p, n, s) for (h, p), (n, s) in votes.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * 4, schema, strict=True)], schema=schema)

    counted = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(vote, "host string, path string, votes long, score double")
    summed = counted.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.round(F.sum("score"), 1).alias("score"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of ``pages`` (page_id, url, html)."""
    winners = cut_lineage(winning_paths(pages))  # it is counted and then joined, and each time would parse all pages
    few = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")
    schema = "page_id long, url string, text string, n_chars long"

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [Page(source or "").text(path) for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(per_slice(read, 200), schema)
