"""Main text of HTML pages: site templates are removed by counting subtrees per host.

Every element gets a hash of its whole subtree (tag, class, id, texts and child
hashes in order). One pass counts, per host, on how many pages each subtree
occurs, where pages of equal main text are one page, so copies of an article cast
one vote; a subtree on at least ``LEAST_PAGES`` pages is part of the site's template,
however large the host. One that holds paragraphs or headings, lies in an article, or
is a list item, table cell or inline element must besides be on ``PROSE_SHARE`` of
the host's pages or on ``PROSE_PAGES``; an inline element with text of its sentence
beside it is not counted. A second pass deletes template subtrees
from every page, then what its own markup names as something other than the
article (menus, adverts, forms, comments, ...), and joins what is left as
blocks of text. Articles themselves, what contains them, and the headings,
paragraphs, lists, tables, figures and marked-up words inside them are never
template: the same article or passage on many pages of a host is still content.
Inside one, only a ``div`` or ``section`` with a class or id of its own and none of
these in it may be.

Names: a class or id names an element as something else by a whole token, all of
whose words say so (``comments``, ``social-share``; not ``has-sidebar`` or
``comments-open``). A name, a role or a form around an article doesn't delete it, nor
one around nearly all text of a page without articles. An article that is itself
named (a comment) counts as one only if the page has no other, and one within another
only if no text but headings is left of that.

Counting: the subtrees of a page are written once, packed with the hash of its main
text and whether its own text depends on them; votes are made distinct and added up
by (host, subtree), so a host with a third of all pages is spread over its subtrees.
Template subtrees come by an equi-join on (host, subtree) to the pages that depend on
them, as many as there are, and these to the pages by an equi-join on a digest of
host and html, which Spark broadcasts if small. Pages are parsed twice.

Defined results: null or empty html has no text ("" and 0 characters); a null
url, or one without ``://``, belongs to the host "" with others of its kind;
broken markup is read as browsers do it in outline (open elements end with their
parent, stray end tags are ignored, a ``<`` that starts no tag is text);
repeated rows are one page to the count and rows of their own in the result; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.url_filters import host_and_path
from nightjar.operators.lineage import materialize

LEAST_PAGES = 5
PROSE_SHARE = 0.3
#: Distinct pages on which prose is template whatever its share: that of a host of 100 pages.
PROSE_PAGES = 30

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
tbody td tfoot th thead title tr ul""".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("caption dd dt head html body legend li optgroup option summary tbody td tfoot th thead title tr".split()) | {"li", "dd", "dt"}
#: Open elements that a start tag ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
P_SCOPE = frozenset("article aside blockquote body button caption div fieldset figure footer form header html li main nav object section table td th dd".split())
HOLDS_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Parts of a list, a table or a sentence; a few words that recur by chance.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
PARTS = INLINE | frozenset("dd dt li td th tr".split())
#: Elements that only group others; inside an article, nothing else is template by its count.
GROUPS = frozenset("div section".split())
#: What holds an article's text besides; a group with any of it is never template inside an article.
HOLDS_TEXT = HOLDS_PROSE | frozenset("ul ol dl li dd dt table caption tr td th figure figcaption details summary math address code kbd samp var del ins".split())

#: Elements that hold no article text, or the source of a formula beside its text.
NOT_TEXT = frozenset("""annotation aside audio button canvas dialog embed footer frame frameset head iframe input menu nav noembed noframes
noscript object script select style svg template textarea title video""".split())
#: Roles (ARIA) of such elements.
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id names of such elements.
NOT_TEXT_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related
share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets""".split())
#: Words that may stand beside them in a name.
PART_NAMES = frozenset("area bar block box button buttons item items link links list section".split())
#: Share of a page's text around which a name, role or form says nothing, if the page has no article.
WHOLE = 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names_other(names: str) -> bool:
    """Whether a token of a class or id names something else than an article."""
    for token in names.split():
        words = {w.lower() for w in WORDS.findall(token)}
        if token.lower() in NOT_TEXT_NAMES or words & NOT_TEXT_NAMES and words <= NOT_TEXT_NAMES | PART_NAMES:
            return True
    return False


class Page:
    """Elements and text runs of a page, in page order."""

    def __init__(self, source: str):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.hash: list[int] = []
        self.dropped: list[bool] = []
        self._beside: list[bool] = []  # by a name, a role or as a form or header, unless it is around an article
        #: (element, text) or (element, None) where a block starts or ends.
        self.runs: list[tuple[int, str | None]] = []
        self._parts: list[list[bytes]] = []
        self._open: list[int] = []
        self._names: list[bytes] = []
        self._marked: list[bool] = []  # with a class or id
        self._read(source)
        self.inside = [False] * len(self.tag)  # an article or main element, or in one
        self.around = [False] * len(self.tag)  # an article or main element, or around one
        for i, tag in enumerate(self.tag):
            if tag in ("article", "main"):
                self.inside[i] = True
                while i >= 0 and not self.around[i]:
                    self.around[i] = True
                    i = self.parent[i]
            elif self.parent[i] >= 0:
                self.inside[i] = self.inside[self.parent[i]]
        self.prose, self.holds_text = self._holding(HOLDS_PROSE), self._holding(HOLDS_TEXT)
        self._drop_beside()
        self.gone = self._below(self.dropped)
        wanted = next((t for t in ("article", "main") if any(x == t and not g for x, g in zip(self.tag, self.gone))), None)
        self.part = self._below([wanted is None or tag == wanted for tag in self.tag])
        self.whole = wanted is None
        self.strict = [p or inside or tag in PARTS for p, inside, tag in zip(self.prose, self.inside, self.tag)]
        says = {i for i, text in self.runs if text and any(map(str.isalnum, text))}
        self._in_sentence = [False] * len(self.tag)
        for i, up in enumerate(self.parent):
            self._in_sentence[i] = up >= 0 and self.tag[i] in INLINE and (up in says or self._in_sentence[up])

    def _below(self, marked: list[bool]) -> list[bool]:
        """Whether an element is marked, or in a marked one."""
        below = list(marked)
        for i, up in enumerate(self.parent):
            below[i] = below[i] or up >= 0 and below[up]
        return below

    def _drop_beside(self) -> None:
        if not any(self._beside):
            return
        hidden = self._below(self.dropped)
        articles = [i for i, tag in enumerate(self.tag) if tag in ("article", "main") and not hidden[i]]
        spared = [False] * len(self.tag)

        def spare(some: list[int]) -> None:
            for i in [i for i in some if not self._beside[i]] or some:
                while i >= 0 and not spared[i]:
                    spared[i] = True
                    i = self.parent[i]

        def dropped() -> list[bool]:
            return [d or b and not kept for d, b, kept in zip(self.dropped, self._beside, spared)]

        if articles:
            top = list(range(len(self.tag)))  # the outermost article or main element around an element, or a root
            for i, up in enumerate(self.parent):
                if up >= 0 and (self.inside[up] or self.tag[i] not in ("article", "main")):
                    top[i] = top[up]
            spare([i for i in articles if top[i] == i])
            nested = [i for i in articles if top[i] != i and spared[top[i]]]
            if nested:
                gone, headed = self._below(dropped()), self._below([tag in HEADINGS for tag in self.tag])
                left = {top[i] for i, text in self.runs if i >= 0 and text and not text.isspace() and not gone[i] and not headed[i]}
                spare([i for i in nested if top[i] not in left])
        else:
            size, prose = [0] * len(self.tag), [tag in HOLDS_PROSE and not h for tag, h in zip(self.tag, hidden)]
            total, all_prose = 0, sum(prose)
            for i, text in self.runs:
                if text and (i < 0 or not hidden[i]):
                    n = len("".join(text.split()))
                    total += n
                    if i >= 0:
                        size[i] += n
            held = [int(x) for x in prose]
            for i in range(len(self.tag) - 1, -1, -1):
                if self.parent[i] >= 0:
                    size[self.parent[i]] += size[i]
                    held[self.parent[i]] += held[i]
            spared = [0 < all_prose == h and n >= WHOLE * total for h, n in zip(held, size)]
        self.dropped = dropped()

    def _holding(self, tags: frozenset[str]) -> list[bool]:
        """Whether an element is, or contains, one of the tags."""
        held = [tag in tags for tag in self.tag]
        for i in range(len(self.tag) - 1, -1, -1):
            if held[i] and self.parent[i] >= 0:
                held[self.parent[i]] = True
        return held

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if not found:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at:found.start()])
            at = found.end()
            if found[2]:
                name = found[2].lower()
                if found[1]:
                    self._end(name)
                else:
                    self._start(name, found[3])
                    if name in RAW:
                        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                        self._text(source[at:close.start() if close else size])
                        at = close.start() if close else size
        while self._open:
            self._close()

    def _text(self, text: str) -> None:
        text = html.unescape(text)
        if self._open and not text.isspace():
            self._parts[self._open[-1]].append(" ".join(text.split()).encode("utf-8", "surrogatepass"))
        self.runs.append((self._open[-1] if self._open else -1, text))

    def _start(self, name: str, raw: str) -> None:
        if name in ENDS_P:
            self._end_open({"p"}, P_SCOPE)
        if name in ENDS:
            self._end_open(*ENDS[name])
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
        me, parent = len(self.tag), self._open[-1] if self._open else -1
        self.tag.append(name)
        self.parent.append(parent)
        self.hash.append(0)
        self._parts.append([])
        self._names.append(f"{name} {attributes.get('class', '')} {attributes.get('id', '')}".encode("utf-8", "surrogatepass"))
        self._marked.append(bool(attributes.get("class") or attributes.get("id")))
        self.dropped.append(self._not_text(name, attributes))
        self._beside.append(self._not_article(name, parent, attributes))
        if name in BLOCK:
            self.runs.append((me, None))
        elif name == "br":
            self.runs.append((parent, " "))
        self._open.append(me)
        if name in VOID:
            self._close()

    def _not_text(self, name: str, attributes: dict[str, str]) -> bool:
        if name in NOT_TEXT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))

    def _not_article(self, name: str, parent: int, attributes: dict[str, str]) -> bool:
        if name == "form" or attributes.get("role", "").lower() in NOT_TEXT_ROLES:
            return True
        while name == "header" and parent >= 0:  # the head of an article belongs to it
            if self.tag[parent] in ("article", "main"):
                return False
            parent = self.parent[parent]
        if name in ("html", "body", "main"):
            return False
        return name == "header" or _names_other(f"{attributes.get('class', '')} {attributes.get('id', '')}")

    def _end(self, name: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self.tag[self._open[i]] == name:
                while len(self._open) > i:
                    self._close()
                return
            if self.tag[self._open[i]] in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "table", "div", "section"):
                return

    def _end_open(self, names: set[str], stop: Iterable[str]) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            tag = self.tag[self._open[i]]
            if tag in names:
                while len(self._open) > i:
                    self._close()
                return
            if tag in stop:
                return

    def _close(self) -> None:
        me = self._open.pop()
        digest = hashlib.blake2b(self._names[me] + b"\x1f" + b"\x1f".join(self._parts[me]), digest_size=8).digest()
        self.hash[me] = int.from_bytes(digest, "little", signed=True)
        self._parts[me] = []
        if self._open:
            self._parts[self._open[-1]].append(b"\x1e" + digest)
        if self.tag[me] in BLOCK:
            self.runs.append((me, None))

    def may_be_template(self, i: int) -> bool:
        if self.around[i] or self._in_sentence[i] or self.tag[i] in ("html", "body", "head") or self.tag[i] in VOID:
            return False
        return not self.inside[i] or self.tag[i] in GROUPS and self._marked[i] and not self.holds_text[i]

    def subtrees(self) -> dict[tuple[int, bool], bool]:
        """Hashes that may be template, each with whether it must be prose's share, and whether the page's text depends on it."""
        found: dict[tuple[int, bool], bool] = {}
        for i in range(len(self.tag)):
            if self.may_be_template(i):
                key = self.hash[i], self.strict[i]
                found[key] = found.get(key, False) or self.part[i] and not self.gone[i]
        return found

    def content(self) -> int:
        """A hash of the main text, or of all text if the page names no article."""
        return int.from_bytes(hashlib.blake2b(self.text(set()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def text(self, template: set[int], prose: frozenset[int] | set[int] = frozenset()) -> str:
        """Without the template subtrees; ``prose``: those that are held to prose's share."""
        gone, part = self.gone, self.part
        if template or prose:
            gone = self._below([d or self.hash[i] in (prose if self.strict[i] else template) and self.may_be_template(i) for i, d in enumerate(self.dropped)])
        blocks, now = [], []
        for i, text in self.runs:
            if i >= 0 and (gone[i] or not part[i]) or i < 0 and not self.whole:
                if text is None and now:
                    blocks.append("".join(now))
                    now = []
            elif text is None:
                blocks.append("".join(now))
                now = []
            else:
                now.append(text)
        blocks.append("".join(now))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _vote_batch(batches):
    flags, shape = pa.list_(pa.bool_()), ["host", "page", "content", "subtrees", "strict", "needed"]
    for batch in batches:
        contents, subtrees, strict, needed = [], [], [], []
        for source in batch.column("html").to_pylist():
            page = Page(source)
            found = page.subtrees()
            contents.append(page.content())
            subtrees.append([x for x, _ in found])
            strict.append([x for _, x in found])
            needed.append(list(found.values()))
        columns = [pa.array(contents, pa.int64()), pa.array(subtrees, pa.list_(pa.int64())), pa.array(strict, flags), pa.array(needed, flags)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), *columns], shape)


def _extract_batch(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "template", "prose")))
        texts = [Page(source).text(set(template or ()), set(prose or ())) for source, template, prose in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def site_templates(votes: DataFrame, least_pages: int = LEAST_PAGES, prose_share: float = PROSE_SHARE, prose_pages: int = PROSE_PAGES) -> DataFrame:
    """host, subtree, often: the subtrees that recur across the host's pages, and whether often enough for prose."""
    n_pages = votes.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = votes.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    seen = each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    often = F.col("n") >= F.least(F.col("pages") * prose_share, F.lit(float(prose_pages)))
    return seen.join(n_pages, "host").select("host", "subtree", often.alias("often"))


def page_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, prose_share: float = PROSE_SHARE, prose_pages: int = PROSE_PAGES) -> DataFrame:
    """page, template, prose: for each page with any, the template subtrees its text depends on. ``pages``: host, page, html."""
    shape = "host string, page binary, content bigint, subtrees array<bigint>, strict array<boolean>, needed array<boolean>"
    votes = materialize(pages.mapInArrow(_vote_batch, shape), "html-votes")
    asking = votes.filter(F.exists("needed", lambda x: x)).dropDuplicates(["page"])
    asked = asking.select("host", "page", F.inline(F.arrays_zip("subtrees", "strict", "needed"))).filter("needed").withColumnRenamed("subtrees", "subtree")
    met = asked.join(site_templates(votes, least_pages, prose_share, prose_pages), ["host", "subtree"]).filter(F.col("often") | ~F.col("strict"))
    sets = [F.collect_set(F.when(kind, F.col("subtree"))).alias(name) for kind, name in ((~F.col("strict"), "template"), (F.col("strict"), "prose"))]
    return materialize(met.groupBy("page").agg(*sets), "html-templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, prose_share: float = PROSE_SHARE, prose_pages: int = PROSE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host, _ = host_and_path(F.col("url"))
    slim = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    slim = slim.withColumn("page", F.unhex(F.md5(F.concat_ws("\n", "host", "html"))))
    kind = slim.schema["page_id"].dataType.simpleString()
    marked = slim.join(page_templates(slim.select("host", "page", "html"), least_pages, prose_share, prose_pages), "page", "left")
    out = marked.select("page_id", "url", "html", "template", "prose").mapInArrow(_extract_batch, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
