"""Operator 4: main text of web pages by removal of site templates.

Every element subtree of a page that may be a template is hashed twice: whole
(tag, attributes, texts and children) and by its slot, which is its place in the
page by the tags, classes and ids from the root down, without text.  Spark
counts, for each host, on how many different pages each hash stands, copies of
one page counting once, and how much text each slot holds.

Subtrees that recur on many pages of their host are deleted, and so are the
elements of slots that recur on most pages, hold little of the host's text and
stand beside the slots that hold most of it: menus, adverts and footers whose
words change from page to page, whatever their names.  What is left is the
page's article: what the ``article`` and ``main`` elements have in common around
them, else the body.  Where one article has more than half of the text of all,
the others are teasers or comments and go.

Elements that by tag or role are no content (scripts, forms, menus and the like)
always go; class and id names decide only about containers, on hosts with fewer
than MIN_PAGES pages and inside articles.  A whole class or id must be such a
name.  By its name or slot no element goes that is or holds an ``article`` or
``main`` or more than half of the page's text; nor does a form or header that
holds an ``article`` or ``main``.  Inside an article only containers can be
templates, not its paragraphs, headings or list items: a passage may well recur
in many articles of a host.  There a slot acts on containers that have a class or
an id and stand, on all pages, behind half of the article's text: comment
threads, signup boxes and the like, whatever their names.

Defined results: a null or empty page, or one without text, gives an empty text;
very long and very deep pages are taken whole, in time in proportion to their
length; unclosed elements end where the next block or their parent ends, and a
tag that never ends is left out with what follows; a null or odd url is a host of
its own; equal rows each give a row; other columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.html_tokens import RAW, attributes, tokens
from .common import ship, table

MIN_PAGES = 5
MIN_SHARE = 0.1
#: A slot is a template if it stands on so many of a host's pages and holds at most so much of their text.
SLOT_SHARE, SLOT_TEXT = 0.5, 0.2
#: Template hashes of all hosts that are broadcast at most, 16 MB; beyond, pages are joined with their hosts.
MOST_BROADCAST = 1 << 21

#: Fixed: elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("aside center details div dl fieldset figure footer form header menu nav ol search section table ul".split())
NOT_CONTENT = frozenset("aside button dialog fieldset footer form head iframe input menu nav noscript script search select style svg template textarea title".split())
#: Fixed: tags that may also stand around a whole page.
WRAPPERS = frozenset("fieldset form header".split())
NOT_CONTENT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOT_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Fixed: open elements that the start of another one ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table article section div main body html td th blockquote aside nav form".split())

_START, _END, _TEXT = range(3)
_DIGITS = re.compile(r"[0-9]+")


class Page:
    """A page as events in order; elements are numbers, 0 the root, and come after their parents."""

    def __init__(self, page: str) -> None:
        self.tags, self.written, self.parents, self.ends = [""], [""], [0], [0]
        self.article = [0]  # the outermost article or main around an element, itself included
        self.events: list[tuple[int, int | str]] = []
        open_: list[int] = [0]
        depths: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of each tag stand

        def close_to(depth: int) -> None:
            while len(open_) > depth:
                done = open_.pop()
                depths[self.tags[done]].pop()
                self.ends[done] = len(self.events)
                self.events.append((_END, done))

        def deepest(tags: Iterable[str]) -> int:
            return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        def close(tags: set[str], stop: frozenset[str]) -> None:
            if (depth := deepest(tags)) > deepest(stop):
                close_to(depth)

        for kind, what, written in tokens(page):
            if kind == "text":
                self.events.append((_TEXT, what))
            elif kind == "end":
                if depths.get(what):
                    close_to(depths[what][-1])
            else:
                if what in BLOCK:
                    close({"p"}, SCOPE)
                if what in ENDS:
                    close(ENDS[what], SCOPE - ENDS[what] - {"td", "th"} if what in ("tr", "td", "th") else SCOPE - ENDS[what])
                own = len(self.tags)
                self.tags.append(what)
                self.written.append(written)
                self.parents.append(open_[-1])
                self.ends.append(0)
                self.article.append(self.article[open_[-1]] or (own if what in ("article", "main") else 0))
                self.events.append((_START, own))
                depths[what].append(len(open_))
                open_.append(own)
                if what in VOID or (written.endswith("/") and what not in RAW):
                    close_to(len(open_) - 1)
        close_to(1)
        self._weigh()

    def names(self, i: int) -> set[str]:
        own = attributes(self.written[i])
        return {*own.get("class", "").lower().split(), own.get("id", "").strip().lower()} - {""}

    def role(self, i: int) -> str:
        return attributes(self.written[i]).get("role", "").lower() if "role" in self.written[i].lower() else ""

    def _weigh(self) -> None:
        """For each element: whether it is or holds a main element, and how many characters of text it has."""
        n = len(self.tags)
        self.main = [t in ("article", "main") or self.role(i) == "main" for i, t in enumerate(self.tags)]
        self.holds_main, self.chars = self.main[:], [0] * n
        self.begin, self.stop = [0] * n, [0] * n  # characters of text before an element and up to its end
        at, seen = [0], 0
        for kind, what in self.events:
            if kind == _START:
                at.append(what)
                self.begin[what] = seen
            elif kind == _END:
                self.stop[at.pop()] = seen
            else:
                own = len("".join(what.split()))
                self.chars[at[-1]] += own
                seen += own
        articles = [0] * n  # text of articles inside
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            articles[up] += self.chars[i] if self.tags[i] == "article" else articles[i]
            if self.tags[i] not in NOT_CONTENT or self.tags[i] in WRAPPERS:
                self.chars[up] += self.chars[i]
                self.holds_main[up] |= self.holds_main[i]
        # an article with more than half of the text of all articles is the page's; those around it stay
        own = {i: self.chars[i] - articles[i] for i in range(1, n) if self.tags[i] == "article"}
        top = max(own, key=lambda i: (own[i], -i), default=0)
        self.other_articles: set[int] = set()
        if own and 2 * own[top] > sum(own.values()):
            self.other_articles = set(own) - {top}
            while top:
                self.other_articles.discard(top)
                top = self.parents[top]

    def is_content(self, i: int, by_name: bool) -> bool:
        tag = self.tags[i]
        wraps = tag in WRAPPERS and self.holds_main[i]
        if not wraps and (tag in NOT_CONTENT or (tag == "header" and not self.article[i])):
            return False
        if i in self.other_articles:
            return False
        if not self.written[i].strip():
            return True
        if self.role(i) in NOT_CONTENT_ROLES and not wraps:
            return False
        if tag not in CONTAINER or self._is_large(i) or not (by_name or self.article[i]):
            return True
        return not self.names(i) & NOT_CONTENT_NAMES

    def _is_large(self, i: int) -> bool:
        return self.holds_main[i] or 2 * self.chars[i] > self.chars[0]

    def may_be_template(self, i: int) -> bool:
        return self.tags[i] in (CONTAINER if self.article[i] else BLOCK) and self.tags[i] not in ("html", "head", "body", "main", "article", "title")

    def hashes(self) -> dict[int, int]:
        """The hash of each subtree that may be a template."""
        found, open_ = {}, [xxhash.xxh64()]
        for kind, what in self.events:
            if kind == _START:
                open_.append(xxhash.xxh64(f"<{self.tags[what]} {' '.join(self.written[what].split())}>"))
            elif kind == _TEXT:
                open_[-1].update(" ".join(what.split()))
            else:
                value = open_.pop().intdigest()
                open_[-1].update(value.to_bytes(8, "little"))
                if self.may_be_template(what):
                    found[what] = _signed(value)
        return found

    def slots(self) -> list[int]:
        """The slot of each element; numbers in names count as equal."""
        found = [0] * len(self.tags)
        for i in range(1, len(self.tags)):
            names = " ".join(sorted(_DIGITS.sub("0", x) for x in self.names(i))) if self.written[i].strip() else ""
            found[i] = _signed(xxhash.xxh64_intdigest(f"{found[self.parents[i]]} {self.tags[i]} {names}"))
        return found

    def in_slot(self, i: int) -> bool:
        """Whether the element may go by its slot: inside an article only a container with a name behind half of the article's text."""
        if self.tags[i] not in CONTAINER:
            return False
        top = self.article[i]
        return not top or (bool(self.names(i)) and 2 * (self.begin[i] - self.begin[top]) >= self.stop[top] - self.begin[top])

    def templates(self, subtrees: set[int], slots: set[int]) -> set[int]:
        """The elements that are templates."""
        found = {i for i, value in self.hashes().items() if value in subtrees} if subtrees else set()
        if slots:
            found |= {i for i, value in enumerate(self.slots()) if value in slots and self.in_slot(i) and not self._is_large(i)}
        return found

    def text(self, deleted: set[int], by_name: bool = True) -> str:
        """The text of the article that is left without the ``deleted`` elements."""
        held = [True] * len(self.tags)
        children: list[list[int]] = [[] for _ in self.tags]
        for i in range(1, len(self.tags)):
            held[i] = i not in deleted and self.is_content(i, by_name)
            if held[i] and self.holds_main[i]:
                children[self.parents[i]].append(i)
        top = 0
        while not self.main[top] and len(children[top]) == 1:
            top = children[top][0]

        blocks: list[str] = []
        inline: list[str] = []

        def flush() -> None:
            if text := " ".join(entities.unescape("".join(inline)).split()):
                blocks.append(text)
            inline.clear()

        at = next((k for k, e in enumerate(self.events) if e == (_START, top)), -1) + 1
        end = self.ends[top] if top else len(self.events)
        while at < end:
            kind, what = self.events[at]
            at += 1
            if kind == _TEXT:
                inline.append(what)
            elif self.tags[what] == "br":
                inline.append(" ")
            elif kind == _START and not held[what]:
                at = self.ends[what] + 1
            elif self.tags[what] in BLOCK:
                flush()
        flush()
        return "\n".join(blocks)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def main_text(page: str, subtrees: set[int], slots: set[int] = frozenset(), by_name: bool = True) -> str:
    """The text of what is left after the template subtrees and slots are deleted."""
    parsed = Page(page)
    return parsed.text(parsed.templates(subtrees, slots), by_name)


def _parts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(page.alias("html"), F.xxhash64(host).alias("host"), F.xxhash64(host, page).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))


def _hash_pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("parent", pa.int64()), ("chars", pa.int64()), ("may_go", pa.bool_())]))
    for batch in batches:
        subtrees, slots, chars = [], [], []
        for x in batch.column(0).to_pylist():
            page = Page(x)
            subtrees.append(sorted(set(page.hashes().values())))
            own, held = page.slots(), {}
            for i in range(1, len(own)):
                if page.tags[i] in BLOCK and (not page.article[page.parents[i]] or page.tags[i] in CONTAINER):
                    row = held.setdefault(own[i], {"slot": own[i], "parent": own[page.parents[i]], "chars": 0, "may_go": page.in_slot(i)})
                    row["chars"] += page.chars[i]
                    row["may_go"] &= page.in_slot(i)
            slots.append(list(held.values()))
            chars.append(page.chars[0])
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(subtrees, pa.list_(pa.int64())), pa.array(slots, kind), pa.array(chars, pa.int64())], names=["host", "key", "subtrees", "slots", "chars"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, subtrees, slots): the template hashes of each host that has ``min_pages`` different pages or more.

    A host's subtrees are few: each stands on a ``min_share`` of its pages.
    """
    schema = "host long, key long, subtrees array<long>, slots array<struct<slot:bigint,parent:bigint,chars:bigint,may_go:boolean>>, chars long"
    hashed = table(_parts(pages).select("html", "host", "key").mapInArrow(_hash_pages, schema).dropDuplicates(["key"]))
    sizes = table(hashed.groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("all_chars")).filter(F.col("pages") >= min_pages))
    counts = hashed.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    whole = counts.join(sizes, "host").filter(F.col("n") >= min_share * F.col("pages")).groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))

    each = hashed.select("host", F.explode("slots").alias("s")).select("host", "s.*").groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.first("parent").alias("parent"), F.bool_and("may_go").alias("may_go"))
    placed = table(each.filter(F.col("n") >= min_pages).join(sizes, "host"))
    frame = placed.filter(2 * F.col("chars") > F.col("all_chars")).select("host", F.col("slot").alias("parent"))
    small = placed.filter(F.col("may_go") & (F.col("n") >= SLOT_SHARE * F.col("pages")) & (F.col("chars") <= SLOT_TEXT * F.col("all_chars")))
    beside = small.join(frame, ["host", "parent"], "left_semi").groupBy("host").agg(F.collect_set("slot").alias("slots"))
    none = F.array().cast("array<long>")
    return table(sizes.select("host").join(whole, "host", "left").join(beside, "host", "left").select("host", F.coalesce("subtrees", none).alias("subtrees"), F.coalesce("slots", none).alias("slots")))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        texts = [main_text(x, set(t or ()), set(s or ()), t is None) for x, t, s in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    found = templates(pages, min_pages, min_share)
    held = found.agg(F.coalesce(F.sum(2 + F.size("subtrees") + F.size("slots")), F.lit(0)).alias("n")).first()["n"]
    joined = _parts(pages).join(F.broadcast(found) if held <= MOST_BROADCAST else found, "host", "left").select("html", "subtrees", "slots", "page_id", "url")
    return joined.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
