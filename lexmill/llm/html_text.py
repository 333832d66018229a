"""Main-text extraction by equivalence-class template deduction.

Pages of one host share a template.  Every page is cut into tokens: opening
and closing tags of elements with their path, class and id, and text blocks
with their path.  A token's occurrence vector says how often it occurs on
each page of the host; it is kept as a sum of page hashes weighted by the
counts, which partial aggregation can merge, so no host's pages ever meet in
one task.  Tokens with equal vectors form an equivalence class.  A class is
valid if it covers most pages of the host, has two tokens or more, is ordered
(on most of its pages its tokens follow each other in one order, once or
several times over) and nests (there it lies inside one gap of every other
class that it meets, or beside it).  The valid classes are the template, and
what the template fixes is no content, wherever it is; the rest are its slots.
Pages whose article is the same are one page for the deduction, or else the
copies of an article would make it a template.

The slots are read in page order, and then checked by names: slots inside
boilerplate elements (menus, headers, footers, side bars, notices, adverts,
forms, scripts, comments) are left out, and if a page has an article or main
element, only slots inside it count.  Names are whole class or id names.

Null and empty pages give an empty text; a null url is a host of its own;
repeated rows give the same text each.  Work is linear in a page's length,
whatever its depth.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .common import materialise, prepare, scratch

#: Template classes need this share of a host's pages, and this many pages.
MIN_SUPPORT = 0.9
MIN_PAGES = 5
#: Tokens of a valid class, at least.
MIN_TOKENS = 2
#: Templates up to this number of tokens in all are broadcast (8 bytes each); more are joined by host and a salt.
BROADCAST_TOKENS = 4_000_000
SALTS = 32
_TOKEN = regex.compile(
    r"<!--.*?(?:-->|(?P<cut>\Z))|<!\[CDATA\[.*?(?:\]\]>|(?P<cut>\Z))|<[!?][^>]*+>?|<(?P<raw>script|style|textarea|title|noscript|template|iframe)\b[^>]*+>.*?(?:</(?P=raw)\s*>|(?P<cut>\Z))|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<",
    regex.S | regex.I,
)
_ATTR = regex.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", regex.I)

# Element names by their part in a page.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_BOILERPLATE = frozenset("nav header footer aside form head menu dialog search fieldset button select svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_IN_HEAD = frozenset("base link meta title script style noscript template".split())
#: Elements whose start ends an open one of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_NAME = regex.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary)[-_]?)?(?:header|footer|nav|navigation|navbar|menu|sidebar|side-bar|masthead|banner)(?:[-_](?:left|right|top|bottom|menu|links?|wrap|wrapper|inner|container))?"
    r"|ads?|advert|adverts|advertisement|advertising|adsense|adslot|(?:ad|ads|advert|advertisement)[-_](?:slot|unit|box|banner|block|container|wrapper|label|top|bottom|\d+)|sponsor|sponsored|sponsors|promo|promos|promotion|promoted|(?:promo|sponsored)[-_](?:box|banner|block|links?|content)"
    r"|breadcrumbs?|pagination|pager|toolbar|skip-?link|(?:cookie|consent|gdpr|privacy)[-_]?(?:banner|notice|bar|popup|consent|message)|cookies?|consent|gdpr|notice|site-notice|alert|popup|modal|overlay|lightbox|widget|widgets"
    r"|comments?|(?:comments?|reply)[-_](?:list|section|area|form|thread|box|respond|body|\d+)|respond|replies|disqus|disqus_thread"
    r"|share|sharing|social|(?:share|social)[-_](?:buttons?|links?|bar|icons?|media|share)|related|(?:related|recommended|more)[-_](?:posts?|articles?|links?|stories|content|reading)|recommended|recommendations|newsletter|newsletter[-_](?:signup|form|box)|subscribe|subscription|signup|login",
    regex.I,
)
_COMMENT = regex.compile(r"comments?|(?:comments?|reply)[-_](?:list|section|area|form|thread|box|respond|body|\d+)|reply|replies", regex.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
_HIDDEN = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", regex.I)
_MASK = (1 << 64) - 1


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _is_boilerplate(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element is one by its name, role, style, class or id; the header of an article is a part of it."""
    if tag in _BOILERPLATE and not (in_main and tag == "header"):
        return True
    if not attrs:
        return False
    named = _COMMENT if tag == "article" else _NAME
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main") and any(named.fullmatch(v) for v in value.split()):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return False


class Page:
    """A page's text blocks and tokens, read in one pass with a stack of open elements."""

    def __init__(self, page: str):
        #: Token, text, whether in boilerplate, whether in an article or main element, of every block in page order.
        self.blocks: list[tuple[int, str, bool, bool]] = []
        #: All tokens, of tags and texts, in page order.
        self.stream: list[int] = []
        self._stack: list[tuple[str, bool, bool, int, list[str] | None]] = [("", False, False, 0, None)]
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        # Without a later ">" there is no further tag: what is left is text up to its first "<" before a name,
        # unless it belongs to a comment or a raw element that is still open.
        end, cut = page.rfind(">") + 1, False
        for m in _TOKEN.finditer(page, 0, end):
            tag = m["tag"]
            if tag is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    self._text.append(piece)
                elif piece.startswith("<![CDATA["):
                    self._text.append(piece[9:].removesuffix("]]>"))
            else:
                self._tag(tag.lower(), bool(m["close"]), m["attrs"])
            cut = m["cut"] is not None
        if not cut:
            self._text.append(regex.split(r"<[a-zA-Z/!?]", page[end:], maxsplit=1)[0])
        self._close(1)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            joined = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if joined:
                _, boilerplate, main, path, _ = self._stack[-1]
                token = _hash(joined, path)
                self.blocks.append((token, joined, boilerplate, main))
                self.stream.append(token)

    def _tag(self, tag: str, close: bool, attrs: str) -> None:
        block = tag in _BLOCKS
        if close:
            if self._open[tag]:
                if block:
                    self._flush()
                at = len(self._stack) - 1
                while self._stack[at][0] != tag:
                    at -= 1
                self._close(at)
            elif block:
                self._flush()
            return
        if tag == "br":
            self._text.append(" ")
        if tag in _VOID or attrs.endswith("/") and not block:
            if block:
                self._flush()
            return
        top, _, main, _, _ = self._stack[-1]
        boilerplate = _is_boilerplate(tag, attrs, main)
        if block:
            self._flush()
            if top == "head" and tag not in _IN_HEAD or top == "p" or top in _ENDS.get(tag, ()):
                self._close(len(self._stack) - 1)
                if tag == "tr" and self._stack[-1][0] == "tr":
                    self._close(len(self._stack) - 1)
            self._push(tag, boilerplate, tag in _MAIN, attrs, None)
        elif boilerplate:
            # The text of the block around an inline element goes on behind it.
            self._push(tag, True, False, attrs, self._text)
            self._text = []

    def _push(self, tag: str, boilerplate: bool, main: bool, attrs: str, held: list[str] | None) -> None:
        _, in_boilerplate, in_main, path, _ = self._stack[-1]
        here = _hash(tag, path)
        self._stack.append((tag, in_boilerplate or boilerplate, in_main or main, here, held))
        self._open[tag] += 1
        names = sorted((n.lower(), a or b or c) for n, a, b, c in _ATTR.findall(attrs) if n.lower() in ("class", "id")) if attrs else ()
        self.stream.append(_hash(f"<{names}", here))

    def _close(self, at: int) -> None:
        """Close the elements of the stack from ``at`` on, innermost first."""
        while len(self._stack) > at:
            held = self._stack[-1][4]
            self._flush()
            tag, _, _, path, _ = self._stack.pop()
            self._open[tag] -= 1
            self.stream.append(_hash("\1>", path))
            if held is not None:
                self._text = held

    @property
    def signature(self) -> int:
        """The page's article, or all its text outside boilerplate, as a hash."""
        whole = [t for t, _, _, main in self.blocks if main] or [t for t, _, boilerplate, _ in self.blocks if not boilerplate]
        return _hash(",".join(map(str, whole)))


def host_of(url: Column) -> Column:
    """A url's host in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[^/?#]*//)?(?:[^/?#]*@)?([^/?#]*)", 1))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its host, its article's hash and its tokens."""
    for batch in batches:
        pages = [Page(html) for html in batch.column("html").to_pylist()]
        tokens = pa.array([[_signed(t) for t in p.stream] for p in pages], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_signed(p.signature) for p in pages], pa.int64()), tokens], names=["host", "signature", "tokens"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token of a batch: pages, and the count-weighted sum of page hashes; token 0 counts pages."""
    for batch in batches:
        pages: Counter = Counter()
        vector: Counter = Counter()
        for host, signature, tokens in zip(batch.column("host").to_pylist(), batch.column("signature").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            mark = _hash(str(signature))
            pages[host, 0] += 1
            for token, n in Counter(tokens).items():
                pages[host, token] += 1
                vector[host, token] = (vector[host, token] + n * mark) & _MASK
        hosts = [h for h, _ in pages]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array([t for _, t in pages], pa.int64()), pa.array(list(pages.values()), pa.int64()), pa.array([_signed(vector[k]) for k in pages], pa.int64())],
            names=["host", "token", "pages", "vector"],
        )


def order_of(tokens: list[int]) -> int:
    """The order in which a class's tokens follow each other on a page, as a hash; 0 if they do not repeat one order."""
    size = len(set(tokens))
    if len(tokens) % size or any(t != tokens[i % size] for i, t in enumerate(tokens)):
        return 0
    return _hash(",".join(map(str, tokens[:size])))


def crossing(rounds: list[tuple[int, int, int]]) -> set[int]:
    """Classes that cross another one: rounds are (first place, last place, class), and of two that cross the later one is meant."""
    out: set[int] = set()
    stack: list[tuple[int, int]] = []  # last place and class of the rounds that are open
    for first, last, number in sorted(rounds, key=lambda r: (r[0], -r[1])):
        while stack and stack[-1][0] < first:
            stack.pop()
        if stack and stack[-1][0] < last:
            out.add(number)
        else:
            stack.append((last, number))
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host, class and order of its tokens: pages of a batch on which the class nests."""
    for batch in batches:
        seen: Counter = Counter()
        class_of: dict[str, dict[int, int]] = {}
        classes = batch.column("classes")
        for i, (host, stream) in enumerate(zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
            if host not in class_of:
                class_of[host] = {t: c["class"] for c in classes[i].as_py() for t in c["members"]}
            known = class_of[host]
            found: dict[int, list[tuple[int, int]]] = {}
            for place, token in enumerate(stream):
                if (number := known.get(token)) is not None:
                    found.setdefault(number, []).append((place, token))
            order = {number: order_of([t for _, t in hits]) for number, hits in found.items()}
            rounds = []
            for number, hits in found.items():
                if order[number]:
                    size = len({t for _, t in hits})
                    rounds += [(hits[k][0], hits[k + size - 1][0], number) for k in range(0, len(hits), size)]
            crossed = crossing(rounds)
            for number in found:
                seen[host, number, 0 if number in crossed else order[number]] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _, _ in keys], pa.string()), pa.array([n for _, n, _ in keys], pa.int64()), pa.array([_signed(o) for _, _, o in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["host", "class", "order", "n"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """host and template: the tokens of its valid equivalence classes; of pages with html and host."""
    with scratch(pages.sparkSession) as keep:
        streams = pages.select("host", "html").mapInArrow(bk.tidy(_streams), "host string, signature long, tokens array<long>")
        streams = materialise(streams.dropDuplicates(["host", "signature"]), "streams")
        rows = streams.mapInArrow(bk.tidy(_vectors), "host string, token long, pages long, vector long")
        # Hash sums wrap around: a bitwise split keeps ANSI sums from overflowing.
        low, high = F.col("vector").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("vector", 32)
        token = rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum(low).alias("low"), F.sum(high).alias("high"))
        carried = (F.col("high") + F.shiftrightunsigned("low", 32)).bitwiseAND((1 << 32) - 1)
        token = token.select("host", "token", "pages", F.shiftleft(carried, 32).bitwiseOR(F.col("low").bitwiseAND((1 << 32) - 1)).alias("vector"))
        token = materialise(token, "tokens")
        total = materialise(token.where(f"token = 0 and pages >= {MIN_PAGES}").select("host", F.col("pages").alias("host_pages")), "hosts")
        # Few tokens are on as many pages as the smallest template needs; only these meet their host.
        frequent = token.where((F.col("token") != 0) & (F.col("pages") >= MIN_SUPPORT * MIN_PAGES))
        wide = frequent.join(total, "host").where(F.col("pages") >= MIN_SUPPORT * F.col("host_pages"))
        classes = wide.groupBy("host", F.col("vector").alias("class"), "pages").agg(F.collect_set("token").alias("members")).where(F.size("members") >= MIN_TOKENS)
        classes = materialise(classes, "classes")
        per_host = materialise(classes.groupBy("host").agg(F.collect_list(F.struct("class", "members")).alias("classes")), "host-classes")
        met = _by_host(streams, per_host, F.xxhash64("signature"), "classes").select("host", "tokens", "classes").mapInArrow(bk.tidy(_orders), "host string, class long, order long, n long")
        orders = met.where("order != 0").groupBy("host", "class", "order").agg(F.sum("n").alias("n"))
        ordered = orders.groupBy("host", "class").agg(F.max("n").alias("n"))
        valid = classes.join(ordered, ["host", "class"]).where(F.col("n") >= MIN_SUPPORT * F.col("pages"))
        return keep(valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("template")), "templates")


def _by_host(rows: DataFrame, facts: DataFrame, deal: Column, sizes: str, how: str = "inner") -> DataFrame:
    """Rows with the facts of their host: broadcast up to a size, else joined with a salt, which splits large hosts."""
    number = F.size(sizes) if sizes == "template" else F.aggregate(sizes, F.lit(0), lambda n, c: n + F.size(c["members"]))
    if facts.agg(F.coalesce(F.sum(number + 8), F.lit(0))).first()[0] <= BROADCAST_TOKENS:
        return rows.join(F.broadcast(facts), "host", how)
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(deal, F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how).drop("salt")


def main_text(page: str, template: frozenset[int] | set[int]) -> str:
    """The content slots of a page, joined by blank lines: the template decides, then the names."""
    found = Page(page).blocks
    has_main = any(main and not boilerplate for _, _, boilerplate, main in found)
    return "\n\n".join(text for token, text, boilerplate, main in found if not boilerplate and (main or not has_main) and token not in template)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        known: dict[str, frozenset[int]] = {}
        found = batch.column("template")
        for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host not in known:
                known[host] = frozenset(t & _MASK for t in found[i].as_py() or ())
            texts.append(main_text(page, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    joined = _by_host(narrow, templates(narrow), F.xxhash64("page_id", "url"), "template", "left").select("page_id", "url", "html", "host", "template")
    return joined.mapInArrow(bk.tidy(_extract), "page_id long, url string, text string, n_chars long")
