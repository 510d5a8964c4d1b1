"""Main text of web pages by template deduction.

Tokens of a page are its start tags, told apart by their path of tags and classes, and its blocks of text under such a path.
Tokens of one host that share an occurrence vector (how often each page holds them) form an equivalence class; vectors
are compared by a sum of page hashes weighted by counts, with the number of pages and of occurrences, so that each task
ships one row a token and a hot host is summed before the shuffle. A class is valid if it holds several tokens and stands on
enough pages of the host; paths say how classes nest. Valid classes make up the template: their tags are its skeleton, and a block
of text in one of them, on nearly all pages of a host whose pages differ, is template text, not what a page says.

The slot that holds the article is found from the top: as long as one skeleton element holds nearly all of the host's text that is not
navigation, notice or link, the slot lies in it; where headings or paragraphs that aren't template text stand beside it, at any depth
or, on the level of the page itself, right there, it is the element around them. The blocks in that slot that aren't template text are read, in page order.

What a template can't tell is left out by what elements say they are, as a last resort: by tag (menus, page headers, footers, sidebars, forms
and their controls; noscript holds what readers with scripts don't see, svg and canvas are pictures), and by whole names of classes, ids
and roles. A compound name counts if each of its parts does ("site-header"; not "section-header" or "has-sidebar"). Names that may also be
those of a paragraph's contents ("reply", "related") count on containers only, and inside an article or main element only names that no part of
an article has ("comments", "advert"; a discussion, a form of words or a notice may be the article's own). A header in an article is the article's own. A
control inside a paragraph goes without cutting it in two. Where nothing would be left of a page, names are not believed.

Every host has its own template, however few its pages. Text counts as template text from two pages on that differ, unless it makes up most of the slot's text, as on
pages that are near copies; headings in the slot stay, since sections of articles have equal names. A page without its host's slot is read whole, without
the elements left out above.

Cases: null and empty html give an empty text and null urls are one host; unclosed and stray tags, comments and raw script text
are dealt with as browsers do; pages that repeat count as pages, but text that they alone share is no template text; any length is read
whole; an empty table gives an empty result; other columns are kept, but columns named like an output give way to it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored, unused, without

#: Different pages that template text must stand on; shares of pages that a class and a template text must stand on; share of a host's text a slot must hold, and
#: that text may have which is the same on all pages.
LEAST_DIFFERENT, FREQUENT, CONSTANT, HOLDS, SAME = 2, 0.5, 0.9, 0.8, 0.5

RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|noembed|noframes"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle".split())
#: Start tags that close an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section main aside nav div body blockquote td th".split())
#: Tags of elements that aren't the article, and of those whose own header belongs to it.
LEFT_OUT = frozenset("head nav header footer aside form dialog menu fieldset".split())
OWNERS = frozenset("article main".split())
#: Names of adverts, menus, notices and comments, on any element; names that count on containers only; parts that say nothing by themselves.
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs masthead contentinfo sidebar cookie cookies consent gdpr comments commentlist disqus newsletter toolbar".split())
CONTAINER_NAMES = SURE_NAMES | frozenset("promotion banner header footer aside complementary widget widgets notice notices alert comment discussion reply replies respond form search login signup subscribe subscription share sharing social related popup modal".split())
PLAIN_PARTS = frozenset("site page main top bottom left right global primary secondary list box bar block area wrapper wrap container inner outer links items posts articles".split())
#: Names that count inside an article.
INNER_NAMES = SURE_NAMES - {"menu", "toolbar"} | frozenset("comment comments replies widget widgets promotion login signup subscribe subscription popup modal sharing".split())
CONTAINERS = frozenset("div section ul ol dl table aside details figure footer header nav form iframe center".split())
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Blocks whose text belongs to what stands beside them.
PAGE_LEVEL = re.compile(r"(?:\A|/)(?:body|html)(?:\.[^/]*)?\Z")
HEADING = re.compile(r"h[1-6](?:\.|\Z)")
PROSE = re.compile(r"(?:h[1-6]|p|blockquote|pre|figure)(?:\.|\Z)")


def says(names: list[str], known: frozenset[str]) -> bool:
    """Whether one of the names, as a whole or in each of its parts, is a known one."""
    for name in names:
        parts = [x for x in re.split(r"[-_]+|(?<=\d)(?=\D)|(?<=\D)(?=\d)", name) if x]
        if name in known or any(x in known for x in parts) and all(x in known or x in PLAIN_PARTS or x.isdigit() for x in parts):
            return True
    return False


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


class Block:
    """out: 0 for text that may be the article's, 1 for what a name leaves out, 2 for what a tag does."""

    __slots__ = ("path", "text", "links", "out")

    def __init__(self, path: tuple[str, ...], text: str, links: int, out: int):
        self.path, self.text, self.links, self.out = path, text, links, out

    def token(self) -> tuple[str, str]:
        return "/".join(self.path), hashlib.blake2b(self.text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def parsed(page: str) -> tuple[list[tuple[str, ...]], list[Block]]:
    """Paths of the start tags, and the blocks of text, both in page order."""
    starts: list[tuple[str, ...]] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, its step of the path, what leaves it or one above out
    pieces: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(tuple(s[1] for s in stack if s[0] not in INLINE), text, min(links, len(text)), stack[-1][2] if stack else 0))
            pieces.clear()
        links = 0

    def close(to: int) -> None:
        if any(s[0] not in INLINE for s in stack[to:]):
            flush()
        del stack[to:]

    def said(text: str) -> None:
        nonlocal links
        if text and not any(s[0] == "button" for s in stack):
            text = entities.unescape(text)
            pieces.append(text)
            if any(s[0] == "a" for s in stack):
                links += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                close(k)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                pieces.append(" ")
            continue
        if tag not in INLINE:
            closes = SIBLINGS.get(tag, ()) or ()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in closes:
                    close(k)
                    if tag not in SIBLINGS:
                        break
                elif stack[k][0] in FENCES:
                    break
            flush()
        if tag == "body":  # what is open of the head ends here
            close(next((k for k, s in enumerate(stack) if s[0] == "head"), len(stack)))
        names = [x for found in NAMED.findall(m["rest"]) for x in "".join(found[1:]).lower().split()] if "=" in m["rest"] else []
        step = tag + "".join("." + x.replace("/", "-") for x in sorted(set(names)))
        if tag in VOID or m["rest"].endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        out = stack[-1][2] if stack else 0
        inside = any(x[0] in OWNERS for x in stack)
        if tag in LEFT_OUT and not (tag == "header" and inside):
            out = 2
        elif not out and names and tag not in ("html", "body", *OWNERS) and says(names, (INNER_NAMES if inside else CONTAINER_NAMES) if tag in CONTAINERS else SURE_NAMES):
            out = 1
        stack.append((tag, step, out))
        if tag not in INLINE:
            starts.append(tuple(s[1] for s in stack if s[0] not in INLINE))
    said(page[at:])
    flush()
    return starts, blocks


def page_tokens(page: str) -> dict[tuple[str, str], list[int]]:
    """(path, digest of a block's text or "" for a tag) -> occurrences, characters of text that may be the article's under it."""
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    starts, blocks = parsed(page)
    for path in starts:
        out["/".join(path), ""][0] += 1
    for b in blocks:
        out[b.token()][0] += 1
        if not b.out:
            out[b.token()][1] += len(b.text) - b.links
            for k in range(1, len(b.path) + 1):
                out["/".join(b.path[:k]), ""][1] += len(b.text) - b.links
    return out


TOKENS = "host string, path string, word string, vector long, pages long, total long, chars long"


def token_sums(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Tokens of each host with their occurrence vectors, summed in the worker before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str], list[int]] = {}
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                raw = (page or "").encode()
                mark = crc32(raw) * 2654435761 + crc32(raw, 1)
                for (path, word), (n, chars) in page_tokens(page or "").items():
                    s = sums.setdefault((name, path, word), [0, 0, 0, 0])
                    s[0] = (s[0] + n * mark) & 0x7FFFFFFFFFFFFF
                    s[1] += 1
                    s[2] += n
                    s[3] += chars
            rows = [(*k, *v) for k, v in sums.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string()] * 3 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    bound_batches(pages.sparkSession)
    part = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(run, TOKENS)
    return _summed(part)


def _summed(tokens: DataFrame) -> DataFrame:
    # Sums of 55-bit marks stay within 64 bits for 256 partial rows; beyond, they are folded as they grow.
    fold = F.pmod(F.sum(F.col("vector").cast("decimal(20,0)")), F.lit(1 << 55).cast("decimal(20,0)")).cast("long")
    return tokens.groupBy("host", "path", "word").agg(fold.alias("vector"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("chars").alias("chars"))


def skeleton_slot(tags: list[tuple[str, int, int, int]], constant: set[str]) -> str:
    """The path of the article's slot from template tags (path, pages, total, chars) and the paths of template texts."""
    children: dict[str, list[tuple[str, int]]] = defaultdict(list)
    beside: dict[str, list[str]] = defaultdict(list)
    top = 0
    for path, on, total, chars in tags:
        above, _, step = path.rpartition("/")
        if on == total:  # once on a page: a token of the skeleton
            children[above].append((path, chars))
        if chars and PROSE.match(step) and path not in constant:
            beside[above].append(path)
            while (above := above.rpartition("/")[0]) and not PAGE_LEVEL.search(above):
                beside[above].append(path)
        top = max(top, chars)
    slot = ""
    while True:
        best = max(children.get(slot, []), key=lambda c: (c[1], c[0]), default=None)
        if best is None or not best[1] or best[1] < HOLDS * top:
            break
        slot = best[0]
    around = slot
    while around:
        inner, around = around, around.rpartition("/")[0]
        if any(path != inner and not path.startswith(f"{inner}/") for path in beside.get(around, ())):
            slot = around
    return slot


def template_texts(slot: str, members: list[tuple[str, str, int]]) -> list[str]:
    """Path and digest of the blocks that are template text, from the template's tags and texts (path, digest or "", characters)."""
    within = lambda path: not slot or path == slot or path.startswith(f"{slot}/")
    own = [m for m in members if m[1] and within(m[0])]
    whole = sum(m[2] for m in members if not m[1] and (m[0] == slot if slot else "/" not in m[0]))
    if sum(m[2] for m in own) > SAME * whole:
        own = []
    return sorted(f"{path} {word}" for path, word, _ in own if not HEADING.match(path.rpartition("/")[2]))


def templates(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, slot, texts (path and digest of each template text): the template of each host, from the equivalence classes of its tokens."""
    classes = tokens.groupBy("host", "vector", "pages", "total").agg(F.count("*").alias("members"))
    valid = classes.join(sizes, "host").where((F.col("members") >= 2) & (F.col("pages") >= FREQUENT * F.col("host_pages"))).select("host", "vector", "pages", "total", "host_pages", "differing")
    # Pages that repeat show nothing about their texts.
    sure = (F.col("pages") >= CONSTANT * F.col("host_pages")) & (F.col("differing") >= F.greatest(F.lit(LEAST_DIFFERENT), F.col("host_pages") / 2))
    members = tokens.join(valid, ["host", "vector", "pages", "total"]).where((F.col("word") == "") | sure)
    found = members.groupBy("host").agg(F.collect_list(F.struct("path", "word", "pages", "total", "chars")).alias("members"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, texts = [], []
            for members in batch.column("members").to_pylist():
                slot = skeleton_slot([(m["path"], m["pages"], m["total"], m["chars"]) for m in members if not m["word"]], {m["path"] for m in members if m["word"]})
                made.append(slot)
                texts.append(template_texts(slot, [(m["path"], m["word"], m["chars"]) for m in members]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string()), pa.array(texts, pa.list_(pa.string()))], names=["host", "slot", "texts"])

    return found.mapInArrow(slots, "host string, slot string, texts array<string>")


def main_text(page: str | None, slot: str | None, texts: list[str] | None = None) -> str:
    """The blocks of the slot that aren't template text, or of the whole page where it lacks the slot."""
    if not page:
        return ""
    every = parsed(page)[1]
    blocks = [b for b in every if not b.out] or [b for b in every if b.out == 1]
    if slot:
        steps = tuple(slot.split("/"))
        blocks = [b for b in blocks if b.path[: len(steps)] == steps] or blocks
    if texts:
        known = set(texts)
        blocks = [b for b in blocks if " ".join(b.token()) not in known]
    return "\n".join(b.text for b in blocks)


def extract(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds text and n_chars; the html goes."""
    kept = without(df, html, "text", "n_chars")
    hosts = df.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    tokens = stored(token_sums(hosts), "page-tokens")
    counts = F.count("*").alias("host_pages"), F.approx_count_distinct(F.xxhash64("html")).alias("differing")
    sizes = stored(hosts.groupBy("host").agg(*counts), "page-hosts")
    # A table of one row a host; its size on disk decides whether it is broadcast.
    host, of, slot, texts, page = unused(df, "_host", "_of", "_slot", "_texts", "_html")
    slots = stored(templates(tokens, sizes), "page-slots").select(F.col("host").alias(host), F.col("slot").alias(slot), F.col("texts").alias(texts))
    keyed = df.select(*kept, F.col(html).alias(page), host_of(F.col(url)).alias(of))
    joined = keyed.join(slots, F.col(of) == F.col(host), "left").select(*kept, page, slot, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [main_text(*x) for x in zip(*(batch.column(c).to_pylist() for c in (page, slot, texts)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64())], names=[*kept, "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
