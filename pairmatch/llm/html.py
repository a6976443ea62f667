"""Main text of web pages, by differencing each page against its nearest neighbour.

Pages of one host are paired by URL path.  The text lines of a page are aligned with those of its
neighbour by longest common subsequence, and the lines both share are template text.  Markup that
says what it is comes first: lines inside navigation, adverts, forms, comments and the like always
go, lines inside a declared main element always stay (two pages of a host may quote the same
passage, or be copies), and differencing decides all other lines.  A page with an article, a main
element or a main role has no other lines than those.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.llm.common import lists, small_batches, stored
from pairmatch.operators.ordering import number_rows

# fixed values: elements of HTML by what they do to text
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
TEMPLATE = {
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "input", "svg", "canvas", "object",
    "audio", "video", "head", "fieldset", "datalist", "map",
}
MAIN = {"article", "main"}
# fixed values: words in class, id or role that name parts of a page
TEMPLATE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer",
    "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "privacy", "promo", "related",
    "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "articlebody"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_UNQUOTED = re.compile(r"[^>\"']*")
_NAMING = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# elements that some pages wrap around all they have
WRAPPERS = {"form", "fieldset", "header"}
DECLARED, KEEP, DECIDE, DROP = 3, 2, 1, 0


def _says(attributes: str) -> tuple[int | None, bool]:
    """What class, id and role say about an element, if anything, and if it is hidden.

    Words count if they are a whole name: "has-sidebar" or "post-meta" says nothing.
    """
    names: set[str] = set()
    main = False
    for name, *values in _NAMING.findall(attributes):
        value = "".join(values).strip().lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return DROP, True
        names.update(value.split())
        main |= name.lower() == "role" and "main" in value.split()
    if main:
        return DECLARED, False
    if names & TEMPLATE_WORDS:
        return DROP, False
    return (KEEP if names & MAIN_WORDS else None), False


def _element(name: str, attributes: str) -> tuple[int | None, bool]:
    """What an element and its attributes say about its text, and if it goes even around an article."""
    said, hidden = _says(attributes)
    if name == "body":
        return None, False
    if name in TEMPLATE and said != DECLARED:
        return DROP, hidden or name not in WRAPPERS
    if name in MAIN and not hidden and (name == "main" or said != DROP or MAIN_WORDS & set(_names(attributes))):
        return DECLARED, False
    return said, hidden


def _names(attributes: str) -> list[str]:
    return [w for _, *values in _NAMING.findall(attributes) for w in "".join(values).lower().split()]


def _tag_end(html: str, at: int) -> tuple[int, int]:
    """Where the attributes of a tag end, and the tag itself; a quote without a partner is a letter as others are.

    Every step goes on where the last one ended, and a quote is missed twice at most, once of each kind.
    """
    missed = ""
    while True:
        at = _UNQUOTED.match(html, at).end()
        if at == len(html):
            return at, at
        if html[at] == ">":
            return at, at + 1
        close = -1 if html[at] in missed else html.find(html[at], at + 1)
        if close < 0:
            missed += html[at]
        at = max(at, close) + 1


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with DECLARED, KEEP, DECIDE or DROP by its markup.

    What only a class, id or role calls template text, a form or a header isn't dropped if it holds the page's article
    or main element.  Unclosed elements end with their parents, unclosed comments and tags with the page; a quote that
    nothing closes doesn't keep its tag from ending.  Character references are decoded and white space becomes one space.
    Time follows the length of the page, whatever is in it.
    """
    lines, around = _parsed(html, frozenset())
    return _parsed(html, frozenset(around))[0] if around else lines


def _parsed(html: str | None, spared: frozenset[int]) -> tuple[list[tuple[str, int]], set[int]]:
    """The lines, and the places of dropped elements around an article; those in ``spared`` say nothing."""
    out: list[tuple[str, int]] = []
    around: set[int] = set()
    # name, how its lines go, what it says itself, if it goes in any case, its place, the depth of the block it is in
    stack: list[tuple[str, int, int | None, bool, int, int]] = [("", DECIDE, None, False, -1, 0)]
    held: Counter[str] = Counter()  # names on the stack
    seen = 0  # how much of the stack was looked at for what is around an article
    pieces: list[str] = []

    def flush() -> None:
        line = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if line:
            out.append((line, stack[-1][1]))

    def leave(depth: int) -> None:
        nonlocal seen
        held.subtract(entry[0] for entry in stack[depth:])
        del stack[depth:]
        seen = min(seen, depth)

    html = html or ""
    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        pieces.append(html[at : tag.start() if tag else end])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:  # comment or declaration: not even a space
            continue
        stop, at = _tag_end(html, at)
        attributes = html[tag.end() : stop]
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            if name in VOID or name not in ("span", "a", "label", "small"):
                continue
        else:
            flush()
        if tag[1]:
            if held[name] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                if name in INLINE and (stack[depth][1] != stack[depth - 1][1] or stack[depth][2] == DROP):
                    flush()
                leave(depth)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        above = stack[-1][1]
        said, firm = _element(name, attributes)
        if name == "header" and above < KEEP and said != DECLARED:
            said, firm = DROP, _says(attributes)[1]
        if at in spared:
            said = None
        if said == DECLARED:
            while seen < len(stack):
                _, _, own, stays, place, _ = stack[seen]
                if own == DECLARED or stays:
                    break
                if own == DROP:
                    around.add(place)
                seen += 1
        now = _below(above, said)
        if name == "p":  # a paragraph ends the one before it
            if stack[stack[-1][5]][0] == "p":
                leave(stack[-1][5])
            now = _below(stack[-1][1], said)
        elif name in INLINE and (now != above or said == DROP):
            flush()
        stack.append((name, now, said, firm, at, stack[-1][5] if name in INLINE else len(stack)))
        held[name] += 1
    flush()
    return out, around


def _below(above: int, said: int | None) -> int:
    """How the lines of an element go that says ``said``, in one whose lines go as ``above``."""
    return DROP if DROP in (above, said) else max(above, said or above)


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own``'s lines are in a longest common subsequence with ``other``.

    Lines that only one page has are left out and common beginnings and ends matched.  The rest is cut in halves where
    the lengths of both halves' subsequences add up to most (Hirschberg), and the lengths are had for 64 lines of the other
    page at a time (bit vectors), so memory follows the lines and time their product over 64, however often lines repeat.
    """
    keep = np.zeros(len(own), bool)
    numbers = {line: n for n, line in enumerate(np.intersect1d(own, other).tolist())}
    mine = [(numbers[line], i) for i, line in enumerate(own.tolist()) if line in numbers]
    theirs = [numbers[line] for line in other.tolist() if line in numbers]
    places = np.array([i for _, i in mine], np.int64)
    todo = [([n for n, _ in mine], theirs, 0)]
    while todo:
        a, b, at = todo.pop()
        most = min(len(a), len(b))
        begin = 0
        while begin < most and a[begin] == b[begin]:
            begin += 1
        end = 0
        while end < most - begin and a[-1 - end] == b[-1 - end]:
            end += 1
        keep[places[at : at + begin]] = True
        keep[places[at + len(a) - end : at + len(a)]] = True
        a, b, at = a[begin : len(a) - end], b[begin : len(b) - end], at + begin
        if not a or not b:
            continue
        if len(a) == 1:
            keep[places[at]] |= a[0] in b
            continue
        half = len(a) // 2
        first = common_lengths(a[:half], b)
        second = common_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(first + second))
        todo.append((a[:half], b[:cut], at))
        todo.append((a[half:], b[cut:], at + half))
    return keep


def common_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and the first 0, 1, ... elements of ``b``.

    Bit j of the vector is 0 where the length grows with element j (Crochemore and others, 2001).
    """
    wanted = set(a)
    where = defaultdict(list)
    for j, line in enumerate(b):
        if line in wanted:
            where[line].append(j)
    # a mask of its own for lines that repeat; there are few of those
    masks = {line: _mask(found, len(b)) for line, found in where.items() if len(found) > 16}
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        if line in masks:
            both = row & masks[line]
        elif line in where:
            both = row & sum(1 << j for j in where[line])
        else:
            continue
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _mask(places: list[int], n: int) -> int:
    bits = np.zeros(n, np.uint8)
    bits[places] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def main_text(html: str | None, neighbour: np.ndarray | None) -> str:
    """The page's text without template lines; ``neighbour`` has the line hashes of the paired page."""
    lines = text_lines(html)
    shared = np.zeros(len(lines), bool)
    if neighbour is not None and len(neighbour):
        shared = shared_lines(line_hashes(lines), neighbour)
        undecided = np.array([how == DECIDE for _, how in lines], bool)
        # a copy of the page, with all its undecided lines, says nothing about the template
        if undecided.any() and shared[undecided].all():
            shared[:] = False
    declared = any(how == DECLARED for _, how in lines)
    return "\n".join(
        line
        for (line, how), both in zip(lines, shared, strict=True)
        if how >= KEEP or (how == DECIDE and not both and not declared)
    )


def line_hashes(lines: list[tuple[str, int]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(line) for line, _ in lines), np.uint64, len(lines))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        hashes = [line_hashes(text_lines(h)).view(np.int64) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("host"), batch.column("path"), lists(hashes, pa.int64())],
            ["key", "host", "path", "hashes"],
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html"):
        texts = []
        for html, other in zip(batch.column("html").to_pylist(), batch.column("other"), strict=True):
            hashes = None if not other.is_valid else np.asarray(other.values, np.int64).view(np.uint64)
            texts.append(main_text(html, hashes))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def nearest_pages(pages: DataFrame) -> DataFrame:
    """For each distinct page ``key``, the ``other`` page of its host with the nearest path.

    Pages are sorted by host and path over all tasks; the neighbour before or after with the longer
    common beginning of the path is taken, the one before if they tie.  Only keys and paths move, a
    host with a third of the pages is spread over tasks.  Pages of a host with the same line hashes have one place in the order, at the
    least of their paths, and share the ``other``.
    """
    # copies of one page, whatever their paths, have one place; they meet the next different page
    kinds = pages.groupBy("host", "content").agg(F.min(F.struct("path", "key")).alias("least"))
    kinds = kinds.select("host", "content", F.col("least.path").alias("path"), F.col("least.key").alias("first"))
    numbered = number_rows(kinds, ["host", "path", "content"], "n")
    beside = numbered.select(
        F.col("host").alias("h"), F.col("path").alias("p"), F.col("first").alias("other"), F.col("content").alias("c"),
        F.explode(F.array(F.struct((F.col("n") + 1).alias("at"), F.lit(0).alias("after")),
                          F.struct((F.col("n") - 1).alias("at"), F.lit(1).alias("after")))).alias("s"),
    ).select("h", "p", "other", "c", "s.at", "s.after")
    # place of the first letter that differs; 0 if the paths are equal
    differ = F.array_position(F.zip_with(F.split("path", ""), F.split("p", ""), lambda x, y: x.eqNullSafe(y)), False)
    same = F.when(differ == 0, F.length("path")).otherwise(differ - 1)
    pairs = numbered.join(beside, (F.col("n") == F.col("at")) & (F.col("host") == F.col("h")) & (F.col("content") != F.col("c")))
    order = Window.partitionBy("n").orderBy(same.desc(), "after")  # two rows at most
    best = pairs.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return pages.join(best.select("host", "content", "other"), ["host", "content"]).select("key", "other")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null html is empty and gives the empty text; a page without url, or alone on its host, has no
    neighbour, so its undecided lines stay.  Repeated rows get the same text each, and null ids stay
    null.  Other columns are ignored.  Nothing is cut: texts and pages are whole.
    """
    source = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = source.withColumn("key", F.unhex(F.md5(F.concat_ws("|", F.coalesce("url", F.lit("")), F.md5(F.coalesce("html", F.lit("")))))))
    rest = F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, "^//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(rest, "^(?://[^/?#]*)?([^?#]*)", 1)
    located = keyed.where(host != "").select("key", "html", host.alias("host"), path.alias("path"))
    digests = located.mapInArrow(_digests, "key binary, host string, path string, hashes array<bigint>")
    # read four times from here on, and html is parsed once for all of them
    digests = stored(digests.withColumn("content", F.xxhash64("hashes")).dropDuplicates(["key"]))
    near = nearest_pages(digests.drop("hashes"))
    others = near.join(digests.select(F.col("key").alias("other"), "hashes"), "other").select(
        "key", F.col("hashes").alias("other")
    )
    return keyed.join(others, "key", "left").select("page_id", "url", "html", "other").mapInArrow(
        _extracted, "page_id bigint, url string, text string, n_chars bigint"
    )
