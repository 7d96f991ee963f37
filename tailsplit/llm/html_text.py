"""Main text of web pages by two passes over their blocks.

The first pass decides by link density, length and stop-word density; the place of a block in the page decides what
is furniture whatever it says. Short blocks without links stay open; the second pass gives them the label of the
nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOOD, BAD, OPEN = 1, 0, -1
LINK_SHARE = 0.5  # of a block's characters, from which it is a menu
SHORT = 70  # characters below which a block is not judged by its words
STOP_SHARE = 0.15  # of a block's words, from which it is prose

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be by for from has have he in is it its not of on or she that the they this to was were which with
au aux avec dans de des du elle en est et il la le les mais ne ou par pas pour qui que se sur un une
als am auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie und von zu
al como con de del el ella en es la las lo los más no para pero por que se su un una y
""".split())
# Elements by their role.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section
select summary table tbody td tfoot th thead tr ul""".split())
FURNITURE = frozenset("nav aside footer form button select datalist menu dialog object canvas audio video head".split())
MAIN = frozenset("article main".split())
ENDS_PARAGRAPH = BLOCKS - {"option", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main body".split())
# Words of class, id and role that name furniture.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs
comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr legal login
menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo recommended related
replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser
toolbar topbar tracking widget""".split())
SPARED = frozenset("article body content entry has main no page post story text with without wrapper".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+>?""",
                   re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                       re.I | re.S)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD = re.compile(r"[^\W\d_]+")


def is_furniture(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_main:
        return True
    if not attributes or tag in MAIN and "comment" not in attributes.lower() or tag in ("html", "body"):
        return False
    names: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        names.update(x.lower() for x in PARTS.findall(value))
    return bool(names & NAMES) and not names & SPARED or not in_main and "header" in names and not names & SPARED


def blocks_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links, whether in the main part) of each block outside furniture, in page order."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = at = furniture = main = links = 0
    stack: list[tuple[str, bool, bool]] = []

    def flush() -> None:
        nonlocal linked
        if text:
            found = " ".join(html.unescape("".join(text)).split())
            if found:
                out.append((found, linked, main > 0))
            text.clear()
        linked = 0

    def pop() -> str:
        nonlocal furniture, main, links
        tag, outside, inside = stack.pop()
        furniture -= outside
        main -= inside
        links -= tag == "a"
        return tag

    def close(tags: set[str], limits: frozenset[str]) -> None:
        """Ends the nearest open element of the kind, with all in it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in limits:
                return

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not furniture:
            text.append(piece)
            if links:
                linked += len("".join(html.unescape(piece).split()))

    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag in BLOCKS:
                flush()
            close({tag}, frozenset())
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                say(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_PARAGRAPH:
                close({"p"}, SCOPES)
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPES)
        if tag in VOID or token[3].endswith("/"):
            continue
        outside = is_furniture(tag, token[3], main > 0)
        inside = tag in MAIN and not outside
        stack.append((tag, outside, inside))
        furniture += outside
        main += inside
        links += tag == "a"
    flush()
    return out


def first_pass(text: str, linked: int, main: bool) -> int:
    if linked > LINK_SHARE * len(text):
        return BAD
    if main:
        return GOOD if len(text) >= SHORT else OPEN
    if len(text) < SHORT:
        return BAD if linked or "©" in text else OPEN
    words = WORD.findall(text.lower())
    return GOOD if sum(w in STOP_WORDS for w in words) >= STOP_SHARE * max(1, len(words)) else BAD


def second_pass(labels: list[int], main: list[bool]) -> list[int]:
    """Open blocks take the label of the decided blocks nearest before and after them, of the same part of the page.

    If those differ, or on neither side is any, a block is good in the main part and bad outside it.
    """
    n = len(labels)
    before, after = [OPEN] * n, [OPEN] * n
    for i in range(1, n):
        if main[i] == main[i - 1]:
            before[i] = labels[i - 1] if labels[i - 1] != OPEN else before[i - 1]
    for i in range(n - 2, -1, -1):
        if main[i] == main[i + 1]:
            after[i] = labels[i + 1] if labels[i + 1] != OPEN else after[i + 1]
    out = []
    for i in range(n):
        near = {before[i], after[i]} - {OPEN}
        out.append(labels[i] if labels[i] != OPEN else near.pop() if len(near) == 1 else GOOD if main[i] else BAD)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by empty lines; a page with a main part is read there only."""
    blocks = blocks_of(page or "")
    main = [b[2] for b in blocks]
    labels = second_pass([first_pass(*b) for b in blocks], main)
    whole = any(main)
    return "\n\n".join(b[0] for b, label in zip(blocks, labels) if label == GOOD and (b[2] or not whole))


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``source``, with ``text`` and ``n_chars``, its code points.

    The whole page is read. A null or empty page, and one without a good block, has an empty text. Repeated rows are
    extracted each; columns that are called ``text`` or ``n_chars`` already are replaced.
    """
    kept = [f for f in pages.schema.fields if f.name not in (source, text, "n_chars")]
    rows = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(len(kept))]
            yield pa.record_batch([batch.column(i) for i in range(len(kept))]
                                  + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                                  [f.name for f in kept] + [text, "n_chars"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType()),
                                              T.StructField("n_chars", T.LongType())]))
