"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
DROPPED = frozenset("head title script style noscript template svg math iframe object canvas audio video button select option textarea datalist map".split())
#: Of these, those whose content has no tags, so without an end tag it is the rest of the page.
RAW = frozenset("script style title textarea".split())
#: Those that may hold any element, so that only their end tag ends them where there is one.
CLOSED_ALONE = frozenset("noscript template svg math iframe".split())
#: Elements that hold navigation, notices, forms and the like.
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset address".split())
#: Elements that start and end blocks.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th hr figure figcaption details summary center".split()
) | BOILERPLATE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a new one of the given kind closes when they are still open.
CLOSED_BY = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
#: Words of class, id and role attributes that mark what surrounds the main text.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notice|alert|comments?|disqus|replies|respond|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|copyright|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|widget|pagination|pager|tags|skip|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and a to in is you that it he was for on are as with his they i at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on été même ces elle aux leur été fait être était dans sans cette
    que el en y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy
    """.split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:\shidden(?=[\s>=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none)", re.I)
MAIN_START = re.compile(r"<(?:body|article|main)(?=[\s/>])", re.I)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
EDGE = re.compile(r"^\W+|\W+$")

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINK_HIGH = 0.33


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    hinted: bool = False
    inside: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, with what pass one needs to know of each.

    Tolerates what real pages have: tags never closed, tags cut off at the end, unknown elements, `<` in text.
    """
    found: list[Block] = []
    cur = Block()
    stack: list[tuple[str, bool]] = []  # element, whether it marks boilerplate
    inside = hinted = links = headings = 0
    breaks = 0
    at = 0
    n = len(page)

    def flush() -> None:
        nonlocal cur
        raw = "".join(cur.parts)
        cur.text = " ".join(html.unescape(raw).split())
        if cur.text:
            found.append(cur)
        cur = Block()

    def add(raw: str) -> None:
        nonlocal breaks
        if raw.strip():
            breaks = 0
            cur.hinted = cur.hinted or hinted > 0
            cur.inside = cur.inside or inside > 0
            cur.heading = cur.heading or headings > 0
            if links:
                cur.linked += len(" ".join(html.unescape(raw).split()))
        cur.parts.append(raw)

    def pop() -> None:
        nonlocal inside, hinted, links, headings
        name, marks = stack.pop()
        hinted -= marks
        inside -= name in ("article", "main")
        links -= name == "a"
        headings -= name in HEADINGS

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[0]
        named = NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name in BLOCK:
                flush()
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                cur.parts.append(" ")
            continue
        if name in DROPPED:
            if not tag.endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                if end and (name in RAW or name in CLOSED_ALONE or not MAIN_START.search(page, at, end.start())):
                    at = end.end()
                elif name in RAW:
                    at = n
                elif name != "head":  # never closed: the next block ends it; what a head holds is dropped by itself
                    block = BLOCK_TAG.search(page, at)
                    at = block.start() if block else n
            continue
        if name in BLOCK:
            flush()
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                pop()
            if name not in CLOSED_BY or name != "p":
                # an open paragraph and the inline elements in it end before any other block
                while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK) and any(x[0] == "p" for x in stack):
                    pop()
            elif any(x[0] == "p" for x in stack):
                while stack[-1][0] != "p":
                    if stack[-1][0] in BLOCK:
                        break
                    pop()
                if stack and stack[-1][0] == "p":
                    pop()
        if name in VOID or tag.endswith("/>"):
            continue
        marks = name in BOILERPLATE and not (name in ("header", "address") and inside) or bool(HIDDEN.search(tag))
        if not marks and name not in ("html", "body", "article", "main"):
            marks = any(HINTS.search(" ".join(filter(None, a))) for a in ATTRIBUTE.findall(tag))
        stack.append((name, marks))
        hinted += marks
        inside += name in ("article", "main")
        links += name == "a"
        headings += name in HEADINGS
    flush()
    return found


def stop_density(text: str) -> float:
    words = [EDGE.sub("", w) for w in text.lower().split()]
    words = [w for w in words if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def label_blocks(found: list[Block]) -> None:
    """Pass one decides each block by itself; pass two gives ambiguous ones the label of the nearest decided ones.

    Pass one.  bad: marked by its surroundings, outside of the article where the page has one, or mostly links.
    Of the rest, long blocks with many stop words are good; short blocks, headings and blocks with few stop words
    are ambiguous; without an article, longer blocks with hardly any stop word are bad.
    Pass two.  An ambiguous block becomes what the nearest decided block on either side is; of two at one
    distance a heading takes the following one, others good if they aren't short.  With no decided block in an
    article, its blocks are good.
    """
    has_article = any(b.inside and not b.hinted for b in found)
    for b in found:
        size = len(b.text)
        if b.hinted or (has_article and not b.inside) or b.linked > LINK_HIGH * size or "©" in b.text[:3] and size < LONG:
            b.label = "bad"
        elif b.heading or size < SHORT:
            b.label = "short"
        else:
            density = stop_density(b.text)
            b.label = "good" if density >= STOP_HIGH or (density >= STOP_LOW and size >= LONG) else "near" if density >= STOP_LOW or b.inside else "bad"
    decided = [b.label in ("good", "bad") for b in found]

    def decides(i: int) -> bool:
        """In a page with an article, only the article's own blocks speak for their neighbours."""
        return decided[i] and not (has_article and (found[i].hinted or not found[i].inside))

    before, last = [], None
    for i in range(len(found)):
        before.append(last)
        if decides(i):
            last = i
    after, last = [None] * len(found), None
    for i in range(len(found) - 1, -1, -1):
        after[i] = last
        if decides(i):
            last = i
    labels = []
    for i, b in enumerate(found):
        if decided[i]:
            labels.append(b.label)
            continue
        near = [(abs(i - j), k, found[j].label) for k, j in enumerate((after[i], before[i])) if j is not None]
        if not near:
            labels.append("good" if b.inside else "bad")
            continue
        near.sort()
        if len(near) == 2 and near[0][0] == near[1][0] and not b.heading:
            both = {x[2] for x in near}
            labels.append(both.pop() if len(both) == 1 else "good" if b.label == "near" else "bad")
        else:
            labels.append(near[0][2])
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks_of(page)
    label_blocks(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points of text) of every row of pages.

    Null and empty pages, and pages without main text, give an empty text.  Whole pages are read; repeated rows give
    repeated results; other columns are not read; an empty table gives an empty result.
    """
    src = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    names = [f"k{i}" for i in range(len(keep))] + ["text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    out = src.mapInArrow(run, f"{kinds}, text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
