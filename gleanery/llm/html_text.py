"""Main-text extraction from HTML by minimum-cut labelling.

A page is cut into blocks: runs of text between block-level tags, each with its path of open elements. A classifier gives each
block the log odds of being content, and these are the capacities of its edges to the two terminals:

- A logistic regression over the block's text (words, punctuation, link density, kind of element, stock phrases), held within
  TEXT_ODDS. Its text weights are fitted on a sample of at most sample_pages pages and BLOCKS_A_PAGE blocks of each, in which markup tells:
  blocks inside article or main are content, those inside nav, footer, aside and the like aren't. Names aren't used there. The fit
  is pulled towards PRIOR, so that a few pages, or pages without such markup, leave the weights as they are.
- The names (class, id, role) and kinds of the elements around it add fixed odds, GOOD_ODDS or BAD_ODDS. Names that only hint
  give way to a name or an element of articles.
- So do headings such as "Comments" or "Related": what follows them in the same element is boilerplate.

Blocks that stand next to each other, and neighbouring blocks under the same parent, are joined by smoothness edges on the same
scale: one odd paragraph or a short line inside an article isn't lost, a sentence in a list of links isn't kept. The minimum cut
(maximum flow, by shortest augmenting paths) labels all blocks at once. Blocks whose own odds outweigh all smoothness edges at
them are fixed first, which leaves the cut as it was and the graphs small.

Elements that never hold main text (script, style, forms, navigation, footers, ...) have a cost that no neighbour outweighs, and no
smoothness edges: what stands beside a menu is no more of a menu for that.

Text is given with character references decoded, white space inside a block turned into one space, trimmed, blocks joined by
one newline in page order, nothing else dropped or cut.

Cases: null html and pages without content give an empty text. Broken markup (unclosed elements, cut-off tags or references) is
read as far as browsers' rules for implied ends go. Very long pages are read whole in linear time. Columns other than those
named are not read, so extra columns can't clash.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches

#: Comment, declaration, raw-text element with its content, tag; in one pass over the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|svg|math|noembed|noframes|xmp|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
NEVER = frozenset("head title nav footer aside form button menu dialog fieldset legend label option datalist output progress meter map".split())
GOOD = frozenset("article main".split())
#: Words in class, id or role: of reader comments; of boilerplate whatever else the name says; of boilerplate unless a word or element of articles stands beside; of articles; of content.
COMMENT_NAME = frozenset("comment comments commentlist reply replies respond responses disqus discussion discussions reactions talkback guestbook shoutbox feedback thread".split())
BAD_NAME = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner breadcrumb breadcrumbs cookie cookies consent gdpr footer masthead topbar menu nav navbar navigation pager pagination popup modal overlay related recommend recommended recommendations outbrain taboola sidebar aside subscribe subscription newsletter signup login toolbar widget widgets copyright disclaimer contentinfo complementary dialog".split())
HINT_NAME = frozenset("header head top foot notice alert search share shares sharing social rail side skip tag tags byline legal rating toc".split())
ARTICLE_NAME = frozenset("article post entry story prose".split())
GOOD_NAME = ARTICLE_NAME | frozenset("content body text main".split())
#: A short heading that begins boilerplate.
SECTION = re.compile(r"(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses?|replies|discussion|leave a (?:reply|comment)|related\b.*|you (?:may|might) also like|more stories|read next|recommended\b.*|share this\b.*)(?:\s*\(\d+\))?\s*[:!.]?", re.I)
STOCK = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved|posted (?:by|on)\b|share (?:this|on)\b|read more\b|advertisement\b|sponsored\b)", re.I)
SPLIT_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Open elements that a start tag closes, up to a boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
STRONG = 1e6
#: Log odds: the text's are held between these; those of names; the smoothness between neighbours at no distance, and under one parent.
TEXT_ODDS = (-6.0, 4.0)
GOOD_ODDS, BAD_ODDS = 0.8, -8.0
NEXT_EDGE, SIBLING_EDGE = 4.0, 1.5
#: Weights of features() before any fit: constant, log2 of words, link density, sentence end, comma, paragraph, heading, list or table, stock phrase.
PRIOR = (-2.5, 0.8, -4.0, 1.0, 0.3, 0.8, 0.4, -0.4, -2.5)
#: Those that are fitted: what a block's element is goes with the markup that labels it, so that its weights would stand for the label.
FITTED = (0, 1, 2, 3, 4)
#: Blocks that the fit takes of a page, spread over all of it.
BLOCKS_A_PAGE = 64


class Block:
    __slots__ = ("text", "path", "links", "never", "bad", "good", "tag")

    def __init__(self, text: str, path: tuple[int, ...], links: float, never: bool, bad: bool, good: bool, tag: str):
        self.text, self.path, self.links, self.never, self.bad, self.good, self.tag = text, path, links, never, bad, good, tag


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; text is decoded and its white space folded."""
    out: list[Block] = []
    # open elements: (tag, number, never, bad, good); the root
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    parts: list[str] = []
    linked = made = 0
    in_link = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((htmllib.unescape(raw) if "&" in raw else raw).split())
            if text:
                i = len(stack) - 1
                while i and stack[i][0] in INLINE:
                    i -= 1
                tag, _, never, bad, good = stack[i]
                out.append(Block(text, tuple(x[1] for x in stack[: i + 1]), min(1.0, linked / max(1, len(raw))), never, bad, good, tag))
            parts.clear()
            linked = 0

    def open_element(tag: str, attrs: str) -> None:
        nonlocal made
        _, _, never, bad, good = stack[-1]
        made += 1
        hidden = False
        if attrs and tag not in ("html", "body"):
            names = []
            for m in ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role"):
                    names.append(value)
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                    hidden = True
            mark = _named(tag, names)
            bad, good = bad or mark < 0, good or mark > 0
        elif tag in GOOD:
            good = True
        if tag == "header" and not good:
            never = True
        stack.append((tag, made, never or hidden or tag in NEVER, bad, good))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            linked += in_link and len(text)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:  # an end tag
            if tag == "p" and not any(x[0] == "p" for x in stack):
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if any(x[0] not in INLINE for x in stack[i:]):
                        end_block()
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # an inline element doesn't close a block around it
            in_link = in_link and any(x[0] == "a" for x in stack)
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                end_block()
            else:
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link = True
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "a":
                    del stack[i]
                    break
        if tag not in INLINE:
            end_block()
            if tag in ENDS:
                closes, until = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in until:
                        break
                    if stack[i][0] in closes:
                        del stack[i:]
                        break
            # a block ends an open paragraph, with the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    in_link = in_link and any(x[0] == "a" for x in stack)
                    break
                if stack[i][0] not in INLINE:
                    break
            if tag == "body":
                del stack[1:]
            elif tag == "head" or tag == "html":
                pass
            elif len(stack) > 1 and stack[-1][0] == "head" and tag not in ("title", "script", "style"):
                stack.pop()
        open_element(tag, m[4])
    if at < len(page):
        tail = page[at:]
        parts.append(tail)
        linked += in_link and len(tail)
    end_block()
    return _sections(out)


def _named(tag: str, names: list[str]) -> int:
    """What an element's kind and names say: 1 content, -1 boilerplate, 0 nothing or both."""
    words = {w.lower() for name in names for w in SPLIT_NAME.findall(name)}
    if words & COMMENT_NAME:
        return -1
    if words & BAD_NAME:
        return 0 if tag in GOOD else -1
    if words & HINT_NAME and tag not in GOOD and not words & ARTICLE_NAME:
        return -1
    return int(tag in GOOD or bool(words & GOOD_NAME))


def _sections(bs: list[Block]) -> list[Block]:
    """Marks what follows headings of boilerplate, in the element around the heading, as bad; the heading too."""
    open_: tuple[int, ...] | None = None
    for b in bs:
        if open_ is not None and b.path[: len(open_)] != open_:
            open_ = None
        if open_ is None and b.tag in HEADINGS and len(b.text) < 60 and SECTION.fullmatch(b.text):
            open_ = b.path[:-1]
        b.bad = b.bad or open_ is not None
    return bs


def features(b: Block) -> tuple[float, ...]:
    """Of the block's text and element, in the order of PRIOR."""
    tag = b.tag
    return (1.0, math.log2(b.text.count(" ") + 2), b.links, float(b.text[-1:] in ".!?…»”\""), float("," in b.text), float(tag in ("p", "blockquote", "pre")), float(tag in HEADINGS), float(tag in ("li", "td", "th", "dt", "dd")), float(len(b.text) < 200 and STOCK.match(b.text) is not None))


def costs(b: Block, weights: Sequence[float] = PRIOR) -> float:
    """The log odds of content; their size is the difference of the two terminal capacities."""
    if b.never:
        return -STRONG
    text = sum(w * x for w, x in zip(weights, features(b)))
    return min(max(text, TEXT_ODDS[0]), TEXT_ODDS[1]) + GOOD_ODDS * b.good + BAD_ODDS * b.bad


def fitted(x: np.ndarray, y: np.ndarray, pull: float = 4.0, rounds: int = 12) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's steps, pulled towards PRIOR; classes count alike."""
    whole, own = np.array(PRIOR), list(FITTED)
    if not (0 < y.sum() < len(y)):
        return PRIOR
    given = x @ whole - x[:, own] @ whole[own]
    x, w0 = x[:, own], whole[own]
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = w0.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + given, -30, 30)))
        grad = x.T @ (each * (p - y)) + pull * (w - w0)
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
    whole[own] = w
    return tuple(whole.tolist())


def smoothness(a: Block, b: Block) -> float:
    """The edge between neighbours in page order: the closer they stand in the tree, the dearer to cut."""
    same = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        same += 1
    far = len(a.path) + len(b.path) - 2 * same
    return NEXT_EDGE / (1 + far) ** 2


def labels(bs: list[Block], weights: Sequence[float] = PRIOR) -> list[bool]:
    """Content or not, by the minimum cut."""
    n = len(bs)
    score = [costs(b, weights) for b in bs]
    edges: list[dict[int, float]] = [{} for _ in range(n)]

    def join(i: int, j: int, w: float) -> None:
        edges[i][j] = edges[i].get(j, 0.0) + w
        edges[j][i] = edges[j].get(i, 0.0) + w

    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if b.never:
            continue
        if i and not bs[i - 1].never:
            join(i - 1, i, smoothness(bs[i - 1], b))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last:
            join(last[parent], i, SIBLING_EDGE)
        last[parent] = i
    # Persistency: such a block has the same label in every minimum cut; its edges become terminal capacities of its neighbours.
    fixed: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if fixed[i] is not None or abs(score[i]) <= sum(edges[i].values()):
            continue
        fixed[i] = score[i] > 0
        for j, w in edges[i].items():
            score[j] += w if fixed[i] else -w
            del edges[j][i]
            todo.append(j)
        edges[i] = {}
    rest = [i for i in range(n) if fixed[i] is None]
    if rest:
        side = _source_side(rest, score, edges)
        for i in rest:
            fixed[i] = i in side
    return fixed  # type: ignore[return-value]


def _source_side(nodes: list[int], score: list[float], edges: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut; shortest augmenting paths."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {i: dict(edges[i]) for i in nodes}
    left[source], left[sink] = {}, {}
    for i in nodes:
        if score[i] > 0:
            left[source][i] = score[i]
            left[i][source] = 0.0
        else:
            left[i][sink] = -score[i]
            left[sink][i] = 0.0
    while True:
        before, queue = {source: source}, deque([source])
        while queue and sink not in before:
            i = queue.popleft()
            for j, w in left[i].items():
                if w > 1e-12 and j not in before:
                    before[j] = i
                    queue.append(j)
        if sink not in before:
            return set(before)
        path, j = [], sink
        while j != source:
            path.append((before[j], j))
            j = before[j]
        flow = min(left[i][j] for i, j in path)
        for i, j in path:
            left[i][j] -= flow
            left[j][i] = left[j].get(i, 0.0) + flow


def main_text(page: str | None, weights: Sequence[float] = PRIOR) -> str:
    if not page:
        return ""
    bs = blocks(page)
    return "\n".join(b.text for b, keep in zip(bs, labels(bs, weights)) if keep)


def cut_effect(page: str | None, weights: Sequence[float] = PRIOR) -> tuple[int, int]:
    """(blocks, blocks whose label the cut makes other than their own odds say) of a page."""
    bs = blocks(page) if page else []
    return len(bs), sum(keep != (costs(b, weights) > 0) for b, keep in zip(bs, labels(bs, weights)))


def fit(pages: DataFrame, html: str = "html", sample_pages: int = 400) -> tuple[float, ...]:
    """The weights of features(), of at most sample_pages pages, those of the least hashes; BLOCKS_A_PAGE rows of numbers of each reach the driver."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{html}`").alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    share = min(1.0, 8.0 * sample_pages / max(1, rows.count()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for t in batch.column(0):
                own = [b for b in blocks(t.as_py()) if b.never or (b.good and not b.bad)]
                own = own[:: -(-len(own) // BLOCKS_A_PAGE) or 1]
                data.append(np.array([(not b.never, *features(b)) for b in own], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(data, pa.binary())], names=["h", "x"])

    # a few times as many as wanted are parsed, by another hash; pages that repeat count once
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("h"), 11) < F.lit(int(share * (1 << 53)))).select("t", "h").mapInArrow(learn, "h bigint, x binary")
    got = drawn.distinct().orderBy("h", "x").limit(sample_pages).collect()
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float64).reshape(-1, 1 + len(PRIOR))
    return fitted(x[:, 1:], x[:, 0]) if len(x) else PRIOR


def all_text(page: str | None) -> str:
    """Every block's text, boilerplate too, as plain-text conversions of crawls have it."""
    return "\n".join(b.text for b in blocks(page) if b.tag != "title") if page else ""


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Sequence[float] | None = None) -> DataFrame:
    """The columns keep, text and n_chars of each row: one pass, no shuffle, after that of fit() if no weights are given."""
    weights = fit(pages, html) if weights is None else tuple(weights)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py(), weights) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html")).mapInArrow(run, f"{schema}, text string, n_chars bigint")
