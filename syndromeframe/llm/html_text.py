"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of tags. What the contract of main text rules
out by markup has no blocks: menus, page headers, footers, asides, forms, notices, adverts and comments, by tag,
role, class or id. Of every path the blocks' mean length of text, less what stands in links, and their mean number
of punctuation marks are the path's ratios. Given back to the blocks in page order they are smoothed by a Gaussian
and fused by their product. Markup weighs the fused values: text inside article and main elements counts more
and text outside less, by the share of the page's text that these elements hold. Paths whose mean fused value
reaches a part of the deviation of all blocks are content, on every page. Last, blocks too short for a ratio of
their own are filled in: in an article that has content paths, between content in a main element, and headings.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Standard deviation, in blocks, of the smoothing; and the part of the fused values' deviation that a path must reach.
SIGMA = 1.0
THRESHOLD = 0.6
#: Fused values inside article and main elements count so often, and outside by so much less, where these hold all text.
INSIDE, OUTSIDE = 4.0, 0.9
#: Part of its length that text in links keeps.
LINK = 0.05

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption li option tbody td tfoot th thead tr body head html legend dd dt select".split())
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = frozenset("table td th caption button object html body".split())
BOILERPLATE = frozenset("nav aside footer form button select dialog menu label fieldset".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HINTS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?|toolbar|pagination|pager|skip|masthead|topbar|header|footer|foot|copyright|legal|disclaimer|"
    r"comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommended|recommendations|teasers?|more|tags|hidden|search)(?=$|[\s_-])"
)
#: Of these, words that wrappers of a whole page bear, too: an article or main element below them counts again.
_GENERIC = re.compile(r"(?i)header|foot|more|side$|search|hidden|legal|tags|alert|notice|overlay|banner|shar|social|login|signup|subscri|toolbar|skip|top")
#: Classes that tell of another part of the page, such as has-sidebar.
_ABOUT = re.compile(r"(?i)(?:^|(?<=[\s_-]))(?:with|has|no|without|hide|show|is|fixed)[-_][\w-]+")
MARKS = re.compile(r"[.,;:!?、。，؟،]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_BODY = re.compile(r"(?i)role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?(articleBody)")


class _Node:
    __slots__ = ("tag", "path", "skipped", "region", "link")

    def __init__(self, tag: str, path: int, skipped: int, region: int, link: bool):
        self.tag, self.path, self.skipped, self.region, self.link = tag, path, skipped, region, link


class Block:
    """Text between two block-level tags: its path, text, link characters and the article or main element it is in.

    region: 0 outside of both, else the number of the element, negative for main.
    """

    __slots__ = ("path", "text", "links", "region", "heading")

    def __init__(self, path: int, text: str, links: int, region: int, heading: bool):
        self.path, self.text, self.links, self.region, self.heading = path, text, links, region, heading


def _boilerplate(tag: str, attributes: str, content: bool) -> int:
    """0: text; 1: boilerplate by a generic class or id only; 2: boilerplate."""
    if tag in BOILERPLATE or (tag == "header" and not content):
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    generic = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES:
            return 2
        if name in ("class", "id") and tag not in CONTENT:
            value = _ABOUT.sub(" ", value)
            for hint in HINTS.finditer(value):
                if content and "header" in hint[0].lower():
                    continue
                if not _GENERIC.search(hint[0].strip(" _-")):
                    return 2
                generic = 1
        if name in ("class", "id") and tag == "article" and re.search(r"(?i)\b(?:comments?|related|teaser|sponsored|promo|advert)", value):
            return 2
        if (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return 2
    return 2 if re.search(r"(?:^|\s)hidden(?=$|\s)", attributes) else generic


def blocks(html: str, by_name: bool = True) -> list[Block]:
    """Blocks of a page in order; boilerplate and raw elements have none. Never fails on broken markup.

    by_name: whether classes, ids and roles count, too, for what is boilerplate.
    """
    found: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    stack = [_Node("", 0, 0, 0, False)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    links = first = region = regions = 0
    heading = False

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                found.append(Block(first, text, links, region, heading))
        parts, links = [], 0

    def pop_to(names, scope) -> None:
        if not any(open_tags.get(x) for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                for node in stack[k:]:
                    open_tags[node.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    def text(piece: str) -> None:
        nonlocal links, first, region, heading
        top = stack[-1]
        if piece and not top.skipped:
            if not parts:
                first, region = top.path, top.region
                heading = any(open_tags.get(h) for h in ("h1", "h2", "h3", "h4", "h5", "h6"))
            parts.append(piece)
            if top.link:
                links += len(piece)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        closing, tag, attributes = m[1] or m[4], tag.lower(), m[3] or m[6] or ""
        if closing:
            if tag in BLOCK:
                flush()
            if open_tags.get(tag):
                pop_to({tag}, P_SCOPE if tag not in BLOCK else ())
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else n
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                pop_to({"p"}, P_SCOPE)
            if tag in SIBLING:
                pop_to(*SIBLING[tag])
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        top = stack[-1]
        path = paths.setdefault((top.path, tag), len(paths) + 1)
        inside, body = top.region, len(attributes) > 8 and _BODY.search(attributes)
        if inside <= 0 and (tag == "article" or (body and body[1])) or not inside and (tag == "main" or body):
            regions += 1
            inside = regions if tag == "article" or (body and body[1]) else -regions
        above = 0 if top.skipped == 1 and tag in CONTENT else top.skipped
        stack.append(_Node(tag, path, max(above, _boilerplate(tag, attributes if by_name else "", top.region != 0)), inside, top.link or tag == "a"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return found


def _smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = norm = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), weights, strict=True):
            if 0 <= k < len(values):
                total += w * values[k]
                norm += w
        out.append(total / norm)
    return out


def ratios(found: list[Block]) -> dict[int, tuple[float, float, float]]:
    """By path: its blocks' mean length (text in links counts LINK), mean number of marks, and share of text in links."""
    sums: dict[int, list[float]] = {}
    for b in found:
        total = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        total[0] += 1
        total[1] += len(b.text)
        total[2] += min(b.links, len(b.text))
        total[3] += len(MARKS.findall(b.text))
    return {p: ((chars - (1 - LINK) * linked) / n, marks * (1 - linked / chars) / n, linked / chars) for p, (n, chars, linked, marks) in sums.items()}


def marked_share(found: list[Block]) -> float:
    """Share of the text outside links that article and main elements hold."""
    own = [(max(0, len(b.text) - b.links), b.region) for b in found]
    return sum(n for n, region in own if region) / max(1, sum(n for n, _ in own))


def path_values(found: list[Block], sigma: float = SIGMA) -> tuple[dict[int, float], float]:
    """(mean fused value of each path, standard deviation of the blocks' fused values before markup weighs them)."""
    own, share = ratios(found), marked_share(found)
    lengths = _smooth([own[b.path][0] for b in found], sigma)
    marks = _smooth([own[b.path][1] for b in found], sigma)
    fused = [x * (1 + y) * (1 - (1 - LINK) * own[b.path][2]) for x, y, b in zip(lengths, marks, found, strict=True)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    by_path: dict[int, list[float]] = {}
    for x, b in zip(fused, found, strict=True):
        # a path next to long text has a high smoothed value; its own length keeps it apart
        weight = 1 + (INSIDE - 1) * share if b.region else 1 - OUTSIDE * share
        by_path.setdefault(b.path, []).append(x * weight * min(1.0, own[b.path][0] / max(1.0, max(lengths))))
    return {p: sum(v) / len(v) for p, v in by_path.items()}, deviation


def content_paths(found: list[Block], sigma: float = SIGMA, threshold: float = THRESHOLD) -> set[int]:
    """Paths whose mean fused value reaches `threshold` deviations; the highest one if none does."""
    values, deviation = path_values(found, sigma)
    return {p for p, v in values.items() if v >= threshold * deviation} or {max(values, key=lambda p: (values[p], -p))}


def content_blocks(found: list[Block]) -> list[int]:
    """Positions of the blocks of content paths and of the short ones that belong to them."""
    if not found:
        return []
    chosen, links = content_paths(found), {p: r[2] for p, r in ratios(found).items()}
    at = [k for k, b in enumerate(found) if b.path in chosen]
    keep = set(at)
    spans: dict[int, tuple[int, int]] = {}
    for k in at:
        spans[found[k].region] = (spans.get(found[k].region, (k, k))[0], k)
    marked = marked_share(found) >= 0.5  # else text outside outweighs the marked one, which gets no privilege
    for k, b in enumerate(found):
        if b.region and marked and b.region in spans:
            first, last = spans[b.region]
            between, listed = first <= k <= last, links[b.path] > 0.5
            if (b.region > 0 and (between or not listed)) or (not listed and (between or (b.heading and first - 2 <= k < first))):
                keep.add(k)
        elif b.heading and not (marked and not b.region) and at[0] - 2 <= k <= at[-1]:
            keep.add(k)
    return sorted(keep)


def extract(html: str | None) -> str:
    """Main text: one line per block, in page order; empty for a null or empty page."""
    found = blocks(html or "")
    if not found and html:
        found = blocks(html, by_name=False)
    return "\n".join(found[k].text for k in content_blocks(found))


def text_udf():
    @F.arrow_udf("string")
    def main_text(pages: pa.Array) -> pa.Array:
        return pa.array([extract(x) for x in pages.to_pylist()], pa.string())

    return main_text


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty html has an empty text; repeated rows come back as often as they are, null ids and urls stay
    null, other columns are ignored, whatever their names, and an empty table gives an empty result. Pages of any
    length are read whole.
    """
    common.small_batches(pages.sparkSession)
    return pages.select("page_id", "url", text_udf()(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(common.table(spark, sf_dir, "pages"))
