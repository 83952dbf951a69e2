"""Tag-path ratios against a plain version of them, and what they decide on pages of many shapes."""

import math
import re

import pytest

from syndromeframe.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


def plain_content_paths(found):
    """The definition, block by block and without shared sums."""
    marks = ".,;:!?、。，؟،"

    def of_path(p):
        own = [b for b in found if b.path == p]
        chars, linked = sum(len(b.text) for b in own), sum(min(b.links, len(b.text)) for b in own)
        length = (chars - 0.95 * linked) / len(own)
        dots = sum(b.text.count(m) for b in own for m in marks) * (1 - linked / chars) / len(own)
        return length, dots, linked / chars

    lengths, dots, linked = zip(*[of_path(b.path) for b in found], strict=True)

    def smooth(v, i):
        near = [(v[k], math.exp(-((k - i) ** 2) / 2)) for k in range(max(0, i - 2), min(len(v), i + 3))]
        return sum(x * w for x, w in near) / sum(w for _, w in near)

    free = [max(0, len(b.text) - b.links) for b in found]
    share = sum(n for n, b in zip(free, found, strict=True) if b.region) / max(1, sum(free))
    smoothed = [smooth(lengths, i) for i in range(len(found))]
    fused = [smoothed[i] * (1 + smooth(dots, i)) * (1 - 0.95 * linked[i]) for i in range(len(found))]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    values = {}
    for p in {b.path for b in found}:
        at = [i for i, b in enumerate(found) if b.path == p]
        values[p] = sum(fused[i] * (1 + 3 * share if found[i].region else 1 - 0.9 * share) * min(1, lengths[i] / max(1, max(smoothed))) for i in at) / len(at)
    return {p for p, v in values.items() if v >= 0.6 * deviation} or {max(values, key=lambda p: (values[p], -p))}


def test_content_paths_are_the_plain_ones(spark):
    odd = ["<p>a", "<article><p><a>all link</a></p></article>", "<ul><li><a>x</a><li>y</ul><p>Long, long text. More of it.", "a<b>b</b><main><h1>h</h1><p>t, u.</main>"]
    for html in odd + [r.html for r in spark.read.parquet(PAGES).collect()]:
        found = html_text.blocks(html or "")
        if found:
            assert html_text.content_paths(found) == plain_content_paths(found)


def test_article_of_the_fixture_pages(spark):
    """These pages hold their text in one article; the ratios alone choose its paragraphs on every page."""
    for r in spark.read.parquet(PAGES).collect():
        found = html_text.blocks(r.html)
        inside = [b.text for b in found if b.region]
        assert html_text.extract(r.html) == "\n".join(inside)
        chosen = html_text.content_paths(found)
        assert all(b.region for b in found if b.path in chosen) and any(b.path in chosen for b in found)


PARAGRAPHS = "".join(f"<p>Paragraph {i}, with text, and more of it; it goes on for a while, as texts do.</p>" for i in range(8))
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(9)) + "</ul>"


@pytest.mark.parametrize(
    "page, has, lacks",
    [
        (f"<body><div class='post-body'><h2>Title</h2>{PARAGRAPHS}</div><article class='card'>Small card</article></body>", ["Title", "Paragraph 7"], ["Small card"]),
        (f"<body><main><div>{LINKS}</div><div><h1>Head</h1>{PARAGRAPHS}<ul><li>one</li><li>two</li></ul><p>Last, then.</p></div><div>{LINKS}</div></main></body>", ["Head", "Paragraph 0", "one", "Last, then."], ["entry 1"]),
        (f"<body><div><b>Buy now</b></div><article><h1>Head</h1><p>Short.</p>{PARAGRAPHS}<h2>Next</h2><ul><li>a</li><li>b</li></ul></article><div>Also, out.</div></body>", ["Head", "Short.", "Next", "a", "b"], ["Buy now", "Also, out."]),
        (f"<article><p>See, for instance, this; it is long enough to count as text here.</p>{LINKS}<p>And more, of the same; it goes on.</p></article>", ["entry 3", "And more"], []),
    ],
)
def test_ratios_decide(page, has, lacks):
    lines = html_text.extract(page).split("\n")
    for x in has:
        assert any(line.startswith(x) for line in lines), (x, lines)
    for x in lacks:
        assert x not in lines, lines


def test_odd_pages(spark):
    rows = [(1, "u", None, "c", 1), (1, "u", None, "c", 1), (None, None, "", "c", 2), (2, "u", "<p>" + "long text, here. " * 200_000, "c", 3), (3, "u", "<a>only</a>", "c", 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.main_texts(pages).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 0, 0, 4, len(re.sub(r"\s+$", "", "long text, here. " * 200_000))]
    assert html_text.main_texts(pages.limit(0)).count() == 0
