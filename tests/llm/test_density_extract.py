from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import types as T

from tests.llm.rows import frame
from wardcast.llm import queries
from wardcast.llm.density_extract import extracted, main_text

ARTICLE = "<h1>The title</h1><p>First &amp; <b>bold</b>\n paragraph with a <a href=x>link</a> in it.<p>Second one,\t&lt;not a tag&gt; &eacute;.</p>"
WANTED = "The title\nFirst & bold paragraph with a link in it.\nSecond one, <not a tag> é."


@pytest.mark.parametrize(
    "around",
    [
        "<body><article>{}</article></body>",
        "<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><main>{}</main><footer>&copy; us</footer>",
        "<header><h1>Our site</h1><p>A long line about what this site is and does, for everyone.</p></header><div id=content>{}</div>",
        "<div class='cookie-notice'><p>We use cookies on this site and you agree to that.</p></div><div class=post>{}</div>",
        "<div id=wrap class='has-sidebar'><div class=sidebar><p>About the author, who writes a lot of text here.</p></div><div>{}</div></div>",
        "<article>{}</article><section id=comments><p>I enjoyed this very long article a lot!</p><p>So did I, it was great fun.</p></section>",
        "<article>{}<div class=comments><p>I enjoyed this very long article a lot!</p></div></article>",
        "<article>{}</article><form><p>Sign up for our letter, which comes each week.</p><input name=a></form>",
        "<article>{}</article><div class='ad box'><p>Buy this now, it is cheaper than ever before and good.</p></div>",
        "<article>{}</article><script>var t='<p>a script with a paragraph in it</p>';</script><style>p{{margin:0}}</style>",
        "<!-- <p>a comment</p> --><aside><p>Other things that one could read here as well.</p></aside><div>{}</div>",
        "<div role=navigation>Menu of everything there is to see</div><div role=main>{}</div>",
        "<article>{}",
    ],
)
def test_article_is_found(around):
    assert main_text(around.format(ARTICLE)) == WANTED


def test_parts_and_headings_around_the_article():
    part = "<p>A paragraph of some length for each part.</p>" * 3
    page = f"<nav>Menu</nav><main><h1>Title</h1><h2>Sub</h2><div>{part}</div><p>Short.</p><h2>More</h2><div>{part}</div></main>"
    line = "A paragraph of some length for each part."
    assert main_text(page).split("\n") == ["Title", "Sub", *[line] * 3, "More", *[line] * 3]


def test_lists_tables_and_empty_pages():
    assert main_text("<article><ul><li>one<li>two <i>2</i></ul><table><tr><td>a<td>b<tr><td>c</table></article>") == "one\ntwo 2\na\nb\nc"
    assert [main_text(x) for x in (None, "", "<div></div>", "<nav>menu</nav>", " \n ")] == [""] * 5
    assert main_text("no markup &am at all") == "no markup &am at all"


def test_all_given_pages(spark, sf_dir):
    """The pages' articles stand between tags of that name."""
    rows = queries.op13_density_extract(spark, sf_dir).collect()
    source = {r.page_id: (r.url, r.html) for r in queries.table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(source)
    for r in rows:
        url, page = source[r.page_id]
        inner = re.sub(r"</?b>|<br>", " ", page[page.index("<article>") + 9 : page.index("</article>")])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert (r.url, r.text, r.n_chars) == (url, "\n".join(b for b in blocks if b), len(r.text))


def test_awkward_rows(spark):
    long = "<article>" + "<p>word é</p>" * 40_000
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, "<p>x</p>"), (2, "v", None), (3, "w", ""), (4, "x", long)]
    pages = frame(spark, rows, ("page_id", "url", "html"), (T.LongType(), T.StringType(), T.StringType()))
    got = sorted(map(tuple, extracted(pages, id="page_id", url="url", page="html").collect()), key=str)
    want = [(1, "u", WANTED, len(WANTED))] * 2 + [(2, "v", "", 0), (3, "w", "", 0), (4, "x", "\n".join(["word é"] * 40_000), 279_999), (None, None, "x", 1)]
    assert got == want
    assert extracted(pages.limit(0), id="page_id", url="url", page="html").collect() == []


def test_odd_markup_takes_linear_time():
    for page in ("<div>" * 20_000 + "x", '<a "' * 50_001, "<p>x" * 50_000, "<div>" * 20_000 + "</p>" * 20_000, "<ul><li><div>" * 9_000, "<" * 200_000):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 10
