"""Site template removal: where it decides, hints and names that are none, odd markup, and time."""

import os
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from promptscreen.llm import html_text as H

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><h1>Title</h1><p>long body</p><article><p>teaser</p></article></main>", "Title\nlong body\nteaser"),
        ("<body><article><p>one</p></article><p>between</p><article><p>two</p></article></body>", "one\ntwo"),
        ("<article><p title='a hidden gem'>kept</p><p hidden>gone</p><p data-hidden='no'>kept too</p><div style='Display: none'>gone</div></article>", "kept\nkept too"),
        ("<header>Site</header><article><header><h1>Headline</h1></header><p>body</p></article>", "Headline\nbody"),
        ("<article><div class='article-header'><h1>Headline</h1></div><p>body</p></article>", "Headline\nbody"),
        ("<article><p class='social-history'>kept</p><section id='legal-analysis'><p>kept</p></section></article>", "kept\nkept"),
        ("<body><p>outside</p><div class='widget'><article><p>inside</p></article></div></body>", "inside"),
        ("<article><p>one</p><p class=\"x>two</p><p>three</p></article>", "one\ntwo\nthree"),
        ("<body><div class='siteHeader'>no</div><div class='post-comments'>no</div><div id='cookie_notice'>no</div><div class='related-articles'>no</div><p>kept</p></body>", "kept"),
        ("<form id='aspnet'><div><p>all of the page is in here, its text too</p></div></form>", "all of the page is in here, its text too"),
        ("<body><h1>Headline</h1><div><article><p>body</p></article></div><footer>no</footer></body>", "Headline\nbody"),
        ("<body><h1>Site</h1><article><h1>Headline</h1><p>body</p></article></body>", "Headline\nbody"),
        ("<article><p>body</p><article class='comment'><p>I disagree</p></article></article>", "body"),
        ("<div role=main><p>body</p></div><div role='navigation'>no</div>", "body"),
        ("<article></article><p>text where the article is empty</p>", "text where the article is empty"),
        ("<x-page><x-card>one</x-card><x-card>two</x-card></x-page>", "one\ntwo"),
    ],
)
def test_hints_and_names(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n, lambda n: "<p>" * n + "</div>" * n, lambda n: "<div>" * n + "x" + "</span>" * n, lambda n: '<p a="x>' * n + "y", lambda n: "<p a='\">" * n, lambda n: "<li>" * n, lambda n: "<!--" * n,
    lambda n: "<" * n, lambda n: "<div " * n, lambda n: "<div class='a' id=b>x" * n, lambda n: "<table><tr><td>" * n, lambda n: "&amp" * n, lambda n: "<ul><li>a<p>b" * n, lambda n: "<script>" * n, lambda n: "<h1>a" * n + "<article>b", lambda n: "word " * n,
])
def test_time_of_odd_pages(make):
    """Twice the page takes about twice the time: no shape of page is quadratic."""
    H.main_text(make(100))

    def seconds(n):
        start = time.process_time()
        H.Page(make(n)).text({b"12345678"})
        return time.process_time() - start

    quarter = min(seconds(15_000) for _ in range(2))
    assert seconds(60_000) < 9 * quarter + 0.5


def words(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r.page_id: r.text for r in H.extract_text(df).collect()}


def test_templates_decide_without_hints(spark):
    """Pages of nothing but unnamed containers: what recurs on a host goes, what is of one page stays, shared passages too."""
    menu, letter = "<div><ul><li><a href=/a>Home</a></li><li><a href=/b>Contact us</a></li></ul></div>", "<section><p>Get our letter every week</p></section>"
    shared = "<p>A passage that many articles of this site quote, word for word.</p>"
    rows = [(k, f"https://a.example/{k}", f"<body>{menu}<div><h2>About {k}</h2><p>{words(k)}</p>{shared}{letter}</div><div>Copyright a.example</div></body>") for k in range(12)]
    rows += [(100 + k, f"https://few.example/{k}", f"<body>{menu}<div><p>{words(100 + k)}</p></div></body>") for k in range(3)]
    out = extracted(spark, rows)
    for k in range(12):
        assert out[k] == f"About {k}\n{words(k)}\nA passage that many articles of this site quote, word for word."
    assert out[100] == f"Home\nContact us\n{words(100)}"  # too few pages to tell


def test_templates_within_articles(spark):
    """An unnamed box within each article goes; a box that is most of the article, and one of a few pages, stay."""
    box = "<div><p>Written by our staff. Write to us.</p></div>"
    rows = [(k, f"https://a.example/{k}", f"<article><p>{words(k)}</p>{box}<div><p>own {k // 4}</p></div></article>") for k in range(16)]
    rows += [(100 + k, f"https://b.example/{k}", f"<article><div><p>{words(0)}</p></div><p>{k}</p></article>") for k in range(16)]
    out = extracted(spark, rows)
    assert all(out[k] == f"{words(k)}\nown {k // 4}" for k in range(16))
    assert all(out[100 + k] == f"{words(0)}\n{k}" for k in range(16))


def test_bar_hardly_rises(spark):
    """A box on 12 of 3,000 pages of a host is template still: the bar is the fourth root of the pages."""
    rows = [(k, "https://big.example/", f"<body><div>box {k // 12 if k < 1200 else -k}</div><p>{words(k, 5)}</p></body>") for k in range(3000)]
    out = extracted(spark, rows)
    assert out[5] == words(5, 5) and out[2000] == f"box -2000\n{words(2000, 5)}"


def test_removal_changes_texts_of_the_table(spark):
    """Ablation on the table's pages with their telling tags made plain (no nav, footer, article, no class): where a page's menu, advert and
    footer each recur across enough articles of its host, which a count by regular expressions says, templates alone bring
    back its article's text; without templates no page is right."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", r"<(/?)(?:nav|footer|article)>", r"<$1div>"), '<div class="ad">', "<div>")
    bare = pages.select("page_id", "url", plain.alias("html"))
    want = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    got = {r.page_id: r.text for r in H.extract_text(bare).collect()}
    without = {r.page_id: H.main_text(r.html) for r in bare.collect()}
    parts, articles = {}, defaultdict(set)
    for r in pages.collect():
        found = re.match("(.*?)<article>.*?(?:</article>(.*)|$)", r.html, re.DOTALL)
        own = [m[0] for side in found.groups() if side for m in re.finditer("<(nav|footer|div)[ >].*?(?:</\\1>|$)", side, re.DOTALL)]
        parts[r.page_id] = [(H.host_of(r.url), x) for x in own]
        for key in parts[r.page_id]:
            articles[key].add(want[r.page_id])
    enough = [k for k, own in parts.items() if len(own) == 3 and all(len(articles[x]) >= 6 for x in own)]
    assert len(enough) > 150
    assert all(got[k] == want[k] for k in enough)
    assert not any(without[k] == want[k] for k in enough)
