import html
import re

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import extraction

TREE = extraction.train()
LONG = "one two three four five six seven eight nine ten eleven twelve " * 4


def article_of(page):
    """The text blocks of the one article element of the generated pages."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|h2|li|ul)\b[^>]*>", inner[1] if inner else "")
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", p)).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extraction.extract(pages.withColumn("raw", F.col("html"))).collect():
        assert r["text"] == article_of(r["raw"]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav><a href=x>only menus</a></nav>", ""),
        ("<article><p>a &amp;amp; b&nbsp; c<br>d<!-- x --></p><p>e<b>f</b>g</article>", "a &amp; b c d\n\nefg"),
        ("<article><h1>T</h1><script>var x='<p>no</p>'</script><p>x &lt; y<p>z</p></article>", "T\n\nx < y\n\nz"),
        (f"<main><p>{LONG}</p><div class='ad-box'>buy</div><aside>side</aside><form>mail <input></form></main>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><section id=comments><p>{LONG}</p></section><footer>f</footer>", LONG.strip()),
        (f"<div class=cookie-notice>We use cookies {LONG}</div><div class='post-content'><p>{LONG}</p><ul class=menu><li>m</ul></div>", LONG.strip()),
        (f"<ul><li><a>one</a><li><a>two</a></ul><div><h2>Title</h2><p>{LONG}</p><p>short one</p><p>{LONG}</p></div><div><a>x</a></div>", "\n\n".join(["Title", LONG.strip(), "short one", LONG.strip()])),
        ("<article><p title='a>b' class=x>in quotes</p><p>1 < 2 and <3</p></article>", "in quotes\n\n1 < 2 and <3"),
        ("<article><p>unclosed <a href=x>link<p>next", "unclosed link\n\nnext"),
        (f"<main><h1>Site</h1><article class='post has-comments'><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article><div>Share</div></main>", LONG.strip()),
        (f"<article class=related><p>{LONG}</p></article><div role=main><p>kept {LONG}</p></div><div aria-label='Reader comments'>{LONG}</div>", f"kept {LONG.strip()}"),
        ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
    ],
)
def test_cases(page, want):
    assert extraction.main_text(page, TREE) == want


def test_table_and_frames(spark):
    for row, label in extraction.LABELLED:
        assert TREE.decide(row) == bool(label)
    df = spark.createDataFrame([(1, "u", None, "clash"), (None, None, "<article>x</article>", "clash")] * 2, "page_id long, url string, html string, text string")
    out = extraction.extract(df).collect()
    assert [r["text"] for r in out] == ["", "x"] * 2 and out[1]["page_id"] is None
    assert extraction.extract(df.limit(0)).count() == 0


def fill(page):
    """G and R with a number become so many words of the article and of the rest."""
    return re.sub(r"\b([GR])([0-9]+)\b", lambda m: " ".join([{"G": "wanted", "R": "other"}[m[1]]] * int(m[2])), page)


#: Layouts that are not among the labelled pages.
HELD_OUT = [
    "<div class='layout sidebar-right'><article><h1>G5</h1><p>G40<p>G12</article><div class=sidebar-right><p>R25</div></div>",
    "<div class='page nav-fixed'><ul class=nav><li><a>R1</a></ul><article><p>G22<p>G61</article></div>",
    "<div id='main' class='content comments-open'><h2>G4</h2><p>G51<p>G3<p>G30</div><div id=footer>R14</div>",
    "<div class='site search-enabled'><main><p>G33<p>G47</main><div class=search-box>R3</div></div>",
    "<form id='aspnetForm'><article><p>G50<p>G8<p>G18</article><div>R20</div></form>",
    "<div class='post tags-politics'><h1>G9</h1><p>G28<p>G44</div>",
    "<article><p>G37<p><a href=x>G11</a><p>G29</article>",
    "<div><h1>G7</h1><p>G45<p>G39</div><div>R17</div>",
    "<body class='single sidebar'><header><a>R2</a></header><article class='post has-comments'><p>G26<p>G71</article><div class=comments><div><p>R80</div><div><p>R64</div></div></body>",
    "<section id=page><div class='menu-wrap'><a>R1</a> <a>R2</a></div><section class='story share-on'><h1>G10</h1><p>G20<p>G5<p>G83</section><section class=replies><p>R31<p>R42</section></section>",
    "<table><tr><td><a>R1</a></td></tr><tr><td><p>G90<p>G35<p>G14</td><td><p>R22</td></tr></table>",
    "<article><h1>G6</h1><div class=byline>R4</div><p>G48<figure><figcaption>G9</figcaption></figure><p>G52<div class='newsletter-signup'>R12 <form>R2 <input></form></div><p>G30<ul class=related><li><a>R5</a><li><a>R6</a></ul></article>",
    "<main><div class=hero><h1>G8</h1></div><div class=body-text><p>G66<p>G4<p>G59</div><div class='promo wide'>R30</div></main>",
    "<p>G58<p>G33<p>G70<div>R13</div>",
    "<article><p>G48<p>G62</p><div>R8</div></article>",
    "<body class='single-post'><header id='masthead' class='site-header'><h1 class='site-title'>R2</h1><nav><a>R1</a><a>R1</a></nav></header><div id='content' class='site-content'><div id='primary' class='content-area'><main id='main' class='site-main'><article id='post-1' class='post type-post category-news tag-politics'><header class='entry-header'><h1 class='entry-title'>G7</h1></header><div class='entry-content'><p>G60</p><p>G8</p><blockquote>G20</blockquote><ul><li>G5</li><li>G9</li></ul><p>G44</p></div></article><nav class='post-navigation'><a>R4</a></nav><div id='comments' class='comments-area'><h2>R2</h2><ol class='comment-list'><li class='comment'><article class='comment-body'><p>R30</p></article></li><li class='comment'><article class='comment-body'><p>R70</p></article></li></ol><form>R3</form></div></main></div><aside id='secondary' class='widget-area'><section class='widget'><h2>R2</h2><ul><li><a>R5</a></li></ul></section></aside></div><footer id='colophon'>R9</footer></body>",
    "<div id='root'><div><nav><a>R1</a></nav></div><article><div><section><h1>G9</h1><p>G33</p></section><section><p>G50</p><p>G40</p></section><section><h2>G3</h2><p>G61</p></section></div></article><div>R12</div></div>",
    "<article><h1>G5</h1><p>G40</p><figure><img><figcaption>G8</figcaption></figure><p>G35</p><table><tr><th>G1</th><th>G1</th></tr><tr><td>G1</td><td>G2</td></tr></table><p>G44</p></article><footer>R5</footer>",
    "<div class='wrapper'><div class='header'>R4</div><div class='main-content'><div class='title'>G6</div><div>G40</div><div>G5</div><div>G55</div></div><div class='footer'>R9</div></div>",
    "<center><a>R1</a> | <a>R2</a></center><h1>G4</h1><p>G30<p>G45<p>G60<hr><address>R6</address>",
    "<article><h1>G5</h1><p>G25</p><p>G30</p></article><section class='comments'><p>R90</p><p>R80</p><p>R60</p></section>",
    "<div class='article-body'><h1>G5</h1><p>G25</p><p>G30</p></div><div class='comment'><p>R90</p></div><div class='comment'><p>R80</p></div>",
    "<div><h1>G5</h1><p>G45</p><p>G30</p></div><div><p>R20</p></div><div><p>R18</p></div>",
    "<article><h1>G5</h1><p>G45</p><p>G30</p><div><b>R1</b> R12</div></article>",
    "<div class='cookie-banner'><p>R30</p><button>R2</button></div><main><h1>G4</h1><p>G50</p><p>G42</p></main><div class='modal'>R12</div>",
    "<article><h1>G3</h1><p>G20</p><pre><code>G12</code></pre><p>G15</p></article>",
    "<main><h1>G3</h1><dl><dt>G2</dt><dd>G20</dd><dt>G1</dt><dd>G18</dd></dl></main>",
    "<article><h1>G3</h1><p><a>G12</a></p><p>G40</p></article><ul><li><a>R5</a><li><a>R6</a></ul>",
    "<article><h1>G3</h1><p>G40</p><p>G25</p><p><a>G12</a></p></article>",
    "<html><body><div id='nav'><a>R1</a></div><div id='text'><h1>G2</h1><p>G6</p></div></body></html>",
    "<div role='alert'>R12</div><div role='main'><h2>G4</h2><p>G33</p><p>G29</p></div><div role='contentinfo'>R8</div>",
    "<article><p>G30</p><p hidden>R10</p><p style='display:none'>R9</p><p>G22</p></article>",
    "<article><h1>G6</h1><p class='byline'>R4</p><div class='social-share'><a>R1</a></div><p>G40</p><p>G35</p><div class='author-box related'>R25</div></article>",
    "<nav><a>R2</a></nav><h1>G5</h1><p>G44<ol><li>G12<li>G9 <a>G2</a><li>G7</ol><p>G39<footer><p>R20<p>R9</footer>",
]


@pytest.mark.parametrize("page", HELD_OUT)
def test_held_out_layouts(page):
    want = re.findall(r"G[0-9]+", page)
    got = extraction.main_text(fill(page), TREE)
    assert "other" not in got and got.count("wanted") == sum(int(x[1:]) for x in want)


def test_the_tree_uses_its_neighbours():
    used, nodes = set(), [TREE]
    while nodes:
        node = nodes.pop()
        if node.feature is not None:
            used.add(extraction.FEATURES[node.feature])
            nodes += [node.low, node.high]
    assert {"words", "links"} <= used and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}


def test_names_only_count_where_they_do_not_wrap():
    long = "one two three four " * 20
    for name in ("sidebar", "comments", "ad"):
        assert extraction.main_text(f"<div class='x {name}-on'><div class=post><p>{long}</p></div><div class={name}>{long}</div></div>", TREE) == long.strip()
