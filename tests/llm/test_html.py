"""HTML extraction: structure, references, the style tree against brute force, edge cases."""

import math
import time
import tracemalloc
from collections import Counter, defaultdict

import pytest

from textlake.llm import html_extract as H


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<html><head><title>no</title></head><body><nav>menu</nav><header>H</header><article><header><h1>T</h1></header><p>a<b>b</b> &amp;amp; &#233;<br>c<p>d\n <i>e</i><ul><li>x<li>y</ul><div class="ad-box">AD</div><aside>s</aside><script>var x="</p><p>";</script><!-- c --><section id="comments"><p>no</p></section></article><footer>f</footer>', "T\n\nab &amp; é c\n\nd e\n\nx\n\ny"),
        ("plain text &lt; more", "plain text < more"),
        ('<p>1 < 2 <3 and <a title="x>y">L</a></p>', "1 < 2 <3 and L"),
        ("<div>a</div>b<div>c", "a\n\nb\n\nc"),
        ("", ""),
        ("<article>unclosed <p>q", "unclosed\n\nq"),
        ('<body><div class="cookie-notice">x</div><main><p>m</p></main><form>f</form></body>', "m"),
        ("<p>it's <b class=x'>q</b> don't</p><style>p{}", "it's q don't"),
        ("<table><tr><td>1<td>2</table>", "1\n\n2"),
        ('<p>a <img alt = "x > y" src=z>b <a title=">">c</a> it"s <!-- > -->d<!doctype x>', 'a b c it"s d'),
        ("<article><p>a</article><div>between</div><article><p>b</article>", "a\n\nb"),
        ('<article><p>a</p><article class="comment"><p>reader says</p></article></article>', "a"),
        ('<article><p>a</p></article><article class="comment"><p>reader says</p></article>', "a"),
        ("<article><article><p>a</p></article></article>", "a"),
        ('<article><p class="notice-board">a</p><p class="search-result">b</p><p class="share-price" data-id="ad">c</p><div class="ad x">d</div></article>', "a\n\nb\n\nc"),
        ('<article><p>main <a class="social">link words</a> rest</p><p class="promo">lede</p></article>', "main link words rest\n\nlede"),
        ('<article><p>main text</p></article><div class="discussion"><article class="reply"><p>reader says</p></article></div>', "main text"),
        ('<article><p>main text</p><section class="user-comments"><p>x</p></section><div id="comments-area"><p>y</p></div></article>', "main text"),
        ('<body class="has-comments"><div class="with-comments"><article class="post comments-open"><h1>T</h1><p>main text</p></article></div></body>', "T\n\nmain text"),
        # runs of signed siblings under any name, below the story or beside it
        ('<body><div class="s"><h1>T</h1><p>' + "long story " * 9 + '</p></div><div class="k7"><h3>2 voices</h3><div class="k8"><i>Ann, 3 May 2024</i><p>nice</p></div><div class="k8"><i>Bob, 4 May 2024</i><p>bad</p></div></div></body>', "T\n\n" + ("long story " * 9).strip()),
        ("<body><article><p>" + "long story " * 9 + "</p></article><ul><li><b>Ann</b><p>I like it</p><li><b>Bob</b><p>I do not</p></ul></body>", ("long story " * 9).strip()),
        ("<article><p>" + "long story " * 9 + "</p></article><article><time>x</time><p>I like it</p></article><article><time>y</time><p>I do not</p></article>", ("long story " * 9).strip()),
        ("<article><p>" + "long story " * 9 + "</p><h3>Talk</h3><section><time>x</time><p>I like it</p></section><section><time>y</time><p>I do not</p></section><p>end</p></article>", ("long story " * 9).strip() + "\n\nend"),
        # signed posts that are the page's text stay: none comes after a longer text
        ("<article><time>2024-01-01</time><p>one two three</p></article><article><time>2024-01-02</time><p>four five six</p></article>", "2024-01-01\n\none two three\n\n2024-01-02\n\nfour five six"),
        ("<article><section><h2>A</h2><p>one two three four five six</p></section><section><h2>B</h2><p>a b</p></section><section><h2>C</h2><p>c d</p></section></article>", "A\n\none two three four five six\n\nB\n\na b\n\nC\n\nc d"),
        ('<p>a<p>b <a href="http', "a\n\nb"),
        ('<p class="x>a</p><p>b</p>', "a\n\nb"),
        ("<p>a<!-- never closed <p>b", "a"),
        ("<p>a</b></article></span>b", "ab"),
    ],
)
def test_extract(page, text):
    assert H.extract(page) == text


def body(k):
    return f'<body><div class="brand"><p>Our site</p></div><div class="x"><p>Text number {k} is its own.</p></div></body>'


def test_style_tree(spark):
    rows = [(k, "http://a.org/%d" % k, body(k)) for k in range(8)] + [(100 + k, "http://b.org/%d" % k, body(1)) for k in range(8)]
    rows += [(200, None, None), (201, "u", ""), (0, "http://a.org/0", body(0)), (None, "http://c.org", "<article><p>é</p></article>"), (202, "http://a.org/z", "<p>" + "w " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    out = H.main_text(pages).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.page_id, r)
        assert r.n_chars == len(r.text)
    # the brand is the same on all pages of a.org; pages of b.org are one text, which tells nothing
    assert by[3].text == "Text number 3 is its own." and by[103].text == "Our site\n\nText number 1 is its own."
    assert by[200].text == "" and by[None].text == "é" and by[202].n_chars == 199_999
    assert H.main_text(pages.limit(0)).count() == 0


def test_large_judgements_take_a_shuffled_join(spark, monkeypatch):
    rows = [(k, f"http://{h}.org/{k}", body(k)) for h in "ab" for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, H.main_text(pages).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, H.main_text(pages).collect())) == want


def test_shared_headings_of_articles(spark):
    # most pages of a host share their heading; neither it nor the others' own headings are boilerplate
    page = lambda k, h: f'<body><div class="top"><p>Brand</p></div><article><h1>{h}</h1><p>Text number {k} is its own.</p></article></body>'
    rows = [(k, f"http://a.org/{k}", page(k, "A series" if k < 18 else f"Title {k}")) for k in range(20)]
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"{'A series' if k < 18 else f'Title {k}'}\n\nText number {k} is its own." for k in range(20)}


def test_unnamed_boilerplate_goes_and_sections_stay(spark):
    # menus, adverts and footers are plain div elements whose words differ from page to page; a second long section is text
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * 31) % 1009}" for i in range(n))
    page = lambda k: f'<body><div class="q1"><ul><li>{words(k, 1)}<li>{words(k + 1, 1)}</ul></div><div class="q2">{words(k + 2, 6)}</div><h1>{words(k + 3, 4)}</h1><div class="q3">{"".join(f"<p>{words(k + i, 30)}</p>" for i in range(3 + k % 5))}<div class="q5">{words(k + 5, 5)}</div></div><div class="q4"><p>{words(k + 9, 60)}</p></div><div class="q6">© {words(k + 4, 7)}</div></body>'
    out = H.main_text(spark.createDataFrame([(k, f"http://a.org/{k}", page(k)) for k in range(12)], "page_id long, url string, html string")).collect()
    for r in out:
        k = r.page_id
        assert r.text == "\n\n".join([words(k + 3, 4), *(words(k + i, 30) for i in range(3 + k % 5)), words(k + 5, 5), words(k + 9, 60)])


def test_the_tree_decides_on_pages(spark):
    """Switched off, every page of a judged host has other text."""
    import os

    at = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(at):
        pytest.skip("no tables here")
    rows = spark.read.parquet(at)
    out = {r.page_id: r.text for r in H.main_text(rows).collect()}
    judged = {r.host for r in H.judge(H.style_tree(H.measured(rows.selectExpr("lower(regexp_extract(url, '://([^/?#]*)', 1)) as host", "html")))).collect()}
    nothing, changed, of = H.Judgement([], [], 0), 0, 0
    for r in rows.collect():
        if r.url.split("/")[2].lower() in judged:
            of += 1
            changed += H.extract(r.html, nothing) != out[r.page_id]
    assert of > 100 and changed == of


@pytest.mark.parametrize("beside", [True, False])
@pytest.mark.parametrize("item", ["article", "div"])
def test_comments_of_judged_hosts(spark, item, beside):
    """Comments of unknown class names differ from page to page; some pages have a single one."""
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * 31) % 1009}" for i in range(n))

    def page(k):
        said = "".join(f'<{item} class="zq"><b>U{k}{i}</b> <span>{1 + k % 9} May 2024</span><p>{words(k * 7 + i, 9)}</p></{item}>' for i in range(1 + k % 3))
        story = f"<h1>{words(k + 3, 4)}</h1>" + "".join(f"<p>{words(k + i, 30)}</p>" for i in range(3 + k % 5))
        talk = f'<div class="zw"><h3>Said</h3>{said}</div>'
        return f'<body><div class="m">Menu Home</div><article>{story}</article>{talk}</body>' if beside else f'<body><div class="m">Menu Home</div><div class="st">{story}{talk}</div></body>'

    out = H.main_text(spark.createDataFrame([(k, f"http://a.org/{k}", page(k)) for k in range(12)], "page_id long, url string, html string")).collect()
    for r in out:
        k = r.page_id
        assert r.text == "\n\n".join([words(k + 3, 4), *(words(k + i, 30) for i in range(3 + k % 5))]), k


def test_tree_against_brute_force(spark):
    pages = [("a", body(k % 5) if k % 3 else f'<body><div class="x"><p>t{k}</p><p>u</p></div><b>z</b></body>') for k in range(30)] + [("b", body(k)) for k in range(3)]
    seen = defaultdict(dict)
    for host, page in pages:  # plainly: every block element's path, shape and text
        texts = defaultdict(list)

        def visit(node, path, texts=texts):
            kids = [visit(k, f"{path}/{k.tag}.{sorted(k.names)}") if not isinstance(k, str) else ("", k, 0) for k in node.kids]
            shape, text = f"<{node.tag}{''.join(k[0] for k in kids)}>", "".join("".join(k[1].split()) for k in kids)
            if (node.tag in H.BLOCK or path == "") and text:
                texts[node.key].append((shape, text, sum(k[2] for k in kids)))
            return shape, text, int(node.tag in H.BLOCK)

        whole = visit(H.parse(page), "")[1]
        for key, found in texts.items():
            seen[host, key][tuple(f[0] for f in found), tuple(f[1] for f in found), whole] = sum(f[2] for f in found)

    def entropy(values):
        counts, n = Counter(values), len(values)
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0

    got = {(r.host, r.path): r for r in H.style_tree(H.measured(spark.createDataFrame(pages, "host string, html string"))).collect()}
    assert set(got) == set(seen) and len(got) > 8
    for key, found in seen.items():
        r, shapes, texts = got[key], [f[0] for f in found], [f[1] for f in found]
        share = H.DECAY ** (sum(found.values()) / len(found))
        assert r.pages == len(found)
        assert r.presentation == pytest.approx(entropy(shapes), abs=1e-9) and r.content == pytest.approx(entropy(texts), abs=1e-9)
        assert r.importance == pytest.approx((1 - share) * entropy(shapes) + share * entropy(texts), abs=1e-9)
        assert r.told == pytest.approx(entropy(texts) * sum(len("".join(t)) for t in texts), rel=1e-9)


@pytest.mark.parametrize("part", ["<div>", "<div class=a>x", "<a ", '<a x="', "<a x='>", "<!--", "</span>", "<span><article><div></span>", "<p><b>", "<li><div>", "<table><td>", "<", "&", "<a x=y"])
def test_bad_pages_take_linear_time(part):
    page = part * 50_000
    began = time.process_time()
    H.measures(H.parse(page))
    H.extract(page)
    assert time.process_time() - began < 20


def test_deep_pages_take_linear_memory():
    tracemalloc.start()
    H.measures(H.parse("<div>" * 100_000 + "x"))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
