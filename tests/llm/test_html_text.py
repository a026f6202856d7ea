"""Main text of pages: whole articles and nothing else, for tagged, classed and bare layouts."""

import html
import re

from tessera.llm import html_text as H

ARTICLE = ["A heading of the page", "The first paragraph holds quite some words, so that it counts as text.", "Short one.", "Another paragraph follows with enough words to be dense, and more of them.", "The last of them ends here, with a few words more."]


def page(inside, around=True):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">entry {i}</a></li>' for i in range(6)) + "</ul>"
    if not around:
        return f"<html><body>{inside}</body></html>"
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav>{menu}</nav><header>Site name</header><!-- x --><div class=\"ad\">Buy these things now, they are cheap and very good.</div>{inside}<aside>Side words about other things.</aside><div id='cookie-notice'>We use cookies on this site for many reasons, please agree.</div><form><label>Mail</label><input></form><div class=\"comments\"><p>First reader says a lot of words about this here.</p></div><footer>&copy; site</footer></body></html>"


BODY = "<h1>" + ARTICLE[0] + "</h1>" + "".join(f"<p>{x}</p>" for x in ARTICLE[1:])
WANT = "\n".join(ARTICLE)


def test_layouts():
    for inside in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f'<div class="content">{BODY}</div>', f"<div><div>{BODY}</div></div>", BODY):
        assert H.main_text(page(inside)) == WANT, inside[:40]
        assert H.main_text(page(inside, False)) == WANT
    split = f"<div><div>{''.join(f'<p>{x}</p>' for x in ARTICLE[:3])}</div><div>{''.join(f'<p>{x}</p>' for x in ARTICLE[3:])}</div></div>"
    assert H.main_text(page(split)) == WANT


def test_names_that_wrap_the_article():
    for wrapped in (f'<div class="with-sidebar"><article>{BODY}</article></div>', f'<div class="page has-sidebar">{BODY}</div>'):
        assert H.main_text(page(wrapped)) == WANT
    assert H.main_text(page(f'<div class="header"><h1>Site</h1></div><article>{BODY}</article>')) == WANT
    assert H.main_text(page(f'<article>{BODY}<section class="reader-comments"><p>Not of the article, but long enough to look like it is.</p></section></article>')) == WANT
    assert H.main_text(page(f'<article>{BODY}<div role="complementary">More</div><p hidden>x</p><p style="display:none">y</p></article>')) == WANT


def test_sibling_articles():
    parts = "".join(f"<article><p>{x}</p></article>" for x in ARTICLE)
    for inside in (parts, f'<div class="posts">{parts}</div>', f"<article>{BODY}</article><article><p>{ARTICLE[1]}</p><p>{ARTICLE[3]}</p></article>"):
        want = WANT if inside.count("<h1>") == 0 else "\n".join([WANT, ARTICLE[1], ARTICLE[3]])
        assert H.main_text(page(inside)) == want and H.main_text(page(inside, False)) == want
    teaser = '<article><a href="/x">Read this other story of ours now</a></article>'
    assert H.main_text(page(f"<article>{BODY}</article>{teaser}")) == WANT


def test_density_chooses_beside_an_article():
    dense = "Words that stand outside of the article and are as dense as anything that is inside of it, so that they belong to the text. " * 3
    assert dense.strip() in H.main_text(page(f"<article>{BODY}</article><div><p>{dense}</p></div>"))


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


def test_nothing_of_a_page_without_an_article_is_lost():
    two = f"<html><body><div><p>{words(60)}</p></div><div><p>{words(20, 'v')}</p></div><p>closing words here</p></body></html>"
    assert H.main_text(two) == "\n".join([words(60), words(20, "v"), "closing words here"])
    menu, foot = '<div id="menu"><a href="/">Home</a></div>', '<div class="footer">All rights</div>'
    boxes = f'<h2>Head</h2><div class="sec"><p>{words(80)}</p></div><div class="sec"><p>just three words</p></div>'
    assert H.main_text(f'<html><body>{menu}<div id="content">{boxes}</div>{foot}</body></html>') == "\n".join(["Head", words(80), "just three words"])


def test_an_article_of_links_stays_beside_a_box():
    refs = [f"reference number {i} of the list" for i in range(12)]
    items = "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(refs))
    for n in (80, 400):
        got = H.main_text(f"<html><body><article><ul>{items}</ul><p>The end.</p></article><div><p>{words(n)}</p></div></body></html>")
        assert got == "\n".join([*refs, "The end.", words(n)])


def test_first_words_of_names_and_formulas_inside_an_article():
    inside = f'<h1>T</h1><p>{words(50)}</p><section class="sidebar-story"><p>kept story of the sidebar</p></section><div class="share-prices">prices of shares</div><p>x <math><mi>y</mi></math> z</p>'
    assert H.main_text(f"<html><body><article>{inside}</article></body></html>") == "\n".join(["T", words(50), "kept story of the sidebar", "prices of shares", "x y z"])


def test_readers_threads():
    thread = f'<section class="thread"><p>{words(30, "c")}</p><p>{words(40, "c")}</p></section>'
    assert H.main_text(f"<html><body><article><h1>T</h1><p>{words(50)}</p></article>{thread}</body></html>") == f"T\n{words(50)}"
    assert H.main_text(f"<html><body>{thread}</body></html>") == f"{words(30, 'c')}\n{words(40, 'c')}"


def test_names_inside_the_article():
    """A word in a class or id decides only where it names the element."""
    kept = '<div class="article-header"><p>Heading words of the article itself stand here.</p></div><section id="related-work"><p>Others wrote about this before, and more than once.</p></section><p class="notice-period">The notice period is three months for all of them.</p>'
    want = ["Heading words of the article itself stand here.", "Others wrote about this before, and more than once.", "The notice period is three months for all of them."]
    for tag in ("article", "main", "div"):
        got = H.main_text(page(f"<{tag}>{kept}{BODY}</{tag}>"))
        assert got == "\n".join([*want, *ARTICLE]), tag
    links = '<div class="related"><a href="/1">One story</a> <a href="/2">Another story</a></div>'
    assert H.main_text(page(f"<article>{BODY}{links}</article>")) == WANT
    for name in ("reader-comments", "commentList", "share-buttons", "ad-slot", "cookie_notice", "newsletter-box", "sidebar2"):
        box = f'<div class="{name}"><p>Words that are not of the article but look like it in every way there is.</p></div>'
        assert H.main_text(page(f"<article>{BODY}{box}</article>")) == WANT, name
        assert H.main_text(page(f"<div><div>{BODY}</div>{box}</div>")) == WANT, name


def plain_sums(node):
    """(characters, tags, link characters, link tags) of a subtree by recursion."""
    total = [0, 1, 0, 0]
    for x in node.parts:
        if isinstance(x, str):
            total[0] += len(x.strip())
        elif not x.dropped:
            total = [a + b for a, b in zip(total, plain_sums(x))]
    return [total[0], total[1], total[0], total[3] + 1] if node.tag == "a" else total


def test_density_by_brute_force(spark, sf_dir):
    import math

    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(30).collect()]
    pages += [page(f"<div><div>{BODY}</div><p>x <a href='/'>link</a></p></div>"), page(f"<main><section>{BODY}</section><section>{BODY}</section></main>")]
    for p in pages:
        _, nodes = H.parse(p)
        H._rescue(nodes)
        H._drop_link_boxes(nodes)
        H.measure(nodes)
        chars, _, links, _ = plain_sums(nodes[0])
        sums = dict.fromkeys(map(id, nodes), 0.0)
        for n in nodes:
            c, t, lc, lt = plain_sums(n)
            if n.dropped or not c:
                continue
            base = math.log(c / max(1, c - lc) * lc + links / max(1, chars) * c + math.e)
            want = c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1) + 1) / math.log(base + 1)
            assert abs(n.density - want) < 1e-9 * max(1, want)
            if n.parent is not None:
                sums[id(n.parent)] += want
        assert all(abs(n.total - sums[id(n)]) < 1e-6 for n in nodes if not n.dropped)
        best = max((n for n in nodes if not n.dropped and n.chars and n.tag in H.CONTAINERS), key=lambda n: sums[id(n)])
        inside = {id(x) for n in H.content(nodes) for x in subtree(n)}
        assert all(id(x) in inside for x in subtree(best) if x.tag in ("p", "h1")) or best.tag == "body"


def subtree(node):
    yield node
    for x in node.parts:
        if not isinstance(x, str) and not x.dropped:
            yield from subtree(x)


def test_driver_pages_without_article_tags(spark, sf_dir):
    """The same articles in plain boxes: density alone finds them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = right = 0
    for r in pages.collect():
        want = H.main_text(r["html"])
        for tag in ('<div class="x">', "<section>"):
            end = "</div>" if tag[1] == "d" else "</section>"
            n += 1
            right += H.main_text(r["html"].replace("<article>", tag).replace("</article>", end)) == want
    assert right >= 0.98 * n, (right, n)


def test_time_grows_with_the_page():
    import time

    def seconds(text):
        began = time.process_time()
        H.main_text(text)
        return time.process_time() - began

    hostile = ['<a "', "<a '>", "<b>", "<b><p>", "<div>", "<p><b>", "<li>", "<ul><li>", "<b><li></li>", "</x>", "<script>", "<!--", "<td><b>", "<article><p>x</p>", "&", '<p class="', "<İ>"]
    for part in hostile:
        small, large = min(seconds("<b>" * 500 + part * 2000 + "x") for _ in range(3)), min(seconds("<b>" * 2000 + part * 8000 + "x") for _ in range(2))
        assert large < 4 * 2.5 * max(small, 0.01), (part, small, large)


def test_markup():
    assert H.main_text("<p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9;</p>") == "a & b <c> ééé"
    assert H.main_text("<p>one  <b>two</b>\n three<br>four</p><p>five") == "one two three four\nfive"
    assert H.main_text("<div>a<p>b<p>c<div>d</div>e</div>") == "a\nb\nc\nd\ne"
    assert H.main_text("plain text") == "plain text" and H.main_text("a < b and <i>c</i>") == "a < b and c"
    assert H.main_text("<p>x</p><p cla") == "x" and H.main_text("<p>x<!-- never ends") == "x"
    assert H.main_text('<p>x</p><p a="never closed>y</p>') == "x\ny" and H.main_text("<p>İİ</p><script>x</SCRIPT ><p>y</p>") == "İİ\ny"
    assert H.main_text("<SCRIPT>1</SCRIPT><P>x</P><script>never ends") == "x"
    assert [H.main_text(x) for x in (None, "", "  ", "<html></html>", "<nav>a</nav>")] == [""] * 5


def test_driver_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (None, "u", "<div>" * 3000 + "deep"), (5, "u", "<p>" + "word " * 60000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = H.extract(pages).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 1, 1, 4, 299999] and H.extract(pages.where("false")).count() == 0
