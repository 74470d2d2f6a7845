import html
import math
import random
import re

import pytest

from burnish.llm.html_text import Page, extracted, main_text


def wanted(source):
    """The article of the test pages, cut out by its tags."""
    body = source[source.index("<article>") + 9 :]
    body = re.split(r"</article>|<footer>", body)[0]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extracted(pages).collect():
        assert r["text"] == wanted(sources[r["page_id"]]) and r["n_chars"] == len(r["text"])


P = "<p>One long paragraph with many words in it, and more.</p>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("a < b &amp; c&nbsp;\n d", "a < b & c d"),
        ("<p>one<p>two <b>bold</b><br>line", "one\n\ntwo bold line"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\n\ny\n\n1\n\n2"),
        ("<script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> -->yes", "yes"),
        ("<article><header><h1>Title</h1></header>" + P + "</article><header>site</header>", None),
        ("<nav>menu" + "<article><h1>Title</h1>" + P + "</article>", None),
        ("<div class='cookie-notice'>We use</div><h1>Title</h1>" + P, None),
        ("<main><h1>Title</h1>" + P + "</main><aside>more</aside><form><p>mail</p></form><section id=comments>me too</section>", None),
        ("<div><div><a href=1>m1</a> <a>m2</a></div><div><h1>Title</h1>" + P + "</div><div><a>x</a> <a>y</a></div></div>", None),
        ("<article><section><h1>Title</h1></section><section>" + P + "</section></article>", None),
        ("<article><h1>Title</h1>" + P, None),
        ("<div", ""),
        ("<!-- open", ""),
        ("a&#" + "9" * 5000 + ";b &#x41;&#0000000000066;", "a\ufffdb AB"),
    ],
)
def test_shapes(source, text):
    assert main_text(source) == ("Title\n\nOne long paragraph with many words in it, and more." if text is None else text)


LINKS = "<ul><li><a href=1>One link</a><li><a href=2>Other link</a></ul>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div class='content has-sidebar'><h1>Title</h1>" + P + "</div>", None),
        ("<div class='layout-with-sidebar'><div class=sidebar>" + LINKS + "</div><div><h1>Title</h1>" + P + "</div></div>", None),
        ("<div id=sidebar><h1>Title</h1>" + P + "</div>", None),
        ("<h1 id=social>Title</h1>" + P, None),
        ("<article><h1 id=comments>Title</h1><div id=related-work>" + P + "</div></article>", None),
        ("<article><section id=sharing-data><h1>Title</h1></section><section id=social>" + P + "</section></article>", None),
        ("<main><h1>Title</h1>" + P + "<div class=related-posts>" + LINKS + "</div><div class=ad-slot>Buy this.</div></main>", None),
        ("<div class=siteFooter>All rights</div><div class=ad-300x250>Buy this.</div><h1>Title</h1>" + P, None),
        ("<div class=ad>" + "Buy this. " * 50 + "</div><article><h1>Title</h1>" + P + "</article>", None),
        ("<div class=popup>Look<article><h1>Title</h1>" + P + "</article>", None),
        ("<article>See <a class=related href=1>this</a> <span id=notice>here</span>.</article>", "See this here."),
    ],
)
def test_names_need_evidence(source, text):
    assert main_text(source) == ("Title\n\nOne long paragraph with many words in it, and more." if text is None else text)


LONG = "<h1>Title</h1>" + P
BAR = "<div class=topbar>" + LINKS + "</div>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        # Nothing inside an attribute's value is a name, and the first of two counts.
        ("<section aria-label='The hidden costs'>" + LONG + "</section>", None),
        ('<section data-x="a class=ad b" title=\'id="sidebar" role="search"\'>' + LONG + "</section>", None),
        ("<section class=text class=ad data-hidden=1 xhidden>" + LONG + "</section>", None),
        ("<p HIDDEN>no</p><p Aria-Hidden = 'TRUE'>no</p><p role=search>no</p>" + LONG, None),
        # A form around the page or its article is no form to fill in; one beside it is.
        ("<form id=aspnetForm action=x>" + BAR + "<div>" + LONG + "</div></form>", None),
        ("<form><header>Site name</header><article>" + LONG + "</article><footer>All rights</footer></form>", None),
        ("<form><div class=wrapper><main>" + LONG + "</main></div><div class=comments>" + P * 9 + "</div></form>", None),
        ("<article>" + LONG + "<form><p>Your mail</p><button>Go</button></form></article>", None),
        ("<div>" + LONG + "<div role=form>Your mail, please</div></div><form>" + P[:40] + "</p></form>", None),
        ("<article>" + LONG + "</article><form>" + "<label>A field with a long name of many words</label>" * 30 + "</form>", None),
        # Formulas are text; what they hold for programs is not.
        (
            "<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation encoding='x'>E=mc^2</annotation></math> is long text</p>",
            "Energy E=mc2 is long text",
        ),
        ("<p>super<wbr>cali<WBR/>fragi<br>listic</p>", "supercalifragi listic"),
    ],
)
def test_forms_attributes_formulas(source, text):
    assert main_text(source) == ("Title\n\nOne long paragraph with many words in it, and more." if text is None else text)


def plain_main(root):
    """The element whose block children have the greatest sum of densities, from the definition, on a tree of (tag, children)."""

    def counts(node, in_link=False):
        tag, children = node
        in_link = in_link or tag == "a"
        chars, tags, links, link_tags = 0, 1, 0, int(in_link)
        for child in children:
            if isinstance(child, str):
                own = len("".join(child.split()))
                chars, links = chars + own, links + own * in_link
            else:
                c, t, lc, lt = counts(child, in_link)
                chars, tags, links, link_tags = chars + c, tags + t, links + lc, link_tags + lt
        return chars, tags, links, link_tags

    whole = counts(root)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        if not whole[2]:
            return c / t
        inner = math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(inner)

    every, above = [], {}

    def walk(node, path):
        every.append(node)
        above[id(node)] = path
        for child in node[1]:
            if not isinstance(child, str):
                walk(child, [*path, node])

    walk(root, [])
    inline = ("a", "b", "span")
    total = {id(n): sum(density(c) for c in n[1] if not isinstance(c, str) and c[0] not in inline) for n in every}
    best = max(every, key=lambda n: total[id(n)])
    for up in reversed(above[id(best)][1:]):
        links = [c for c in up[1] if not isinstance(c, str) and c[0] not in inline and 2 * counts(c)[2] > counts(c)[0]]
        if any(density(c) < density(root) for c in links):
            break
        best = up
    return best


def test_density_against_the_definition():
    draw = random.Random(7)
    moved = 0
    for n in range(400):

        def grown(depth):
            out = []
            for _ in range(draw.randint(1, 4)):
                words = " ".join(draw.choices(["word", "a", "longer", "something"], k=draw.choice([1, 2, 5, 30]))) + f" {draw.randrange(99)}"
                kind = draw.random()
                if depth and kind < 0.5:
                    out.append((draw.choice(["div", "section"]), grown(depth - 1)))
                elif kind < 0.75:
                    out.append(("p", [words, ("a", ["link text here"])] if draw.random() < 0.3 else [words]))
                else:
                    out.append(("ul", [("li", [("a", [words])]) for _ in range(draw.randint(1, 6))]))
            return out

        def written(node):
            return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"

        root = ("body", grown(3))
        page = Page("".join(map(written, root[1])))
        best = plain_main(root)
        blocks = []

        def read(node):
            if node[0] in ("a", "b", "span"):
                return "".join(c if isinstance(c, str) else read(c) for c in node[1])
            parts = ""
            for child in [*node[1], None]:
                if isinstance(child, str) or child is not None and child[0] == "a":
                    parts += child if isinstance(child, str) else read(child)
                    continue
                if parts.strip():
                    blocks.append(" ".join(parts.split()))
                parts = ""
                if child is not None:
                    read(child)

        read(best)
        assert page.text() == "\n\n".join(blocks), n
        moved += best is not root
    assert moved > 100


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(main_text("<article>" + "<p>" + "word " * 10 + "</p>" * 20_000)) == 49
    assert main_text("<article>" + "<p>w</p>" * 20_000) == "\n\n".join(["w"] * 20_000)


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>x"), (2, "u", ""), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as `Html`", "2 as text")
    found = extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert extracted(pages.where("false")).count() == 0
