import random
import time

import pytest

from threadlake.llm import main_text

PROSE = "One two three, four five six seven, eight nine ten eleven twelve thirteen. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}"


def test_article_without_the_rest():
    html = page(
        "<header>Site</header><nav><ul><li><a href='/a'>Menu, one</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, really, on this site, yes.</p></div>"
        f"<!-- ad --><div class=ad>Buy, buy.</div><article><h1>Head &amp; line</h1><p>{PROSE}"
        f"<p>Second<b>bold</b> &eacute;\n\t x<br>y</p><script>var p='</p>';</script>"
        "<form><p>Sign up, now, please</p></form><aside><p>Side, bar</p></aside></article>"
        f"<div id='comments'><p>{PROSE}{PROSE}</p></div><footer>&copy; me</footer></body></html>"
    )
    assert main_text.main_text(html) == f"Head & line {PROSE.strip()} Secondbold é x y"


def test_container_without_article_and_its_siblings():
    html = page(
        "<div><a href=1>a</a> <a href=2>b, c, d</a></div>"
        f"<div><div class=story><p>{PROSE}</p><p>{PROSE}</p></div><div><p>{PROSE}</p></div>"
        "<ul><li><a href=x>More of this, and that</a></li></ul></div>"
    )
    assert main_text.main_text(html) == " ".join([PROSE.strip()] * 3)


def test_names_and_forms_around_the_content_do_not_lose_it():
    side = "<div class=sidebar><p>Side, bar, of the site</p></div>"
    talk = f"<div id=comments><ol><li class=comment><article class=comment-body><p>{PROSE}{PROSE}</p></article></ol></div>"
    for open_, close in (
        ("<div class='site has-sidebar'>", "</div>"),
        ("<div class='elementor-widget elementor-widget-theme-post-content'>", "</div>"),
        ("<div id=no-sidebar><div class='post comments-open widget'>", "</div></div>"),
        ("<form><input value=x><button>Go, now</button>", "</form>"),
    ):
        for content in (f"<article><p>{PROSE}</p></article>", f"<main><div class=widget><p>{PROSE}</p></div></main>", f"<div><p>{PROSE}</p></div>"):
            for html in (page(f"{open_}{content}{side}{close}"), page(f"{side}{open_}{content}{close}")):
                assert main_text.main_text(html) == PROSE.strip(), html
    wrapped = f"<div class='site has-sidebar'><article><p>{PROSE}</p></article>{side}{talk}</div>"
    assert main_text.main_text(page(wrapped)) == PROSE.strip()
    assert main_text.main_text(page(f"<div><p>{PROSE}</p></div>{talk}")) == PROSE.strip()


def test_text_straight_in_a_block_and_unusual_pages():
    assert main_text.main_text(page(f"<div>{PROSE}<br>{PROSE}</div>")) == (PROSE * 2).strip()
    assert main_text.main_text("just text &lt;x&gt; 1 < 2") == "just text <x> 1 < 2"
    for empty in (None, "", "<", "<!--", "<p", "<a href='", "<script>x", "</p></div>", page("")):
        assert main_text.main_text(empty) in ("", "<")
    assert main_text.main_text("<article><p>open <b>tags <i>everywhere") == "open tags everywhere"


def test_long_and_deep_pages_take_linear_time():
    began = time.time()
    for html in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "<p>x", "<p>x, " * 100_000,
                 "<a href='" * 50_000, "<!--" * 100_000, "<li>" * 100_000 + "<i>" * 50_000):
        main_text.main_text(html)
    assert time.time() - began < 20


def test_frame(spark):
    rows = [(1, "u", "<p>a, b</p>", "old", "z"), (1, "u", "<p>a, b</p>", "old", "z"), (2, None, None, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, TEXT string, n_chars string")
    out = main_text.extract(pages)
    got = sorted((r.page_id, r.text, r.n_chars) for r in out.collect())
    assert got == [(1, "a, b", 4), (1, "a, b", 4), (2, "", 0)]
    assert main_text.extract(pages.limit(0)).count() == 0


STORY = "This is a sentence of an article, long enough to be one, with commas, and it goes on for a while. "
SHORT = "A short last remark, no more."


def test_sections_of_an_article_stay_together():
    sections = [f"<section><h2>Part {i}</h2><p>{STORY * 3}</p></section>" for i in range(2)]
    page = f"<body><nav><a href=x>menu</a></nav><div>{''.join(sections)}<section><h2>End</h2><p>{SHORT}</p></section></div></body>"
    text = main_text.main_text(page)
    assert "Part 0" in text and text.endswith(f"End {SHORT}") and "menu" not in text
    page = page.replace("<section>", '<div class="part">').replace("</section>", "</div>")
    assert main_text.main_text(page) == text


def test_nothing_competes_with_the_only_article():
    for around in ("{}", "<main>{}</main>"):
        article = around.format(f"<article><p>{STORY}</p></article>")
        page = f'<body>{article}<div class="user-reviews"><p>{"They wrote this, and that. " * 40}</p></div></body>'
        assert main_text.main_text(page) == STORY.strip()


def test_a_promotion_longer_than_the_story_is_not_taken_back():
    promo = "".join(f"<p>Buy this, {STORY}</p>" for _ in range(5))
    page = f'<body><div><p>{STORY}</p></div><div class="promo">{promo}</div></body>'
    assert main_text.main_text(page) == STORY.strip()
    wrapped = f'<body><p>Home</p><div class="with-sidebar widget">{promo}</div></body>'
    assert main_text.main_text(wrapped).count("Buy this") == 5


def test_lists_of_links_stay_inside_an_article():
    sources = "".join(f"<li><a href=/{i}>Source number {i}</a></li>" for i in range(4))
    page = f'<article><p>{STORY}</p><div class="ad-hoc">An ad-hoc table.</div><ul>{sources}</ul><ul class="related">{sources}</ul></article>'
    text = main_text.main_text(page)
    assert text == f"{STORY.strip()} An ad-hoc table. " + " ".join(f"Source number {i}" for i in range(4))


def test_a_heading_before_its_container_is_kept():
    page = f"<body><h1>The title</h1><div><p>{STORY * 2}</p></div><h2>After it</h2></body>"
    assert main_text.main_text(page) == f"The title {(STORY * 2).strip()}"


def recursive_points(node):
    """Points of an element straight from the rules: (tag, own text, linked, children)."""

    def numbers(n):
        t, x, l, kids = n
        chars = len(x) - x.count(" ")
        inner = [numbers(k) for k in kids]
        return chars + sum(i[0] for i in inner), chars * l + sum(i[1] for i in inner)

    def points(n):
        t, x, l, kids = n
        total, links = numbers(n)
        chars = len(x) - x.count(" ")
        own = (x.count(",") + min(chars / 100, 3) + (chars >= 25)) * (1 - links / total) if chars else 0.0
        below = 0.0
        for k in kids:
            k_points, k_given = points(k)
            below += k_points / 2 + k_given
        if t in main_text.PARAGRAPHS:
            return below, own
        return below + own, 0.0

    return points(node)


def test_scores_equal_the_recursive_ones():
    rng = random.Random(8)
    words = ["word", "other, word", "x" * 30, "a, b, c"]

    def tree(depth):
        tag = rng.choice(["div", "section", "p", "blockquote", "h2"])
        text = " ".join(rng.choices(words, k=rng.randrange(6)))
        linked = rng.random() < 0.2
        kids = [] if depth == 0 or tag in ("p", "h2") else [tree(depth - 1) for _ in range(rng.randrange(4))]
        return tag, text, linked, kids

    def html(node):
        tag, text, linked, kids = node
        body = f"<a href=x>{text}</a>" if linked else text
        return f"<{tag}>{body}{''.join(map(html, kids))}</{tag}>"

    for _ in range(60):
        node = ("div", "", False, [tree(3) for _ in range(3)])
        elements, pieces = main_text._parse(html(node))
        main_text._score(elements, pieces)
        outer = elements[1]
        assert outer.points == pytest.approx(recursive_points(node)[0])
