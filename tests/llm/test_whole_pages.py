"""Pages whose wrappers carry excluded names, and pages without a named article."""

import pytest

from explorium.llm import wrappers

ARTICLE = "<article><div class='post-header'><h1>Title</h1></div><p>First words.<div class='related'><article>teaser</article></div><p>Last words.</article>"
LIST = "<ul>" + "<li>a long item of a list" * 20 + "</ul>"


def told(page):
    return wrappers.main_text(page, wrappers.region(wrappers.page_items(page)))


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'>{}</body>", "<body class='sidebar'>{}</body>", "<div class='page-with-sidebar'>{}<div class='sidebar'>side</div></div>", "<div class='sidebar'><p>side</p>{}</div>",
    "<form id='aspnetForm'>{}</form>", "<div class='related'><article>a teaser</article></div>{}", "<nav><article>in a menu</article></nav>{}<footer>foot</footer>"])
def test_articles_in_marked_wrappers(page):
    assert told("<html>" + page.format(ARTICLE) + "</html>") == "Title First words. Last words."


def test_pages_that_are_all_excluded():
    assert told("<body><form><div class='sidebar'>side</div><div class='text'><p>One.<p>Two.</div><nav>menu</nav></form></body>") == "One. Two."
    assert told("<body><nav>menu</nav><div class='footer'>foot</div></body>") == ""


def test_all_blocks_without_a_named_article(spark):
    listed = "a long item of a list " * 19 + "a long item of a list"
    pages = {
        "<body><nav>m</nav><div id='content'><p>Before.</p>" + LIST + "<p>After.</p></div></body>": f"Before. {listed} After.",
        "<body><div class='intro'><p>The first part</p></div><div class='body'><p>" + "the second part " * 9 + "</p></div><div class='ad'>buy</div></body>": "The first part" + " the second part" * 9,
        "<body><div class='a'><blockquote>" + "long quote " * 30 + "</blockquote><p>Said so.</p></div></body>": "long quote " * 30 + "Said so.",
    }
    rows = [(k, f"http://h{k}.org/", page) for k, page in enumerate(pages)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(pages.values()))


def test_what_a_host_repeats_is_its_template(spark):
    shell = "<body><div class='top'><p>Home About News Contact</p></div><div class='text'>{}</div><section class='responses'><p>A reader says this</p></section><div class='low'><p>All rights with us</p></div></body>"
    own = [f"<h1>Title {k}</h1>" + f"<p>words of page {k} and more of them</p>" * (k + 1) for k in range(4)]
    told = [" ".join([f"Title {k}"] + [f"words of page {k} and more of them"] * (k + 1)) for k in range(4)]
    alike = "<body><div class='a'><p>The same on all of these pages</p></div></body>"
    rows = [(k, "http://one.org/", shell.format(t)) for k, t in enumerate(own)] + [(k, "http://two.org/", alike) for k in range(10, 15)]
    # one page of a host has nothing to compare with; an article keeps what it repeats
    rows += [(20, "http://three.org/", shell.format(own[2]))] + [(k, "http://four.org/", f"<article><p>Now in the series</p><p>part {k}</p></article>") for k in range(30, 35)]
    for parts in (1, 4):
        got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
        assert [got[k] for k in range(4)] == told
        assert {got[k] for k in range(10, 15)} == {"The same on all of these pages"}
        assert got[20] == "Home About News Contact " + told[2] + " All rights with us"
        assert [got[k] for k in range(30, 35)] == [f"Now in the series part {k}" for k in range(30, 35)]


def test_regions_too_large_to_broadcast_are_joined(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.org/", f"<article><p>text {k}</p></article>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(wrappers, "BROADCAST", 10)
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == {k: f"text {k}" for k in range(12)}


@pytest.mark.parametrize(("page", "wanted"), [
    ("<article class='a'><p>The first of two articles here.</p></article><article class='b'><p>And the second one follows.</p></article>", "The first of two articles here. And the second one follows."),
    ("<article><svg><path><p>Text after what is never closed.</p></article>", "Text after what is never closed."),
    ("<article><p>One</p><select><option>a</option><p>Two</p></article>", "One a Two"),
    ("<article><p>One <button>Click</button> and <svg><text>drawn</text></svg> two</p><noscript>no</noscript></article>", "One and two"),
    ("<article><p>Kept</p><p class='advert'>buy</p><p class='ad'>buy<p>also kept</p></article>", "Kept also kept"),
    ("<article><p>Words <span class='ad'>buy <span>now</span> here</span>go on</p></article>", "Words go on"),
    ("<article><p>Story</p></article><ol class='commentlist'><li class='comment'>said</ol>", "Story"),
    ("<article><p>Story</p><ul><li>one<li class='sponsored'>buy<li>two</ul><p>End</p></article>", "Story one two End"),
    ("<div class='siteHeader'>Top</div><div class='text'><p>Story of some length</p></div><div id='siteFooter'>Low</div>", "Story of some length"),
    ("<div class='social-studies'><p>A long text about how people live together</p></div><div class='social-links'>Follow</div><div class='x'>a b c</div>", "A long text about how people live together a b c"),
    ("<article><h2 class='promo'>A heading</h2><p class='comment-on-law'>Text</p></article>", "A heading Text"),
])
def test_marks_within_text_and_unclosed_parts(page, wanted):
    assert told("<html><body>" + page + "</body></html>") == wanted


def test_what_repeats_between_slots_is_of_the_article(spark):
    page = "<body><div class='top'><p>Recipes Contact</p></div><div class='text'><p>Print this page</p><h1>Dish {k}</h1><h2>Summary</h2><p>It is dish {k} of many</p><h2>Ingredients</h2><blockquote>Serves four people at least.</blockquote><p>{k} spoons of salt</p><h4>Back to all recipes</h4></div></body>"
    wanted = "Dish {k} Summary It is dish {k} of many Ingredients Serves four people at least. {k} spoons of salt"
    rows = [(k, "http://dishes.org/", page.format(k=k)) for k in range(5)]
    for parts in (1, 3):
        got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
        assert got == {k: wanted.format(k=k) for k in range(5)}


def test_many_unclosed_parts_take_linear_time():
    page = "<body><article><p>" + "word <svg> <select> " * 20_000 + "</p></article></body>"
    assert told(page).split() == ["word"] * 20_000
