"""Main text of pages: hostile markup in linear time, names and lists inside articles, pages without articles, comments, adverts."""

import time

import pytest

from marginalia.llm import html_text

A = "The first paragraph tells what happened at the harbour in the morning, and who was there to see it."
B = "The second one goes on about the weather, the boats that left, and those that stayed for the day."
C = "It ends with a short word on what comes next, as such reports do in this paper every week."


@pytest.mark.parametrize(
    "page",
    ["<a href='" * 110_000, "<a href='" * 110_001 + ">", '<a href="' * 50_000 + "<a href='" * 50_000 + ">", "<a " * 300_000 + "'>", "<p a=" * 200_000 + "'>", "<a " + "x" * 1_000_000 + ">", "<" * 1_000_000, "<title>" + "</title " * 120_000, "<!--" * 250_000, "<i>" * 20_000 + "</b>" * 20_000 + "x", "<b>" + "<p>x</b>" * 60_000, "<ul><li><a href=x>y</a>" * 20_000],
    ids=["open quotes", "odd quotes", "two kinds", "tag starts", "equals", "long attribute", "less-than", "raw ends", "comments", "open i", "stray ends", "nested lists"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    html_text.extract(page)
    assert time.time() - began < 6


def test_a_quote_that_never_closes_costs_one_tag():
    assert html_text.extract(f"<article><p>{A} <a href='x>link</a> {B}</p></article>") == f"{A} link {B}"
    assert html_text.extract(f"<article><p title=it's>{A}</p><p>isn't {B}</p></article>") == f"{A}\nisn't {B}"
    assert html_text.extract(f"<article><p title='a > b'>{A}</p><p title = \"c > d\">{B}</p></article>") == f"{A}\n{B}"


@pytest.mark.parametrize("name", ["class=share-price", "class=related-work", "class=ad-hoc", "class=popup-book", "class=menu-item-description", "class=cookie-recipe", "class=footer-note", "class=navigation-history", "id=newsletter-history"])
def test_a_part_of_a_name_says_nothing_inside_an_article(name):
    assert html_text.extract(f"<body><nav>Menu</nav><article><h1>Head</h1><p>{A}</p><p {name}>{B}</p><div {name}><p>{C}</p></div></article></body>") == f"Head\n{A}\n{B}\n{C}"


@pytest.mark.parametrize("name", ["class=newsletter", "class=newsletter-signup", "class='box share-buttons'", "id=comments", "class=comment-list", "class=related-posts", "class=sidebar", "class='ad'", "class=ad-slot", "class=cookie-notice", "class='popup-modal'", "role=navigation", "class=social-share", "hidden", "style='display: none'", "class=responses"])
def test_whole_names_leave_out(name):
    assert html_text.extract(f"<body><article><h1>Head</h1><p>{A}</p><div {name}><p>{C}</p></div><p>{B}</p></article></body>") == f"Head\n{A}\n{B}"
    assert html_text.extract(f"<body><div><h1>Head</h1><p>{A}</p><div {name}><p>{C}</p></div><p>{B}</p></div></body>") == f"Head\n{A}\n{B}"


def test_lists_of_links_are_an_articles_own():
    links = "<h2>References</h2><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul><div><a href=3>One</a> <a href=4>Two</a></div>"
    assert html_text.extract(f"<article><h1>Head</h1><p>{A}</p>{links}</article>") == f"Head\n{A}\nReferences\nFirst source\nSecond source\nOne Two"


def test_labels_and_buttons_in_running_text():
    page = f"<article><p>Press <button>OK</button> to go on, <label>as they say</label>. {A}</p><form><label>Mail</label><button>Send</button></form><button>Share</button><p>{B}</p></article>"
    assert html_text.extract(page) == f"Press OK to go on, as they say. {A}\n{B}"


def test_neighbours_on_pages_without_article():
    assert html_text.extract(f"<body><nav><a href=1>Home</a></nav><h1>Big Title</h1><div><p>{A}</p><p>{B}</p></div></body>") == f"Big Title\n{A}\n{B}"
    assert html_text.extract(f"<body><div class=lead>What this is about.</div><div class=body><p>{A}</p><p>{B}</p></div><div class=end>That was all.</div></body>") == f"What this is about.\n{A}\n{B}\nThat was all."
    menu = "<div>" + "<a href=x>some menu entry</a> " * 12 + "</div>"
    a, b = " ".join([A] * 5), " ".join([B] * 4)
    assert html_text.extract(f"<body><div class=lead>What this is about.</div><div class=body><p>{a}</p><p>{b}</p></div><div class=end>That was all.</div></body>") == f"What this is about.\n{a}\n{b}\nThat was all."
    page = f"<body>{menu}<h1>Title</h1><div id=wrap><div><p>{a}</p><p>{b}</p></div></div>{menu}<div>© 2024 The Paper.</div><div>Site map</div></body>"
    assert html_text.extract(page) == f"Title\n{a}\n{b}"


def test_reader_comments_in_articles_of_their_own():
    says = "".join(f"<article><p>Reader {i} says that this is all true and adds a word on the boats of the harbour.</p></article>" for i in range(3))
    for name in ("responses", "comments", "replies", "comment-list"):
        assert html_text.extract(f"<body><article><h1>Head</h1><p>{A}</p><p>{B}</p></article><div class={name}>{says}</div></body>") == f"Head\n{A}\n{B}"


def test_end_tags_and_repairs():
    assert html_text.extract("<article><p>one<p>two</i></b><div>three</article>") == "one\ntwo\nthree"
    assert html_text.extract("<article><ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table></article>") == "a\nb\nc\nd\ne\nf"
    assert html_text.extract("<article><p>a<b>b<p>c</b>d</p></article>") == "ab\ncd"
    assert html_text.extract("<article>x<![CDATA[ y ]]>z<!-- w --><?php q ?><!DOCTYPE p>&amp;&#233;</article>") == "x y z&é"
    assert html_text.extract("<article><script>if (a < b) { '</p>' }</script>t<textarea>n</textarea><br/>u</article>") == "t\nu"
    assert html_text.extract("a < b and c > d") == "a < b and c > d"
