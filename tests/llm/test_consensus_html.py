import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import rows  # noqa: E402

from moodweave.llm import consensus_html as CH  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


STORY = "".join(f"<p>Paragraph {k} of a story that is long enough, with commas, and a point.</p>" for k in range(6))
TEXT = "\n".join(f"Paragraph {k} of a story that is long enough, with commas, and a point." for k in range(6))


def extract(spark, pages):
    return {r["page_id"]: r["text"] for r in CH.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_furniture_goes_and_the_article_stays(spark):
    bodies = {
        1: f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{STORY}</article><footer>&copy; me</footer>",
        2: f"<div class='header'>Site</div><div id='content-12'>{STORY}<div class='comments'><p>Nice!</p></div></div>"
           "<div class='sidebar'><p>Links and many words to read in the side bar, really, so many.</p></div>",
        3: f"<div class='cookie-notice'>We use cookies</div><main>{STORY}<aside>See also</aside>"
           "<form><input name=q><label>Mail</label><button>Go</button></form></main><script>var a='<p>no</p>';</script>",
        4: f"<table><tr><td class=menu><a href=x>one</a><a href=y>two</a></td><td>{STORY}</td></tr></table>",
        5: f"<div class='with-sidebar'><section>{STORY}<div class='ad'>Buy</div></section><!-- <p>gone</p> --></div>",
    }
    got = extract(spark, [(k, f"http://h{k}.org/{k}", page(b, "<style>p{}</style>")) for k, b in bodies.items()])
    assert got == {k: TEXT for k in bodies}


def test_blocks_references_and_white_space(spark):
    html = page("<article><h1>A  &amp;\n B</h1><p>one<br>two &lt;3 &#233;&nbsp;x<p>three <b>bold<i> it</i>alic</b>"
                "<ul><li>first<li>second</ul><pre> a\n  b </pre></article>")
    assert extract(spark, [(1, "http://x.org/", html)])[1] == "A & B\none two <3 é x\nthree bold italic\nfirst\nsecond\na b"


def test_consensus_of_the_host_decides(spark):
    usual = [(k, f"https://news.org/{k}", page(f"<div class='story s{k}'>{STORY}</div><div class='box'><p>Short.</p></div>"))
             for k in range(8)]
    long_box = "<p>" + "a long box of words that is no story, only noise, " * 40 + "</p>"
    odd = (99, "https://NEWS.org/odd", page(f"<div class='story s9'><p>Brief story.</p></div><div class='box'>{long_box}</div>"))
    got = extract(spark, [*usual, odd])
    assert got[99] == "Brief story." and got[3] == TEXT
    assert extract(spark, [odd])[99].startswith("a long box")      # alone, its own best container


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>open <b>never closed", "open never closed"),
    ("<p>a < b and c > d</p>", "a < b and c > d"), ("<div><p>x</div></p></div>y", "x\ny"), ("<script>alert(1)", ""),
    ("<a title='x>y'>link", "link"), ("<p title=\"unclosed>text</p>", "text"), ("<", "<"), ("<!-- never closed", ""),
])
def test_broken_markup(html, text):
    blocks, containers = CH.read_blocks(html or "")
    assert "\n".join(t for at, t, _ in blocks if CH._visible_below(at, None)) == text


def test_nulls_long_pages_and_empty_tables(spark):
    long = page("<article>" + "<p>word " * 20000 + "</article>")
    got = extract(spark, [(1, None, None), (2, "nohost", ""), (3, None, long), (3, None, long), (None, "http://a.b/", page(STORY))])
    assert got[1] == got[2] == "" and got[3].count("\n") == 19999 and got[None] == TEXT
    assert rows(CH.extract_pages(spark.createDataFrame([], SCHEMA))) == []


def test_a_host_with_two_templates(spark):
    plain = [page(f"<div>{STORY}</div>") for _ in range(8)]
    post = [page(f"<div><p>A teaser of something else.</p></div><div class='post p{k}'>{STORY}</div>") for k in range(3)]
    for name in ("https://two.org/a", None):
        got = extract(spark, [(k, name, html) for k, html in enumerate(plain + post)])
        assert got == {k: TEXT for k in range(11)}


def test_every_container_with_a_positive_score_votes(spark):
    html = page("".join(f"<div class='{c}'>{STORY}</div>" for c in "vwxyz"))
    assert CH.host_votes(spark.createDataFrame([(1, "http://x.org/", html)], SCHEMA)).count() == 6
