"""Pages whose main text stands in several elements, and foreign elements that close themselves."""

import time

import pytest

from claimloom.llm import template
from claimloom.llm.template import main_text


def test_all_articles_of_a_page_stay_in_order():
    page = "<p>above</p><article><p>first part</p></article><p>between</p><article><p>the second and longer part</p></article><article>third</article>"
    assert main_text(page) == "first part\n\nthe second and longer part\n\nthird"


def test_main_keeps_its_text_beside_a_tile():
    page = "<main><p>long text of the page</p><article class='card'>short tile</article><p>its end</p></main><p>below</p>"
    assert main_text(page) == "long text of the page\n\nshort tile\n\nits end"


def test_what_closes_itself_hides_nothing():
    for tag in ("<svg width='1'/>", "<math/>", "<svg />"):
        assert main_text(f"<article><p>before {tag} after</p><p>more</p></article>") == "before after\n\nmore"
    assert main_text("<article><svg/><p>a</p><svg><text>drawn</text></svg><p>b</p></article>") == "a\n\nb"
    assert main_text("<article><p>a</p><svg a='/'><text>drawn</text></svg><p>b</p></article>") == "a\n\nb"


def test_main_text_leaves_the_rest_out():
    page = """<header class=site><h1>Site</h1></header><div class="main-content with-sidebar"><h1>Title</h1><p>First  <a href=x>link</a>.</p>
    <script>var a="</p>";</script><form><label>n</label></form><div class="comments"><p>Nice</p></div></div><div id="cookie-notice">We</div><footer>c</footer>"""
    assert main_text(page) == "Title\n\nFirst link."


@pytest.mark.parametrize("page, want", [
    ('<article><p>Hi <span class="advert">Buy now</span> there <span hidden>secret</span></p><button>Subscribe</button><video>no video</video><p>end</p></article>', "Hi there\n\nend"),
    ("<article><p>A one</p><object data=x><p>B two</p></article>", "A one\n\nB two"),
    ("<article><p>A</p><object data=x>fall<p>back</p></object><noscript>js</noscript><p>B</p><svg><text>t</text></svg><p>c<svg/>d</p><template><p>no</p></template></article>", "A\n\nB\n\nc d"),
    ("<article><p>one<svg>two</p><p>three <select><option>x</select>four</p></article>", "one two\n\nthree\n\nfour"),
    ("<article><p>a<a href=x>link <i class=ad>no</i></a>b</p></article>", "alink b"),
])
def test_text_is_left_out_by_the_element_it_is_read_in(page, want):
    assert template.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</span>" * 100_000, "<b>" * 100_000 + "<p>x</p>" * 100_000, "<li><ul>" + "<b>" * 100_000 + "<li>x</li>" * 100_000, "<svg>x" * 100_000, "<object>x" * 100_000])
def test_reading_takes_time_in_proportion(page):
    began = time.process_time()
    template.blocks("<article>" + page)
    assert time.process_time() - began < 20


def test_pages_meet_their_templates_by_salted_parts_too(spark, monkeypatch):
    pages = [(k, "http://h/x", f"<html><body><div class=menu>home news about contact</div><div id=c><p>text number {k} of many words here</p></div><div class=end>all rights reserved here</div></body></html>") for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    one = sorted(map(tuple, template.extract(df).collect()))
    monkeypatch.setattr(template, "BROADCAST", -1)
    monkeypatch.setattr(template, "SALTED", 7)
    assert sorted(map(tuple, template.extract(df).collect())) == one and len(one) == 40
