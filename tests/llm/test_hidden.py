"""What counts as invisible on a page: attributes of their own, not words inside other values."""

import pytest

from voxelspark.llm import html_extraction

TEXT = "First paragraph of the article with quite enough words in it to be read by anyone"
ARTICLE = "<html><body><nav><a href='/'>Home</a></nav><article {}><p>" + TEXT + " and a {} too.</p><p>" + TEXT + ".</p></article></body></html>"
SHOWN = ['style="overflow:hidden"', "style='overflow: hidden; display:block'", 'title="the hidden truth"', 'alt=hidden', 'href="/hidden/x"', 'data-x="display:none"', 'title="aria-hidden=true"', 'class="is-hidden-never"', 'style="display:none;display:block"', 'aria-hidden="false"']
GONE = ["hidden", 'hidden=""', "HIDDEN=hidden", 'style="color:red; display : none"', "style='visibility:hidden'", "style=display:none", 'aria-hidden="true"', "aria-hidden=true", 'style="DISPLAY:NONE !important"']


def text(page):
    return html_extraction.main_text(page, html_extraction.trained())


@pytest.mark.parametrize("attribute", SHOWN)
def test_shown(attribute):
    want = f"{TEXT} and a link here too.\n{TEXT}."
    assert text(ARTICLE.format(attribute, "<a href='#'>link here</a>")) == want
    assert text(ARTICLE.format("", f"<a {attribute}>link here</a>")) == want


@pytest.mark.parametrize("attribute", GONE)
def test_hidden(attribute):
    assert text(ARTICLE.format("", f"<span {attribute}>secret</span>")) == f"{TEXT} and a too.\n{TEXT}."


def test_formulas_are_text():
    formula = "<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math>"
    assert text(ARTICLE.format("", formula)) == f"{TEXT} and a x=2 too.\n{TEXT}."
