import pytest

from voxmill.llm.htmlmain import blocks_of


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>one <svg viewBox='0 0 1 1'/>two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <math/>two</p><p>three <svg><text>x</text></svg>four</p>", ["one two", "three four"]),
        ("<p>one</p><svg><p>two</p>", ["one", "two"]),
        ("<p>one</p><object data='a'><p>two</p>", ["one", "two"]),
        ("<p>one</p><noscript><p>two</p>", ["one", "two"]),
        ("<head><title>t</title><meta charset='u'><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><title>t</title></head><body><p>one</p></body>", ["one"]),
        ("<p>Energy is <math><mi>E</mi><annotation>TeX</annotation></math> known</p><object data='a'>shown instead</object>", ["Energy is E known", "shown instead"]),
        ("<p>one</p><xmp>a &amp; <b> c</xmp><p>two</p>", ["one", "a &amp; <b> c", "two"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
        ("<p>one</p><script>var a; <p>two</p>", ["one"]),
    ],
)
def test_open_tags(page, want):
    assert [b.text for b in blocks_of(page)] == want
