"""Valid pages that leave out </head> or hold empty svg and math elements."""

import pytest
from runlens.llm import pages


def texts(html):
    return [b[0] for b in pages.blocks(html)]


@pytest.mark.parametrize("html, want", [
    ("<html><head><title>t</title><meta charset=utf-8><body><p>One two.<p>Three.</body></html>", ["One two.", "Three."]),
    ("<head><title>t</title><link rel=x href=y><p>One two.</p><div>Three.</div>", ["One two.", "Three."]),
    ("<head><title>t</title>One two.<p>Three.", ["One two.", "Three."]),
    ("<head><title>t</title></head><body><p>One two.</p></body>", ["One two."]),
    ("<body><p>One <svg class='icon' width='1'/> two.</p><p>Three.</p>", ["One", "two.", "Three."]),
    ("<body><p>One <math/> two.</p><p>Four <svg><text>no</text></svg> five.</p>", ["One", "two.", "Four", "five."]),
])
def test_whole_page(html, want):
    assert texts(html) == want
    assert not any("head" in path for _, path, _ in pages.blocks(html))
