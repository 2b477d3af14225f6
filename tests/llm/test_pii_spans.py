"""Spans that only the tagger marks, made by hand."""

import pytest

from glyphmill.llm import pii

IP = pii.KINDS.index("ip")


@pytest.mark.parametrize("span", ["0.1,0.2,0.3,0.4", "a1.b2.c3.d4", "1.2.3.4.", "1..2.34", "1.2.3.²4567"])
def test_added_ip_needs_digit_parts(span):
    assert pii.has_form(IP, span)
    assert pii.added_spans(span, [], [(0, IP, len(span), pii.MIN_MARGIN)]) == []


def test_added_ip_of_digits_stays():
    for span, good in (("10.0.0.255", True), ("10.0.0.256", False), ("010.0.0.1", True)):
        found = pii.added_spans(span, [], [(0, IP, len(span), pii.MIN_MARGIN)])
        assert found == ([(0, IP, len(span))] if good else [])
