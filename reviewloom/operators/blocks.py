"""Raw review blocks of a page, found by the rules of a profile.

Only the search for elements runs in Python, over Arrow batches. It returns raw
strings; cleaning, dates, ratings and filters are expressions.
"""

import re
from collections.abc import Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from reviewloom.operators.profiles import Profile
from reviewloom.schema import BLOCKS_TYPE

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(["script", "style", "template"])

# How a block shows its rating.
_LABEL = r"\d.*star"
_FRACTION = re.compile(r"(\d(?:\.\d)?)\s*/\s*5|(\d(?:\.\d)?)\s*out\s*of\s*5", re.I)
_FILLED = [
    ("svg", "class", "has", "filled"), ("svg", "class", "has", "active"),
    (None, "class", "word", "ui_bubble_rating"),
]


class _Outline(HTMLParser):
    """The elements of a page in document order.

    An element is [tag, attributes, first element after it, first text, last
    text]; what is inside it lies between its own place and its end. An element
    that is never closed ends with the one around it.
    """

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self._open = [], [], []
        self.feed(html)
        self.close()
        self._close_from(0)

    def _close_from(self, depth):
        for place in self._open[depth:]:
            self.elements[place][2] = len(self.elements)
            self.elements[place][4] = len(self.texts)
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        n, t = len(self.elements), len(self.texts)
        self.elements.append([tag, {k: v or "" for k, v in attrs}, n + 1, t, t])
        if tag not in _VOID:
            self._open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.elements[self._open[depth]][0] == tag:
                return self._close_from(depth)

    def handle_data(self, data):
        if not self._open or self.elements[self._open[-1]][0] not in _SILENT:
            self.texts.append(data)

    def text(self, place):
        _, _, _, first, last = self.elements[place]
        return "".join(self.texts[first:last])

    def find(self, rules, within=None):
        """Places of the elements that fit any of the rules, in order."""
        start, end = 0, len(self.elements)
        if within is not None:
            start, end = within + 1, self.elements[within][2]
        return [n for n in range(start, end)
                if any(_fits(self.elements[n], rule) for rule in rules)]

    def first(self, rules, within):
        """First place for the first rule that fits anything."""
        end = self.elements[within][2]
        return next((n for rule in rules for n in range(within + 1, end)
                     if _fits(self.elements[n], rule)), None)


def _fits(element, rule):
    tag, attribute, test, value = rule
    if tag is not None and tag != element[0]:
        return False
    if test == "any":
        return True
    actual = element[1].get(attribute)
    if actual is None or test == "set":
        return actual is not None
    if test == "has":
        return value in actual
    if test == "like":
        return re.search(value, actual, re.I) is not None
    return value in actual.split() if test == "word" else value == actual


def _block(page, profile, place):
    def text_at(rules):
        found = page.first(rules, place)
        return None if found is None else page.text(found)

    def attribute_of(name):
        found = page.first([(None, name, "set", "")], place)
        return None if found is None else page.elements[found][1][name]

    date_at = page.first(profile.date, place)
    date = None
    if date_at is not None:
        given = [page.elements[date_at][1].get(a) for a in profile.date_attributes]
        date = next((g for g in given if g), None) or page.text(date_at)
    block = {
        "name": text_at(profile.name),
        "location": text_at(profile.location),
        "date_raw": date,
        "text": page.text(place) if profile.whole_block_text else text_at(profile.text),
    }
    if profile.rated:
        fraction = _FRACTION.search(page.text(place))
        labelled = page.first([(None, "aria-label", "like", _LABEL)], place)
        block |= {
            "label": None if labelled is None else page.elements[labelled][1]["aria-label"],
            "filled": len(page.find(_FILLED, place)),
            "data_rating": attribute_of("data-rating"),
            "data_score": attribute_of("data-score"),
            "data_stars": attribute_of("data-stars"),
            "fraction": fraction and (fraction[1] or fraction[2]),
        }
    return block


def _page_blocks(profile, html):
    page = _Outline(html)
    found = next(filter(None, (page.find(rules) for rules in profile.blocks)), [])
    return [_block(page, profile, place) for place in found]


def block_entries(html: Column, profile: Column, profiles: Mapping[str, Profile]) -> Column:
    """Raw blocks of a page, an empty list where no rule finds any.

    Pages without text to search, or of no known profile, give null.
    """
    rules = dict(profiles)

    @F.pandas_udf(BLOCKS_TYPE)
    def locate(pages: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([
            _page_blocks(rules[kind], page) if page is not None and kind in rules else None
            for page, kind in zip(pages, kinds)
        ], dtype=object)

    return locate(html, profile)
