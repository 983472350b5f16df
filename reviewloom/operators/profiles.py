"""Where the reviews of a page are: one profile per kind of site.

A rule is (tag or None, attribute or None, test, value). Tests: ``has`` the
value as written inside the attribute, ``like`` a pattern in any letter case,
``word`` one of the class names, ``is`` the whole attribute, ``set`` for an
attribute of any value, and ``any`` for the tag alone.
"""

from collections.abc import Sequence
from dataclasses import dataclass

Rule = tuple[str | None, str | None, str, str]


@dataclass(frozen=True)
class Profile:
    """Strategies and rules. Block and field rules are tried in order; a block
    rule is a group whose members are looked for together."""

    platform: str
    strategies: Sequence[str]
    blocks: Sequence[Sequence[Rule]]
    name: Sequence[Rule]
    text: Sequence[Rule] = ()
    date: Sequence[Rule] = ()
    location: Sequence[Rule] = ()
    date_attributes: Sequence[str] = ()
    state_on_first_page_only: bool = False
    whole_block_text: bool = False
    rated: bool = True
    default_rating: float | None = None
    min_words: int = 5


# The selectors of the supported sites.
_DATE: list[Rule] = [(None, "class", "like", "date|time"), ("time", None, "any", "")]
_DIV_REVIEW: Rule = ("div", "class", "like", "review")

PROFILES = {
    "cesarine": Profile(
        platform="Cesarine",
        strategies=("json_ld", "state", "blocks"),
        blocks=[
            [(None, "class", "has", "ExperienceReview")],
            [(None, "class", "has", "ReviewCard")],
            [(None, "class", "has", "review-card")],
            [("div", "class", "has", "review")],
            [("div", "class", "has", "Review")],
            [("article", "class", "has", "review")],
            [(None, "class", "word", "review-item")],
            [(None, "data-testid", "is", "review")],
            [_DIV_REVIEW],
        ],
        name=[
            (None, "class", "like", "name|author|reviewer"),
            ("strong", None, "any", ""), ("h3", None, "any", ""), ("h4", None, "any", ""),
        ],
        date=_DATE,
        text=[(None, "class", "like", "text|body|content|comment"), ("p", None, "any", "")],
    ),
    "cesarine_rendered": Profile(
        platform="Cesarine",
        strategies=("state", "json_ld", "blocks"),
        blocks=[
            [(None, "class", "has", "ExperienceReview")],
            [(None, "class", "has", "ReviewCard")],
            [(None, "class", "has", "review-card")],
            [_DIV_REVIEW],
        ],
        name=[(None, "class", "like", "name|author"), ("strong", None, "any", "")],
        date=_DATE,
        text=[(None, "class", "like", "text|body|content|comment"), ("p", None, "any", "")],
    ),
    "tripadvisor": Profile(
        platform="TripAdvisor",
        strategies=("state", "blocks"),
        state_on_first_page_only=True,
        blocks=[
            [("div", "data-automation", "is", "reviewCard")],
            [(None, "data-reviewid", "set", "")],
            [("div", "class", "has", "review-container")],
            [("div", "class", "has", "reviewSelector")],
            [(None, "class", "word", "reviewSelector")],
        ],
        name=[
            (None, "class", "like", "memberOverlayLink|username|info_text"),
            (None, "class", "like", "name"),
        ],
        location=[(None, "class", "like", "location|hometown|userLocation")],
        date=[(None, "class", "like", "date|ratingDate|writtenDate"), ("time", None, "any", "")],
        date_attributes=("datetime", "title"),
        text=[
            (None, "class", "like", "reviewText|entry|partial_entry|review-content"),
            (None, "data-automation", "is", "reviewText"),
            ("q", None, "any", ""), ("p", None, "any", ""),
        ],
    ),
    "airbnb": Profile(
        platform="Airbnb",
        strategies=("state", "blocks"),
        blocks=[
            [(None, "data-testid", "is", "pdp-review-card")],
            [(None, "data-testid", "is", "review")],
            [_DIV_REVIEW],
        ],
        name=[
            (None, "class", "like", "name|author"),
            ("h3", None, "any", ""), ("strong", None, "any", ""),
        ],
        location=[(None, "class", "like", "location|city|hometown")],
        date=_DATE,
        text=[
            (None, "class", "like", "comment|text|body|review-content"),
            ("span", "class", "like", "comment"), ("p", None, "any", ""),
        ],
        rated=False,
        default_rating=5.0,
    ),
    "viator": Profile(
        platform="Viator",
        strategies=("blocks",),
        blocks=[
            [(None, "class", "has", "review-container")],
            [(None, "class", "has", "ReviewItem")],
            [_DIV_REVIEW],
        ],
        name=[(None, "class", "like", "name|author|reviewer")],
        date=_DATE,
        text=[(None, "class", "like", "text|comment|body|content"), ("p", None, "any", "")],
    ),
    "site": Profile(
        platform="Собственный сайт",
        strategies=("blocks",),
        blocks=[
            [
                (None, "class", "word", "testimonial"), (None, "class", "word", "review"),
                (None, "class", "word", "review-item"),
                (None, "class", "word", "testimonials-item"),
            ],
            [(None, "class", "like", "testimonial|review|comment")],
        ],
        name=[
            (None, "class", "like", "name|author"),
            ("cite", None, "any", ""), ("strong", None, "any", ""),
        ],
        whole_block_text=True,
        rated=False,
        min_words=10,
    ),
}
