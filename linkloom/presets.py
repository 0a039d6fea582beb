"""Ready-made sources: the URL policies and page handlers that come with the engine.

Each takes a source name; hosts and seed links are tables of the user's own.
"""

from __future__ import annotations

from linkloom.operators import extract as X
from linkloom.registry import Handler, Source


def _everything(title_policy: str) -> tuple[Handler, ...]:
    return (Handler("parse_everything", ((r".*", None),), X.page_extractor(title_policy)),)


def www_site(name: str) -> Source:
    """Hosts get their www; HTML pages only; a page needs a title."""
    return Source(name, "add", html_only=True, handlers=_everything("fail"))


def bare_site(name: str) -> Source:
    """Hosts lose their www and must be declared bare; HTML pages only."""
    return Source(name, "strip", html_only=True, require_host=True, handlers=_everything("default"))


def listed_site(name: str) -> Source:
    """Hosts take whichever form is declared; HTML pages only."""
    return Source(name, "listed", html_only=True, require_host=True, handlers=_everything("default"))


def plain_site(name: str) -> Source:
    """Hosts stay as they are; HTML pages only; a page needs a title."""
    return Source(name, "keep", html_only=True, handlers=_everything("fail"))


def event_calendar(name: str, by_name: bool = False) -> Source:
    """Dated event pages and the calendar pages that list them.

    The event handler is tried first. ``by_name`` tries handlers A to Z, where the wider calendar
    pattern takes event pages as well.
    """
    source = Source(
        name,
        handlers=(
            Handler("parse_events", ((X.EVENT_PATTERN, None),), X.event_extractor()),
            Handler("parse_calendar", ((X.EVENT_LIST_PATTERN, None),), X.links_extractor(*X.EVENT_LIST_REGION)),
        ),
    )
    return source.in_name_order() if by_name else source


def talk_calendar(name: str) -> Source:
    """Numbered talk pages and month pages; URLs lose their query."""
    return Source(
        name,
        drop_query=True,
        handlers=(
            Handler("parse_events", ((X.TALK_PATTERN, None),), X.talk_extractor()),
            Handler("parse_calendar_page", ((X.TALK_LIST_PATTERN, None),), X.links_extractor()),
        ),
    )
