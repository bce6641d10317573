"""Named row rules and predicates built from optional bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
ALNUM_PATTERN = r"^[\p{L}\p{N}]+$"
USERNAME_LENGTH = (3, 15)
PLAYLIST_TITLE_LENGTH = (1, 99)
TRACK_TITLE_LENGTH = (1, 255)
BITRATES = (128, 192, 320)
PAGE_SIZE = (1, 100)
COUNTED_SHARE = 0.5


def length_between(text: Column, bounds: tuple[int, int]) -> Column:
    return F.char_length(text).between(*bounds)


def valid_email(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN)


def valid_username_length(text: Column) -> Column:
    return length_between(text, USERNAME_LENGTH)


def alphanumeric(text: Column) -> Column:
    return text.rlike(ALNUM_PATTERN)


def valid_playlist_title(text: Column) -> Column:
    return length_between(text, PLAYLIST_TITLE_LENGTH)


def valid_track_title(text: Column) -> Column:
    return length_between(text, TRACK_TITLE_LENGTH)


def valid_bitrate(rate: Column) -> Column:
    return rate.isin(*BITRATES)


def positive(value: Column) -> Column:
    return value > 0


def offset_inside(offset: Column, largest: Column) -> Column:
    return (offset >= 0) & (offset <= largest)


def counts_as_listen(sent: Column, total: Column) -> Column:
    """At least half of the track was sent; exactly half counts."""
    return sent >= total * COUNTED_SHARE


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule that is null counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )


# -- predicates from optional bounds ---------------------------------------------------


def every(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def time_range(ts: str, start=None, end=None) -> Column:
    """Half-open [start, end); a missing bound is open. Compares the raw column."""
    parts = []
    if start is not None:
        parts.append(F.col(ts) >= F.lit(start))
    if end is not None:
        parts.append(F.col(ts) < F.lit(end))
    return every(parts)


def closed_range(column: str, low=None, high=None) -> Column:
    """Inclusive bounds, either optional."""
    parts = []
    if low is not None:
        parts.append(F.col(column) >= F.lit(low))
    if high is not None:
        parts.append(F.col(column) <= F.lit(high))
    return every(parts)


def term(column: str, value: bool | None) -> Column:
    """Equality only when a value is given."""
    return F.lit(True) if value is None else F.col(column) == F.lit(value)


def any_of(values: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]))


def visible(is_public: Column, owner: Column, requester: Column) -> Column:
    return F.coalesce(is_public, F.lit(False)) | owner.eqNullSafe(requester)


# -- argument guards -------------------------------------------------------------------


def check_page(page: int, page_size: int) -> None:
    if page < 1:
        raise ValueError(f"page must be at least 1, got {page}")
    if not PAGE_SIZE[0] <= page_size <= PAGE_SIZE[1]:
        raise ValueError(f"page size must be within {PAGE_SIZE}, got {page_size}")


def check_limit(limit: int, offset: int = 0) -> None:
    if not PAGE_SIZE[0] <= limit <= PAGE_SIZE[1]:
        raise ValueError(f"limit must be within {PAGE_SIZE}, got {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, got {offset}")


def check_any_filter(**filters) -> None:
    if all(f is None or f == "" or f == [] for f in filters.values()):
        raise ValueError("at least one search filter is needed")
