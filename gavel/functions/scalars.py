"""Scalar functions over columns, all of them built from Spark's own expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status codes of the state feed.
STATUS_BY_CODE = {1: "Introduced", 2: "Engrossed", 3: "Enrolled", 4: "Passed", 5: "Vetoed", 6: "Failed"}
#: Month names that scraped dates use.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
ELLIPSIS = "…"


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_filled(*choices: Column, default: str | None = None) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in choices], F.lit(default))


def value_or_missing(values: Column, key: str, default: Column) -> Column:
    """``values[key]``, and the default only if the key is absent: a present null stays null."""
    return F.when(F.map_contains_key(values, key), values[key]).otherwise(default)


def lenient_date(c: Column) -> Column:
    """A date of year, month and day in digits, with or without leading zeros; null for anything else."""
    shaped = F.when(c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), c)
    return F.try_to_date(shaped, "y-M-d")


def written_date(c: Column) -> Column:
    """The date as written in an ISO-8601 date or timestamp, without a shift to UTC; null if malformed."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.rlike(iso), F.left(c, F.lit(10))).try_cast("date")


def month_name_date(c: Column) -> Column:
    """The first date like ``Mar 5, 2026`` in a text; null if there is none or it doesn't exist."""
    written = F.regexp_extract(c, rf"(?:{MONTHS})\s+[0-9]{{1,2}},\s+[0-9]{{4}}", 0)
    return F.try_to_date(filled(F.regexp_replace(written, r"\s+", " ")), "MMM d, yyyy")


def seen_timestamp(c: Column) -> Column:
    """A timestamp like ``20260305T120000Z``; null if malformed."""
    return F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def seen_date(c: Column, run_at: Column) -> Column:
    return F.to_date(F.coalesce(seen_timestamp(c), run_at))


def lookup(key: Column, values: Mapping, default: Column) -> Column:
    """The mapped value of a key, else the default."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def status_name(code: Column, listed: Column | None = None) -> Column:
    """Name of a status code, else what the listing says, else ``Introduced``."""
    return lookup(code, STATUS_BY_CODE, F.coalesce(listed.cast("string") if listed is not None else F.lit(None).cast("string"), F.lit("Introduced")))


def chamber(bill_number: Column) -> Column:
    return F.when(F.upper(bill_number).startswith("S"), "Senate").otherwise("House")


def shortened(c: Column, most: int) -> Column:
    """The text, or for a longer one its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 1)), F.lit(ELLIPSIS)))


def prefix(c: Column, most: int) -> Column:
    return F.left(c, F.lit(most))


def agenda_session(c: Column) -> Column:
    """The year of an agenda date; ``current`` for a null or empty one."""
    return first_filled(F.left(c, F.lit(4)), default="current")


def year_session(d: Column) -> Column:
    return F.coalesce(F.year(d).cast("string"), F.lit("current"))


def parts(c: Column, separator: str) -> Column:
    """Trimmed parts between separators, without empty ones; no part for a null."""
    cut = F.split(F.coalesce(c, F.lit("")), rf"\Q{separator}\E")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def merged(left: Column, right: Column) -> Column:
    """Map of both, the right one's values winning; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def json_map(c: Column) -> Column:
    """A flat JSON object as a map of texts: has-key and get work on it."""
    return F.from_json(c, "map<string,string>")


def tagged_names(text: Column, names: Sequence[str]) -> Column:
    """The names that stand in the text as whole words, case ignored, in the order of the list."""
    body = F.coalesce(text, F.lit(""))
    edge = r"[\p{L}\p{N}_]"
    found = [F.when(body.rlike(rf"(?iu)(?<!{edge})\Q{name}\E(?!{edge})"), name) for name in names]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def geo_scope(text: Column, counties: Sequence[str], cities: Sequence[str], default_type: str, default_names: Sequence[str]) -> Column:
    """Struct of scope type and names: any county wins over any city, which wins over the default."""
    county, city = tagged_names(text, counties), tagged_names(text, cities)
    scope = lambda kind, names: F.struct(F.lit(kind).alias("scope_type"), names.alias("scope_names"))
    default = F.array(*[F.lit(x) for x in default_names])
    return F.when(F.size(county) > 0, scope("county", county)).when(F.size(city) > 0, scope("city", city)).otherwise(scope(default_type, default))


def as_multipolygon(kind: Column, coordinates: Column) -> Column:
    """Coordinates of a geometry (JSON text) as those of a MultiPolygon."""
    polygon = "array<array<array<double>>>"
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, polygon))).otherwise(F.from_json(coordinates, f"array<{polygon}>"))


def shade(n: Column) -> Column:
    """Map shading: none, one, two or three, four and more."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def default_jurisdiction(country: Column, region: Column, city: Column, home: tuple[str, str], cities: Sequence[str], state: str) -> Column:
    """The city if it is one of ours (case ignored), else the state; null outside of it."""
    ours = lookup(F.lower(city), {c.lower(): c for c in cities}, F.lit(state))
    return F.when((country == home[0]) & (region == home[1]), ours)


def client_address(real: Column, forwarded: Column) -> Column:
    """The first header, else the first of the forwarded list."""
    return F.coalesce(filled(real), F.trim(F.get(F.split(filled(forwarded), ","), F.lit(0))))


def without_demo_mark(c: Column) -> Column:
    """The text without its first `` (DEMO)``."""
    return F.regexp_replace(c, r"^([\s\S]*?) \(DEMO\)", "$1")


def sponsor_line(sponsors: Column) -> Column:
    """Names of (name, relationship_type) structs, joined, co-sponsors marked."""
    return F.array_join(
        F.transform(sponsors, lambda s: F.when(s["relationship_type"] == "co_sponsor", F.concat(s["name"], F.lit(" (co-sponsor)"))).otherwise(s["name"])), ", "
    )


def like_pattern(q: str) -> str:
    """The user's text as a LIKE pattern that both engines read alike: ``%`` and ``_`` stay live,
    a backslash before anything but ``%``, ``_`` or itself goes."""
    out, n = [], 0
    while n < len(q):
        if q[n] != "\\":
            out.append(q[n])
        elif n + 1 < len(q):
            n += 1
            out.append("\\" + q[n] if q[n] in "%_\\" else q[n])
        else:
            out.append("\\\\")
        n += 1
    return "%" + "".join(out) + "%"


def page_number(offset: Column, size: int) -> Column:
    return F.floor(offset / size) + 1


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.ceil(total / size), F.lit(1))


def page_links(offset: Column, total: Column, size: int) -> Column:
    """Struct of whether a page has one before it and one after it."""
    return F.struct((offset > 0).alias("has_previous"), (offset + size < total).alias("has_next"))


def displayed(c: Column, default: str) -> Column:
    """The text that a page shows, the default for a null or empty one."""
    return first_filled(c, default=default)


def displayed_date(c: Column, default: str) -> Column:
    return F.coalesce(F.date_format(c, "MMM d, yyyy"), F.lit(default))


def natural_id(*columns: Column) -> Column:
    """An id from the natural key: the same on every run."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns]), 256)
