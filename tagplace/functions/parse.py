"""Text grammars of the inputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_trim(s: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def csv_fields(line: Column) -> Column:
    """Fields of one strict CSV line; an empty array if the line does not parse.

    A quoted field holds anything but quotes, a bare one no quote or comma; no doubled quotes.
    """
    field = r'(?:"[^"]*"|[^",]*)'
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*"|[^",]*)'), F.lit(1))
    bare = F.transform(cells, lambda c: F.when(c.startswith('"'), F.substring(c, 2, F.length(c) - 2)).otherwise(c))
    return F.when(line.rlike(rf"^{field}(?:,{field})*\z"), bare).otherwise(F.array().cast("array<string>"))


def tag_list(text: Column) -> Column:
    """``{a,b}`` as an array; white space is dropped everywhere, ``{}`` is one empty tag, bad text no tag."""
    t = F.regexp_replace(text, r"\s+", "")
    return F.when(t.rlike(r"^\{[^{}]*\}\z"), F.split(F.substring(t, 2, F.length(t) - 2), ",")).otherwise(F.array().cast("array<string>"))


def strip_braces_split(s: Column) -> Column:
    """Braces off both ends, split at commas; white space stays."""
    return F.split(F.btrim(s, F.lit("{}")), ",")


def epoch_to_timestamp(s: Column) -> Column:
    return F.timestamp_seconds(s.try_cast("bigint"))


def parse_date(s: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; further text is ignored, a bad date is null."""
    return F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def media_key(s: Column) -> Column:
    """The number before the first underscore, or null."""
    return F.split_part(s, F.lit("_"), F.lit(1)).try_cast("bigint")


def _without_empty_end(parts: Column) -> Column:
    """Trailing empty strings dropped."""
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(parts, 1, last)


def request_terms(text: Column) -> Column:
    """Lower-cased terms between plus signs and commas."""
    return _without_empty_end(F.split(F.lower(text), "[+,]"))


def query_terms(text: Column) -> Column:
    """Free text split at runs of non-word characters."""
    return F.split(text, r"\W+")


def safe_access(value: Column, default, *path: str) -> Column:
    """A nested field, or the default where any step is null."""
    for p in path:
        value = value.getField(p)
    return F.coalesce(value, F.lit(default))


def xml_escape(s: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(escaped))
    return s


def kml_color(key: Column) -> Column:
    """An opaque colour that depends on the key only."""
    return F.concat(F.lit("ff"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 6))


def ring_text(ring: Column) -> Column:
    """``lon,lat,0.0`` lines of an array of (lat, lon), the first point again at the end."""
    line = lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(",0.0\n"))
    return F.concat(F.array_join(F.transform(ring, line), ""), line(F.element_at(ring, 1)))
