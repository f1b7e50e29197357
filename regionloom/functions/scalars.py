"""Scalar column expressions: null rules, names, identifiers, text, numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARKS = ("", "NA", "-99")


def meaningful(c: Column) -> Column:
    """Layer property: trimmed, with '', 'NA' and '-99' as null."""
    t = F.trim(c.cast("string"))
    return F.when(t.isin(*NULL_MARKS), None).otherwise(t)


def not_blank(c: Column) -> Column:
    """Table cell: trimmed, blank as null; 'NA' and '-99' are values."""
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def first_meaningful(columns: Sequence[Column]) -> Column:
    """Identifier: the first column with a meaningful value."""
    return F.coalesce(*map(meaningful, columns))


def with_note(name: Column, note: Column) -> Column:
    """'name — note' where both exist, else the name."""
    return F.when(name.isNotNull() & note.isNotNull(), F.concat(name, F.lit(" — "), note)).otherwise(name)


def parent_name(parent: Column, name: Column) -> Column:
    """A parent's name, kept only with a parent."""
    return F.when(parent.isNotNull(), name)


def language_column(pattern: str, tag: str) -> str:
    """Column of a language tag: {lang} filled in, traditional Chinese tags as zht."""
    low = tag.lower()
    code = "zht" if low.split("-")[0] == "zh" and any(x in low.split("-")[1:] for x in ("hant", "tw", "hk", "mo")) else low.replace("-", "_")
    return pattern.replace("{lang}", code)


def language_map(names: Mapping[str, Column]) -> Column:
    """tag -> name, nulls left out."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(meaningful, names.values())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def wikidata_id(c: Column) -> Column:
    """'Q123' of ' q123 ', else null."""
    digits = F.regexp_extract(F.trim(c), r"^[Qq]([1-9][0-9]*)$", 1)
    return F.when(digits != "", F.concat(F.lit("Q"), digits))


def csv_cell(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\n\r]'), quoted).otherwise(c)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title_name(c: Column) -> Column:
    """A name fit for a page title: reserved characters become '-', blanks are squeezed."""
    c = F.regexp_replace(F.translate(c, "#<>[]|{}/:\\", "-" * 11), r"[_\x00-\x1F\x7F]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """A template with every {key} replaced; null if a brace is left or a value is null."""
    out = F.lit(template)
    for key, value in values.items():
        if "{" + key + "}" in template:
            out = F.replace(out, F.lit("{" + key + "}"), value)
    return F.when(~out.rlike(r"[{}]"), out)


def sha1_hex(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def cache_key(parts: Sequence[Column]) -> Column:
    """SHA-1 of the parts joined by U+001F; a null part is U+0001, so leaving a part out gives another key."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("\x01")) for p in parts)).cast("binary"))


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def sql_name(c: Column) -> Column:
    """A SQL identifier: other characters become '_', a leading digit gets 'c_'."""
    t = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("c_"), t)).otherwise(t)


def without_disambiguation(c: Column) -> Column:
    """'X' of 'X (y)', else null."""
    t = F.regexp_extract(c, r"^(.*\S) \(.*\)$", 1)
    return F.when(t != "", t)


def fixed(c: Column, precision: int) -> Column:
    """Fixed-point text without trailing zeros; '-0' becomes '0'."""
    t = F.format_string(f"%.{precision}f", c)
    if precision:
        t = F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")
    return F.when(t == "-0", "0").otherwise(t)


def number_text(c: Column, digits: int = 9) -> Column:
    """A value rounded and written as plainly as possible: 40, not 40.0."""
    return fixed(F.round(c, digits), digits)


def text_width(c: Column, size: float) -> Column:
    """Estimated width: CJK characters are one em, all others 0.56."""
    wide = F.length(c) - F.length(F.regexp_replace(c, r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-｠]", ""))
    return (wide * F.lit(1.0) + (F.length(c) - wide) * F.lit(0.56)) * F.lit(float(size))


#: Words that carry no meaning in a blank map's file name.
STOP_WORDS = ("blank", "map", "maps", "blankmap", "svg", "the", "of", "for", "with", "and", "file", "a")


def name_key(c: Column) -> Column:
    """Sorted word tokens of a file name without extension and stop words."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\.[^.]+$", ""), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))), " ")


def clean_markup(c: Column) -> Column:
    """Text without tags, entities decoded, blanks squeezed, none before punctuation."""
    t = xml_unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "))
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r" +([,.;:!?])", "$1")


def page_title(c: Column) -> Column:
    """Underscores are blanks and the first letter is a capital."""
    t = F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), " +", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))


def strict_double(c: Column) -> Column:
    """A plain decimal number as double, else null (no suffixes, no hex; inf and nan by name)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)inf(inity)?|(?i)nan)$"), t.try_cast("double"))


def wrap_longitude(c: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(c + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def canonical_antimeridian(c: Column) -> Column:
    """+180 as -180."""
    return F.when(c == 180.0, F.lit(-180.0)).otherwise(c)
