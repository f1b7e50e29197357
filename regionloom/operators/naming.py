"""Names that must not repeat, and areas named in titles and descriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_markup


def unique_ids(rows: DataFrame, raw: str, order: str) -> DataFrame:
    """`rows` (with distinct `order`) plus xml_id: plain characters, 'id-' before a digit, and for each row in order the first
    of id, id-2, id-3, ... that no earlier row has.

    Only ids of one stem (the id without numbers at its end) can meet, so stems are dealt out, sorted, and streamed; of a
    stem just the ids that are taken are held. A null is an empty text.
    """
    plain = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\p{L}\p{N}_.-]", "_")
    plain = F.when(plain.rlike(r"^[\p{L}_]"), plain).otherwise(F.concat(F.lit("id-"), plain))
    named = rows.select(F.col(order).alias("_order"), plain.alias("_plain")).withColumn("_stem", F.regexp_replace("_plain", r"(-[0-9]+)+$", ""))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem, used, following = None, set(), {}
        for b in batches:
            ids = []
            for s, p in zip(b["_stem"], b["_plain"]):
                if s != stem:
                    stem, used, following = s, set(), {}
                n = following.get(p, 1)
                while (name := p if n == 1 else f"{p}-{n}") in used:
                    n += 1
                used.add(name)
                following[p] = n + 1
                ids.append(name)
            yield pd.DataFrame({"_order": b["_order"], "xml_id": ids})

    kind = rows.schema[order].dataType.simpleString()
    out = named.repartition("_stem").sortWithinPartitions("_stem", "_order").mapInPandas(number, f"_order {kind}, xml_id string")
    return rows.join(out, rows[order] == out["_order"]).drop("_order")


#: Words that join a map and its area, words after "maps by" that list maps instead of naming an area, wide
#: areas, former states that are wide too, and marks of a map's kind in brackets.
JOINING = ("of", "for", "in", "showing", "covering", "around")
LISTING = ("country", "region", "continent", "type")
AREAS = (
    "world", "africa", "antarctica", "asia", "europe", "oceania", "north america", "south america", "central america", "caribbean",
    "middle east", "arab world", "afro-eurasia", "eurasia", "united states", "united kingdom", "new zealand", "south korea", "north korea",
    "czech republic", "state of palestine", "honduras", "ethiopia", "philippines", "kazakhstan", "kyrgyzstan", "australia", "austria",
    "belgium", "burkina faso", "canada", "china", "colombia", "ecuador", "france", "germany", "haiti", "india", "israel", "italy", "japan",
    "mexico", "montenegro", "pakistan", "poland", "portugal", "romania", "slovakia", "spain", "switzerland", "ukraine", "uruguay",
)
FORMER = ("soviet union", "russian empire", "ottoman empire", "holy roman empire", "austro-hungarian empire", "yugoslavia", "kingdom of hungary", "kingdom of italy")
KINDS = ("map", "grid", "rivers", "relief", "zoom", "marker", "claimed", "disputed", "de-facto", "semi-secession", "natural", "blue marble", "orthographic", "mini", "scheme", "plus ", "pop areas", "special", "view", "w3")

_END_BRACKET = r"\s*\([^)]*\)\s*$"


def _bare(text: Column) -> Column:
    """Without bracketed words at the end and without punctuation around."""
    return F.btrim(F.regexp_replace(text, r"(\s*\([^)]*\)\s*)+$", ""), F.lit(" .,:"))


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once a row, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _joined(words: Sequence[str]) -> str:
    return "|".join(words)


def area_of_category(category: Column) -> Column:
    """The area that a map category names: what follows the first 'map(s)' and a joining word; '' for lists of maps."""
    label = F.regexp_replace(category, "^Category:", "")
    named = F.regexp_extract(label, rf"(?i)\bmaps?\s+(?:{_joined(JOINING)})\s+(.+)", 1)
    return F.when(label.rlike(rf"(?i)\bmaps?\s+by\s+(?:{_joined(LISTING)})\b"), "").otherwise(_bare(named))


def known_area(text: Column, known: Sequence[str] = AREAS) -> Column:
    """The first of the known areas, in their order, whose words stand in the text one after another; else ''."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    plain = [(n, f" {' '.join(n.lower().replace('-', ' ').split())} ") for n in known]
    names = F.array(*(F.struct(F.lit(n.title()).alias("name"), F.lit(p).alias("words")) for n, p in plain))
    found = _given(padded, lambda text: F.get(F.filter(names, lambda a: F.contains(text, a["words"])), F.lit(0))["name"])
    return F.coalesce(found, F.lit(""))


def described_area(text: Column, known: Sequence[str] = AREAS) -> Column:
    """The area in a description up to the first full stop or semicolon after it: behind 'map(s)' and a joining word, else behind
    'map' and a dash, underscore or colon; else the first known area in the text; else ''.
    """
    return _given(clean_markup(text), lambda clean: _area_in(clean, known))


def _area_in(clean: Column, known: Sequence[str]) -> Column:
    joined = F.regexp_extract(clean, rf"(?i)\bmaps?\s+(?:{_joined(JOINING[:5])})\s+(.+?)(?:[.;]|$)", 1)
    dashed = F.regexp_extract(clean, r"(?i)\bmap\s*[-_:]+\s*([A-Za-z].+?)(?:[.;]|$)", 1)
    named = _bare(_given(joined, lambda j: F.when(j != "", j).otherwise(dashed)))
    return F.coalesce(_given(named, lambda n: F.when(n != "", n).otherwise(known_area(clean, known))), F.lit(""))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "^the ", "")


def is_wide(text: Column, extra: Sequence[str] = ()) -> Column:
    return _normal(text).isin(*AREAS, *FORMER, *(e.lower().removeprefix("the ") for e in extra))


def broad_area(text: Column, extra: Sequence[str] = ()) -> Column:
    """The text if it names a wide area, without brackets and years; else what follows its first 'of' or 'in', if that does; else ''."""
    value = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _END_BRACKET, ""))
    value = F.regexp_replace(value, "^[0-9]{3,4}[–-][0-9]{3,4}\\s+", "")
    after = lambda v: F.btrim(F.regexp_extract(v, r"(?i)\b(?:of|in)\s+(.+)$", 1))
    wide = lambda v, a: F.when(is_wide(v, extra), v).when(is_wide(a, extra), a).otherwise("")
    return _given(value, lambda v: _given(after(v), lambda a: wide(v, a)))


def title_area(title: Column, base: Column, extra: Sequence[str] = ()) -> Column:
    """'Subject, region, wider area' of a file name like 'Subject in Region.svg' or 'Subject on the globe.svg'; else ''."""
    stem = F.btrim(F.translate(F.regexp_replace(title, r"(?i)\.(?:svgz?|png|gif|jpe?g)$", ""), "_", " "))
    return _given(stem, lambda s: _given(broad_area(base, extra), lambda wide: _area_of_stem(s, wide, extra)))


def _area_of_stem(stem: Column, wide: Column, extra: Sequence[str]) -> Column:
    globe = F.btrim(F.regexp_extract(stem, r"(?i)^(.+?)\s+on\s+the\s+globe\b", 1), F.lit(" ,"))
    around = F.when(wide != "", wide).otherwise(sorted(extra, key=str.casefold)[0] if extra else "")
    on_globe = F.when((around == "") | (F.lower(globe) == F.lower(around)), globe).otherwise(F.concat(globe, F.lit(", "), around))

    split = r"(?i)^(.+?)\s+in\s+(.+)$"
    subject = F.regexp_replace(F.btrim(F.regexp_extract(stem, split, 1)), r"(?i)^(?:(?:blank|outline|political|administrative|physical|historical)\s+)?(?:(?:locator|location)\s+)?map\s+of\s+", "")
    subject = F.btrim(subject, F.lit(" ,"))
    region = F.regexp_replace(F.btrim(F.regexp_extract(stem, split, 2)), r"\s+[-–]\s*[0-9]{4}$", "")
    kind = rf"(?:[^()]*(?:{_joined(KINDS)})[^()]*|\s*(?:us[0-9]+|w[0-9]+|[a-z]{{2,4}})\s*)"
    region = F.btrim(F.regexp_replace(region, rf"(?i)(?:\s*\({kind}\)\s*)+$", ""), F.lit(" ,.;"))
    region = F.when(region.rlike(r"(?i)^(?:ca\.?\s*)?[0-9]{3,4}(?:\s*(?:bc|ad|bce|ce))?$"), "").otherwise(region)
    inside = _given(subject, lambda s: _given(region, lambda r: _area_in_region(s, r, wide)))
    return F.coalesce(F.when(~stem.rlike(split), on_globe).otherwise(inside), F.lit(""))


def _area_in_region(subject: Column, region: Column, wide: Column) -> Column:
    within = F.regexp_extract(region, r"^(.+?)\s+\(([^()]+)\)$", 2)
    explicit = _given(F.btrim(within), lambda w: F.when((w != "") & is_wide(w), w).otherwise(""))
    return _given(explicit, lambda e: _given(_region_beside(region, e, wide), lambda r: _joined_area(subject, r, e, wide)))


def _region_beside(region: Column, explicit: Column, wide: Column) -> Column:
    region = F.when(explicit != "", F.btrim(F.regexp_extract(region, r"^(.+?)\s+\(([^()]+)\)$", 1))).otherwise(region)
    return _given(region, lambda r: F.when((r == "") | r.rlike(r"(?i)^(?:its|their|this)\s+(?:region|location)$"), wide).otherwise(r))


def _joined_area(subject: Column, region: Column, explicit: Column, wide: Column) -> Column:
    parent = F.when(explicit != "", explicit).otherwise(wide)
    both = F.concat(subject, F.lit(", "), region)
    more = (parent != "") & ~F.contains(F.lower(F.concat(subject, F.lit(" "), region)), _normal(parent)) & ~F.lower(region).isin(*AREAS, *FORMER)
    inside = F.when(region == "", "").when(F.lower(subject) == F.lower(region), region).when(more, F.concat(both, F.lit(", "), parent)).otherwise(both)
    unnamed = (subject == "") | subject.rlike(r"(?i)\b(?:maps?|blank|locator|location)\b")
    return F.when(unnamed, "").otherwise(inside)


def file_name(*parts: str) -> Column:
    """Parts joined by a blank, as a safe file name."""
    return F.regexp_replace(F.concat_ws(" ", *parts), r"[^A-Za-z0-9._-]", "_")


UNCLEAR = "Unclear from title/categories"
MOST = 420  # characters of a description

#: What a map's description says by its kind, {0} being its area.
LOCATES = "Locator map for {0}; shows the named area within a wider region."
KINDS_SAID = (
    (r"topograph|physical|relief|terrain|elevation", "Physical or topographic blank map of {0}; see the source categories for detail."),
    (r"historic|historical|century|\b(?:1[5-9]|20)\d{2}\b", "Historical blank map of {0}; see the title and source categories for its period and scope."),
    (r"political|administrative|\b(?:region|province|department|county|district|state)\b", "Political or administrative blank map of {0}; see source categories for boundary detail."),
    ("", "Outline map of {0}, intended for adding labels or data; see categories for its scope."),
)
TEMPLATE = "Generic locator template; it does not identify a fixed geographic region or country boundaries."


def _said(text: str, area: Column) -> Column:
    before, after = text.split("{0}")
    return F.concat(F.lit(before), area, F.lit(after))


def short_description(title: Column, area: Column, description: Column, locator: Column) -> Column:
    """At most 420 characters on a map: its own description, cut where it speaks of tools or at a blank; locator maps and maps
    without a description get a sentence by their kind. `locator`: do its categories say that it is a locator map?
    """
    stem = F.btrim(F.regexp_replace(F.translate(F.regexp_replace(title, r"(?i)\.svgz?$", ""), "_", " "), "-+", " "))
    locates = F.coalesce(locator, F.lit(False)) | stem.rlike(r"(?i)location\s+map|locator\s+map")
    own = clean_markup(F.coalesce(description, F.lit("")))
    made = own.rlike(r"(?i)^Locator map for .*; shows the named area within a wider region\.$|processed using|qgis atlas|generated using|\bsee filename|\bxy\b")
    head = F.btrim(F.regexp_extract(own, r"(?i)^(.*?)\b(?:processed using|generated using|based on)\b", 1), F.lit(" ,;."))
    cut = F.substring(own, 1, MOST - 3)
    short = F.concat(F.coalesce(F.nullif(F.btrim(F.regexp_extract(cut, "(?s)^(.*) [^ ]*$", 1)), F.lit("")), F.btrim(cut)), F.lit("..."))
    given = F.when(locates & made, _said(LOCATES, area)).when(F.length(own) <= MOST, own).when((head != "") & (F.length(head) <= MOST), head).otherwise(short)
    kind = F.when(locates, _said(LOCATES, area))
    for pattern, text in KINDS_SAID:
        kind = kind.when(stem.rlike(f"(?i){pattern}") if pattern else F.lit(True), _said(text, area))
    untold = F.concat(F.lit("Blank-map file titled \u201c"), stem, F.lit("\u201d; its coverage is unclear from Commons metadata."))
    found = F.when(own != "", given).when(area != UNCLEAR, kind).otherwise(untold)
    return F.when(F.lower(title) == "blank map.svg", TEMPLATE).otherwise(found)


#: Other names of data sets.
ALIASES = {"countries": "ne-admin0", "country": "ne-admin0", "world": "ne-admin0", "subdivisions": "ne-admin1", "states": "ne-admin1", "provinces": "ne-admin1", "admin1": "ne-admin1", "countries and subdivisions": "mixed"}


def dataset_name(text: Column) -> Column:
    """A data set's own name."""
    name = F.lower(F.trim(text))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[name], name)


def credit_of_year(credit: Column, year: Column) -> Column:
    """A credit with the year of the boundaries, or either alone; null without both."""
    return F.when(credit.isNotNull() & year.isNotNull(), F.concat(credit, F.lit("; boundaries as of "), year)).when(year.isNotNull(), F.concat(F.lit("Boundaries as of "), year)).otherwise(credit)


def template_variables(jobs: DataFrame, countries: DataFrame, level: str = "", year: str | None = None) -> DataFrame:
    """`jobs` (stem, code, sidecar_level, sidecar_year, credit, ...) plus vars: code (the stem without one), name (of the country
    (id, name) with that code, else the code), level and year (the run's own year before the sidecar's), stem and data.
    """
    coded = jobs.withColumn("_code", F.coalesce("code", "stem"))
    names = countries.groupBy(F.col("id").alias("_code")).agg(F.min("name").alias("_name"))
    value = {
        "code": F.col("_code"), "name": F.coalesce("_name", "_code"), "level": F.coalesce("sidecar_level", F.lit(level)),
        "year": F.coalesce(F.lit(year).cast("string"), "sidecar_year", F.lit("")), "stem": F.col("stem"), "data": F.coalesce("credit", F.lit("")),
    }
    out = coded.join(names, "_code", "left").withColumn("vars", F.create_map(*(x for k, v in value.items() for x in (F.lit(k), v))))
    return out.drop("_code", "_name")
