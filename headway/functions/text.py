"""Expressions over names, titles and records of loose text. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = r"[^\p{L}\p{N}]+"
#: Names that go on after " - " although the next word has a capital: the first part, and a pattern of the whole second one.
PAIRS = (("Покровское", "Глебово"), ("Покровское", "Стрешнево"), ("Свято", "Данилов.*"))
#: Words of titles that name a street.
STREETS = ("улица", "переулок", "проезд", "проспект", "шоссе", "тупик", "набережная", "бульвар", "аллея")
#: Classes of roads that count as major; the placeholder for a place without a name.
MAJOR, NAMELESS = ("motorway", "trunk", "primary"), "Без названия"


def normalised(name: Column) -> Column:
    """A name for comparison: lower case, ё as е, letters and digits only; null as empty."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), "ё", "е"), _OTHER, "")


def slug(name: Column) -> Column:
    """Letters and digits in lower case, with a hyphen for each run of others inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), _OTHER, "-"), "^-|-$", "")


def shortened(name: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis if some are left out."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)


def listed(text: Column) -> Column:
    """The parts of a text between commas and semicolons, trimmed; empty ones and those of null are none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def numbers(text: Column) -> Column:
    """The parts that are digits only, as numbers; too long ones are none."""
    return F.filter(F.transform(listed(text), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))), lambda x: x.isNotNull())


def stop_names(track: Column, pairs: tuple[tuple[str, str], ...] = PAIRS) -> Column:
    """The stops of a line as it is described, split at hyphens with blanks around.

    A part that starts in lower case, or follows the first name of a pair and is wholly what the second describes, goes on the name before it; a name equal to the
    one before is left out. Null has none.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(track, F.lit("")), r"\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def step(names: Column, part: Column) -> Column:
        last = F.element_at(names, -1)
        goes_on = part.rlike(r"^\p{Ll}")
        for first, second in pairs:
            goes_on = goes_on | ((last == first) & part.rlike(f"^(?:{second})$"))
        joined = F.concat(F.slice(names, F.lit(1), F.size(names) - 1), F.array(F.concat_ws(" - ", last, part)))
        return F.when(F.size(names) == 0, F.array(part)).when(goes_on, joined).when(last == part, names).otherwise(F.concat(names, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def without_words(title: Column, words: tuple[str, ...] = STREETS) -> Column:
    """Whether a title, in lower case, has none of the words; null has none."""
    return ~F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(words))


def mentions(word: str, *fields: Column) -> Column:
    """Whether the fields, texts or arrays of texts, contain a word in any case; nulls are empty."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(word))


def is_place(name: Column, lat: Column, lon: Column) -> Column:
    """Whether a place has a name of its own and coordinates."""
    return F.coalesce((F.trim(name) != "") & (F.trim(name) != NAMELESS), F.lit(False)) & lat.isNotNull() & lon.isNotNull()


def label(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, by a small table; the code itself if it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)


def road_kind(highway: Column) -> Column:
    return F.when(highway.isin(*MAJOR), "major").otherwise("repair")


def in_years(when: Column, years: tuple[str, ...]) -> Column:
    """Whether a date as text starts with one of the years; null doesn't."""
    return F.coalesce(F.substring(when, 1, 4).isin(*years), F.lit(False))


def event_key(ids: list[Column], when: Column, lat: Column, lon: Column) -> Column:
    """The first id that isn't null or empty, else a key of time and place."""
    known = [F.nullif(x.cast("string"), F.lit("")) for x in ids]
    return F.coalesce(*known, F.format_string("%s|%.5f|%.5f", F.coalesce(when, F.lit("")), lat, lon))


def is_open_date(text: Column, first: str) -> Column:
    """Whether a text is an ISO date, not before ``first``."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (text >= first), F.lit(False))


def date_hour(day: Column, hour: Column) -> Column:
    """``yyyy-MM-dd HH:00:00``."""
    return F.format_string("%s %02d:00:00", day.cast("string"), hour)
