"""Names and three-letter codes of languages from codes, names and locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of ISO 639: name, two letters, three letters, and the older three letters where they differ.
LANGUAGES = (
    ("Arabic", "ar", "ara", ""), ("Bengali", "bn", "ben", ""), ("Bulgarian", "bg", "bul", ""), ("Catalan", "ca", "cat", ""), ("Chinese", "zh", "zho", "chi"),
    ("Croatian", "hr", "hrv", ""), ("Czech", "cs", "ces", "cze"), ("Danish", "da", "dan", ""), ("Dutch", "nl", "nld", "dut"), ("English", "en", "eng", ""),
    ("Estonian", "et", "est", ""), ("Finnish", "fi", "fin", ""), ("French", "fr", "fra", "fre"), ("German", "de", "deu", "ger"), ("Greek", "el", "ell", "gre"),
    ("Hebrew", "he", "heb", ""), ("Hindi", "hi", "hin", ""), ("Hungarian", "hu", "hun", ""), ("Icelandic", "is", "isl", "ice"), ("Indonesian", "id", "ind", ""),
    ("Italian", "it", "ita", ""), ("Japanese", "ja", "jpn", ""), ("Korean", "ko", "kor", ""), ("Latin", "la", "lat", ""), ("Latvian", "lv", "lav", ""),
    ("Lithuanian", "lt", "lit", ""), ("Norwegian", "no", "nor", ""), ("Persian", "fa", "fas", "per"), ("Polish", "pl", "pol", ""), ("Portuguese", "pt", "por", ""),
    ("Romanian", "ro", "ron", "rum"), ("Russian", "ru", "rus", ""), ("Serbian", "sr", "srp", ""), ("Slovak", "sk", "slk", "slo"), ("Slovenian", "sl", "slv", ""),
    ("Spanish", "es", "spa", ""), ("Swedish", "sv", "swe", ""), ("Thai", "th", "tha", ""), ("Turkish", "tr", "tur", ""), ("Ukrainian", "uk", "ukr", ""), ("Vietnamese", "vi", "vie", ""),
)


def _lookup(text: Column, column: int) -> Column:
    table = {k: row[column] for row in LANGUAGES for k in (row[0].lower(), *row[1:]) if k}
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    clean = F.lower(F.trim(F.regexp_replace(text, "_", "-")))
    return F.coalesce(F.try_element_at(found, clean), F.try_element_at(found, F.split_part(clean, F.lit("-"), F.lit(1))))


def language_name(text: Column) -> Column:
    return _lookup(text, 0)


def language_code(text: Column) -> Column:
    """Three letters; null for a language that isn't in the table."""
    return _lookup(text, 2)


def locale(text: Column) -> Column:
    """The text as a locale, with hyphens, if it has the form of one: "en", "en-GB", "es-419", "zh-Hant-TW"."""
    clean = F.trim(F.regexp_replace(text, "_", "-"))
    return F.when(clean.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?\z"), clean)
