"""Scalar expressions on file metadata: sizes, hashes, media types, identifiers, coercions. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit of a size and its bytes.
SIZE_UNITS = {
    "b": 1, "byte": 1, "bytes": 1,
    "k": 1000, "kb": 1000, "kilobyte": 1000, "kilobytes": 1000,
    "m": 1000**2, "mb": 1000**2, "megabyte": 1000**2, "megabytes": 1000**2,
    "g": 1000**3, "gb": 1000**3, "gigabyte": 1000**3, "gigabytes": 1000**3,
    "t": 1000**4, "tb": 1000**4, "terabyte": 1000**4, "terabytes": 1000**4,
    "kib": 1024, "kibi": 1024, "kibibyte": 1024, "kibibytes": 1024,
    "mib": 1024**2, "mibi": 1024**2, "mebibyte": 1024**2, "mebibytes": 1024**2,
    "gib": 1024**3, "gibi": 1024**3, "gibibyte": 1024**3, "gibibytes": 1024**3,
    "tib": 1024**4, "tibi": 1024**4, "tibibyte": 1024**4, "tibibytes": 1024**4,
}
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
MAX_STRING = 255

_HEX_64 = r"^[0-9a-fA-F]{64}\z"
_TLSH = r"^[tT]1[0-9a-fA-F]{70}\z"


def human_size(size: Column) -> Column:
    """Bytes with a binary unit: no decimals up to MiB, two from GiB on, halves to even on the exact value.

    The value is a whole number over a power of two, so whole-number arithmetic is exact where formatting a double isn't.
    """

    def one(k: int) -> Column:
        decimals, whole = 2 if k > 2 else 0, size.cast("long")
        den, scale = F.lit(1 << (10 * k)).cast("long"), F.lit(10**decimals).cast("long")
        rest = whole.bitwiseAND(den - 1) * scale  # apart from the whole units, as a hundred times a size may be no long
        q = F.shiftright(whole, 10 * k) * scale + F.shiftright(rest, 10 * k)
        r = rest.bitwiseAND(den - 1)
        up = (2 * r > den) | ((2 * r == den) & (q % 2 == 1))
        q = q + F.when(up, 1).otherwise(0)
        if not decimals:
            return F.concat(q.cast("string"), F.lit(f" {UNITS[k]}"))
        return F.concat((F.floor(q / 100)).cast("string"), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"), F.lit(f" {UNITS[k]}"))

    out = one(5)
    for k in range(4, -1, -1):
        out = F.when(size < F.lit(1 << (10 * (k + 1))), one(k)).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of "2.5 GiB", "10kb" or "17"; null if it isn't a size."""
    shape = r"^\s*(\d*\.?\d+)\s*([a-zA-Z]+)\s*\z"
    units = F.create_map(*(F.lit(x) for pair in SIZE_UNITS.items() for x in pair))
    unit = F.lower(F.regexp_extract(text, shape, 2))
    value = F.regexp_extract(text, shape, 1).try_cast("double") * F.try_element_at(units, unit)
    return F.when(text.rlike(shape), value.cast("long")).otherwise(F.trim(text).try_cast("long"))


def json_size(json: Column) -> Column:
    """Bytes of a JSON text written with ASCII escapes: 6 for a letter beyond "~", 12 beyond the basic plane."""
    ascii_only = F.length(F.regexp_replace(json, r"[^\x00-\x7E]", ""))
    beyond = F.length(F.regexp_replace(json, r"[\x00-\x{FFFF}]", ""))
    return ascii_only + 6 * (F.length(json) - ascii_only - beyond) + 12 * beyond


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def bounded(text: Column, most: int = MAX_STRING) -> Column:
    """The first ``most`` letters; null for an empty string."""
    return F.when(F.length(text) > 0, F.substring(text, 1, most))


def parse_hash(text: Column) -> Column:
    """``struct(value, function)`` of a hash string with or without prefix; both null if it is none."""
    prefixed = r"(?i)^(sha-?256|blake3|quick|tlsh):(.+)\z"
    prefix, rest = F.lower(F.regexp_extract(text, prefixed, 1)), F.regexp_extract(text, prefixed, 2)
    name = F.when(prefix.startswith("sha"), "SHA-256").when(prefix == "blake3", "BLAKE3").when(prefix == "quick", "QUICK").when(prefix == "tlsh", "TLSH")
    fits = F.when(prefix == "tlsh", rest.rlike(_TLSH)).otherwise(rest.rlike(_HEX_64))
    bare_64, bare_72 = F.length(text) == 64, (F.length(text) == 72) & F.lower(text).startswith("t")
    function = (
        F.when(bare_64, F.when(text.rlike(_HEX_64), "SHA-256")).when(bare_72, F.when(text.rlike(_TLSH), "TLSH")).when(text.rlike(prefixed) & fits, name)
    )
    value = F.when(function.isNotNull(), F.lower(F.when(bare_64 | bare_72, text).otherwise(rest)))
    return F.struct(value.alias("value"), function.alias("function"))


def clean_extension(text: Column) -> Column:
    """The extension in lower case, or null if it isn't one."""
    return F.when(text.rlike(r"^\.[a-zA-Z0-9_!-]{1,16}\z"), F.lower(text))


def is_media_type(text: Column) -> Column:
    return text.rlike(r"(?U)^\w+/[-+.\w]+\z") & F.length(text).between(3, 256)


def media_head(media_type: Column) -> Column:
    """What stands before the slash."""
    return F.split_part(media_type, F.lit("/"), F.lit(1))


def without_parameters(media_type: Column) -> Column:
    return F.trim(F.split_part(media_type, F.lit(";"), F.lit(1)))


def dataset_id(text: Column) -> Column:
    """The trailing ``namespace/name`` of an id or address; null if there is none or it has a double hyphen."""
    found = F.regexp_extract(text, r"^(?:.*/)?([a-z0-9\-]{3,32}/[a-z0-9\-]{3,32})\z", 1)
    return F.when((found != "") & ~found.contains("--"), found)


def coerce_integer(text: Column) -> Column:
    """A whole number, or the first of a ratio such as "3/12"; else null."""
    ratio = F.regexp_extract(F.trim(text), r"^([+-]?\d+)\s*/\s*[+-]?(?:\d*\.)?\d+\z", 1)
    return F.coalesce(F.when(F.trim(text).rlike(r"^[+-]?\d+\z"), F.trim(text).try_cast("long")), ratio.try_cast("long"))


def coerce_float(text: Column) -> Column:
    """A number, or the first of a ratio; else null."""
    ratio = F.regexp_extract(F.trim(text), r"^([+-]?(?:\d*\.)?\d+)\s*/\s*[+-]?(?:\d*\.)?\d+\z", 1)
    return F.coalesce(F.trim(text).try_cast("double"), ratio.try_cast("double"))


def strip_tags(text: Column) -> Column:
    """Without HTML tags, trimmed; null if nothing is left."""
    out = F.trim(F.regexp_replace(text, r"<[^>]+>", ""))
    return F.when(out != "", out)


#: Names that an ISBN stands behind.
ISBN_NAMES = ("ISBN", "urn:isbn:")


def _leading(text: Column, letters: str) -> Column:
    """How many letters of a set a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(letters)))


def _isbn_behind(text: Column) -> Column:
    """The ISBN that a text begins with: up to thirteen digits, ten at least; or nine to twelve and an X. Else null."""
    n = F.least(_leading(text, "0123456789"), F.lit(13))
    size = n + F.when((n < 13) & (F.substr(text, n + 1, F.lit(1)) == "X"), 1).otherwise(0)
    return F.when(size >= 10, F.substr(text, F.lit(1), size))


def isbn(text: Column) -> Column:
    """An ISBN behind its name (``ISBN 978...``, ``ISBN: ...``, ``urn:isbn:...``), the first that has one, or a text that is one but for hyphens."""
    blanks = " \t\n\x0b\f\r"
    behind = []
    for name in ISBN_NAMES:
        rest = F.filter(F.transform(F.split(text, name), lambda part, i: F.when(i > 0, part)), lambda part: part.isNotNull())
        if not name.endswith(":"):
            rest = F.transform(rest, lambda part: F.regexp_replace(F.ltrim(part, F.lit(" \t")), "^:", ""))
        found = F.transform(rest, lambda part: _isbn_behind(F.ltrim(part, F.lit(blanks))))
        behind.append(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
    bare = F.trim(F.translate(text, "-", ""))
    n = _leading(bare, "0123456789")
    whole = ((n == F.length(bare)) & n.isin(10, 13)) | ((n == 9) & (F.length(bare) == 10) & bare.endswith("X"))
    return F.coalesce(*behind, F.when(whole, bare))


def keywords(text: Column) -> Column:
    """Parts between commas and semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def cell_reference(text: Column) -> Column:
    """``struct(rows, cols)`` of the last cell of "A1:C7" or of "C7"."""
    last = F.upper(F.element_at(F.split(text, ":"), -1))
    letters, digits = F.regexp_extract(last, r"^\$?([A-Z]+)\$?(\d+)\z", 1), F.regexp_extract(last, r"^\$?([A-Z]+)\$?(\d+)\z", 2)
    column = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.struct(digits.try_cast("int").alias("rows"), F.when(letters != "", column).alias("cols"))


def icon(media_type: Column, icons: dict[str, str], default: str) -> Column:
    """The icon of a media type, else of its head, else the default."""
    if not icons:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for pair in icons.items() for x in pair))
    return F.coalesce(F.try_element_at(table, media_type), F.try_element_at(table, media_head(media_type)), F.lit(default))


def record_url(base: str, content_hash: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.trim(content_hash))
