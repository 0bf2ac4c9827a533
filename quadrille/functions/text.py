"""Names for files."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def greek_names() -> dict[str, str]:
    """Greek letters by their Unicode names: small ones in lower case, capitals with a capital."""
    out = {}
    for code in range(0x391, 0x3CA):
        words = unicodedata.name(chr(code), "").split()
        if len(words) == 4 and words[:3] == ["GREEK", "SMALL", "LETTER"]:
            out[chr(code)] = words[3].lower()
        elif len(words) == 4 and words[:3] == ["GREEK", "CAPITAL", "LETTER"]:
            out[chr(code)] = words[3].capitalize()
    return out


def slugify(value: Column) -> Column:
    """A file name: Greek letters spelled out, other signs dropped, lower case, one hyphen for each gap."""
    for letter, name in greek_names().items():
        value = F.replace(value, F.lit(letter), F.lit(name))
    value = F.trim(F.regexp_replace(value, r"[^\w\s-]", ""))
    return F.regexp_replace(F.lower(value), r"[-\s]+", "-")


def field_file_name(value: Column) -> Column:
    """Dots as underscores, without leading ones."""
    return F.regexp_replace(F.replace(value, F.lit("."), F.lit("_")), r"^_+", "")
