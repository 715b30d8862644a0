"""Text expressions, all on the JVM side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as Unicode has it (fixed values).
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BETWEEN = r"[^\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """Letters with diacritics beside their bases, then combining marks, which translate() drops: from the Unicode tables, Latin and Greek."""
    found = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            found.append((chr(code), parts[0]))
    return "".join(a for a, _ in found) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in found)


def fold(text: Column) -> Column:
    """Lower case without diacritics; plain ASCII has none."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), *accents()))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.array_remove(F.split(fold(text), BETWEEN), "")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("int")


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only, as case-insensitive name lookups need it."""
    return F.translate(text, UPPER, LOWER)


def label_value(text: Column) -> Column:
    """Trimmed of all white space and in ASCII lower case: how enumerated labels are compared."""
    return ascii_lower(F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", ""))


def cut(text: Column, most: int) -> Column:
    """At most so many code points, with an ellipsis where something is gone."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def snippet(text: Column) -> Column:
    return cut(text, 160)


def detail(text: Column) -> Column:
    return cut(text, 200)


def iso8601(epoch_seconds: Column) -> Column:
    """UTC time of an epoch second; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def title(path: Column) -> Column:
    """The file's name."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, if its name has a dot after its first character."""
    return F.regexp_extract(title(path), r"^.+\.([^.]*)$", 1)


#: Fixed values: (doc_type, language) by extension where no classifier answers.
BY_EXTENSION = {"proto": "proto", "go": "go", "rs": "rust", "md": "markdown"}


def fallback_language(path: Column) -> Column:
    ext = ascii_lower(extension(path))
    out = None
    for name, language in BY_EXTENSION.items():
        out = F.when(ext == name, language) if out is None else out.when(ext == name, language)
    return out.otherwise("unknown")
