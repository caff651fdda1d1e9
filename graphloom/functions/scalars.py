"""Column functions: normalised labels, source references, assertion ids, telemetry labels, sentence and word measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the form of node ids.
ID = r"^[a-z0-9_-]+:[^\s]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(x) -> Column:
    """Lower case, runs of other than a-z0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))


def source_path(x) -> Column:
    """Path of ``path#anchor``; null if it has no such form."""
    return F.nullif(F.regexp_extract(_c(x), r"^([^#]+)#([^\s#].*)$", 1), F.lit(""))


def source_anchor(x) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"^([^#]+)#([^\s#].*)$", 2), F.lit(""))


def assertion_id(a, rel, b, source) -> Column:
    return F.concat(F.lit("a:"), F.substring(F.sha2(F.concat_ws("\x1f", _c(a), _c(rel), _c(b), _c(source)), 256), 1, 20))


def is_node_id(x) -> Column:
    """``type:slug``: lower case, digits, ``_`` and ``-`` before the colon, no white space after it."""
    return _c(x).rlike(ID)


def py_str(x: Column, kind: str) -> Column:
    """Text of a property as filters compare it: booleans capitalised, a missing value ``None``."""
    text = F.when(x, F.lit("True")).otherwise(F.lit("False")) if kind == "boolean" else x.cast("string")
    return F.when(x.isNull(), F.lit("None")).otherwise(text)


# Markers of keys that are never shown, and forms of labels and ids.
SENSITIVE = ("secret", "token", "key", "wallet", "address", "signature", "auth", "bearer")
SAFE = r"^[A-Za-z0-9_.:_-]{1,64}$"
HEX_ID = r"^(0x)?[0-9a-fA-F]{16,}$"
LONG_ID = r"^[0-9]{12,}$"


def is_sensitive(x) -> Column:
    return F.lower(_c(x)).rlike("|".join(SENSITIVE))


def strip(x) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def _looks_like_id(x: Column) -> Column:
    return x.rlike(HEX_ID) | x.rlike(LONG_ID)


def safe_label(x) -> Column:
    """A shown value: missing as unknown; anything but a short plain label, or secret-like, or an id, as redacted."""
    c = strip(x)
    return F.when(c.isNull(), "unknown").when(~c.rlike(SAFE) | is_sensitive(c) | _looks_like_id(c), "redacted_label").otherwise(c)


def safe_segment(x) -> Column:
    """A shown part of a field's path."""
    c = strip(x)
    return F.when(c == "", "empty_key").when(is_sensitive(c), "redacted_key").when(_looks_like_id(c), "dynamic_id").when(~c.rlike(SAFE), "dynamic_key").otherwise(c)


def epoch(x: Column) -> Column:
    """Seconds of a number: above 1e11 milliseconds, above 1e8 seconds, else no time."""
    return F.when(x > 1e11, x / 1000).when(x > 1e8, x)


def iso_utc(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(_c(seconds))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_inline(x) -> Column:
    """Text with link labels for links, CODE and URL for inline code and bare addresses, without emphasis marks."""
    out = _c(x)
    for pattern, by in ((r"\[([^\]]+)\]\([^\)]+\)", "$1"), ("`[^`]*`", " CODE "), (r"(?U)https?://\S+", " URL "), (r"!\[([^\]]*)\]", "$1"), ("[*_~]", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def first_word(x) -> Column:
    """The first run of letters of the cleaned text, in lower case; empty if none."""
    return F.lower(F.regexp_extract(clean_inline(x), "[A-Za-z]+", 0))


def sentences(x) -> Column:
    """Of the cleaned text: split after . ! ? where white space and a capital or digit follow, but not after the points of
    initials and of some abbreviations."""
    held = F.regexp_replace(clean_inline(x), r"(?U)\b([A-Za-z])\.([A-Za-z])\.", "$1§$2§")
    held = F.regexp_replace(held, r"(?U)\b(Mr|Mrs|Ms|Dr|No|Fig|Eq)\.", "$1§")
    marked = F.regexp_replace(held, r"(?U)([.!?])\s+([A-Z0-9])", "$1\x1f$2")
    parts = F.transform(F.split(marked, "\x1f"), lambda s: strip(F.replace(s, F.lit("§"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


UNITS = "%|°[CF]?|A|cm|ft|g|h|Hz|in|kg|km|kPa|L|lb|m|mA|mg|min|mm|Nm|ohm|psi|s|V|W"  # Fixed values: units of measure.


def word_count(x) -> Column:
    """Words of a sentence; a parenthesis, a quotation and a measure count as one word each."""
    out = clean_inline(x)
    out = F.regexp_replace(out, r"\([^()]*\)", " PAREN ")
    out = F.regexp_replace(out, "“[^”]*”|\"[^\"]*\"", " QUOTED ")
    out = F.regexp_replace(out, rf"(?iU)\b\d+(?:\.\d+)?\s*(?:{UNITS})\b", " MEASURE ")
    return F.regexp_count(out, F.lit(r"(?U)\b[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*\b"))


def excerpt(x, most: int = 140) -> Column:
    """One line of at most ``most`` characters."""
    line = strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 1), F.lit("…")))


def xml_escape(x) -> Column:
    out = F.replace(_c(x), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
