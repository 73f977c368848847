"""Native text expressions: whitespace removal, JSON quoting, answer objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Unicode whitespace set of Python's ``\s`` (str.isspace), so
# U+3000 and U+001C..U+001F go too.  Written with \x{..} escapes, which both
# Java regex and RE2 accept.
WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_whitespace(c) -> Column:
    """Remove every run of Unicode whitespace (not only ASCII)."""
    return F.regexp_replace(_col(c), WHITESPACE_CLASS, "")


# control characters whose \u00XX escape contains a hex letter; Python's json
# writes those letters lower-case, Spark's JSON writer upper-case
_UPPER_HEX_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def json_quote(c) -> Column:
    """A JSON string literal for ``c`` (quotes included, non-ASCII kept),
    byte-identical to ``json.dumps(value, ensure_ascii=False)``."""
    j = F.to_json(F.array(_col(c)))          # ["..."]
    q = j.substr(F.lit(2), F.length(j) - F.lit(2))
    fixed = q
    for h in _UPPER_HEX_ESCAPES:
        # an escape, not an escaped backslash followed by text: the run of
        # backslashes before "u" must be odd
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u" + h, "$1\\\\u" + h.lower())
    return F.when(F.instr(q, "\\u00") > 0, fixed).otherwise(q)


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """``{"k": "v", "k2": "v2"}`` with ", " and ": " separators (string values only)."""
    parts: list[Column] = [F.lit("{")]
    for i, (k, v) in enumerate(pairs):
        if i:
            parts.append(F.lit(", "))
        parts.append(F.lit(k.join('""') + ": "))
        parts.append(json_quote(v))
    parts.append(F.lit("}"))
    return F.concat(*parts)
