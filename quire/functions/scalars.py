"""Scalar functions on strings, dates and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Roman numerals in descending order (fixed values).
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column | str) -> Column:
    """Lower-case roman numeral; empty for 0 and less."""
    left, out = F.greatest(_col(n).cast("int"), F.lit(0)), F.lit("")
    for v, s in ROMAN:
        out = F.concat(out, F.repeat(F.lit(s), F.expr("1") * F.floor(left / v).cast("int")))
        left = left % v
    return out


def letters(n: Column | str) -> Column:
    """a, b, ... z, aa, bb, ...; empty for 0 and less."""
    n = _col(n).cast("int")
    return F.when(n <= 0, F.lit("")).otherwise(F.repeat(F.char((97 + (n - 1) % 26).cast("int")), F.floor((n + 25) / 26).cast("int")))


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """Prefix and number in the range's style; an unknown style is decimal, none is the prefix alone."""
    cut = F.substring_index(F.coalesce(prefix, F.lit("")), "\0", 1)
    text = (
        F.when(style.isNull(), F.lit("")).when(style == "r", roman(number)).when(style == "R", F.upper(roman(number)))
        .when(style == "a", letters(number)).when(style == "A", F.upper(letters(number))).otherwise(number.cast("string"))
    )
    return F.concat(cut, text)


def hex_decode(s: Column | str) -> Column:
    """Bytes of the leading whole pairs of hex digits; stops at the first other pair."""
    return F.unhex(F.regexp_extract(F.regexp_replace(_col(s), r"[\r\n]", ""), "^(?:[0-9A-Fa-f]{2})*", 0))


def hex_string(s: Column | str) -> Column:
    """A hex string literal: trimmed, an odd digit padded by 0; other characters raise."""
    t = F.trim(_col(s))
    t = F.when(F.length(t) % 2 == 1, F.concat(t, F.lit("0"))).otherwise(t)
    return F.when(t.rlike("^[0-9A-Fa-f]*$"), F.unhex(t)).otherwise(F.raise_error(F.lit("bad hex string")).cast("binary"))


def decode_by_mark(b: Column | str) -> Column:
    """Text of bytes by their byte order mark; without one, as Latin letters."""
    b = _col(b)
    h = F.hex(b)
    return (
        F.when(h.startswith("FEFF"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16BE")).when(h.startswith("FFFE"), F.decode(F.substring(b, 3, 1 << 30), "UTF-16LE"))
        .when(h.startswith("EFBBBF"), F.decode(F.substring(b, 4, 1 << 30), "UTF-8")).otherwise(F.decode(b, "ISO-8859-1"))
    )


_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:Z|([+-])(\d{2})'?(\d{2})?'?)?$"


def parse_date(s: Column | str) -> Column:
    """UTC timestamp of D:YYYYMMDDHHmmSSOHH'mm' with any tail missing; null if malformed."""
    s = _col(s)
    part = [F.nullif(F.regexp_extract(s, _DATE, i), F.lit("")) for i in range(1, 10)]
    num = [F.coalesce(p.cast("int"), F.lit(d)) for p, d in zip(part[:6], (0, 1, 1, 0, 0, 0))]
    at = F.try_make_timestamp(*num[:5], num[5].cast("decimal(8,6)"))
    minutes = F.coalesce(part[7].cast("int"), F.lit(0)) * 60 + F.coalesce(part[8].cast("int"), F.lit(0))
    sign = F.when(part[6] == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.when(s.rlike(_DATE), at - F.make_dt_interval(F.lit(0), F.lit(0), sign * minutes))


def format_date(ts: Column | str) -> Column:
    """ISO 8601 in UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def format_number(x: Column | str, digits: int) -> Column:
    """At most ``digits`` decimals, halves away from zero, trailing zeros trimmed."""
    x = _col(x).cast("double")
    scaled = F.floor(F.abs(x) * 10**digits + 0.5)
    whole, rest = F.floor(scaled / 10**digits), (scaled % 10**digits).cast("bigint")
    frac = F.rtrim(F.lpad(rest.cast("string"), digits, "0"), F.lit("0"))
    text = F.concat(whole.cast("string"), F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    return F.when(F.isnan(x) | (F.abs(x) > 1e15), F.lit(None).cast("string")).otherwise(F.concat(F.when((x < 0) & (scaled > 0), F.lit("-")).otherwise(F.lit("")), text))


def escape_markdown(s: Column | str) -> Column:
    return F.regexp_replace(_col(s), r"([\\`*_\[\]<>#|])", r"\\$1")


def escape_html(s: Column | str) -> Column:
    out = _col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rational(s: Column | str) -> Column:
    """n/d or a whole number as double; null if malformed or over zero."""
    s = _col(s)
    n, d = F.regexp_extract(s, r"^([+-]?\d+)(?:/([+-]?\d+))?$", 1), F.regexp_extract(s, r"^([+-]?\d+)(?:/([+-]?\d+))?$", 2)
    return F.when(n != "", F.when(d == "", n.cast("double")).otherwise(F.try_divide(F.try_to_number(n, F.lit("S9999999999")).cast("double"), F.nullif(d, F.lit("")).cast("double"))))


def rgb_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [1 - F.least(F.lit(1.0), x + k) for x in (c, m, y)]


def rotation(b: Column, d: Column) -> Column:
    """Whole degrees in [0, 360) of a text matrix; halves go to the even number."""
    return F.pmod(F.rint(F.degrees(F.atan2(b, d))), F.lit(360.0)).cast("int")


def guard_doctype(s: Column | str) -> Column:
    """The XML as it is, or an error if it declares a document type."""
    s = _col(s)
    return F.when(s.rlike("(?i)<!DOCTYPE"), F.raise_error(F.lit("DOCTYPE is not allowed")).cast("string")).otherwise(s)
