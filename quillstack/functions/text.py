"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """ASCII slug: lower, runs of anything else to one hyphen, none at the ends; empty: untitled."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, c)


def html_escape(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def xml_escape(c: Column) -> Column:
    return _replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def cell_escape(c: Column) -> Column:
    return _replaced(c, [("|", "\\|"), ("\n", " ")])


def natural_key(c: Column) -> Column:
    """Letters lower-cased and each digit run led by its length, so that plain order is numeric-aware for numbers of any length."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), 1)

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


#: Values of the roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_to_int(c: Column) -> Column:
    """Subtractive roman numeral to int; null for anything else or nothing."""
    value = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.transform(F.split(F.lower(c), ""), lambda d: F.coalesce(F.try_element_at(value, d), F.lit(0)))
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.try_element_at(digits, i + 2), F.lit(0)), -d).otherwise(d))
    return F.when(F.lower(c).rlike("^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda a, d: a + d))


def heading_number(c: Column) -> Column:
    """The leading number of a heading: followed by a dot or a space and more text, or dotted and followed by a letter; else ''."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    apart = F.regexp_extract(t, r"^([0-9]++(?:\.[0-9]++)*+)(?:\. ?| )[^ ]", 1)
    glued = F.regexp_extract(t, r"^([0-9]++(?:\.[0-9]++)++)\p{L}", 1)
    return F.when(apart != "", apart).otherwise(glued)


def heading_title(c: Column) -> Column:
    """A heading's text without its number."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    n = heading_number(c)
    return F.when(n != "", F.trim(F.regexp_replace(F.substring(t, F.length(n) + 1, F.length(t)), r"^\.", ""))).otherwise(t)


def fence(c: Column) -> Column:
    """A fence longer than any run of backticks in the text, of three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), 1), lambda r: F.length(r)))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(longest, F.lit(0)) + 1, F.lit(3)).cast("int"))


def initials(c: Column) -> Column:
    words = F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def palette(c: Column, colours: int = 9) -> Column:
    """31-multiplier hash over characters, wrapped to 32 bits in longs, and its magnitude modulo the palette."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x))) % colours).cast("int")


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def page_number(name: Column, ordinal: Column) -> Column:
    found = F.regexp_extract(name, r"_page_([0-9]+)\.md$", 1)
    return F.when(found != "", found.cast("int")).otherwise(ordinal)


def diagnostic_line(severity: Column, code: Column, file: Column, line: Column, column: Column, message: Column) -> Column:
    """``warning code (file:line:col): message`` with severities as wide as the longest; null places are left out, and with them the brackets."""
    place = F.concat_ws(":", file, line.cast("string"), column.cast("string"))
    return F.concat(F.rpad(severity, 7, " "), F.lit(" "), code, F.when(place != "", F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""), F.lit(": "), message)


def safe_name(c: Column) -> Column:
    """Whether an object's name is relative, without empty, ``.`` and ``..`` parts, backslashes or NUL, and at most 512 long; null is not."""
    ok = (c != "") & ~c.contains("\\") & ~c.contains("\u0000") & (F.length(c) <= 512) & ~F.exists(F.split(c, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce(ok, F.lit(False))


def image_type(content: Column) -> Column:
    """png, jpg or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


#: Words whose own number a roman numeral behind them is (fixed values).
NUMBERED_WORDS = ("chapter", "part", "appendix", "volume")


def trailing_page(c: Column) -> Column:
    """The page number that ends a contents line, in brackets or not: up to four digits or a roman numeral; '' if there is none or if it is a part's own number ("Part II")."""
    words = F.split(F.trim(c), r"\s+")
    last = F.regexp_replace(F.element_at(words, -1), r"^\(|\)$", "")
    roman = last.rlike("^[ivxlcdmIVXLCDM]{1,7}$")
    own = roman & F.lower(F.regexp_extract(F.try_element_at(words, F.lit(-2)), r"([\p{L}]*)[\s.·…•_—–-]*$", 1)).isin(*NUMBERED_WORDS)
    return F.when((F.size(words) > 1) & (roman | last.rlike("^[0-9]{1,4}$")) & ~own, last).otherwise("")
