"""Money in text, as Column builders that also work inside array lambdas."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency tokens, as patterns, and their codes.
CURRENCY = r"USD|US\$|EUR|GBP|EGP|LE|SAR|AED|KWD|OMR|QAR|BHD|دولار|يورو|جنيه|ج\.م|ريال|درهم"
CODES = {
    "usd": "USD", "us$": "USD", "eur": "EUR", "gbp": "GBP", "egp": "EGP", "le": "EGP", "sar": "SAR", "aed": "AED", "kwd": "KWD",
    "omr": "OMR", "qar": "QAR", "bhd": "BHD", "دولار": "USD", "يورو": "EUR", "جنيه": "EGP", "ج.م": "EGP", "ريال": "SAR", "درهم": "AED",
}
# The first two characters of currency tokens.
_HEAD = "".join(f"[{re.escape(''.join(sorted({token[k] for token in CODES})))}]" for k in (0, 1))
# Numbers with thousands, and the shapes that amounts are read in.
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
ARABIC_DIGITS, PERSIAN_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"

# One amount alone, an amount after a currency, one before it, and runs of digits.
SINGLE = rf"(?i)^\s*(?:(?:{CURRENCY})\s*)?({NUMBER})\s*(?:(?:{CURRENCY}))?\s*$"
LEFT = rf"(?i)(?:^|\s)(?:{CURRENCY})\s*({NUMBER})"
RIGHT = rf"(?i)({NUMBER})\s*(?:{CURRENCY})(?:\s|$)"
RUN = r"[0-9][0-9,]*\.?[0-9]*"
GROUP = r"[,.]*+[0-9][0-9,.]*+"


# Currency tokens of amounts in prose, and labels of numbers that are no amounts, in the 32 characters before.
PROSE_CURRENCY = r"جنيه|ج\.م|EGP|USD|US\$|EUR|GBP|SAR|AED|ريال|دولار|يورو|درهم|LE\b"
PROSE_NUMBER = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
REFERENCE_LABEL = r"(?i)(?=[rرصic])(?:ref|رقم|ص\s*[/]\s*م|invoice\s*#|contract\s*#)"
LABEL_CHARS, WINDOW_CHARS = 32, 50
# A number before a currency and one after it. No currency token begins with what a number or white space may go on with, so that nothing is given back; a number
# is tried from its first digit alone, and a token only where its first two characters are ones of a token.
_BEFORE = rf"(?i)(?<![0-9])[0-9]++(?:,[0-9]{{3}})*+(?:\.[0-9]++)?+\s*+(?={_HEAD})(?:{PROSE_CURRENCY})"
_AFTER = rf"(?i)(?={_HEAD})(?:{PROSE_CURRENCY})\s*+{PROSE_NUMBER}"


def western_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS + DIGITS)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _translated(text: Column, of: str, to: str) -> Column:
    """text with characters of `of`, none of them ASCII, as those of `to`. text: looked at more than once; one in ASCII stays as it is."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, of, to))


def to_number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def is_year(token: Column, last: int = 2100) -> Column:
    """Four digits without a point, 1900 to last."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    return ~F.contains(token, F.lit(".")) & (F.length(digits) == 4) & to_number(token).between(1900, last)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _unique(tokens: Column) -> Column:
    """The one value of tokens that are no years, else null."""
    values = F.transform(F.filter(tokens, lambda t: to_number(t).isNotNull() & ~is_year(t)), lambda t: F.round(to_number(t), 8))
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, distinct[0])


def parse_amount(text: Column) -> Column:
    """Exactly one amount, never joined from separate runs of digits: the whole text, else the one value
    next to a currency, else the one run of digits that is no year."""
    return _parsed(F.trim(western_digits(text)))


def _parsed(s: Column) -> Column:
    """parse_amount() of trimmed text with western digits."""
    whole = F.regexp_extract(s, SINGLE, 1)
    beside = F.concat(_all(s, LEFT, 1), _all(s, RIGHT, 1))
    valid = F.filter(beside, lambda t: ~is_year(t))
    # an empty string is no number
    return F.coalesce(to_number(whole), F.when(F.size(valid) > 0, _unique(beside)).otherwise(_unique(_all(s, RUN, 0))))


def currency_code(text: Column) -> Column:
    """The one currency that the text names, else null."""
    codes = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    # tokens have no digits; most places of a text don't begin with two characters of one
    named = F.array_distinct(_all(text, f"(?i)(?={_HEAD})({CURRENCY})", 1))
    found = F.array_distinct(F.transform(named, lambda t: codes[F.lower(t)]))
    # inside a lambda, so that the text is searched once
    return F.get(F.transform(F.array(found), lambda c: F.when(F.size(c) == 1, c[0])), F.lit(0))


def scan_amounts(text: Column, least: float = 1000.0) -> Column:
    """Values of runs of digits, commas and points, from least on, without years to 2035, in order."""
    groups = _once(F.coalesce(text, F.lit("")), lambda t: _all(_translated(t, ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS + DIGITS), GROUP, 0))
    # a run of fewer characters than the least amount has is none
    long = F.filter(groups, lambda g: (F.length(g) >= len(str(max(int(least), 0)))) & ~F.coalesce(is_year(g, 2035), F.lit(False)))
    return F.filter(F.transform(long, _parsed), lambda v: F.coalesce(v >= least, F.lit(False)))


def within_tiny_tolerance(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 1e-6, F.lit(0.01))


def coarse(value: Column) -> Column:
    """Below 10,000 to the nearest 100, else to the nearest 1,000; halves to even."""
    return F.when(value < 10_000, F.bround(value / 100) * 100).otherwise(F.bround(value / 1_000) * 1_000)


def _last(text: Column, chars: int) -> Column:
    return F.substring(text, -chars, chars)


def _found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as (position, end, raw, before), in order: before is the WINDOW_CHARS before. In one fold over the
    pieces between marks, so that the text is not built again for every match. A piece is a match and what follows it; the first one is what goes before all."""
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01", -1)
    none = F.array().cast("array<struct<position:int,end:int,raw:string,before:string>>")

    def step(acc: Column, piece: Column) -> Column:
        raw, rest = F.get(piece, F.lit(0)), F.get(piece, F.lit(1))
        end = acc["at"] + F.length(raw)
        found = F.struct(acc["at"].alias("position"), end.alias("end"), raw.alias("raw"), acc["tail"].alias("before"))
        return F.struct((end + F.length(rest)).alias("at"), _last(F.concat(acc["tail"], raw, rest), WINDOW_CHARS).alias("tail"), F.concat(acc["out"], F.array(found)).alias("out"))

    def fold(pieces: Column) -> Column:
        first = F.get(pieces, F.lit(0))
        start = F.struct(F.length(first).alias("at"), _last(first, WINDOW_CHARS).alias("tail"), none.alias("out"))
        marked = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.split(p, "\x02", -1))
        return F.when(F.size(pieces) > 1, F.aggregate(marked, start, step, lambda acc: acc["out"])).otherwise(none)

    return _once(pieces, fold)


def amounts_in(text: Column) -> Column:
    """(position, end, raw, before, value) of amounts with a currency before or after them, by position; those after a label of a
    reference are no amounts. before: the 50 characters that precede it. Null texts have none."""
    s = _once(F.coalesce(text, F.lit("")), lambda t: _translated(t, ARABIC_DIGITS + PERSIAN_DIGITS + "،", DIGITS + DIGITS + ","))
    s = _once(s, lambda t: F.when(F.contains(t, F.lit("\x01")) | F.contains(t, F.lit("\x02")), F.translate(t, "\x01\x02", "\x03\x03")).otherwise(t))
    both = F.flatten(_once(s, lambda t: F.array(_found(t, _BEFORE), _found(t, _AFTER))))
    kept = F.filter(F.array_distinct(both), lambda x: ~F.rlike(_last(x["before"], LABEL_CHARS), F.lit(REFERENCE_LABEL)))
    with_value = F.transform(F.sort_array(kept), lambda x: F.struct(x["position"].alias("position"), x["end"].alias("end"), x["raw"].alias("raw"), x["before"].alias("before"), _parsed(F.trim(x["raw"])).alias("value")))
    return F.filter(with_value, lambda x: x["value"].isNotNull())


def tagged_amounts(text: Column) -> Column:
    """Values of amounts_in(), in order."""
    return F.transform(amounts_in(text), lambda x: x["value"])


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; 1 if both are empty, 0 if one is."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def variants(value: Column) -> list[Column]:
    """The ways that an amount may be written: with and without thousands, with two decimals and with none. Halves go to even with thousands and without."""
    return [F.format_number(value, 2), F.format_number(value, 0), F.format_string("%.2f", value), F.format_string("%.0f", F.rint(value))]


def number_multiset(text: Column) -> Column:
    """All numbers of the text by value, sorted: equal texts of numbers have equal multisets."""
    tokens = F.transform(_all(F.coalesce(text, F.lit("")), r"[0-9][0-9,.]*", 0), lambda t: F.round(F.rtrim(F.replace(t, F.lit(","), F.lit("")), F.lit(".")).try_cast("double"), 2))
    return F.array_sort(F.filter(tokens, lambda x: x.isNotNull()))
