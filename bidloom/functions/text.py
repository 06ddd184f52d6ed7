"""Text functions over whole tables: language, masking, repair, checksums, labels."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidloom.functions import patterns as P

# The multiplication and permutation tables of the Verhoeff checksum, row by row.
VERHOEFF_D = "".join(
    ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
     "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
)
VERHOEFF_P = "".join(
    ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
)


#: Decimal digits of all scripts but ASCII, and what they stand for.
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_PLAIN = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def plain_digits(text: Column) -> Column:
    """Digits of any script as ASCII digits; the length stays."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, "".join(_DIGITS), _PLAIN))


#: White space of any kind, as Unicode has it, and the separators of information.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACES))


def devanagari_ratio(text: Column) -> Column:
    """Devanagari characters among letter-like ones; 0 where there are none."""
    left = lambda others: F.char_length(F.regexp_replace(text, others, ""))
    ratio = F.try_divide(left(r"[^\x{0900}-\x{097F}]+"), left(r"[^\p{L}\x{0900}-\x{097F}]+"))
    # A plain text has none, and is not searched.
    return F.when(F.octet_length(text) == F.char_length(text), 0.0).otherwise(F.coalesce(ratio, F.lit(0.0)))


def language(ratio: Column) -> Column:
    return F.when(ratio > 0.3, "hi").when(ratio < 0.05, "en").otherwise("mixed")


def language_confidence(ratio: Column) -> Column:
    """A half at the border of the class, more with the distance from it."""
    high, low = (ratio - 0.3) / 0.7 + 0.5, (0.05 - ratio) / 0.05 + 0.5
    return F.when(ratio > 0.3, F.least(F.lit(1.0), high)).when(ratio < 0.05, F.least(F.lit(1.0), low)).otherwise(0.5)


def verhoeff_ok(digits: Column) -> Column:
    """Whether a digit string passes the checksum."""
    at = lambda s, k: F.substr(F.lit(s), k + 1, F.lit(1)).cast("int")
    step = lambda c, x: at(VERHOEFF_D, c * 10 + x)
    n = F.char_length(digits)
    turned = F.transform(F.sequence(F.lit(1), n), lambda i: at(VERHOEFF_P, (i - 1) % 8 * 10 + F.substr(digits, n - i + 1, F.lit(1)).cast("int")))
    return F.aggregate(turned, F.lit(0), step) == 0


def mask_ids(text: Column) -> Column:
    """GSTIN, then PAN, masked but for their last four characters."""
    text = F.regexp_replace(text, r"\b[0-9]{2}[A-Z]{5}[0-9]{4}([A-Z][1-9A-Z]Z[0-9A-Z])\b", "[GSTIN:***********$1]")
    return F.regexp_replace(text, r"\b[A-Z]{5}[0-9]([0-9]{3}[A-Z])\b", "[PAN:******$1]")


def replace_each(text: Column, pattern: str, change) -> Column:
    """Every match of a pattern changed where it stands: gaps and changed matches, joined in turn."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    gaps = F.split(text, pattern)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def mask_aadhaar(text: Column) -> Column:
    """Twelve digits (also 4-4-4), in no longer run, that pass the checksum; Devanagari digits count."""
    digit = "[0-9०-९]"
    pattern = rf"(?<!{digit}){digit}{{4}}[\s-]?{digit}{{4}}[\s-]?{digit}{{4}}(?!{digit})"

    def mask(m):
        bare = F.regexp_replace(m, r"[\s-]", "")
        good = verhoeff_ok(F.translate(bare, "०१२३४५६७८९", "0123456789"))
        return F.when(good, F.concat(F.lit("[AADHAAR:********"), F.right(bare, F.lit(4)), F.lit("]"))).otherwise(m)

    return F.when(text.rlike(pattern), replace_each(text, pattern, mask)).otherwise(text)


def redact(text: Column) -> Column:
    return mask_aadhaar(mask_ids(text))


def redact_json(payload: Column) -> Column:
    """Masks within the string values of a JSON text, at any depth; keys and numbers stay.

    A text that is no JSON is masked as a whole.
    """
    literal = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'
    inside = replace_each(payload, literal, lambda m: F.when(m.endswith(":"), m).otherwise(redact(m)))
    return F.when(F.try_parse_json(payload).isNotNull(), inside).otherwise(redact(payload))


def ocr_repair(text: Column) -> Column:
    """The letter O within the run of an amount becomes zero, unless a dash, slash or letter follows the run."""
    own = r"\p{Nd},₹."
    pattern = rf"(?<![{own}])[{own}]++[Oo][Oo{own}]*+(?![-/\\A-Za-z])"
    changed = replace_each(text, pattern, lambda m: F.translate(m, "Oo", "00"))
    return F.when(text.rlike(rf"[{own}][Oo]"), changed).otherwise(text)


def checksum(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def stable_key(prefix: str, *parts: Column) -> Column:
    """Prefix and 48 hex digits of the parts, each not-null one followed by a unit separator."""
    joined = F.concat(*[F.coalesce(F.concat(p.cast("string"), F.lit("\x1f")), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.left(F.sha2(joined, 256), F.lit(48)))


def python_float(value: Column) -> Column:
    """A number as Python writes it: the shortest digits, with an exponent from 1e16 on and below 1e-4."""
    s = value.cast("string")
    part = lambda g: F.regexp_extract(s, r"^-?(\d)\.(\d+)E(-?\d+)$", g)
    sign = F.when(value < 0, "-").otherwise("")
    power = part(3).cast("int")
    frac = F.when(part(2) == "0", "").otherwise(part(2))
    digits = F.concat(part(1), frac)
    whole = F.rpad(digits, power + 1, F.lit("0"))
    rest = F.when(F.char_length(digits) > power + 1, F.substr(digits, power + 2)).otherwise("0")
    short = F.concat(part(1), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)))
    power_text = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(power).cast("string"))), F.lit("0")))
    return (
        F.when(~s.contains("E"), s)
        .when(power.between(0, 15), F.concat(sign, whole, F.lit("."), rest))
        .when(power.between(-4, -1), F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .otherwise(F.concat(sign, short, F.lit("e"), power_text))
    )


def format_inr(value: Column) -> Column:
    return (
        F.when(value >= 1e7, F.format_string("₹%.2f Cr", value / 1e7)).when(value >= 1e5, F.format_string("₹%.1f L", value / 1e5))
        .otherwise(F.concat(F.lit("₹"), F.format_number(value, 0)))
    )


def discrepancy_percent(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == 0, F.lit(0.0)).otherwise(F.round(F.abs(a - b) / top * 100))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.45, "medium").otherwise("low")


def doc_type(raw: Column) -> Column:
    """Trimmed and lower-case; blank is supporting, an unknown one null."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(t == "", "supporting").when(t.isin(P.DOC_TYPES), t)


def action_label(action: Column) -> Column:
    key = F.regexp_replace(F.upper(F.coalesce(action, F.lit(""))), r"\s+", "_")
    table = F.create_map(*[F.lit(x) for kv in P.ACTION_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.nullif(action, F.lit("")), F.lit("Action"))


def chunks(text: Column, most: int = 4000) -> Column:
    """Pieces of at most ``most`` characters, broken at line feeds; longer lines are cut hard.

    A text that fits stays whole, and an empty one has no pieces.  Nothing is put before the next
    line while a piece is still empty, so line feeds at the start of a piece are lost.
    """
    line_parts = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.when(
        F.char_length(x) <= most, F.array(x)).otherwise(F.transform(
            F.sequence(F.lit(0), F.floor((F.char_length(x) - 1) / most).cast("int")),
            lambda i: F.substr(x, i * most + 1, F.lit(most))))))
    form = "struct<done: array<string>, now: string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(form)

    def step(a, x):
        fits = F.char_length(a["now"]) + 1 + F.char_length(x) <= most
        return (
            F.when(a["now"] == "", F.struct(a["done"].alias("done"), x.alias("now")))
            .when(fits, F.struct(a["done"].alias("done"), F.concat(a["now"], F.lit("\n"), x).alias("now")))
            .otherwise(F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), x.alias("now"))).cast(form)
        )

    cut = F.aggregate(line_parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))
    return F.when(text == "", F.array().cast("array<string>")).when(F.char_length(text) <= most, F.array(text)).otherwise(cut)
