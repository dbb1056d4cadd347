"""Column functions on text: tokens, stems, identifiers, cleaning. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\p{L}{2,}"
#: Suffixes in the order in which they are tried, and old forms with their modern ones.
SUFFIXES = ["ational", "ations", "ation", "ingly", "edly", "ness", "ment", "eth", "est", "ing", "ied", "ies", "ed", "es", "ly", "s"]
MODERN = {"thir": "their", "hee": "he", "mee": "me", "wee": "we", "shee": "she", "bee": "be", "onely": "only", "sev": "seven", "heav": "heaven"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of two letters or more; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def old_spelling(text: Column) -> Column:
    """Apostrophe endings written out: 'd, 'n, 'r, 'st, and 's dropped."""
    t = F.regexp_replace(F.lower(text), "[’‘]", "'")
    for ending, full in (("d", "ed"), ("n", "en"), ("r", "er"), ("st", "est"), ("s", "")):
        t = F.regexp_replace(t, rf"(\w)'{ending}\b", "$1" + full)
    return F.replace(t, F.lit("'"), F.lit(""))


def stem(word: Column) -> Column:
    """Modern form, then without the first suffix that leaves three letters."""
    modern = F.coalesce(F.create_map(*[F.lit(x) for pair in MODERN.items() for x in pair])[word], word)
    fits = lambda s: modern.endswith(s) & (F.length(modern) - len(s) >= 3)
    return reduce(lambda rest, s: F.when(fits(s), F.substr(modern, F.lit(1), F.length(modern) - len(s))).otherwise(rest), reversed(SUFFIXES), modern)


def squeeze(text: Column) -> Column:
    """Lower case, white space runs as one space, a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" "))


def char_grams(text: Column, n: int = 4) -> Column:
    t = squeeze(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))


def unescape(text: Column) -> Column:
    """The common named character references and numbers of two or three digits, `&amp;` last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    """Words that a line break cuts are joined."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")


def one_line(text: Column) -> Column:
    """Tabs and line breaks as spaces, for writing tab-separated files."""
    return F.translate(text, "\t\n\r", "   ")


#: The characters of bytes 128 to 255 in the code page windows-1251 (byte 152 has none).
CP1251 = "ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—\ufffd™љ›њќћџ\u00a0ЎўЈ¤Ґ¦§Ё©Є«¬\u00ad®Ї°±Ііґµ¶·ё№є»јЅѕїАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюя"


def decode_cp1251(data: Column) -> Column:
    """Text of bytes in windows-1251: read as Latin-1, then the upper half is put in place."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(128, 256))), CP1251)


def roman(text: Column) -> Column:
    """Value of a Roman numeral; null for anything else."""
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in p]), c)
    digits = F.transform(F.split(F.upper(text), ""), value)
    step = lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, 2 * s["last"]).otherwise(0)).alias("sum"), v.alias("last"))
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda s: s["sum"]))
