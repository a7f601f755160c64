"""Text functions of form labels, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marks() -> tuple[str, str]:
    """Lower-case letters with marks and the letters under them: of every letter up to U+1EFF that takes apart into one letter and marks; combining marks alone go."""
    marked, plain = "", ""
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code) and chr(code).lower() == chr(code):
            marked, plain = marked + chr(code), plain + parts[0].lower()
    return marked + "".join(map(chr, range(0x300, 0x370))), plain


MARKED, PLAIN = _marks()
#: Words that say nothing about a field.
EMPTY_WORDS = tuple("il lo la i gli le un uno una di del della dello dei degli delle da dal dalla in nel nella con su per tra fra e ed o che chi al allo alla ai agli alle a n sottoscritto sottoscritta dichiara dichiaro presso seguente seguenti cui come anche non si se ovvero oppure quale qualita num numero".split())
#: How forms write the same thing, applied in this order.
SYNONYMS = (("cf", "fiscale"), ("c f", "codice fiscale"), ("p iva", "partita iva"), ("piva", "partita iva"), ("p i", "partita iva"), ("prov", "provincia"), ("tel", "telefono"), ("e mail", "email"), ("mail", "email"), ("denominazione", "ragione"), ("ditta", "ragione"), ("societa", "ragione"), ("impresa", "ragione"), ("domicilio", "residenza"), ("nato", "nascita"), ("nata", "nascita"))
#: Abbreviations that stay in capitals.
ACRONYMS = ("iban", "pec", "cap", "rea", "soa", "cf", "piva", "iva", "inps", "inail")


def unmarked(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def folded(text: Column) -> Column:
    """Lower case without accents; everything but words is one blank."""
    return F.trim(F.regexp_replace(unmarked(text), r"[^\p{L}\p{N}_]+", " "))


def content_words(text: Column) -> Column:
    """Words of a label that say what it asks for: synonyms replaced in order, empty and short words dropped."""
    plain = folded(text)
    for short, long in SYNONYMS:
        plain = F.regexp_replace(plain, rf"\b{short}\b", long)
    return F.filter(F.split(plain, " "), lambda w: (F.length(w) > 2) & ~w.isin(*EMPTY_WORDS))


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(unmarked(text), F.lit("([a-z0-9]+)"), F.lit(1))


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def long_words(text: Column, least: int = 4) -> Column:
    """Distinct words of at least `least` letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-zà-ù]{{{least},}})"), F.lit(1)))


def named(text: Column) -> Column:
    """Acronyms (dots between their letters dropped) and capitalised words of four letters and more, in lower case."""
    plain = F.regexp_replace(text, r"(?<![A-Za-z])([A-Z])\.(?=[A-Z](?:\.|(?![A-Za-z])))", "$1")
    words = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    acronyms = F.filter(words, lambda w: w.rlike("^[A-Z]{3,}$"))
    names = F.transform(F.filter(words, lambda w: w.rlike("^[A-Z][a-zà-ù]{3,}$")), F.lower)
    return F.array_union(acronyms, names)


def overlap(a: Column, b: Column) -> Column:
    """Common members over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def subset_equal(a: Column, b: Column, glue: Column) -> Column:
    """Whether the words of one value, glue aside, are all among the other's."""
    x, y = F.array_except(a, glue), F.array_except(b, glue)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def pretty_key(key: Column) -> Column:
    """via_sede_legale: Via sede legale; acronyms in capitals."""
    parts = F.filter(F.split(key, "_"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w, i: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))).otherwise(F.lower(w))), " ")


def without_echo(label: Column, value: Column) -> Column:
    """The value without the label it repeats in front, at a word's end, if something is left."""
    rest = F.ltrim(F.substr(value, F.length(label) + 1))
    starts = F.lower(value).startswith(F.concat(F.lower(label), F.lit(" "))) & (F.length(label) > 0)
    return F.when(starts & (rest != ""), rest).otherwise(value)


def echo_length(before: Column, value: Column, most: int = 4) -> Column:
    """How many words, `most` at most, the value's head repeats of the text before it."""
    a, b = ascii_words(before), ascii_words(value)
    tries = F.filter(F.sequence(F.lit(most), F.lit(1), F.lit(-1)), lambda n: (F.size(a) >= n) & (F.size(b) >= n) & (F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n) == F.slice(b, 1, n)))
    return F.coalesce(F.get(tries, F.lit(0)), F.lit(0))


def excerpt(text: Column, value: Column, before: int = 100, after: int = 60) -> Column:
    """The text around the first place of a value."""
    at = F.position(value, text)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substr(text, start, at - start + F.length(value) + after)))


def clean_label(text: Column, left: bool) -> Column:
    """A label without filler runs: what stands after the last (looking left) or before the first (looking right)."""
    pattern = r"(?:_{3,}|\.{3,}|-{3,}|…+)"
    out = F.regexp_replace(text, f"^.*{pattern}", "") if left else F.regexp_replace(text, f"{pattern}.*$", "")
    return F.trim(out)


def filled_sentence(line: Column, value: Column) -> Column:
    """A form's line as one reads it: the own mark replaced by the value, others and filler runs by ___."""
    out = F.replace(line, F.lit("«QUI»"), F.concat(F.lit("[ "), F.substring(value, 1, 60), F.lit(" ]")))
    out = F.regexp_replace(out, "«[^»]*»", "___")
    out = F.regexp_replace(out, r"(?:\.[ ]?){3,}|(?:_[ ]?){3,}|(?:-[ ]?){3,}|(?:#[ ]?){3,}|(?:%[ ]?){3,}|(?:\*[ ]?){3,}|(?:\$[ ]?){3,}|(?:&[ ]?){3,}", "___ ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, 130)


def last_fenced_block(text: Column) -> Column:
    """The last block between fences, else the first {...}, else the text."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.trim(F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).when(braces != "", braces).otherwise(text))
