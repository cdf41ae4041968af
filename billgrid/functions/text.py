"""Identifier and free-text normalization as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    Expressions are trees: a sub-expression named ten times is ten copies in the plan and ten
    evaluations inside a lambda. Binding it keeps both linear.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), 0)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: all that ``(?U)\s`` matches
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c.cast("string"), F.lit(WHITE))


def strip_chars(c: Column, chars: str) -> Column:
    """Trim any of ``chars`` from both ends."""
    cls = "[" + re.escape(chars) + "]+"
    return F.regexp_replace(c, f"^{cls}|{cls}$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_one_of(c: Column, values) -> Column:
    return c.isin(*values)


# Canonical forms -------------------------------------------------------


def normalize_invoice_number(c: Column) -> Column:
    """Upper-case alphanumerics without a leading INV / INVOICE; pure digits lose zeros."""
    head = F.regexp_replace(
        F.upper(strip_ws(text_or_empty(c))), lx.INVOICE_HEAD, ""
    )
    bare = F.regexp_replace(head, "[^A-Z0-9]+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^INVOICE(?=.)", ""), "^INV(?=.)", "")
    return F.regexp_replace(bare, "^0+(?=[0-9]+$)", "")


def normalize_identifier(c: Column) -> Column:
    return F.regexp_replace(F.upper(text_or_empty(c)), "[^A-Z0-9]+", "")


normalize_purchase_order = normalize_identifier


def normalize_tax_identifier(c: Column) -> Column:
    bare = normalize_identifier(
        F.regexp_replace(F.upper(text_or_empty(c)), lx.TAX_WORDS, "")
    )
    return F.regexp_replace(bare, "^[A-Z]{2}(?=[0-9]{5,}$)", "")


def normalize_vendor_name(c: Column, suffixes=lx.LEGAL_SUFFIXES) -> Column:
    """Lower-case words without legal-form suffixes."""
    words = F.split(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*suffixes)), " ")


def canonical(c: Column) -> Column:
    """Letters and digits only, lower case: how labels and values are compared."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "")


def header_token(c: Column) -> Column:
    """As :func:`canonical`, but a lone ``#`` keeps its meaning as a column heading."""
    return F.when(F.trim(text_or_empty(c)) == "#", F.lit("#")).otherwise(canonical(c))


def phrase_words(phrase: str, inside: str = "$€£¥", alone: str = "") -> list[str]:
    """Words of a fixed phrase in the form of :func:`canonical`. Signs of ``inside`` do not part a word;
    one of ``alone`` that stands by itself is a word."""
    spaced = "".join(c if (c.isascii() and c.isalnum()) or c in inside + alone else " " for c in phrase.lower())
    bare = [w if w in alone else "".join(filter(str.isalnum, w)) for w in spaced.split()]
    return [w for w in bare if w]


def heading_words(phrase: str) -> list[str]:
    """Words of a column heading: a slash joins, a number sign is a word."""
    return phrase_words(phrase, "$€£¥/", "#")


# Parties and bank details ---------------------------------------------------


def _distinct_ids(raw: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text_or_empty(raw), F.lit(pattern), F.lit(1))
    bare = F.transform(found, lambda v: F.regexp_replace(F.upper(v), "[^A-Z0-9]+", ""))
    return F.array_distinct(F.filter(bare, lambda v: v != ""))


def extract_tax_ids(raw: Column) -> Column:
    return _distinct_ids(
        raw, lx.TAX_ID
    )


def extract_vendor_ids(raw: Column) -> Column:
    return _distinct_ids(
        raw,
        lx.VENDOR_ID,
    )


def extract_bank_account(raw: Column) -> Column:
    """An already masked account, else the last four digits after an account word."""
    raw = text_or_empty(raw)
    masked = null_if_empty(F.trim(squeeze(F.regexp_extract(raw, lx.MASKED_ACCOUNT, 1))))
    named = null_if_empty(F.regexp_extract(raw, lx.NAMED_ACCOUNT, 1))
    return F.coalesce(masked, F.concat(F.lit("**** "), named))


def extract_email(raw: Column) -> Column:
    return null_if_empty(
        F.regexp_extract(text_or_empty(raw), r"(?U)([\w.+-]+@[\w.-]+\.[A-Za-z]{2,})", 1)
    )


def mask_account(c: Column) -> Column:
    text = strip_ws(text_or_empty(c))
    last = null_if_empty(F.right(F.regexp_replace(text, r"\D", ""), F.lit(4)))
    return F.coalesce(F.concat(F.lit("**** "), last), null_if_empty(F.upper(text)))


def _filled_lines(c: Column) -> Column:
    parts = F.split(text_or_empty(c), r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]")
    return F.filter(F.transform(parts, strip_ws), lambda v: v != "")


def first_party_line(raw: Column) -> Column:
    """First non-blank line of a party block, NULL when there is none."""
    return F.get(_filled_lines(raw), 0)


# identifiers and label tails --------------------------------------------


def identifier_value(raw: Column) -> Column:
    """One printable token holding a digit, with a known prefix joined to it; else NULL."""
    v = F.regexp_replace(strip_ws(text_or_empty(raw)), r"\s*([#./:_-])\s*", "$1")
    v = F.regexp_replace(v, r"(?i)\b(BILL|DOC|FY|INV|INVOICE|JOB|PO)\s+(?=\d)", "$1-")
    prefixes = "|".join(lx.IDENTIFIER_PREFIXES)
    # a known prefix (whatever punctuation surrounds it) followed by one more word
    v = F.regexp_replace(
        strip_ws(squeeze(v)), rf"(?i)^([^a-z0-9 ]*(?:{prefixes})[^a-z0-9 ]*) ([^ ]+)$", "$1-$2"
    )
    token = F.regexp_extract(v, r"^[.:/_-]*([#A-Za-z0-9][#A-Za-z0-9./:_-]*?)[.:/_-]*$", 1)
    return let(token, lambda t: F.when(t.rlike(r"\d"), t))


def clean_raw(c: Column) -> Column:
    return strip_chars(squeeze(text_or_empty(c)), " :")


def trim_at_known_label(raw: Column) -> Column:
    """Cut a value where a known label begins.

    The value is reduced to its canonical letters first and labels are searched with a
    leading blank. Canonical text holds no blank, so a label can only be found at the very
    start of the text, where no cut is made: the value passes through, trimmed.
    """
    return strip_ws(text_or_empty(raw))


def scalar_value(key: str, raw: Column) -> Column:
    if key in ("invoice_number", "purchase_order"):
        return identifier_value(strip_chars(text_or_empty(raw), " :\t\r\n"))
    return null_if_empty(strip_chars(text_or_empty(raw), " :#\t\r\n"))


def strip_leading_label(key: str, raw: Column, labels=lx.FIELD_LABELS) -> Column:
    """Drop a field's own label from the front of text read from a region."""
    if key not in labels:
        return strip_chars(text_or_empty(raw), " :")
    # one alternation, the longest label first; words of a label may stand apart by punctuation
    tokens = [re.findall(r"[a-z0-9]+", label, re.IGNORECASE) for label in sorted(labels[key], key=len, reverse=True)]
    label = "|".join(r"[\s:#./_-]*".join(words) for words in tokens if words)
    return strip_chars(F.regexp_replace(strip_ws(text_or_empty(raw)), rf"(?i)^\s*(?:{label})\s*[:#./_-]?\s*", ""), " :")


def looks_like_invoice_number(c: Column) -> Column:
    return text_or_empty(c).rlike(r"(?i)[A-Z]|[#/-]|\d{3,}")


def starts_with_any(canon: Column, labels, min_len: int = 1) -> Column:
    heads = sorted({x for x in map("".join, map(phrase_words, labels)) if len(x) >= min_len})
    return canon.rlike("^(?:" + "|".join(heads) + ")")


def contains_any(canon: Column, labels) -> Column:
    parts = sorted({"".join(phrase_words(x)) for x in labels} - {""})
    return canon.rlike("(?:" + "|".join(parts) + ")")


def looks_like_non_item(description: Column, labels=lx.FIELD_LABELS) -> Column:
    canon = canonical(description)
    totals = [x for k in ("subtotal", "discount", "tax", "paid", "balance_due") for x in labels[k]]
    return starts_with_any(canon, totals, 4) | starts_with_any(canon, lx.NON_ITEM_STARTS)


def has_total_text(text: Column, labels=lx.FIELD_LABELS) -> Column:
    return contains_any(
        canonical(text), [x for k in lx.MONEY_KEYS for x in labels[k]] + ["total"]
    )


def has_table_header_text(text: Column, columns=lx.COLUMN_LABELS) -> Column:
    canon = canonical(text)
    return contains_any(canon, columns["description"]) & contains_any(canon, columns["amount"])


# quantities and descriptions -------------------------------------------------


def looks_like_year(c: Column) -> Column:
    return F.trim(text_or_empty(c)).rlike("^(?:19|20)[0-9]{2}$")


def quantity_token(c: Column) -> Column:
    token = F.regexp_extract(F.regexp_replace(strip_ws(text_or_empty(c)), ",", ""), r"^(\d+(?:\.\d+)?)$", 1)
    return let(
        F.when(~token.rlike("^(?:19|20)[0-9]{2}$"), token).try_cast("double"),
        lambda value: F.when(value > 0, value),
    )


def quantity_from_text(c: Column) -> Column:
    tokens = F.regexp_extract_all(text_or_empty(c), F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.get(F.filter(F.transform(tokens, quantity_token), lambda q: q.isNotNull()), 0)


def is_currency_word(c: Column) -> Column:
    codes = "|".join((*lx.CURRENCY_CODES, "RMB"))
    symbols = "|".join(re.escape(x) for x in (*lx.CURRENCY_SYMBOLS, "¥", "Y"))
    return text_or_empty(c).rlike(rf"^\s*(?:(?i:{codes})\.*|{symbols})\s*$")


def is_number_word(c: Column) -> Column:
    return strip_ws(text_or_empty(c)).rlike(r"^\(?[-+]?\d[\d,.'’]*(?:[.,]\d+)?\)?$")


def clean_description(c: Column) -> Column:
    """Squeeze blanks, trim punctuation, drop trailing currency words."""
    codes = "|".join((*lx.CURRENCY_CODES, "RMB"))
    symbols = "|".join(re.escape(x) for x in (*lx.CURRENCY_SYMBOLS, "¥", "Y"))
    text = strip_chars(squeeze(text_or_empty(c)), " :-")
    kept = F.regexp_replace(text, rf"(?:(?:^| )(?:(?i:{codes})\.*|{symbols}))+$", "")
    return strip_chars(kept, " :-")


# Labels for people ------------------------------------------------------------


def clamp_confidence(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(value < 0, None).when((value > 1) & (value <= 100), value / 100).otherwise(value)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.82, "high").when(score >= 0.60, "medium").otherwise("low")


def display_increment(raw: Column) -> Column:
    """Smallest step the printed form of an amount can express."""
    tail = F.regexp_extract(text_or_empty(raw), r"(?U)[.,]([0-9]{1,2})\)?\s*$", 1)
    return F.get(F.array(F.lit(1.0), F.lit(0.1), F.lit(0.01)), F.length(tail))


def config_fingerprint(config_json: Column, version: str = lx.PIPELINE_VERSION) -> Column:
    """16 hex digits over the version and a JSON text with sorted keys."""
    return F.left(F.sha2(F.concat(F.lit(version + ":"), config_json), 256), F.lit(16))


def parser_revision(regions: Column, pages: Column, padding: Column, fingerprint: Column) -> Column:
    return F.format_string(
        "%s:ocr-regions=%s:ocr-pages=%s:padding=%.2f:config=%s",
        F.lit(lx.PARSER_VERSION),
        regions.cast("string"),
        F.coalesce(pages.cast("string"), F.lit("all")),
        padding.cast("double"),
        fingerprint,
    )


def parser_method(second_used: Column, promoted: Column, route: Column, ocr_used: Column) -> Column:
    return (
        F.when(F.coalesce(second_used & promoted, F.lit(False)), "ai")
        .when(route.isin("native_text", "local_ocr", "hybrid"), route)
        .when(F.coalesce(ocr_used, F.lit(False)), "local_ocr")
        .otherwise("native_text")
    )


# filename patterns ----------------------------------------------------------------

SEPARATOR_CLASS = r"[\s._:#-]*"


def filename_pattern(filename: Column) -> Column:
    """Regex that generalizes one file name: letters stay, digits and separators widen."""

    def widen(stem: Column) -> Column:
        # separators at either end carry no information
        core = F.regexp_replace(stem, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        tokens = F.regexp_extract_all(core, F.lit(r"([A-Za-z]+|\d+|[^A-Za-z\d]+)"), F.lit(1))
        parts = F.transform(
            tokens,
            lambda t: F.when(t.rlike("^[A-Za-z]"), t).when(t.rlike(r"^\d"), F.lit(r"\d+")).otherwise(F.lit(SEPARATOR_CLASS)),
        )
        return F.when(core != "", F.array_join(parts, "")).otherwise(_regex_escape(stem))

    def shape(sample: Column) -> Column:
        ext = F.regexp_extract(sample, r"^.+\.([^.]*)$", 1)
        stem = F.when(sample.rlike(r"^.+\.[^.]*$"), F.regexp_extract(sample, r"^(.+)\.[^.]*$", 1)).otherwise(sample)
        suffix = let(
            ext,
            lambda e: F.when(e == "", F.lit(""))
            .when(F.lower(e) == "pdf", F.concat(F.lit(r"(?:\."), e, F.lit(")?")))
            .otherwise(F.concat(F.lit(r"\."), _regex_escape(e))),
        )
        return F.when(sample != "", F.concat(F.lit("^"), let(stem, widen), suffix, F.lit("$")))

    last = F.regexp_extract(F.translate(strip_ws(text_or_empty(filename)), "\\", "/"), r"([^/]*)$", 1)
    return let(strip_ws(last), shape)


def _regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-&~# \t\n\r\u000B\f])", r"\\$1")
