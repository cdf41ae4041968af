"""Money in text and as decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrid.functions import lexicon as lx
from billgrid.functions.text import let, strip_chars, strip_ws, text_or_empty

MONEY = "decimal(12,2)"

#: prefix, number, suffix, and (looking ahead only) whether another number follows
MENTION_PATTERN = (
    rf"(?i)({lx.CURRENCY_PATTERN})?\s*({lx.NUMBER_PATTERN})\s*({lx.CURRENCY_PATTERN})?(?=(\s+\d)?)"
)


def money_decimal(c: Column) -> Column:
    """Two decimals, half up; NULL for anything that is not a number."""
    return c.try_cast(MONEY)


def parse_amount(raw: Column) -> Column:
    """Number text to double: parentheses or minus negate, either separator may be decimal."""

    def plain(v: Column) -> Column:
        """Digits with a decimal point, from digits with any separators."""
        short_tail = v.rlike(r"[.,][^.,]{1,2}$")
        # every separator but the last one groups thousands
        last_is_decimal = F.translate(F.regexp_replace(v, r"[.,](?=.*[.,])", ""), ",", ".")
        return (
            F.when(~v.rlike(r"\d"), None)
            .when(~v.contains(","), F.when(v.rlike(r"\..*\."), F.when(short_tail, last_is_decimal).otherwise(F.translate(v, ".", ""))).otherwise(v))
            .when(v.rlike(r"\..*,[^.]*$"), F.translate(F.translate(v, ".", ""), ",", "."))
            .when(v.contains(".") | ~short_tail, F.translate(v, ",", ""))
            .otherwise(last_is_decimal)
        )

    def signed(text: Column) -> Column:
        bare = F.translate(strip_chars(text, "()"), "'’ +", "")
        size = let(F.regexp_replace(bare, "^-", ""), plain).try_cast("double")
        return F.when(text.rlike(r"^\(.*\)$") | text.rlike(r"^[(]*[ +'’]*-"), -size).otherwise(size)

    return let(strip_ws(text_or_empty(raw)), signed)


def normalize_currency(raw: Column) -> Column:
    """ISO code of a code, alias or symbol; the bare yen glyph stays unknown."""
    exact = F.create_map(*[F.lit(x) for kv in lx.CURRENCY_SYMBOLS.items() for x in kv])
    codes = {**{c: c for c in lx.CURRENCY_CODES}, "RMB": "CNY", "RS": "INR"}
    upper = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return let(
        strip_ws(text_or_empty(raw)),
        lambda v: F.coalesce(
            F.try_element_at(upper, F.regexp_replace(F.upper(v), r"\.+$", "")), F.try_element_at(exact, v)
        ),
    )


def _plausible_without_currency(number: Column) -> Column:
    digits = F.length(F.regexp_replace(number, r"\D", ""))
    return (digits > 1) & ~((digits == 8) & number.rlike(r"^\d{8}$"))


def money_mentions(text: Column) -> Column:
    """All amounts in a text, in order: ``array<struct<raw, amount, currency>>``."""
    src = F.when(text.rlike(r"\d"), text)

    def group(i: int) -> Column:
        return F.regexp_extract_all(src, F.lit(MENTION_PATTERN), F.lit(i))

    zipped = F.arrays_zip(
        group(0).alias("raw"), group(1).alias("pre"), group(2).alias("num"),
        group(3).alias("suf"), group(4).alias("next"),
    )
    def keep(m: Column) -> Column:
        # "12 USD 500": a short count whose currency belongs to the number behind it
        borrowed = (
            (m["suf"] != "") & (m["pre"] == "")
            & strip_ws(m["num"]).rlike(r"^\d{1,2}$") & (m["next"] != "")
        )
        has_currency = (m["pre"] != "") | (m["suf"] != "")
        return ~borrowed & (has_currency | _plausible_without_currency(m["num"]))

    shaped = F.transform(
        F.filter(zipped, keep),
        lambda m: F.struct(
            strip_ws(m["raw"]).alias("raw"),
            parse_amount(m["num"]).alias("amount"),
            normalize_currency(F.when(m["pre"] != "", m["pre"]).otherwise(m["suf"])).alias("currency"),
        ),
    )
    return F.coalesce(
        F.filter(shaped, lambda m: m["amount"].isNotNull()),
        F.expr("cast(array() as array<struct<raw:string,amount:double,currency:string>>)"),
    )


def has_money(text: Column) -> Column:
    return F.size(money_mentions(text)) > 0


def last_money(text: Column) -> Column:
    return F.try_element_at(money_mentions(text), F.lit(-1))


def currency_for_money(mention: Column, inferred: Column) -> Column:
    """The mention's own currency, else the document's; a yen glyph only takes CNY or JPY."""
    yen = mention["raw"].rlike(r"(?i)(?:¥|\bY\b)")
    return F.coalesce(
        mention["currency"],
        F.when(~yen | inferred.isin("CNY", "JPY"), inferred),
    )


def currency_in_text(text: Column) -> Column:
    """First recognizable currency of a text as ``struct<raw, value>``, else NULL."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(f"(?i)({lx.CURRENCY_PATTERN})"), F.lit(1))
    pairs = F.filter(
        F.transform(found, lambda t: F.struct(t.alias("raw"), normalize_currency(t).alias("value"))),
        lambda p: p["value"].isNotNull(),
    )
    return F.get(pairs, 0)


def amount_display(amount: Column, currency: Column) -> Column:
    shown = F.format_number(amount.try_cast("decimal(18,2)"), 2)
    code = F.trim(text_or_empty(currency))
    return F.when(shown.isNotNull(), F.when(code != "", F.concat_ws(" ", code, shown)).otherwise(shown))


def money_equal(a: Column, b: Column) -> Column:
    return F.coalesce(a.try_cast("decimal(18,2)") == b.try_cast("decimal(18,2)"), F.lit(False))


def money_key(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(18,2)").cast("string"), F.lit(""))


def visible_money(value: Column, decimals: Column) -> Column:
    """Text of ``value`` rounded half up to the printed number of decimals."""
    exact = value.try_cast("decimal(18,6)")
    out = F.round(exact, 0).cast("decimal(18,0)").cast("string")
    for n in (1, 2, 3, 4):
        out = F.when(decimals == n, F.round(exact, n).cast(f"decimal(18,{n})").cast("string")).otherwise(out)
    return out
