"""Column functions against literal expectations."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billgrid.functions import boxes, dates, keys, money, similarity, text


def run(spark, values, expr, schema="v string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["out"] for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def V():
    return F.col("v")


@pytest.mark.parametrize(
    "fn, cases",
    [
        (text.normalize_invoice_number, {
            "INV-2024-001": "2024001", "Invoice No. 0042": "42", "inv#00099": "99", "INV": "",
            "000": "0", "A-0012": "A0012", "INVOICE INV 7": "7", None: "", "CM-17": "CM17",
        }),
        (text.normalize_purchase_order, {"PO-77 88": "PO7788", None: "", " po/1 ": "PO1"}),
        (text.normalize_vendor_name, {
            "ACME Supplies, Inc.": "acme supplies", "The Co Company": "the", None: "",
        }),
        (text.normalize_tax_identifier, {"VAT GB123456": "123456", "US-12": "US12", "EIN 12-3456789": "123456789"}),
        (text.extract_bank_account, {
            "Acct ending 00123456": "**** 3456", "Bank ****  7788": "**** 7788", "none": None,
        }),
        (text.extract_email, {"pay to ap@x-y.example.com now": "ap@x-y.example.com", "no": None}),
        (text.mask_account, {"12-345-6789": "**** 6789", "iban": "IBAN", " ": None, None: None}),
        (text.first_party_line, {"\n  \n Acme \nRoad": "Acme", "": None, None: None}),
        (text.identifier_value, {
            "PO-7788": "PO-7788", "INV 1042": "INV-1042", "#1204-26": "#1204-26",
            "VALIDATED IMPORT 488": None, "abc": None, "CM 9": "CM-9", "12 . 5": "12.5",
        }),
        (text.clean_raw, {" : a  b\u00a0c : ": "a b c"}),
        (text.quantity_token, {"1,200": 1200.0, "2.5": 2.5, "2024": None, "0": None, "10001": 10001.0, "x": None}),
        (text.quantity_from_text, {"about 3 units in 2024": 3.0, "in 2024": None}),
        (text.clean_description, {" - Widget  blue USD $ :": "Widget blue", "USD": "", "a - b": "a - b"}),
        (text.looks_like_non_item, {"Subtotal": True, "VAT 20%": False, "Page 2": True, "Taxi ride": False,
                                    "Terms apply": True, "Blue bolt": False}),
        (text.display_increment, {"USD 12": 1.0, "12.5": 0.1, "12,50": 0.01, "(12.50)": 0.01}),
        (text.confidence_level, {"0.9": "high", "0.7": "medium", "0.1": "low"}),
        (text.clamp_confidence, {"85": 0.85, "-1": None, "0.4": 0.4, "x": None}),
        (money.parse_amount, {
            "1,234.56": 1234.56, "1.234,56": 1234.56, "(48.00)": -48.0, "-5": -5.0, "1'234.50": 1234.5,
            "1,234": 1234.0, "12,5": 12.5, "1.234.567": 1234567.0, "1.234.56": 1234.56, "": None, "+7": 7.0,
            "1,234,567.8": 1234567.8,
        }),
        (money.normalize_currency, {"us$": None, "US$": "USD", "usd": "USD", "Rs.": "INR", "RMB": "CNY", "¥": None,
                                    "€": "EUR", "r": None, "R": "ZAR", "RS": "INR"}),
        (money.money_decimal, {"2.675": Decimal("2.68"), "x": None, None: None, " 7 ": Decimal("7.00")}),
        (money.money_key, {"1": "1.00", "z": ""}),
        (dates.normalize_date, {"2026-06-10T00:00": "2026-06-10", "soon": "soon", "": None, None: None}),
        (keys.message_id_from_resource, {"Users('a')/messages/'AB'": "AB", "x": None}),
        (keys.json_obj, {'{"a": 1}': '{"a":1}', "[1]": "{}", "nope": "{}", None: "{}"}),
        (keys.json_arr, {"[1,2]": "[1,2]", "{}": "[]", None: "[]"}),
    ],
)
def test_scalar_function(spark, fn, cases):
    assert run(spark, list(cases), fn(V())) == list(cases.values())


def test_filename_pattern(spark):
    got = run(
        spark,
        ["INV-2024-001.pdf", "C:\\x\\bill_7.PDF", "scan 12.txt", "--7--", "***"],
        text.filename_pattern(V()),
    )
    sep = r"[\s._:#-]*"
    assert got == [
        rf"^INV{sep}\d+{sep}\d+(?:\.pdf)?$",
        rf"^bill{sep}\d+(?:\.PDF)?$",
        rf"^scan{sep}\d+\.txt$",
        r"^\d+$",
        r"^\*\*\*$",
    ]


def test_money_mentions(spark):
    got = run(
        spark,
        ["USD 1,234.50 and 7", "2 USD 500", "€12,50 total", "20260710", "5", "Y 900 RMB", "no digits", "12 EUR"],
        money.money_mentions(V()),
    )
    flat = [[(m["raw"], m["amount"], m["currency"]) for m in row] for row in got]
    assert flat[0] == [("USD 1,234.50", 1234.5, "USD")]
    assert flat[1] == [("500", 500.0, None)]
    assert flat[2] == [("€12,50", 12.5, "EUR")]
    assert flat[3] == [] and flat[4] == [] and flat[6] == []
    assert flat[5] == [("Y 900 RMB", 900.0, None)]
    assert flat[7] == [("12 EUR", 12.0, "EUR")]


def test_parse_date(spark):
    cases = {
        "Invoice Date 2026-06-10": ("2026-06-10", "2026-06-10"),
        "Due 10 Jul 2026": ("10 Jul 2026", "2026-07-10"),
        "Doc Date 20260710": ("20260710", "2026-07-10"),
        "March 5, 26": ("March 5, 26", "2026-03-05"),
        "13/02/2026": ("13/02/2026", "2026-02-13"),
        "02/03/2026": ("02/03/2026", "2026-02-03"),
        "31.12.99": ("31.12.99", "1999-12-31"),
        "310299": None,
        "13022026": ("13022026", "2026-02-13"),
        "no date": None,
    }
    got = run(spark, list(cases), dates.parse_date(V()))
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_possible_dates(spark):
    got = run(spark, ["02/03/2026", "20260203", "020326", "31/12/2026", "x"], dates.possible_dates(V()))
    d = dt.date
    assert got == [[d(2026, 3, 2), d(2026, 2, 3)], [d(2026, 2, 3)], [d(2026, 3, 2), d(2026, 2, 3)],
                   [d(2026, 12, 31)], []]


def test_date_candidates(spark):
    got = run(
        spark, [("2026-02-03", "03/02/2026"), (None, "020326")],
        dates.date_candidates(F.col("v"), F.col("r")), "v string, r string",
    )
    assert set(got[0]) == {"2026-02-03", "2026-02-03", "2026-03-02"}
    assert set(got[1]) == {"2026-03-02", "2026-02-03"}


def test_received_at(spark):
    got = run(
        spark,
        [("1700000000000", None), (None, "Tue, 5 Mar 2024 09:07:01 +0200"), ("x", "5 Mar 2024 09:07:01"), (None, None)],
        dates.received_at(F.col("v"), F.col("h")).cast("string"), "v string, h string",
    )
    assert got == ["2023-11-14 22:13:20", "2024-03-05 07:07:01", "2024-03-05 09:07:01", None]


def test_similarity_matches_longest_blocks(spark):
    got = run(
        spark, [("acme supples", "acme supplies"), ("a", "a"), ("", ""), ("abcd", "bcde")],
        similarity.text_similarity(F.col("v"), F.col("w")), "v string, w string",
    )
    assert got[0] == pytest.approx(0.96) and got[1:3] == [1.0, 1.0] and got[3] == 0.75


def test_boxes(spark):
    b = F.array(*[F.lit(float(x)) for x in (10, 10, 20, 14)])
    got = run(spark, ["x"], boxes.pad_box(b, 0.5, F.lit(22.0), F.lit(100.0)))[0]
    assert got == [5.0, 8.0, 22.0, 16.0]
    got = run(spark, ["x"], boxes.min_pad_box(b, b, F.lit(100.0), F.lit(100.0)))[0]
    assert got == [2.0, 6.0, 28.0, 18.0]
    assert run(spark, ["x"], boxes.box_valid(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)))) == [False]


def test_strip_leading_label(spark):
    got = run(spark, ["Invoice No: INV-7", "PO", "INV-7"], text.strip_leading_label("invoice_number", V()))
    assert got == ["INV-7", "PO", "INV-7"]


def test_blocks_ratio_is_that_of_the_matcher():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    word = lambda chars: "".join(rng.choices(chars, k=rng.randint(0, 18)))
    pairs = [(word(chars), word(chars)) for chars in ("ab", "0123456789", "abc \U0001f600\u00e9") for _ in range(500)]
    pairs += [("", ""), ("a", ""), ("supplier 0010007", "supplier 000000107")]
    assert [similarity.blocks_ratio(*p) for p in pairs] == [SequenceMatcher(None, *p, autojunk=False).ratio() for p in pairs]
