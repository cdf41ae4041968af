"""Fixed values of the invoice domain: label phrases, codes, thresholds.

These word lists and numbers define what counts as a label, a table column, a currency or a
confident reading. They are data, stated as they are; every operator takes them as
parameters with these defaults.
"""

from __future__ import annotations

# --- fixed values: label phrases of each field, in order of preference ---------------
INVOICE_NUMBER_LABELS = (
    "credit memo number", "credit memo no", "invoice number", "invoice no", "invoice #",
    "bill id", "bill no", "doc #", "document number", "voucher no", "reference", "note ref",
    "receipt id", "account ref", "inv ref", "request no", "serial", "ticket", "batch id",
    "folio", "no.",
)
ISSUE_DATE_LABELS = (
    "invoice date", "issue date", "issued", "bill dt", "bill date", "date", "raised on",
    "posting date", "dated", "created", "printed", "account date", "inv date",
    "request date", "doc date", "work date", "batch date", "fecha",
)
DUE_DATE_LABELS = (
    "due date", "due", "pay by", "payment before", "settle by", "collection date",
    "last date", "clear by", "balance on", "payment target", "collection", "needed by",
    "cash date", "payment cutoff", "release date", "limite pago",
)
PURCHASE_ORDER_LABELS = (
    "purchase order", "related po", "po number", "po ref", "po", "order ref", "buyer ref",
    "client order", "contract", "job no", "auth ref", "ref code", "work ref", "budget ref",
    "batch", "site order", "control", "orden",
)
TERMS_LABELS = (
    "terms", "pay terms", "payment terms", "agreement", "credit", "settlement",
    "credit days", "window", "policy", "basis", "payment rule", "cycle", "contract term",
    "run terms", "condiciones",
)
SELLER_LABELS = (
    "from", "seller", "supplier", "provider", "remit from", "issuer", "prepared by",
    "merchant", "origin", "vendor", "payee", "consignor", "entity", "contractor", "source",
    "emisor",
)
BUYER_LABELS = (
    "bill to", "billed to", "customer", "client", "account", "to", "charged to", "payer",
    "destination", "recipient", "consignee", "requester", "counterparty", "site", "payor",
    "receptor",
)
SUBTOTAL_LABELS = (
    "subtotal", "credit subtotal", "goods value", "billed amount", "net services",
    "taxable value", "charge total", "debit total", "items total", "value before tax",
    "assessable", "requested amount", "sheet total", "work value", "batch sum",
)
DISCOUNT_LABELS = (
    "discount", "less disc", "less discount", "allowance", "rebate", "deduction",
    "adjustment", "credit adj", "promo", "offset", "scheme disc", "withheld", "less",
    "retention", "holdback", "descuento",
)
TAX_LABELS = (
    "tax", "gst", "sales tax", "vat", "tax charged", "cgst sgst", "tax add-on",
    "consumption tax", "iva",
)
SHIPPING_LABELS = (
    "shipping", "freight", "handling", "expenses", "carriage", "delivery", "other fees",
    "service", "logistics", "transport", "pass-through", "move cost", "travel", "admin",
    "envio",
)
PAID_LABELS = (
    "paid", "received", "payment received", "advance", "settled", "credit", "already paid",
    "applied", "tendered", "deposit", "released", "cleared", "progress pay", "abonado",
)
BALANCE_DUE_LABELS = (
    "balance due", "credit balance", "amount due", "total due", "left balance",
    "remaining payment", "open amount", "amount open", "left to pay", "outstanding",
    "amount left", "net due", "receivable", "unreleased", "not cleared", "final claim",
    "pending release", "saldo",
)
PAYMENT_LABELS = (
    "payment instructions", "payment", "bank details", "settlement", "remittance",
    "payable to", "payment route", "transfer info", "tender", "funds", "upi bank", "bank",
    "eft detail", "clearing", "forma de pago", "remit",
)

FIELD_LABELS: dict[str, tuple[str, ...]] = {
    "invoice_number": INVOICE_NUMBER_LABELS,
    "issue_date": ISSUE_DATE_LABELS,
    "due_date": DUE_DATE_LABELS,
    "purchase_order": PURCHASE_ORDER_LABELS,
    "terms": TERMS_LABELS,
    "seller": SELLER_LABELS,
    "buyer": BUYER_LABELS,
    "subtotal": SUBTOTAL_LABELS,
    "discount": DISCOUNT_LABELS,
    "tax": TAX_LABELS,
    "shipping": SHIPPING_LABELS,
    "paid": PAID_LABELS,
    "balance_due": BALANCE_DUE_LABELS,
    "payment_instructions": PAYMENT_LABELS,
}

# --- fixed values: table header words by column role ---------------------------------
COLUMN_LABELS: dict[str, tuple[str, ...]] = {
    "description": (
        "item", "particulars", "description", "work", "charge", "narration", "memo",
        "line", "supply", "billing description", "material", "task", "details", "concept",
    ),
    "quantity": ("qty", "quantity", "count", "units", "unit", "hours", "nos", "pack", "time"),
    "unit_price": ("rate", "price", "unit fee", "basic", "each"),
    "amount": (
        "amount", "amt", "billed amt", "line total", "net", "taxable", "payable", "debit",
        "ext", "value", "tax inv val", "charge", "rmb amt", "due amt", "jpy", "importe",
    ),
    "other": (
        "#", "ln", "sku", "code", "hsn", "hsn sac", "hsn/sac", "service date", "txn date",
        "applied", "ref", "job",
    ),
}
COLUMN_ROLE_SCORE = {"amount": 5, "unit_price": 4, "description": 3, "quantity": 2, "other": 1}

# --- fixed values: words that end or disqualify a block ------------------------------
AMBIGUOUS_PARTY_LABELS = ("account", "to", "site", "entity", "source")
PARTY_NOISE_TOKENS = (
    "date", "order", "ref", "reference", "number", "no", "id", "total", "subtotal",
    "amount", "value", "charge", "tax", "rate", "qty", "quantity",
)
NON_ITEM_STARTS = (
    "payment instructions", "payment", "bank details", "settlement", "remittance", "terms",
    "notes", "note", "footer", "page", "thank you",
)
TITLE_WORDS = ("invoice", "taxinvoice", "statement", "receipt")
IDENTIFIER_PREFIXES = ("bill", "cm", "doc", "fy", "inv", "invoice", "job", "po")
LEGAL_SUFFIXES = ("llc", "inc", "ltd", "limited", "corp", "corporation", "co", "company")

# --- fixed values: currencies and months ---------------------------------------------
CURRENCY_CODES = (
    "USD", "INR", "EUR", "GBP", "AED", "SGD", "CAD", "AUD", "CNY", "JPY", "ZAR", "MXN",
)
CURRENCY_SYMBOLS = {
    "US$": "USD", "$": "USD", "Rs": "INR", "Rs.": "INR", "€": "EUR", "£": "GBP",
    "S$": "SGD", "C$": "CAD", "A$": "AUD", "RMB": "CNY", "R": "ZAR", "Mex$": "MXN",
}
CURRENCY_PATTERN = (
    r"USD|INR|EUR|GBP|AED|SGD|CAD|AUD|CNY|JPY|ZAR|MXN|RMB|Mex\$|US\$|S\$|C\$|A\$|Rs\.?|[$€£¥YR]"
)
NUMBER_PATTERN = r"\(?[-+]?\d(?:[\d\s,.'’]*\d)?(?:[.,]\d{1,2})?\)?"
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4,
    "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}

# --- fixed values: keys and thresholds -----------------------------------------------
SCALAR_KEYS = ("invoice_number", "issue_date", "due_date", "purchase_order", "terms")
MONEY_KEYS = ("subtotal", "discount", "tax", "shipping", "paid", "balance_due")
FIELD_KEYS = (
    "invoice_number", "issue_date", "due_date", "purchase_order", "terms", "currency",
    "seller", "buyer", "subtotal", "discount", "tax", "shipping", "paid", "balance_due",
    "payment_instructions",
)
REQUIRED_KEYS = (
    "invoice_number", "issue_date", "due_date", "currency", "seller", "buyer", "balance_due",
)
CRITICAL_KEYS = (
    "vendor", "buyer", "invoice_number", "issue_date", "due_date", "currency", "amount_due",
)
TRACKED_KEYS = (
    "vendor", "buyer", "invoice_number", "issue_date", "due_date", "purchase_order",
    "currency", "amount_due",
)
TRUTH_MONEY_KEYS = ("subtotal", "discount", "tax", "shipping", "paid", "total", "balance_due")

LOW_CONFIDENCE = 0.70          # normalized fields below this need a person
REVIEW_CONFIDENCE = 0.80       # parsed fields below this need a person
SECOND_SOURCE_CONFIDENCE = 0.85  # readings of a second source are held to this
AMBIGUOUS_MIN_CONFIDENCE = 0.70  # enough to settle an ambiguous field
FUZZY_VENDOR = 0.85
MAX_ATTACHMENT_BYTES = 25 * 1024 * 1024
PARSER_VERSION = "static-pdf-v4"
PIPELINE_VERSION = "local-adaptive-v4"

REVIEW_DECISIONS = (
    "needs_review", "request_missing_info", "flag_possible_duplicate", "block_or_escalate",
    "apply_credit_or_route_review",
)
DURABLE_WORK_TYPES = ("gmail_message_fetch", "outlook_message_fetch", "parse_pdf")

# --- fixed values: where a missing field is likely to be read again ------------------
REGION_PRIORITY = {
    "invoice_number": 0, "issue_date": 1, "due_date": 2, "balance_due": 3, "subtotal": 4,
    "tax": 5, "shipping": 6, "discount": 7, "paid": 8, "currency": 9, "purchase_order": 10,
    "terms": 11, "payment_instructions": 12, "seller": 13, "buyer": 14, "amount": 20,
    "unit_price": 21, "quantity": 22, "description": 23, "line_items": 24,
}
REGION_HINTS: dict[str, tuple[str, ...]] = {
    "invoice_number": ("invoice no", "invoice #", "invoice number", "bill no"),
    "issue_date": ("invoice date", "issue date", "bill date"),
    "due_date": ("due date", "pay by", "payment before"),
    "purchase_order": ("purchase order", "po number", "po #", "po ref"),
    "terms": ("payment terms", "terms", "net "),
    "seller": ("seller", "supplier", "vendor", "from"),
    "buyer": ("bill to", "buyer", "customer", "client"),
    "subtotal": ("subtotal", "net amount"),
    "tax": ("tax", "vat", "gst"),
    "balance_due": ("balance due", "amount due", "grand total", "total"),
    "payment_instructions": ("payment instructions", "bank", "iban", "swift", "remit"),
    "line_items": ("description", "quantity", "qty", "unit price", "amount"),
}
BOTTOM_FIELDS = (
    "subtotal", "discount", "tax", "shipping", "paid", "balance_due", "payment_instructions",
)
LINE_ITEM_MENTIONS = ("description", "item", "quantity", "qty", "unit price", "amount")

# --- fixed values: sentences of checks, summaries and next actions --------------------
DECISION_TEXTS = {
    "parser_reported_no_usable_text": "Parser reported no usable text layer.",
    "parser_extracted_a_usable_text": "Parser extracted a usable text layer.",
    "missing_critical_fields": "Missing critical fields: ",
    "critical_invoice_fields_were_extracted": "Critical invoice fields were extracted.",
    "low_confidence_parsed_fields": "Low-confidence parsed fields: ",
    "parsed_fields_meet_confidence_threshold": "Parsed fields meet confidence threshold.",
    "parser_completed_without_review_status": "Parser completed without review status.",
    "parser_marked_the_invoice_as": "Parser marked the invoice as needing review.",
    "parser_did_not_produce_an": "Parser did not produce an approvable result (",
    "procurement_context_loaded": "Procurement context loaded.",
    "procurement_context_is_unavailable": "Procurement context is unavailable.",
    "no_approved_vendor_identity_is": "No approved vendor identity is available in accounts payable context.",
    "invoice_vendor_matches_approved_vendor": "Invoice vendor matches approved vendor.",
    "invoice_vendor_matches_an_approved": "Invoice vendor matches an approved vendor alias.",
    "invoice_vendor_tax_identifier_matches": "Invoice vendor tax identifier matches approved vendor.",
    "invoice_vendor_identifier_matches_approved": "Invoice vendor identifier matches approved vendor.",
    "invoice_vendor_is_a_close": "Invoice vendor is a close fuzzy match and requires identity review.",
    "invoice_vendor_does_not_match": "Invoice vendor does not match approved vendor.",
    "accounts_payable_context_does_not": "Accounts payable context does not specify an expected buyer.",
    "invoice_buyer_matches_the_approved": "Invoice buyer matches the approved bill-to entity.",
    "invoice_buyer_does_not_match": "Invoice buyer does not match the approved bill-to entity.",
    "invoice_monetary_fields_contain_inconsistent": "Invoice monetary fields contain inconsistent currencies.",
    "accounts_payable_context_does_not_specify": "Accounts payable context does not specify an expected currency.",
    "invoice_currency_matches_accounts_payable": "Invoice currency matches accounts payable context.",
    "invoice_currency_does_not_match": "Invoice currency does not match accounts payable context.",
    "normalized_invoice_number_matches_a": "Normalized invoice number matches a prior invoice candidate.",
    "no_duplicate_invoice_candidate_matched": "No duplicate invoice candidate matched.",
    "accounts_payable_context_does_not_specify_an": "Accounts payable context does not specify an expected invoice number.",
    "invoice_number_matches_the_accounts": "Invoice number matches the accounts payable record.",
    "invoice_number_does_not_match": "Invoice number does not match the accounts payable record.",
    "accounts_payable_context_does_not_specify_expected": "Accounts payable context does not specify expected invoice dates.",
    "invoice_date_fields_do_not": "Invoice date fields do not match accounts payable context: ",
    "invoice_dates_match_accounts_payable": "Invoice dates match accounts payable context.",
    "no_approved_bank_account_override": "No approved bank account override is present in accounts payable context.",
    "invoice_bank_account_matches_vendor": "Invoice bank account matches vendor master.",
    "invoice_bank_account_differs_from": "Invoice bank account differs from vendor master.",
    "credit_memo_or_negative_balance": "Credit memo or negative balance detected.",
    "invoice_is_not_a_credit": "Invoice is not a credit memo or negative payable.",
    "invoice_omits_a_purchase_order": "Invoice omits a purchase order.",
    "invoice_purchase_order_does_not": "Invoice purchase order does not match accounts payable context.",
    "invoice_purchase_order_matches_accounts": "Invoice purchase order matches accounts payable context.",
    "route_to_review_and_attach": "Route to review and attach candidate PO ",
    "request_the_purchase_order_reference": "Request the purchase order reference or route to non-purchase-order accounts payable review.",
    "review_the_po_mismatch_before": "Review the PO mismatch before approval.",
    "accounts_payable_amount_components": "accounts payable amount components",
    "invoice_does_not_expose_a": "Invoice does not expose a subtotal for amount composition reconciliation.",
    "invoice_balance_due_is_unavailable": "Invoice balance due is unavailable for amount composition reconciliation.",
    "invoice_amount_composition_does_not": "Invoice amount composition does not reconcile: ",
    "subtotal_discounts_aggregate_tax_shipping": "Subtotal, discounts, aggregate tax, shipping, payments, and balance due reconcile.",
    "no_prior_po_consumption_is": "No prior PO consumption is present.",
    "partial_po_context_is_present": "Partial PO context is present, but invoice amount or PO balance is missing.",
    "invoice_amount_is_within_remaining": "Invoice amount is within remaining PO balance.",
    "invoice_amount_exceeds_remaining_po": "Invoice amount exceeds remaining PO balance.",
    "invoice_amount_or_accounts_payable": "Invoice amount or accounts payable expected amount is missing.",
    "invoice_amount_matches_accounts_payable": "Invoice amount matches accounts payable expected amount.",
    "invoice_amount_variance_is_within": "Invoice amount variance is within tolerance.",
    "invoice_amount_variance_exceeds_tolerance": "Invoice amount variance exceeds tolerance.",
    "resolve_the_parser_review_findings": "Resolve the parser review findings and re-parse the invoice before approval.",
    "invoice_text_could_not_be": "Invoice text could not be extracted.",
    "request_a_text_searchable_invoice": "Request a text-searchable invoice PDF or run OCR before accounts payable review.",
    "required_invoice_fields_are_missing": "Required invoice fields are missing.",
    "ask_the_vendor_for_the": "Ask the vendor for the missing invoice fields before matching to accounts payable context.",
    "validate_the_low_confidence_fields": "Validate the low-confidence fields against the source invoice before approval.",
    "procurement_context_is_missing": "Procurement context is missing.",
    "load_po_vendor_master_duplicate": "Load PO, vendor master, duplicate, and payment context before approving payment.",
    "review_vendor_identity_aliases_and": "Review vendor identity, aliases, and tax identifiers before approving payment.",
    "confirm_that_the_invoice_is": "Confirm that the invoice is billed to the approved legal entity before approval.",
    "confirm_invoice_and_purchase_order": "Confirm invoice and purchase-order currency before comparing monetary amounts.",
    "invoice_may_duplicate_a_prior": "Invoice may duplicate a prior vendor invoice.",
    "hold_payment_and_compare_the": "Hold payment and compare the candidate prior invoice before posting.",
    "resolve_the_invoice_number_mismatch": "Resolve the invoice-number mismatch against the matched accounts payable record.",
    "resolve_invoice_or_due_date": "Resolve invoice or due-date differences against accounts payable context.",
    "invoice_payment_details_differ_from": "Invoice payment details differ from the approved vendor master.",
    "block_payment_and_escalate_the": "Block payment and escalate the bank detail change for vendor verification.",
    "invoice_appears_to_be_a": "Invoice appears to be a credit memo or negative payable.",
    "apply_the_credit_to_open": "Apply the credit to open liability or route to accounts payable review if no matching payable is open.",
    "reconcile_subtotal_discounts_aggregate_tax": "Reconcile subtotal, discounts, aggregate tax, shipping, payments, and balance due before approval.",
    "invoice_fits_within_the_remaining": "Invoice fits within the remaining PO balance after prior consumption.",
    "approve_the_invoice_and_consume": "Approve the invoice and consume the remaining PO balance by the invoice amount.",
    "resolve_the_remaining_purchase_order": "Resolve the remaining purchase-order balance before approval.",
    "invoice_variance_is_within_the": "Invoice variance is within the configured accounts payable tolerance.",
    "approve_with_a_tolerance_note": "Approve with a tolerance note in the audit trail.",
    "invoice_amount_is_outside_the": "Invoice amount is outside the configured accounts payable tolerance.",
    "route_to_accounts_payable_review": "Route to accounts payable review for purchase order variance approval or vendor correction.",
    "load_the_missing_expected_amount": "Load the missing expected amount and route the invoice for accounts payable review.",
    "vendor_purchase_order_payment_details": "Vendor, purchase order, payment details, duplicate check, and amount match accounts payable context.",
    "approve_the_invoice_for_payment": "Approve the invoice for payment.",
}

# --- fixed values: patterns of numbers and identifiers ---------------------------------
INVOICE_HEAD = r"^(?:INVOICE|INV)(?:\s*NO\.?|\s*#)?\s*"
TAX_WORDS = r"\b(?:TAX\s*ID|VAT|GSTIN|GST|EIN)\b"
TAX_ID = r"(?i)\b(?:tax\s*id|vat|gstin|gst|ein)\s*[:#-]?\s*([A-Z0-9][A-Z0-9 -]{4,24})"
VENDOR_ID = r"(?i)\b(?:vendor|supplier)\s*(?:id|number|no\.?)\s*[:#-]?\s*([A-Z0-9][A-Z0-9-]{2,24})"
MASKED_ACCOUNT = r"(\*{2,}\s*\d{2,})"
NAMED_ACCOUNT = r"(?i)(?:account|acct|ending)\D{0,12}\d*(\d{4})"
MONTH_NAME_DATE = r"\b(?:(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{2,4})|([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{2,4}))\b"
SEPARATED_DATE = r"\b(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})\b"
COMPACT_DATE = r"\b(\d{8}|\d{6})\b"
SHORT_SEPARATED_DATE = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b"

# --- fixed values: sentences of contexts and warnings ----------------------------------
NO_CONTEXT_MATCHED = "No accounts payable context record matched the invoice."
NO_CONTEXT_GIVEN = "Procurement context was not provided."
ITEM_SUM_WARNING = "Line item amount sum %.2f does not match %s %.2f."
MISSING_FIELD_WARNING = "Could not confidently extract required normalized field "
FAILED_VALIDATION_WARNING = "Invoice validation failed: "
