"""Schemas of the tables the operators exchange."""

from __future__ import annotations

WORD = (
    "doc_id string, page int, text string, x0 double, top double, x1 double, bottom double, "
    "confidence double"
)

PAGE = "doc_id string, page int, width double, height double, text string, char_count long"

ALTERNATIVE = (
    "struct<raw:string,value:string,amount:double,currency:string,page:int,bbox:array<double>,"
    "label:string,confidence:double,method:string>"
)

#: one row per (doc_id, field): what was read, where, and how sure the reading is
FIELD = (
    "doc_id string, field string, raw string, value string, amount double, currency string, "
    "page int, bbox array<double>, label string, confidence double, method string, "
    f"ambiguity_reasons array<string>, alternatives array<{ALTERNATIVE}>"
)

ROLE = (
    "struct<raw:string,value:string,amount:double,currency:string,page:int,bbox:array<double>,"
    "label:string,confidence:double,method:string,ambiguity_reasons:array<string>>"
)

#: one row per line item; ``index`` counts from 1 in reading order
LINE_ITEM = (
    f"doc_id string, index int, description {ROLE}, quantity {ROLE}, unit_price {ROLE}, "
    f"amount {ROLE}, raw string, row_raw string, page int, bbox array<double>, "
    "confidence double, method string"
)

REFERENCE = (
    "struct<invoice_number:string,normalized_invoice_number:string,vendor_name:string,"
    "normalized_vendor:string,purchase_order:string,normalized_purchase_order:string,"
    "issue_date:string,total:decimal(12,2),applied_to_po:decimal(12,2),status:string,"
    "database:string,document_id:string>"
)

#: procurement context of one document
CONTEXT = (
    "struct<"
    "scenario:string,"
    "vendor:struct<name:string,normalized_name:string,aliases:array<string>,vendor_id:string,"
    "tax_id:string>,"
    "buyer:struct<name:string,normalized_name:string>,"
    "invoice:struct<invoice_number:string,normalized_invoice_number:string,issue_date:string,"
    "due_date:string>,"
    "currency:string,"
    "purchase_order:struct<po_number:string,normalized:string,authorized_total:decimal(12,2),"
    "previously_consumed:decimal(12,2),remaining_before_invoice:decimal(12,2)>,"
    "invoice_total:decimal(12,2),"
    "approved_bank_account:string,"
    "invoice_payment:struct<bank_account:string,remit_to:string>,"
    f"previous_invoices:array<{REFERENCE}>,"
    f"duplicate_candidates:array<{REFERENCE}>,"
    "candidate_open_po:struct<po_number:string,normalized:string,vendor_name:string,"
    "normalized_vendor:string,authorized_total:decimal(12,2),remaining_balance:decimal(12,2)>,"
    "tolerance_policy:struct<percent:decimal(12,2),amount:decimal(12,2)>,"
    "amounts:map<string,decimal(12,2)>,"
    "variance_amount:decimal(12,2),"
    "expected_decision:string"
    ">"
)

AP_RECORD = (
    "id long, owner_user_id string, source_key string, vendor_name string, "
    "normalized_vendor string, purchase_order string, normalized_purchase_order string, "
    "invoice_number string, normalized_invoice_number string, invoice_total decimal(12,2), "
    f"issue_date date, scenario string, context {CONTEXT}, updated_at timestamp"
)

MONEY_PARTS = "struct<value:string,visible_value:string,display:string>"
DATED = "struct<value:string,display:string>"
PARTY = "struct<name:string,line1:string,city:string,email:string,tax_id:string>"
MANIFEST_ITEM = (
    "struct<line:int,sku:string,hsn:string,name:string,description:string,quantity:string,"
    f"quantity_display:string,unit_price:{MONEY_PARTS},amount:{MONEY_PARTS},service_date:{DATED}>"
)
MANIFEST_PAGE = (
    "struct<pdf_page_number:int,document_page_number:int,document_page_count:int,"
    "sample_id:string,line_item_numbers:array<int>,table_continues_from_previous_page:boolean,"
    "table_continues_after_page:boolean,renders_totals:boolean,total_placement:string,"
    "notes_near_table_bounds:boolean,"
    "components:array<struct<kind:string,bbox_mm:array<double>>>>"
)
MANIFEST_TABLE = (
    "struct<variant:string,columns:array<struct<key:string,label:string,numeric:boolean>>,"
    "show_description:boolean,total_placement:string,continued_across_pages:boolean>"
)
RAW_REFERENCE = (
    "struct<invoice_number:string,normalized_invoice_number:string,vendor_name:string,"
    "purchase_order:string,issue_date:string,total:string,invoice_total:string,"
    "applied_to_po:string,status:string,database:string,document_id:string,"
    "client_document_id:string,vendor_document_id:string>"
)
RAW_CONTEXT = (
    "struct<invoice_total:string,po_number:string,po_authorized_total:string,"
    "po_remaining_before_invoice:string,po_previously_consumed:string,"
    "tolerance_percent:string,tolerance_amount:string,variance_amount:string,"
    "currency:string,invoice_currency:string,po_currency:string,expected_currency:string,"
    "candidate_open_po:struct<po_number:string,vendor_name:string,authorized_total:string,"
    "remaining_balance:string>,"
    "vendor_master:struct<vendor_name:string,vendor_id:string,tax_id:string,"
    "approved_bank_account:string,aliases:array<string>>,"
    "invoice_payment:struct<bank_account:string,remit_to:string>,"
    f"prior_invoice:{RAW_REFERENCE},previous_related_document:{RAW_REFERENCE},"
    f"client_database:struct<previous_related_documents:array<{RAW_REFERENCE}>>,"
    f"vendor_database:struct<previous_related_documents:array<{RAW_REFERENCE}>>>"
)
MANIFEST_DOCUMENT = (
    "struct<document_id:string,sample_ids:array<string>,invoice_number:string,"
    f"purchase_order:string,status:string,seller:{PARTY},buyer:{PARTY},issue_date:{DATED},"
    f"due_date:{DATED},terms:string,currency:string,labels:map<string,string>,"
    f"amounts:map<string,{MONEY_PARTS}>,line_items:array<{MANIFEST_ITEM}>,table:{MANIFEST_TABLE},"
    f"pages:array<{MANIFEST_PAGE}>,challenge_tags:array<string>,edge_cases:array<string>,"
    f"ap_context:struct<scenario:string,context:{RAW_CONTEXT},expected:struct<decision:string>>>"
)
MANIFEST = (
    "schema_version int, suite string, fixture_slug string, "
    "pdf struct<filename:string,page_count:int>, challenge_tags array<string>, "
    f"documents array<{MANIFEST_DOCUMENT}>"
)
