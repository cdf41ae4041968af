"""Stored result tables derived from orders: accounts, files, messages, parses, decisions, work.

Each view is one SELECT in the dialect both Spark SQL and the checking engine read, so that
the same rows feed an operator and its check. ``{x}`` stands for a table or an earlier view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from billgrid.plans.fixtures import EXPECTED, table

_DEC = "CASE " + " ".join(f"WHEN o_orderkey % 8 = {i} THEN '{d}'" for i, d in enumerate(EXPECTED)) + " END"

VIEWS = {
    "accounts": """SELECT c_custkey AS id, n_name AS owner_user_id, 'gmail' AS provider,
        CASE WHEN c_custkey % 3 = 0 THEN 'User' ELSE 'user' END || CAST(FLOOR(c_custkey / 2) AS BIGINT) || '@example.com' AS email,
        CASE WHEN c_custkey % 10 = 0 THEN 'error' ELSE 'active' END AS status,
        'sub-' || c_custkey AS subscription_id, 'secret-' || (c_custkey % 7) AS client_state
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "files": """SELECT o_orderkey AS id, 'sha-' || o_orderkey AS sha256, o_orderkey * 10 AS byte_size,
        'sha-' || o_orderkey || '.pdf' AS storage_path FROM {orders} WHERE o_orderkey % 4 <> 3""",
    "attachments": """SELECT o_orderkey AS id, o_custkey AS account_id, CAST(FLOOR(o_orderkey / 3) AS BIGINT) AS message_id,
        'invoice_' || o_orderkey || '.pdf' AS filename, 'application/pdf' AS mime_type,
        CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS pdf_file_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'invoice_hint' ELSE 'pdf_attachment' END AS candidate_reason,
        CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders} WHERE o_orderkey % 6 <> 5""",
    "messages": """SELECT CAST(o_orderkey / 3 AS BIGINT) AS id, 'gmail' AS provider, 'm-' || o_orderkey AS provider_message_id,
        'sender-' || o_custkey AS sender, 'Invoice ' || o_orderkey AS subject, CAST(o_orderdate AS TIMESTAMP) AS received_at
        FROM {orders} WHERE o_orderkey % 3 = 0 AND o_orderkey % 12 <> 9""",
    "extractions": """SELECT n_name AS owner_user_id, o_orderkey AS pdf_file_id,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS attachment_id, c_name AS vendor_name,
        CASE WHEN o_orderkey % 7 <> 0 THEN 'INV-' || o_orderkey END AS invoice_number, 'PO-' || o_orderkey AS purchase_order,
        CAST(o_totalprice AS DECIMAL(12,2)) AS amount_due, 'USD' AS currency,
        CASE WHEN o_orderkey % 5 < 2 THEN 'needs_review' ELSE 'parsed' END AS parse_status, 'native_text' AS parser_method,
        CAST(0.9 AS DECIMAL(5,3)) AS confidence, CAST(o_orderdate AS TIMESTAMP) AS updated_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "decisions": f"""SELECT n_name AS owner_user_id, o_orderkey AS pdf_file_id, {_DEC} AS decision, 'medium' AS confidence,
        'summary ' || (o_orderkey % 8) AS summary, 'action ' || (o_orderkey % 8) AS next_action
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey WHERE o_orderkey % 4 <> 1""",
    "parses": """SELECT o_orderkey AS pdf_file_id, CASE WHEN o_orderkey % 5 < 2 THEN 'needs_review' ELSE 'parsed' END AS status,
        CASE WHEN o_orderkey % 2 = 0 THEN 'rev1' ELSE 'rev2' END AS parser_version,
        '{"ocr_used": ' || CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END || ', "ocr_failed_parts": '
        || CASE WHEN o_orderkey % 11 = 0 THEN '["tax"]' ELSE '[]' END || ', "warnings": '
        || CASE WHEN o_orderkey % 13 = 0 THEN '["Full-document OCR failed: x"]' ELSE '["other"]' END
        || ', "fields": {"invoice_number": {"value": "P-' || o_orderkey || '"}, "tax": {"amount": 1}}}' AS result,
        CASE WHEN o_orderkey % 3 = 0 THEN '["w1","w2"]' WHEN o_orderkey % 3 = 1 THEN '{"a":1}' ELSE 'broken' END AS warnings,
        CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {orders} WHERE o_orderkey % 9 <> 8""",
    "jobs": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'gmail_history_sync' ELSE 'parse_pdf' END AS type,
        '{"pdf_file_id": "' || o_orderkey || '"}' AS payload, 'job-' || CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS unique_key,
        CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'running' ELSE 'failed' END AS status,
        CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate + INTERVAL 2 DAY AS TIMESTAMP) AS updated_at
        FROM {orders} WHERE o_orderkey % 3 <> 2""",
    "known_keys": """SELECT 'job-' || CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS unique_key, 'parse_pdf' AS type,
        CAST(o_orderdate AS TIMESTAMP) AS first_seen_at, CASE WHEN o_orderkey % 14 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS completed_at,
        CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM {orders} WHERE o_orderkey % 14 = 0 OR o_orderkey % 14 = 6""",
}
BASE = ("orders", "customer", "nation")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One stored table as a DataFrame."""
    frames = {b: table(spark, sf, b) for b in BASE if "{" + b + "}" in VIEWS[name]}
    text = VIEWS[name]
    # only table placeholders are filled; JSON braces in the text stay as they are
    for b, df in frames.items():
        df.createOrReplaceTempView(f"_stored_{b}")
        text = text.replace("{" + b + "}", f"_stored_{b}")
    return spark.sql(text)


def cte(*names: str) -> str:
    """The same views as a WITH clause."""
    parts = []
    for n in names:
        text = VIEWS[n]
        for b in BASE:
            text = text.replace("{" + b + "}", b)
        parts.append(f"{n} AS ({text})")
    return "WITH " + ",\n".join(parts)
