"""SQL counterparts of the invoice views, for the checking engine."""

DEC = "DECIMAL(12,2)"

INV = f"""
li AS (
  SELECT l_orderkey AS k, MIN(l_suppkey) AS suppkey,
    CAST(SUM(CAST(l_extendedprice AS {DEC})) AS {DEC}) AS subtotal,
    CAST(SUM(CAST(CAST(l_extendedprice AS {DEC}) * CAST(l_discount AS DECIMAL(4,2)) AS {DEC})) AS {DEC}) AS discount,
    CAST(SUM(CAST(CAST(l_extendedprice AS {DEC}) * CAST(l_tax AS DECIMAL(4,2)) AS {DEC})) AS {DEC}) AS tax,
    COUNT(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey),
inv AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS doc_id, n_name AS owner,
    printf('INV-%06d', o_orderkey) AS invoice_number,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'PO-' || o_orderkey END AS purchase_order,
    s_name AS vendor, c_name AS buyer, suppkey, CAST(o_orderdate AS DATE) AS issue_date,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date,
    COALESCE(subtotal, 0)::{DEC} AS subtotal, COALESCE(discount, 0)::{DEC} AS discount, COALESCE(tax, 0)::{DEC} AS tax,
    (COALESCE(subtotal, 0) - COALESCE(discount, 0) + COALESCE(tax, 0))::{DEC} AS balance_due,
    COALESCE(n_lines, 0) AS n_lines, o_orderstatus AS order_status,
    CASE WHEN suppkey IS NOT NULL THEN '**** ' || printf('%04d', suppkey % 10000) END AS bank_account
  FROM orders LEFT JOIN li ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = suppkey)"""

NORM = """regexp_replace(regexp_replace({0}, '[^A-Z0-9]+', '', 'g'), '^(INVOICE|INV)', '')"""

ITEMS = f"""
items AS (
  SELECT l_orderkey AS k, COALESCE(p_name, 'item') AS description, CAST(l_quantity AS {DEC}) AS quantity,
    CAST(l_extendedprice AS {DEC}) AS amount,
    CAST(((2 * CAST(CAST(l_extendedprice AS {DEC}) * 100 AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))) / 100.0 AS {DEC}) AS unit_price
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""

#: matched procurement record per invoice; s is the record's scenario
MATCH = """
ap AS (
  SELECT k AS id, owner, vendor, balance_due AS total, k % 8 AS s, suppkey, issue_date AS day,
    CASE WHEN k % 26 <> 0 THEN issue_date END AS issue_date,
    CASE WHEN k % 8 <> 5 AND purchase_order <> '' AND k % 13 <> 0 THEN replace(purchase_order, '-', '') END AS po,
    CASE WHEN k % 13 <> 0 THEN k END AS number
  FROM inv),
cand AS (
  SELECT i.doc_id, 1 AS tier, 0 AS sub, i.vendor, a.vendor AS a_vendor, a.day, a.id FROM inv i JOIN ap a
    ON a.owner = i.owner AND a.po = replace(i.purchase_order, '-', '')
  UNION ALL SELECT i.doc_id, 2, 0, i.vendor, a.vendor, a.day, a.id FROM inv i JOIN ap a ON a.owner = i.owner AND a.number = i.k
  UNION ALL SELECT i.doc_id, 3, CASE WHEN a.issue_date = i.issue_date THEN 0 ELSE 1 END, i.vendor, a.vendor, a.day, a.id
    FROM inv i JOIN ap a ON a.owner = i.owner AND a.total = i.balance_due AND (a.issue_date = i.issue_date OR a.issue_date IS NULL)),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY tier,
    CASE WHEN vendor IS NOT NULL AND vendor = a_vendor THEN 0 ELSE 1 END, sub, day DESC, id DESC) AS rn FROM cand),
matched AS (
  SELECT doc_id, id AS ap_id, CASE WHEN vendor IS NULL THEN 0.0 WHEN vendor = a_vendor THEN 1.0 END AS similarity,
    CASE WHEN vendor = a_vendor THEN ['vendor_po', 'vendor_invoice_number', 'vendor_amount_date'][tier]
         ELSE ['po', 'invoice_number', 'amount_date'][tier] END AS match_strategy
  FROM ranked WHERE rn = 1)"""

DECIDE = """
ctx AS (
  SELECT i.*, m.ap_id, m.ap_id % 8 AS s, x.balance_due AS a_total, x.vendor AS a_vendor, x.buyer AS a_buyer, x.suppkey AS a_supp,
    x.issue_date AS a_issue, x.purchase_order AS a_po, x.invoice_number AS a_number, x.subtotal AS a_sub, x.discount AS a_disc, x.tax AS a_tax
  FROM inv i LEFT JOIN matched m USING (doc_id) LEFT JOIN inv x ON x.k = m.ap_id),
ctx2 AS (
  SELECT *, CAST(round(CASE s WHEN 1 THEN a_total * 2 WHEN 2 THEN CAST(a_total AS DECIMAL(18,8)) / 1.01 WHEN 3 THEN CAST(a_total AS DECIMAL(18,8)) / 1.05
      ELSE a_total END, 2) AS DECIMAL(12,2)) AS authorized FROM ctx),
decided AS (
  SELECT doc_id, k, owner, s, ap_id, authorized,
    CASE WHEN k % 23 = 0 OR vendor IS NULL THEN 'request_missing_info'
      WHEN k % 19 = 0 OR k % 17 = 0 OR ap_id IS NULL OR vendor IS DISTINCT FROM a_vendor OR buyer <> a_buyer THEN 'needs_review'
      WHEN s = 4 AND ap_id % 13 <> 0 AND a_number = invoice_number THEN 'flag_possible_duplicate'
      WHEN s = 4 AND ap_id % 13 = 0 AND a_number = invoice_number THEN 'flag_possible_duplicate'
      WHEN ap_id % 13 <> 0 AND a_number <> invoice_number THEN 'needs_review'
      WHEN a_issue <> issue_date THEN 'needs_review'
      WHEN s = 6 THEN 'block_or_escalate' WHEN s = 7 OR balance_due < 0 THEN 'apply_credit_or_route_review'
      WHEN purchase_order = '' OR s = 5 OR (ap_id % 13 <> 0 AND a_po <> '' AND a_po <> purchase_order) THEN 'needs_review'
      WHEN a_sub <> subtotal OR a_disc <> discount OR a_tax <> tax THEN 'needs_review'
      WHEN s = 1 THEN CASE WHEN balance_due <= authorized - CAST(a_total / 4 AS DECIMAL(12,2)) THEN 'approve_partial_consumption' ELSE 'needs_review' END
      WHEN s IN (2, 3) THEN CASE WHEN balance_due = authorized THEN 'approve'
        WHEN abs(balance_due - authorized) <= CAST(round(CAST(authorized AS DECIMAL(18,6)) * 2 / 100, 2) AS DECIMAL(12,2)) THEN 'approve_with_tolerance' ELSE 'needs_review' END
      ELSE 'approve' END AS decision,
    CASE WHEN k % 23 = 0 OR vendor IS NULL OR k % 19 = 0 OR ap_id IS NULL THEN 'low'
      WHEN k % 17 = 0 THEN 'medium' END AS early
  FROM ctx2),
final AS (
  SELECT doc_id, k, owner, s, ap_id, decision,
    COALESCE(early, CASE WHEN decision LIKE 'approve%' OR decision = 'block_or_escalate' THEN 'high' ELSE 'medium' END) AS confidence FROM decided)"""


def with_inv(body: str, *more: str) -> str:
    return "WITH " + ",".join([INV, *more]) + "\n" + body
