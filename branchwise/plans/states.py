"""DuckDB SQL for the tables after a change, and for ordered replays.

A table after a change follows from the opening tables and the change's
outcome, for which ``changesets.ORACLE`` has SQL.  The replays step through
the requests: step n handles the n-th request of every product (transfers),
of every stock row (single-line sales) or of every branch (sales of several
lines), which do not depend on others.
"""

from __future__ import annotations

from branchwise.plans.changesets import ACTIVE, INV_AFTER_DELETES, NOW, ORACLE, _blank, _q


def _after(outcome: str, select: str, extra: str = "") -> str:
    """SQL over the opening tables and ``oc``, the outcome of a change."""
    return _q(select, "oc AS (" + ORACLE[outcome] + ")" + (", " + extra if extra else ""))


def _last(key: str) -> str:
    """The last accepted request of each key."""
    return f"la AS (SELECT * FROM oc WHERE accepted QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY seq DESC) = 1)"


def _recursive(select: str, extra: str) -> str:
    return _q(select, extra).replace("WITH", "WITH RECURSIVE", 1)


SQL = {
    "employees_after_insert": _after("employee_insert", """SELECT employee_id, full_name, job_title, branch_code FROM employee
UNION ALL SELECT oc.employee_id, trim(e.full_name), trim(e.job_title), oc.branch_code FROM oc JOIN emp_add e ON e.seq = oc.seq WHERE accepted"""),
    "employees_after_patch": _after("employee_patch", """SELECT e.employee_id, coalesce(full_name_after, full_name) AS full_name,
  coalesce(job_title_after, job_title) AS job_title, e.branch_code
FROM employee e LEFT JOIN la ON la.employee_id = e.employee_id""", _last("employee_id")),
    "employees_after_delete": _after("employee_delete", """SELECT employee_id, full_name, job_title, branch_code FROM employee e
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.employee_id = e.employee_id)"""),
    "products_after_create": _after("product_create", """SELECT product_code, product_name, unit_price FROM product
UNION ALL SELECT oc.product_code, trim(a.product_name), a.unit_price FROM oc JOIN prod_add a ON a.seq = oc.seq WHERE accepted"""),
    "products_after_patch": _after("product_patch", """SELECT p.product_code, coalesce(product_name_after, product_name) AS product_name,
  CAST(coalesce(unit_price_after, unit_price) AS DECIMAL(10,2)) AS unit_price
FROM product p LEFT JOIN la ON la.product_code = p.product_code""", _last("product_code")),
    "products_after_delete": _after("product_delete", """SELECT product_code, product_name, unit_price FROM product p
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.product_code = p.product_code)"""),
    "inventory_after_product_delete": _after("product_delete", """SELECT product_code, branch_code, qty FROM inventory v
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.product_code = v.product_code)"""),
    "inventory_after_receipt": _after("stock_receipt", """SELECT v.product_code, v.branch_code, coalesce(qty_after, qty) AS qty
FROM inventory v LEFT JOIN la ON la.product_code = v.product_code AND la.branch_code = v.branch_code""",
                                      _last("product_code, branch_code")),
    "inventory_after_row_delete": _after("inventory_item_delete", """SELECT product_code, branch_code, qty FROM inventory v
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.product_code = v.product_code AND oc.branch_code = v.branch_code)"""),
    "invoices_after_delete": _after("invoice_delete", """SELECT invoice_id, note, created_at, branch_code, employee_id FROM invoice i
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.invoice_id = i.invoice_id AND oc.branch_code = i.branch_code)"""),
    "lines_after_delete": _after("invoice_delete", """SELECT invoice_id, product_code, qty, unit_price, branch_code FROM invoice_line i
WHERE NOT EXISTS (SELECT 1 FROM oc WHERE accepted AND oc.invoice_id = i.invoice_id AND oc.branch_code = i.branch_code)"""),
    "invoices_after_replace": _after("invoice_replace", """SELECT i.invoice_id, created_at,
  CASE WHEN la.seq IS NULL THEN note ELSE note_after END AS note,
  CASE WHEN la.seq IS NULL THEN employee_id ELSE employee_id_after END AS employee_id, i.branch_code
FROM invoice i LEFT JOIN la ON la.invoice_id = i.invoice_id AND la.branch_code = i.branch_code""",
                                     _last("invoice_id, branch_code")),
    "lines_after_replace": _after("invoice_replace", """SELECT invoice_id, product_code, qty, unit_price, branch_code FROM invoice_line i
WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.invoice_id = i.invoice_id AND la.branch_code = i.branch_code)
UNION ALL SELECT invoice_id, product_code_after, qty_after, unit_price_after, branch_code FROM la""",
                                  _last("invoice_id, branch_code")),
    "products_after_replace": _after("invoice_replace", """SELECT coalesce(p.product_code, la.product_code_after) AS product_code,
  coalesce(product_name_after, product_name) AS product_name, coalesce(unit_price_after, unit_price) AS unit_price
FROM product p FULL JOIN la ON la.product_code_after = p.product_code""", _last("product_code_after")),
}

_TRANSFER = """g AS (SELECT *, CASE WHEN NOT """ + ACTIVE.format(b="f") + " OR NOT " + ACTIVE.format(b="t") + """ OR f = t
    OR """ + _blank("product_code") + """ THEN '50000' WHEN qty IS NULL OR qty <= 0 THEN '50001' END AS code
  FROM (SELECT seq, upper(trim(from_branch)) AS f, upper(trim(to_branch)) AS t, product_code, trim(product_code) AS c, qty
    FROM xfer) x0),
v AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seq) AS n FROM g WHERE code IS NULL),
st AS (SELECT product_code AS c, map_from_entries(list({'k': branch_code, 'v': CAST(qty AS BIGINT)})) AS stock
  FROM inventory GROUP BY product_code),
s AS (SELECT CAST(0 AS BIGINT) AS n, q.c, coalesce(stock, CAST(MAP {} AS MAP(VARCHAR, BIGINT))) AS stock,
    CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS BIGINT) AS fb, CAST(NULL AS BIGINT) AS tb
  FROM (SELECT DISTINCT c FROM v) q LEFT JOIN st ON st.c = q.c
  UNION ALL
  SELECT v.n, s.c, CASE WHEN s.stock[v.f] >= v.qty THEN map_concat(s.stock, MAP {v.f: s.stock[v.f] - v.qty,
      v.t: coalesce(s.stock[v.t], 0) + v.qty}) ELSE s.stock END, v.seq,
    CASE WHEN s.stock[v.f] IS NULL THEN '50002' WHEN s.stock[v.f] < v.qty THEN '50003' END, s.stock[v.f], s.stock[v.t]
  FROM s JOIN v ON v.c = s.c AND v.n = s.n + 1)"""

_SINGLE = """li AS (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS INT) AS qty FROM lineitem GROUP BY ALL),
sell AS (SELECT l_orderkey, coalesce(min(CASE WHEN r_name = branch_code THEN l_suppkey END), min(l_suppkey)) AS e
  FROM lineitem JOIN sup ON s_suppkey = l_suppkey JOIN ord ON o_orderkey = l_orderkey GROUP BY l_orderkey),
one AS (SELECT row_number() OVER (ORDER BY li.l_orderkey, l_partkey) AS seq, branch_code AS b, CAST(l_partkey AS VARCHAR) AS c,
    qty, CASE WHEN li.l_orderkey % 10 = 0 THEN '' ELSE 'N' END || li.l_orderkey AS inv, CAST(e AS VARCHAR) AS emp
  FROM li JOIN ord ON o_orderkey = li.l_orderkey JOIN sell ON sell.l_orderkey = li.l_orderkey),
g AS (SELECT one.*, unit_price, v.qty AS stock, EXISTS (SELECT 1 FROM invoice_line l WHERE l.invoice_id = inv AND l.product_code = c) AS pk,
    CASE WHEN one.qty <= 0 THEN '50000' WHEN unit_price IS NULL OR unit_price <= 0 THEN '50001'
      WHEN NOT EXISTS (SELECT 1 FROM employee x WHERE x.employee_id = emp AND x.branch_code = b) THEN '50002' END AS code
  FROM one LEFT JOIN product p ON p.product_code = c LEFT JOIN inventory v ON v.product_code = c AND v.branch_code = b),
v AS (SELECT *, row_number() OVER (PARTITION BY c, b ORDER BY seq) AS n FROM g WHERE code IS NULL),
s AS (SELECT CAST(0 AS BIGINT) AS n, c, b, CAST(min(stock) AS BIGINT) AS stock, CAST(NULL AS BIGINT) AS seq,
    CAST(NULL AS VARCHAR) AS code FROM v GROUP BY c, b
  UNION ALL
  SELECT v.n, s.c, s.b, CASE WHEN s.stock >= v.qty AND NOT v.pk THEN s.stock - v.qty ELSE s.stock END, v.seq,
    CASE WHEN s.stock IS NULL OR s.stock < v.qty THEN '50003' WHEN v.pk THEN 'PK_LINE' END
  FROM s JOIN v ON v.c = s.c AND v.b = s.b AND v.n = s.n + 1)"""

# A multi-line sale is all-or-nothing over several stock rows of its branch, so
# step n handles the n-th request of every branch.  Its state is the stock of
# the rows that all requests together could overdraw; others never run short.
_SALES = """sell AS (SELECT l_orderkey, coalesce(min(CASE WHEN r_name = branch_code THEN l_suppkey END), min(l_suppkey)) AS e
  FROM lineitem JOIN sup ON s_suppkey = l_suppkey JOIN ord ON o_orderkey = l_orderkey GROUP BY l_orderkey),
rq AS (SELECT o_orderkey AS seq, branch_code AS b, o_orderpriority AS note, CAST(e AS VARCHAR) AS emp,
    CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'N' END || o_orderkey AS inv FROM ord LEFT JOIN sell ON l_orderkey = o_orderkey),
it AS (SELECT m.seq, rq.b, rq.inv, m.product_code AS c, m.qty, v.qty AS stock, coalesce(nullif(m.price, 0), p.unit_price, 0) AS price
  FROM sale_merged m JOIN rq ON rq.seq = m.seq LEFT JOIN product p ON p.product_code = m.product_code
  LEFT JOIN inventory v ON v.product_code = m.product_code AND v.branch_code = rq.b),
its AS (SELECT seq, bool_or(qty IS NULL OR qty <= 0) AS bad_qty, bool_or(price <= 0) AS bad_price FROM it GROUP BY seq),
pk AS (SELECT DISTINCT it.seq FROM it JOIN invoice_line l ON l.invoice_id = it.inv AND l.product_code = it.c),
g AS (SELECT rq.*, pk.seq IS NOT NULL AS on_invoice, CASE WHEN NOT """ + ACTIVE.format(b="b") + " OR " + _blank("emp") + """ THEN '50000'
    WHEN NOT EXISTS (SELECT 1 FROM employee x WHERE x.employee_id = emp AND x.branch_code = b) THEN '50001'
    WHEN its.seq IS NULL THEN '50002' WHEN bad_qty THEN '50003' WHEN bad_price THEN '50004' END AS code
  FROM rq LEFT JOIN its ON its.seq = rq.seq LEFT JOIN pk ON pk.seq = rq.seq),
live AS (SELECT seq, b, on_invoice, row_number() OVER (PARTITION BY b ORDER BY seq) AS n FROM g WHERE code IS NULL),
bk AS (SELECT n, live.b, live.seq, on_invoice, bool_or(stock IS NULL) AS missing, list({'k': CAST(c AS INT), 'v': qty}) AS items
  FROM live JOIN it ON it.seq = live.seq GROUP BY ALL),
short AS (SELECT b, map_from_entries(list({'k': CAST(c AS INT), 'v': CAST(stock AS BIGINT)})) AS stock FROM (SELECT live.b, c, min(stock) AS stock
  FROM live JOIN it ON it.seq = live.seq GROUP BY live.b, c HAVING sum(it.qty) > min(stock)) x GROUP BY b),
s AS (SELECT CAST(0 AS BIGINT) AS n, q.b, coalesce(stock, CAST(MAP {} AS MAP(INT, BIGINT))) AS stock,
    CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS code FROM (SELECT DISTINCT b FROM live) q LEFT JOIN short ON short.b = q.b
  UNION ALL
  SELECT n, b, CASE WHEN code IS NULL THEN map_concat(stock, map_from_entries(list_transform(
      list_filter(items, lambda x: stock[x.k] IS NOT NULL), lambda x: {'k': x.k, 'v': stock[x.k] - x.v}))) ELSE stock END, seq, code
  FROM (SELECT bk.n, s.b, s.stock, bk.items, bk.seq, CASE
      WHEN missing OR NOT list_bool_and(list_transform(bk.items, lambda x: coalesce(s.stock[x.k] >= x.v, true))) THEN '50005'
      WHEN on_invoice THEN 'PK_LINE' END AS code FROM s JOIN bk ON bk.b = s.b AND bk.n = s.n + 1) y),
oc AS (SELECT g.seq, inv, g.b, note, emp, coalesce(g.code, s.code) AS code FROM g LEFT JOIN s ON s.seq = g.seq)"""

SQL |= {
    "post_invoices": _recursive("""SELECT oc.seq, inv AS invoice_id, b AS branch_code, code IS NULL AS accepted, code AS reject_code,
  CASE WHEN code IS NULL THEN n END AS line_count, CASE WHEN code IS NULL THEN total END AS total
FROM oc LEFT JOIN (SELECT seq, count(*) AS n, CAST(sum(CAST(qty * price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
  FROM it GROUP BY seq) a ON a.seq = oc.seq""", _SALES),
    "invoices_after_sales": _recursive("""SELECT invoice_id, note, created_at, branch_code, employee_id FROM invoice
UNION ALL SELECT inv, note, {now}, b, emp FROM oc WHERE code IS NULL AND NOT EXISTS (SELECT 1 FROM invoice i WHERE i.invoice_id = inv)""",
                                       _SALES),
    "lines_after_sales": _recursive("""SELECT invoice_id, product_code, qty, unit_price, branch_code FROM invoice_line
UNION ALL SELECT oc.inv, c, CAST(qty AS INT), CAST(price AS DECIMAL(10,2)), oc.b FROM oc JOIN it ON it.seq = oc.seq WHERE code IS NULL""",
                                    _SALES),
    "inventory_after_sales": _recursive("""SELECT product_code, branch_code, CAST(qty - coalesce(sold, 0) AS INT) AS qty FROM inventory
LEFT JOIN (SELECT it.c, oc.b, sum(it.qty) AS sold FROM oc JOIN it ON it.seq = oc.seq WHERE code IS NULL GROUP BY ALL) x
  ON c = product_code AND b = branch_code""", _SALES),
    "invoices_after_single_lines": _recursive("""SELECT invoice_id, note, created_at, branch_code, employee_id FROM invoice
UNION ALL SELECT inv, arg_min(o_orderpriority, g.seq), {now}, min(g.b), arg_min(emp, g.seq) FROM g LEFT JOIN s ON s.seq = g.seq
  JOIN orders ON o_orderkey = CAST(replace(inv, 'N', '') AS BIGINT)
WHERE coalesce(g.code, s.code) IS NULL AND NOT EXISTS (SELECT 1 FROM invoice i WHERE i.invoice_id = inv) GROUP BY inv""", _SINGLE),
    "lines_after_single_lines": _recursive("""SELECT invoice_id, product_code, qty, unit_price, branch_code FROM invoice_line
UNION ALL SELECT inv, g.c, g.qty, unit_price, g.b FROM g LEFT JOIN s ON s.seq = g.seq WHERE coalesce(g.code, s.code) IS NULL""", _SINGLE),
    "inventory_after_single_lines": _recursive("""SELECT product_code, branch_code, CAST(qty - coalesce(sold, 0) AS INT) AS qty FROM inventory
LEFT JOIN (SELECT g.c, g.b, sum(g.qty) AS sold FROM g LEFT JOIN s ON s.seq = g.seq WHERE coalesce(g.code, s.code) IS NULL GROUP BY ALL) x
  ON c = product_code AND b = branch_code""", _SINGLE),
    "inventory_after_set": _after("inventory_set", """SELECT v.product_code, v.branch_code, coalesce(qty_after, qty) AS qty
FROM inventory v LEFT JOIN la ON la.product_code = v.product_code AND la.branch_code = v.branch_code""",
                                  _last("product_code, branch_code")),
    "inventory_after_row_create": _after("inventory_item_create", """SELECT product_code, branch_code, qty FROM inv2
UNION ALL SELECT product_code, branch_code, qty_after FROM oc WHERE accepted""", INV_AFTER_DELETES),
    "stock_transfer": _recursive("""SELECT g.seq, f AS from_branch, t AS to_branch, g.c AS product_code, qty,
  coalesce(g.code, s.code) IS NULL AS accepted, coalesce(g.code, s.code) AS reject_code,
  CASE WHEN coalesce(g.code, s.code) IS NULL THEN fb END AS from_before,
  CASE WHEN coalesce(g.code, s.code) IS NULL THEN fb - qty END AS from_after,
  CASE WHEN coalesce(g.code, s.code) IS NULL THEN tb END AS to_before,
  CASE WHEN coalesce(g.code, s.code) IS NULL THEN coalesce(tb, 0) + qty END AS to_after
FROM g LEFT JOIN s ON s.seq = g.seq""", _TRANSFER),
    "inventory_after_transfer": _recursive("""SELECT product_code, branch_code, qty FROM inventory
  WHERE product_code NOT IN (SELECT c FROM v)
UNION ALL SELECT c, unnest(map_keys(stock)), CAST(unnest(map_values(stock)) AS INT) FROM
  (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1)""", _TRANSFER),
    "post_single_line": _recursive("""SELECT g.seq, inv AS invoice_id, g.b AS branch_code, g.c AS product_code,
  coalesce(g.code, s.code) IS NULL AS accepted, coalesce(g.code, s.code) AS reject_code,
  CASE WHEN coalesce(g.code, s.code) IS NULL THEN CAST(qty * unit_price AS DECIMAL(18,2)) END AS amount
FROM g LEFT JOIN s ON s.seq = g.seq""", _SINGLE),
}

SQL = {k: q.replace("{now}", f"TIMESTAMP '{NOW.isoformat(sep=' ')}'") for k, q in SQL.items()}
