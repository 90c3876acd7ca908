"""DuckDB oracle: the same queries written as plain SQL over the driver tables.

``BASE`` rebuilds the canonical tables with the adapter's rules; each query
appends its own CTEs.  Week numbers are computed here with DATEPART-style
expressions (not with the Spark side's date bounds), so the two sides are
independent formulations.
"""

from __future__ import annotations

from branchwise.plans.params import AS_OF, AS_OF_WEEK1, BRANCH, TOP_N

BASE = """
WITH geo AS (
  SELECT n_nationkey, r_regionkey, r_name AS branch_code
  FROM nation JOIN region ON r_regionkey = n_regionkey),
branch AS (SELECT r_name AS branch_code, r_name AS branch_name, TRUE AS is_active FROM region),  -- name: NULL-ness only
employee AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS employee_id, s_name AS full_name,
         CASE WHEN s_suppkey % 10 = 1 THEN 'Manager' ELSE 'Cashier' END AS job_title,
         g.branch_code
  FROM supplier JOIN geo g ON g.n_nationkey = s_nationkey),
product AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price
  FROM part),
pairs AS (
  SELECT l_orderkey, l_partkey, CAST(sum(CAST(l_quantity AS INT)) AS INT) AS qty,
         min(l_suppkey) AS seller
  FROM lineitem GROUP BY l_orderkey, l_partkey),
ob AS (
  SELECT o_orderkey, o_orderdate, o_orderpriority, g.branch_code
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN geo g ON g.n_nationkey = c_nationkey),
invoice AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, o_orderpriority AS note,
         o_orderdate AS created_at, ob.branch_code, CAST(s.seller AS VARCHAR) AS employee_id
  FROM ob LEFT JOIN (SELECT l_orderkey, min(seller) AS seller FROM pairs GROUP BY l_orderkey) s
    ON s.l_orderkey = ob.o_orderkey),
invoice_line AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id, CAST(l_partkey AS VARCHAR) AS product_code,
         qty, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, ob.branch_code
  FROM pairs JOIN ob ON ob.o_orderkey = pairs.l_orderkey
  JOIN part ON p_partkey = pairs.l_partkey),
inventory AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_code, r_name AS branch_code,
         CAST((p_partkey * 7 + r_regionkey * 13) % 240 AS INT) AS qty
  FROM part CROSS JOIN region),
gl AS (
  SELECT i.invoice_id, i.created_at, i.branch_code, i.employee_id, l.product_code, l.qty,
         l.unit_price, CAST(l.qty * l.unit_price AS DECIMAL(18,2)) AS amount,
         CAST(year(i.created_at) AS INT) AS yr,
         CAST((dayofyear(i.created_at) - 1 + dayofweek(date_trunc('year', i.created_at))) // 7 + 1 AS INT) AS wk
  FROM invoice i JOIN invoice_line l ON l.invoice_id = i.invoice_id AND l.branch_code = i.branch_code)
"""


def _d(d) -> str:
    return f"DATE '{d.isoformat()}'"


def _week_of(d) -> str:
    return f"CAST((dayofyear({_d(d)}) - 1 + dayofweek(date_trunc('year', {_d(d)}))) // 7 + 1 AS INT)"


def q(select: str, ctes: str = "") -> str:
    return BASE + (", " + ctes if ctes else "") + "\n" + select


R1 = """SELECT branch_code, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl
WHERE branch_code IN (SELECT branch_code FROM branch WHERE is_active)
GROUP BY branch_code ORDER BY branch_code"""

DAILY = """SELECT branch_code, CAST(created_at AS DATE) AS day, count(DISTINCT invoice_id) AS order_count,
CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl GROUP BY 1, 2"""


def _week_compare(as_of) -> str:
    w = _week_of(as_of)
    return q(f"""SELECT branch_code,
 CAST(sum(CASE WHEN wk = {w} THEN amount ELSE 0 END) AS DECIMAL(28,2)) AS this_week,
 CAST(sum(CASE WHEN wk = {w} - 1 THEN amount ELSE 0 END) AS DECIMAL(28,2)) AS last_week
FROM gl WHERE yr = year({_d(as_of)}) AND wk IN ({w}, {w} - 1)
GROUP BY branch_code""")


DASH_ALL = """SELECT b.branch_code,
 CAST(coalesce((SELECT count(*) FROM employee e WHERE e.branch_code = b.branch_code), 0) AS BIGINT) AS employee_count,
 CAST(coalesce((SELECT count(*) FROM invoice i WHERE i.branch_code = b.branch_code), 0) AS BIGINT) AS invoice_count,
 CAST(coalesce((SELECT sum(amount) FROM gl WHERE gl.branch_code = b.branch_code), 0) AS DECIMAL(28,2)) AS revenue,
 CAST(coalesce((SELECT sum(qty) FROM inventory v WHERE v.branch_code = b.branch_code), 0) AS BIGINT) AS total_stock_units,
 CAST(coalesce((SELECT sum(CASE WHEN qty < 50 THEN 1 ELSE 0 END) FROM inventory v WHERE v.branch_code = b.branch_code), 0) AS BIGINT) AS low_stock_products
FROM branch b"""

SPINE7 = f"""spine AS (
  SELECT b.branch_code, CAST({_d(AS_OF)} - CAST(t.n AS INT) AS DATE) AS day
  FROM branch b, range(7) t(n))"""

INVOICE_LIST = """SELECT i.invoice_id,
 CAST(sum(CAST(l.qty * l.unit_price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total,
 count(l.product_code) AS line_count, i.note, i.created_at, i.branch_code,
 {emp_id} AS employee_id, {emp_name} AS employee_name
FROM invoice i
LEFT JOIN invoice_line l ON l.invoice_id = i.invoice_id AND l.branch_code = i.branch_code
{emp_join}
GROUP BY i.invoice_id, i.note, i.created_at, i.branch_code{emp_group}"""


def _top_stock(n: int) -> str:
    return q(f"""SELECT branch_code, rank, product_code, product_name, qty FROM (
  SELECT v.branch_code, CAST(row_number() OVER (PARTITION BY v.branch_code ORDER BY v.qty DESC, v.product_code) AS INT) AS rank,
         v.product_code, p.product_name, v.qty
  FROM inventory v LEFT JOIN product p ON p.product_code = v.product_code) x
WHERE rank <= {n}""")


ORACLE: dict[str, str] = {
    "scan_invoice_lines": q("SELECT invoice_id, product_code, qty, unit_price, branch_code FROM invoice_line"),
    "fragment_roundtrip": q("SELECT invoice_id, branch_code, created_at FROM invoice"),
    "global_invoice_lines": q("SELECT invoice_id, created_at, branch_code, employee_id, product_code, qty, unit_price, amount FROM gl"),
    "national_inventory_raw": q("SELECT product_code, qty, branch_code FROM inventory"),
    "parse_invoice_items": q("SELECT invoice_id, product_code, qty, unit_price FROM invoice_line"),
    "parse_text_items": q("SELECT invoice_id, product_code, qty, unit_price FROM invoice_line"),
    "invoice_list_no_employee": q(INVOICE_LIST.format(
        emp_id="CAST(NULL AS VARCHAR)", emp_name="CAST(NULL AS VARCHAR)", emp_join="", emp_group="")),
    "employees_by_branch": q(f"SELECT employee_id, full_name, job_title, branch_code FROM employee WHERE branch_code = '{BRANCH}'"),
    "report_json_export": q(DAILY),
    "product_list": q("SELECT product_code, product_name, unit_price FROM product ORDER BY product_code"),
    "national_employees": q("SELECT employee_id, full_name, job_title, branch_code FROM employee ORDER BY branch_code, employee_id"),
    "inventory_by_branch": q(f"SELECT branch_code, product_code, qty FROM inventory WHERE branch_code = '{BRANCH}' ORDER BY product_code"),
    "national_inventory": q("""SELECT v.branch_code, v.product_code, p.product_name, v.qty
FROM inventory v JOIN product p ON p.product_code = v.product_code ORDER BY v.product_code, v.branch_code"""),
    "inventory_enriched": q("""SELECT v.branch_code, v.product_code, coalesce(p.product_name, '') AS product_name,
 p.unit_price, v.qty FROM inventory v LEFT JOIN product p ON p.product_code = v.product_code"""),
    "invoice_list": q(INVOICE_LIST.format(
        emp_id="i.employee_id", emp_name="max(e.full_name)",
        emp_join="LEFT JOIN employee e ON e.employee_id = i.employee_id AND e.branch_code = i.branch_code",
        emp_group=", i.employee_id")),
    "invoice_details": q("""SELECT l.invoice_id, l.branch_code, l.product_code, p.product_name, l.qty, l.unit_price,
 CAST(l.qty * l.unit_price AS DECIMAL(18,2)) AS amount
FROM invoice_line l LEFT JOIN product p ON p.product_code = l.product_code
JOIN invoice i ON i.invoice_id = l.invoice_id AND i.branch_code = l.branch_code"""),
    "invoice_document_items": q("""SELECT i.invoice_id, i.branch_code, i.employee_id, i.note, i.created_at,
  CAST(coalesce(sum(amount) OVER w, 0) AS DECIMAL(28,2)) AS total, count(d.product_code) OVER w AS item_count,
  CASE WHEN d.product_code IS NOT NULL THEN row_number() OVER (PARTITION BY i.invoice_id, i.branch_code ORDER BY d.product_code) END AS item_no,
  d.product_code, p.product_name, d.qty, d.unit_price, d.amount
FROM invoice i LEFT JOIN gl d ON d.invoice_id = i.invoice_id AND d.branch_code = i.branch_code
LEFT JOIN product p ON p.product_code = d.product_code WINDOW w AS (PARTITION BY i.invoice_id, i.branch_code)"""),
    "invoice_documents": q("""SELECT i.invoice_id, i.branch_code, i.employee_id, i.note, i.created_at,
 CAST(coalesce(d.total, 0) AS DECIMAL(28,2)) AS total, CAST(coalesce(d.item_count, 0) AS BIGINT) AS item_count,
 f.product_code AS first_product_code, f.qty AS first_qty, f.unit_price AS first_unit_price,
 f.product_name AS first_product_name
FROM invoice i
LEFT JOIN (SELECT invoice_id, branch_code, sum(amount) AS total, count(*) AS item_count,
                  min(product_code) AS first_code FROM dl GROUP BY 1, 2) d
  ON d.invoice_id = i.invoice_id AND d.branch_code = i.branch_code
LEFT JOIN dl f ON f.invoice_id = d.invoice_id AND f.branch_code = d.branch_code AND f.product_code = d.first_code""",
        """dl AS (SELECT l.invoice_id, l.branch_code, l.product_code, p.product_name, l.qty, l.unit_price,
 CAST(l.qty * l.unit_price AS DECIMAL(18,2)) AS amount
 FROM invoice_line l LEFT JOIN product p ON p.product_code = l.product_code)"""),
    "revenue_by_branch": q(R1),
    "revenue_by_branch_global": q("SELECT branch_code, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl GROUP BY branch_code"),
    "national_revenue": q("""SELECT CAST(sum(revenue) AS DECIMAL(28,2)) AS national_revenue, count(*) AS branch_count,
 (SELECT branch_code FROM r ORDER BY revenue DESC, branch_code LIMIT 1) AS leading_branch,
 CAST(max(revenue) AS DECIMAL(28,2)) AS leading_revenue FROM r""", "r AS (" + R1 + ")"),
    "revenue_share": q("""SELECT branch_code, revenue, CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) AS share
FROM (SELECT branch_code, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl GROUP BY branch_code) r"""),
    "daily_revenue": q(DAILY + " ORDER BY day DESC, branch_code"),
    "weekly_revenue": q("""SELECT branch_code, yr AS year, wk AS week, count(DISTINCT invoice_id) AS order_count,
 CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl GROUP BY 1, 2, 3"""),
    "daily_revenue_last7": q("""SELECT day, revenue FROM (
 SELECT CAST(created_at AS DATE) AS day, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl
 GROUP BY 1 ORDER BY day DESC LIMIT 7) x"""),
    "weekly_revenue_last8": q("""SELECT week_label, revenue FROM (
 SELECT printf('%d-W%02d', yr, wk) AS week_label, CAST(sum(amount) AS DECIMAL(28,2)) AS revenue FROM gl
 GROUP BY 1 ORDER BY week_label DESC LIMIT 8) x"""),
    "week_compare": _week_compare(AS_OF),
    "week_compare_week1": _week_compare(AS_OF_WEEK1),
    "branch_dashboard": q(DASH_ALL.replace("FROM branch b", f"FROM branch b WHERE b.branch_code = '{BRANCH}'")
                          .replace("SELECT b.branch_code,", "SELECT", 1)),
    "branch_dashboard_all": q(DASH_ALL),
    "branch_revenue_7d": q("""SELECT s.branch_code, s.day,
 CAST(coalesce(sum(CAST(l.qty * l.unit_price AS DECIMAL(18,2))), 0) AS DECIMAL(28,2)) AS revenue
FROM spine s
LEFT JOIN invoice i ON CAST(i.created_at AS DATE) = s.day AND i.branch_code = s.branch_code
LEFT JOIN invoice_line l ON l.invoice_id = i.invoice_id AND l.branch_code = i.branch_code
GROUP BY s.branch_code, s.day""", SPINE7),
    "branch_revenue_7d_from_totals": q("""SELECT s.branch_code, s.day,
 CAST(coalesce(sum(coalesce(t.total, 0)), 0) AS DECIMAL(28,2)) AS revenue
FROM spine s LEFT JOIN (
  SELECT i.invoice_id, i.branch_code, CAST(i.created_at AS DATE) AS day,
         sum(CAST(l.qty * l.unit_price AS DECIMAL(18,2))) AS total
  FROM invoice i LEFT JOIN invoice_line l ON l.invoice_id = i.invoice_id AND l.branch_code = i.branch_code
  GROUP BY 1, 2, 3) t ON t.day = s.day AND t.branch_code = s.branch_code
GROUP BY s.branch_code, s.day""", SPINE7),
    "invoice_count_by_branch": q("SELECT branch_code, count(*) AS row_count FROM invoice GROUP BY branch_code"),
    "revenue_report_zero_filled": q("""SELECT b.branch_code, CAST(coalesce(sum(gl.amount), 0) AS DECIMAL(28,2)) AS revenue,
 CAST(count(gl.invoice_id) AS BIGINT) AS invoice_count
FROM branch b LEFT JOIN gl ON gl.branch_code = b.branch_code GROUP BY b.branch_code"""),
    "best_employee_week": q(f"""SELECT branch_code, employee_id, full_name, revenue FROM (
  SELECT gl.branch_code, gl.employee_id, e.full_name, CAST(sum(gl.amount) AS DECIMAL(28,2)) AS revenue,
         row_number() OVER (PARTITION BY gl.branch_code ORDER BY sum(gl.amount) DESC, gl.employee_id) AS rn
  FROM gl JOIN employee e ON e.employee_id = gl.employee_id AND e.branch_code = gl.branch_code
  WHERE gl.wk = {_week_of(AS_OF)} AND gl.yr = year({_d(AS_OF)})
  GROUP BY gl.branch_code, gl.employee_id, e.full_name) x WHERE rn = 1"""),
    "best_product_week": q(f"""SELECT branch_code, product_code, product_name, units FROM (
  SELECT gl.branch_code, gl.product_code, p.product_name, CAST(sum(gl.qty) AS BIGINT) AS units,
         row_number() OVER (PARTITION BY gl.branch_code ORDER BY sum(gl.qty) DESC, gl.product_code) AS rn
  FROM gl JOIN product p ON p.product_code = gl.product_code
  WHERE gl.wk = {_week_of(AS_OF)} AND gl.yr = year({_d(AS_OF)})
  GROUP BY gl.branch_code, gl.product_code, p.product_name) x WHERE rn = 1"""),
    "top_stock": _top_stock(TOP_N),
    "top_stock_default_n": _top_stock(8),
    "daily_preview": q("""SELECT CAST(pos AS INT) AS pos, branch_code, day, order_count, revenue, cnt > 8 AS has_more FROM (
  SELECT *, row_number() OVER (ORDER BY day DESC, branch_code) AS pos, count(*) OVER () AS cnt
  FROM (""" + DAILY + """ ORDER BY day DESC, branch_code LIMIT 9) a) b WHERE pos <= 8"""),
}


DQ_DUPLICATES = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}) AS key, "
    f"count(*) AS row_count FROM {name} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
    for name, keys in [("branch", ["branch_code"]), ("employee", ["employee_id"]),
                       ("product", ["product_code"]), ("invoice", ["invoice_id"]),
                       ("inventory", ["product_code", "branch_code"]),
                       ("invoice_line", ["invoice_id", "product_code"]),
                       ("invoice_line_raw", ["invoice_id", "product_code"])])

DQ_FK = " UNION ALL ".join(
    f"SELECT '{name}' AS constraint_name, count(*) AS checked_rows, "
    f"CAST(count(*) FILTER (WHERE p.{pc} IS NULL) AS BIGINT) AS orphan_rows "
    f"FROM {child} c LEFT JOIN (SELECT DISTINCT {pc} FROM {parent}) p ON p.{pc} = c.{cc} "
    f"WHERE c.{cc} IS NOT NULL"
    for name, child, cc, parent, pc in [
        ("employee_branch", "employee", "branch_code", "branch", "branch_code"),
        ("invoice_branch", "invoice", "branch_code", "branch", "branch_code"),
        ("invoice_employee", "invoice", "employee_id", "employee", "employee_id"),
        ("inventory_product", "inventory", "product_code", "product", "product_code"),
        ("inventory_branch", "inventory", "branch_code", "branch", "branch_code"),
        ("line_invoice", "invoice_line", "invoice_id", "invoice", "invoice_id"),
        ("line_product", "invoice_line", "product_code", "product", "product_code")])

DQ_CK = " UNION ALL ".join(
    f"SELECT '{name}' AS constraint_name, count(*) AS checked_rows, "
    f"CAST(count(*) FILTER (WHERE NOT ({cond})) AS BIGINT) AS violations FROM {tb}"
    for name, tb, cond in [("product_price_nonneg", "product", "unit_price >= 0"),
                           ("inventory_qty_nonneg", "inventory", "qty >= 0"),
                           ("line_qty_positive", "invoice_line", "qty > 0"),
                           ("line_price_nonneg", "invoice_line", "unit_price >= 0")])

DQ_NN = " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{col}' AS column_name, "
    f"CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) AS null_count FROM {tb}"
    for tb, cols in [("branch", ["branch_code", "branch_name", "is_active"]),
                     ("employee", ["employee_id", "full_name", "job_title", "branch_code"]),
                     ("product", ["product_code", "product_name", "unit_price"]),
                     ("invoice", ["invoice_id", "created_at", "branch_code"]),
                     ("inventory", ["product_code", "branch_code", "qty"]),
                     ("invoice_line", ["invoice_id", "product_code", "qty", "unit_price", "branch_code"])]
    for col in cols)

DQ_FR = """SELECT 'invoice_line' AS table_name, count(*) AS checked_rows,
 CAST(count(*) FILTER (WHERE i.branch_code IS NULL OR i.branch_code <> l.branch_code) AS BIGINT) AS misplaced_rows
FROM invoice_line l LEFT JOIN invoice i ON i.invoice_id = l.invoice_id
UNION ALL
SELECT 'invoice_employee', count(*),
 CAST(count(*) FILTER (WHERE e.branch_code IS NULL OR e.branch_code <> i.branch_code) AS BIGINT)
FROM invoice i LEFT JOIN employee e ON e.employee_id = i.employee_id WHERE i.employee_id IS NOT NULL"""

ORACLE.update({
    "dq_duplicate_keys": q("SELECT * FROM (" + DQ_DUPLICATES + ") x",
                           """invoice_line_raw AS (SELECT CAST(l_orderkey AS VARCHAR) AS invoice_id,
 CAST(l_partkey AS VARCHAR) AS product_code FROM lineitem)"""),
    "dq_orphans": q(DQ_FK),
    "dq_check_violations": q(DQ_CK),
    "dq_null_counts": q(DQ_NN),
    "dq_fragment_membership": q(DQ_FR),
    "parse_event_props": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
})


def _long(report, src, key="NULL", label="NULL", count="NULL", amount="NULL", amount2="NULL", pos="NULL",
          where="TRUE", branch="branch_code") -> str:
    return (f"SELECT '{report}' AS report, CAST({branch} AS VARCHAR) AS branch_code, CAST({key} AS VARCHAR) AS item_key, "
            f"CAST({label} AS VARCHAR) AS item_label, CAST({count} AS BIGINT) AS count_value, "
            f"CAST({amount} AS DECIMAL(28,2)) AS amount, CAST({amount2} AS DECIMAL(28,2)) AS amount2, "
            f"CAST({pos} AS INT) AS position FROM ({src}) x WHERE {where}")


_B = f"branch_code = '{BRANCH}'"
ORACLE.update({
    "analytics_overview": " UNION ALL ".join([
        _long("daily", ORACLE["daily_revenue"], key="strftime(day, '%Y-%m-%d')",
              count="coalesce(order_count, 0)", amount="coalesce(revenue, 0)"),
        _long("weekly", ORACLE["weekly_revenue"], key="printf('%d-W%02d', year, week)",
              count="coalesce(order_count, 0)", amount="coalesce(revenue, 0)"),
        _long("best_employee", ORACLE["best_employee_week"], key="employee_id", label="full_name",
              amount="coalesce(revenue, 0)"),
        _long("best_product", ORACLE["best_product_week"], key="product_code", label="product_name",
              count="coalesce(units, 0)"),
        _long("week_compare", ORACLE["week_compare"], amount="coalesce(this_week, 0)",
              amount2="coalesce(last_week, 0)"),
    ]),
    "branch_dashboard_bundle": " UNION ALL ".join([
        _long("summary", ORACLE["branch_dashboard_all"], key="'employees'", count="employee_count", where=_B),
        _long("summary", ORACLE["branch_dashboard_all"], key="'invoices'", count="invoice_count", where=_B),
        _long("summary", ORACLE["branch_dashboard_all"], key="'stock_units'", count="total_stock_units", where=_B),
        _long("summary", ORACLE["branch_dashboard_all"], key="'low_stock_products'", count="low_stock_products",
              where=_B),
        _long("summary", ORACLE["branch_dashboard_all"], key="'revenue'", amount="revenue", where=_B),
        _long("trend", ORACLE["branch_revenue_7d"], key="strftime(day, '%Y-%m-%d')",
              label="strftime(day, '%m-%d')", amount="revenue", where=_B),
        _long("top_stock", _top_stock(8), key="product_code", label="product_name", count="qty", pos="rank",
              where=_B),
    ]),
    "product_lookup": q("""SELECT r.requested_code, p.product_code, p.product_name, p.unit_price,
  p.product_code IS NOT NULL AS found,
  CASE WHEN nullif(trim(r.requested_code), '') IS NULL THEN 50000 END AS error_code
FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR)
                  WHEN p_partkey % 13 = 0 THEN '  ' ELSE ' ' || CAST(p_partkey AS VARCHAR) || ' ' END AS requested_code
      FROM part) r
LEFT JOIN product p ON p.product_code = trim(r.requested_code)"""),
    "inventory_lookup_default": q("""SELECT r.branch_code, r.requested_code, CAST(coalesce(v.qty, 0) AS INT) AS qty,
  v.qty IS NOT NULL AS found,
  CASE WHEN nullif(trim(r.requested_code), '') IS NULL THEN 50000 END AS error_code
FROM (SELECT r_name AS branch_code,
             CASE WHEN p_partkey % 11 = 0 THEN 'U' || CAST(p_partkey AS VARCHAR)
                  WHEN p_partkey % 13 = 0 THEN ' ' ELSE ' ' || CAST(p_partkey AS VARCHAR) END AS requested_code
      FROM part, region) r
LEFT JOIN inventory v ON v.product_code = trim(r.requested_code) AND v.branch_code = r.branch_code"""),
    "scalar_dates": f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year,
  CAST((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1 AS INT) AS week,
  printf('%d-W%02d', year(o_orderdate),
         (dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1) AS week_label,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_day, strftime(o_orderdate, '%m-%d') AS short_day,
  strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS display_time,
  CAST(datediff('day', CAST(o_orderdate AS DATE), {_d(AS_OF)}) AS INT) AS days_before_as_of
FROM orders""",
    "scalar_text": f"""SELECT c_custkey, trim('  ' || c_name || ' ') AS name_clean,
  nullif(trim(seg), '') IS NULL AS segment_blank,
  coalesce(nullif(trim(seg), ''), c_name) AS patched,
  CASE WHEN EXISTS (SELECT 1 FROM region r2 WHERE r2.r_name = norm) THEN norm END AS branch_or_null,
  coalesce(CASE WHEN EXISTS (SELECT 1 FROM region r2 WHERE r2.r_name = norm) THEN norm END, '{BRANCH}') AS source_branch
FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_mktsegment END AS seg,
             upper(trim(CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' ELSE ' ' || lower(r_name) || ' ' END)) AS norm
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) c""",
    "scalar_numeric": """SELECT l_orderkey, l_partkey,
  CAST(CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS amount,
  CAST(coalesce(nullif(CASE WHEN l_partkey % 3 = 0 THEN CAST(0 AS DECIMAL(10,2)) WHEN l_partkey % 3 = 1 THEN NULL
                            ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) - 1 AS DECIMAL(10,2)) END, 0),
                CAST(p_retailprice AS DECIMAL(10,2)), 0) AS DECIMAL(10,2)) AS resolved_price,
  coalesce(TRY_CAST(trim(CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN ''
                              WHEN l_partkey % 4 = 2 THEN 'abc' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END)
                    AS DECIMAL(28,2)), CAST(0 AS DECIMAL(28,2))) AS number_value
FROM lineitem JOIN part ON p_partkey = l_partkey""",
})


def oracle_sql() -> dict[str, str]:
    out = dict(ORACLE)
    from branchwise.plans import changesets, states
    out.update(changesets.ORACLE)
    out.update(states.SQL)
    return out
