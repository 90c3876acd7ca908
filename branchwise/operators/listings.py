"""Listings, lookups and documents.

Single-key procedures of the reference (look up one product, one stock
row, one invoice) are re-aimed as batch operators: a DataFrame of requested
keys joined to the table, so one job answers any number of lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchwise.functions import exprs as X
from branchwise.operators import ordered
from branchwise.sources.schemas import MONEY, TOTAL, Tables

# Columns the client hides when present (replication adds them).
HIDDEN_COLUMNS = ("rowguid", "rowid")

# The field names of one item of a sale's JSON document
# (product code, quantity, optional unit price), as the chain's clients
# send them; documents are only compatible with these exact names.
ITEM_CODE, ITEM_QTY, ITEM_PRICE = "MaSP", "SoLuong", "DonGia"



def _branch_filter(df: DataFrame, branch: str | None) -> DataFrame:
    return df if branch is None else df.where(F.col("branch_code") == F.lit(branch))


def hide_columns(df: DataFrame, names=HIDDEN_COLUMNS) -> DataFrame:
    """Drop named columns if present, matching case-insensitively."""
    lower = {n.lower() for n in names}
    return df.drop(*[col for col in df.columns if col.lower() in lower])


# ------------------------------------------------------------------ scans
def scan_invoice_lines(t: Tables) -> DataFrame:
    """Scan of a base table with its declared schema."""
    return t.invoice_line.select("invoice_id", "product_code", "qty", "unit_price", "branch_code")


def fragment_roundtrip(t: Tables) -> DataFrame:
    """The fragments of all registered branches together.  One fragment
    is a partition filter (``views.fragment``); all of them are one scan."""
    return (t.invoice.join(t.branch.select("branch_code"), "branch_code", "left_semi")
            .select("invoice_id", "branch_code", "created_at"))


# ------------------------------------------------------------------ products
def product_list(t: Tables) -> DataFrame:
    """L1: catalogue sorted by code."""
    return (t.product.select("product_code", "product_name",
                             F.col("unit_price").cast(MONEY).alias("unit_price"))
            .orderBy("product_code"))


def product_lookup(t: Tables, requests: DataFrame) -> DataFrame:
    """L2 batch form: ``requests(requested_code)`` -> product or not found.

    A blank code is rejected with 50000; an unknown code gives found=false
    and NULL fields (the procedure returns no row).
    """
    req = requests.select("requested_code", X.clean("requested_code").alias("_code"))
    prod = t.product.select(F.col("product_code").alias("_code"), "product_code",
                            "product_name", "unit_price")
    j = req.join(prod, "_code", "left")
    return j.select(
        "requested_code", "product_code", "product_name",
        F.col("unit_price").cast(MONEY).alias("unit_price"),
        F.col("product_code").isNotNull().alias("found"),
        F.when(X.is_blank("requested_code"), F.lit(X.E_INPUT)).alias("error_code"))


# ------------------------------------------------------------------ employees
def employees_by_branch(t: Tables, branch: str | None = None) -> DataFrame:
    """L3: the employee fragment of a branch (all columns but hidden ones)."""
    return hide_columns(_branch_filter(t.employee, branch))


def national_employees(t: Tables) -> DataFrame:
    """L4: all employees ordered by branch, id."""
    from branchwise.operators.views import national_employees as view
    return view(t).orderBy("branch_code", "employee_id")


# ------------------------------------------------------------------ inventory
def inventory_by_branch(t: Tables, branch: str | None = None) -> DataFrame:
    """Stock of a branch ordered by product code."""
    return (_branch_filter(t.inventory, branch).select("branch_code", "product_code", "qty")
            .orderBy("branch_code", "product_code"))


def inventory_lookup(t: Tables, requests: DataFrame) -> DataFrame:
    """L6 batch form: requested (branch, code) -> quantity, 0 when absent."""
    req = requests.select("branch_code", "requested_code",
                          X.clean("requested_code").alias("product_code"))
    inv = t.inventory.select("branch_code", "product_code", "qty")
    j = req.join(inv, ["branch_code", "product_code"], "left")
    return j.select("branch_code", "requested_code",
                    F.coalesce("qty", F.lit(0)).cast("int").alias("qty"),
                    F.col("qty").isNotNull().alias("found"),
                    F.when(X.is_blank("requested_code"), F.lit(X.E_INPUT)).alias("error_code"))


def national_inventory(t: Tables) -> DataFrame:
    """Stock of all branches with product name, by product then branch."""
    return (t.inventory.join(t.product.select("product_code", "product_name"), "product_code")
            .select("branch_code", "product_code", "product_name", "qty")
            .orderBy("product_code", "branch_code"))


def inventory_enriched(t: Tables) -> DataFrame:
    """Stock with name ('' when the product is unknown) and price (NULL)."""
    return (t.inventory.join(t.product, "product_code", "left")
            .select("branch_code", "product_code",
                    F.coalesce("product_name", F.lit("")).alias("product_name"),
                    F.col("unit_price").cast(MONEY).alias("unit_price"), "qty"))


# ------------------------------------------------------------------ invoices
def invoice_list(t: Tables, branch: str | None = None) -> DataFrame:
    """Invoices of a branch with total, line count and employee name.

    Invoices without lines stay, with a NULL total and 0 lines.  The
    employee is looked up in the invoice's own fragment (id AND branch).
    Lines are summed per invoice before the join.
    """
    inv = _branch_filter(t.invoice, branch)
    emp = t.employee.select("employee_id", "branch_code", F.col("full_name").alias("employee_name"))
    if t.invoice_summary is not None:
        # Stored per-invoice totals: one scan, no join with the lines.
        s = _branch_filter(t.invoice_summary, branch)
        j = s.withColumnRenamed("n_lines", "line_count").join(emp, ["employee_id", "branch_code"], "left")
        return (j.select("invoice_id", "total", F.col("line_count").cast("bigint").alias("line_count"),
                         "note", "created_at", "branch_code", "employee_id", "employee_name")
                .orderBy(F.desc("created_at")))
    per = (t.invoice_line.groupBy("invoice_id", "branch_code")
           .agg(F.sum(X.amount()).cast(TOTAL).alias("total"),
                F.count("product_code").alias("line_count")))
    if "employee_id" in inv.columns:
        j = (inv.join(per, ["invoice_id", "branch_code"], "left")
             .join(emp, ["employee_id", "branch_code"], "left"))
        emp_cols = [F.col("employee_id"), F.col("employee_name")]
    else:
        # Old schema without HoaDon.MaNV -> NULL id and name.
        j = inv.join(per, ["invoice_id", "branch_code"], "left")
        emp_cols = [F.lit(None).cast("string").alias("employee_id"),
                    F.lit(None).cast("string").alias("employee_name")]
    return (j.select("invoice_id", "total",
                     F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
                     "note", "created_at", "branch_code", *emp_cols)
            .orderBy(F.desc("created_at")))


def invoice_list_no_employee(t: Tables, branch: str | None = None) -> DataFrame:
    """The invoice list over a schema without the employee column."""
    if t.invoice_summary is not None:
        s = _branch_filter(t.invoice_summary, branch)
        return (s.select("invoice_id", "total", F.col("n_lines").cast("bigint").alias("line_count"), "note",
                         "created_at", "branch_code", F.lit(None).cast("string").alias("employee_id"),
                         F.lit(None).cast("string").alias("employee_name")).orderBy(F.desc("created_at")))
    return invoice_list(t.with_tables(invoice=t.invoice.drop("employee_id")), branch)


def invoice_details(t: Tables, invoices: DataFrame | None = None) -> DataFrame:
    """Lines of the requested invoices with product name and amount.

    The branch guard is a semi join with the invoice in the same fragment.
    ``invoices`` defaults to every invoice.
    """
    inv = (invoices if invoices is not None else t.invoice).select("invoice_id", "branch_code")
    lines = t.invoice_line.join(inv, ["invoice_id", "branch_code"], "left_semi")
    return (lines.join(t.product.select("product_code", "product_name"), "product_code", "left")
            .select("invoice_id", "branch_code", "product_code", "product_name", "qty",
                    F.col("unit_price").cast(MONEY).alias("unit_price"),
                    X.amount().alias("amount")))


def invoice_documents(t: Tables) -> DataFrame:
    """L12 flattened: header, total, item count and the first item's fields.

    The first item is the smallest product code (the reference gives no
    order).  Everything is an aggregate, so a huge invoice never becomes
    one in-memory value.
    """
    if t.invoice_summary is not None:
        # Totals from the stored summary; from the lines only the first item
        # per invoice (a partial-aggregate min), then its product name.
        first = (t.invoice_line.groupBy("invoice_id", "branch_code")
                 .agg(F.min(F.struct("product_code", "qty", "unit_price")).alias("f"))
                 .select("invoice_id", "branch_code", F.col("f.product_code").alias("product_code"),
                         F.col("f.qty").alias("first_qty"), F.col("f.unit_price").alias("first_unit_price")))
        first = first.join(t.product.select("product_code", F.col("product_name").alias("first_product_name")),
                           "product_code", "left").withColumnRenamed("product_code", "first_product_code")
        s = t.invoice_summary.join(first, ["invoice_id", "branch_code"], "left")
        return s.select("invoice_id", "branch_code", "employee_id", "note", "created_at",
                        F.coalesce("total", F.lit(0).cast(TOTAL)).alias("total"),
                        F.col("n_lines").cast("bigint").alias("item_count"),
                        "first_product_code", "first_qty",
                        F.col("first_unit_price").cast(MONEY).alias("first_unit_price"), "first_product_name")
    d = invoice_details(t)
    first = F.min(F.struct("product_code", "qty", "unit_price", "product_name"))
    per = (d.groupBy("invoice_id", "branch_code")
           .agg(F.sum("amount").cast(TOTAL).alias("total"),
                F.count(F.lit(1)).alias("item_count"),
                first.alias("f")))
    return (t.invoice.join(per, ["invoice_id", "branch_code"], "left")
            .select("invoice_id", "branch_code", "employee_id", "note", "created_at",
                    F.coalesce("total", F.lit(0).cast(TOTAL)).alias("total"),
                    F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
                    F.col("f.product_code").alias("first_product_code"),
                    F.col("f.qty").alias("first_qty"),
                    F.col("f.unit_price").alias("first_unit_price"),
                    F.col("f.product_name").alias("first_product_name")))


def invoice_document_items(t: Tables) -> DataFrame:
    """L12, the items of the documents: one row per item with the invoice's
    header, its total and number of items, and ``item_no`` from 1 by product
    code.  An invoice without lines has one row without an item."""
    keys = ["invoice_id", "branch_code"]
    d = invoice_details(t)
    sizes = d.groupBy(*keys).agg(F.sum("amount").cast(TOTAL).alias("total"), F.count(F.lit(1)).alias("item_count"))
    d = ordered.bucketize(d.withColumn("_one", F.lit(1).cast("bigint")), keys, "product_code")
    d = ordered.running_sums(d, keys, ["_one"], "product_code")
    items = d.select(*keys, (F.col("p__one") + 1).alias("item_no"), "product_code", "product_name", "qty",
                     "unit_price", "amount")
    return (t.invoice.join(sizes, keys, "left").join(items, keys, "left")
            .select(*keys, "employee_id", "note", "created_at", F.coalesce("total", F.lit(0).cast(TOTAL)).alias("total"),
                    F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"), "item_no", "product_code",
                    "product_name", "qty", "unit_price", "amount"))


# ------------------------------------------------------------------ JSON
def parse_items(json_col) -> "F.Column":
    """The items of a JSON sale document as a typed array.

    Values are taken as their text and converted, so a number may be given as
    one (``"2"``), as the procedure's typed columns take it; what cannot be
    converted (``"two"``, ``2.5`` as a quantity, ``true``) is NULL, and its
    item bad.  A single object counts as one item; an item that is no object
    has NULLs.  Malformed text gives NULL (both reject the request).
    """
    document = F.try_parse_json(X.c(json_col))
    text = lambda item, field: F.trim(F.try_variant_get(item, F.lit(f"$.{field}"), "string"))
    many = F.try_variant_get(document, F.lit("$"), "array<variant>")
    one = F.when(F.schema_of_variant(document).startswith("OBJECT"), F.array(document))
    return F.transform(F.coalesce(many, one), lambda item: F.struct(
        text(item, ITEM_CODE).alias(ITEM_CODE), text(item, ITEM_QTY).try_cast("int").alias(ITEM_QTY),
        text(item, ITEM_PRICE).try_cast(MONEY).alias(ITEM_PRICE)))


def explode_items(df: DataFrame, json_col: str = "items_json") -> DataFrame:
    """One row per JSON item with typed, trimmed fields and its position."""
    return (df.select("*", F.posexplode_outer(parse_items(json_col)).alias("item_pos", "item"))
            .select(*df.columns, "item_pos",
                    X.clean(F.col("item").getField(ITEM_CODE)).alias("item_code"),
                    F.col("item").getField(ITEM_QTY).alias("item_qty"),
                    F.col("item").getField(ITEM_PRICE).alias("item_price")))


#: Items of one packed document; an invoice with more has several, by page.
PAGE_ITEMS = 500


def pack_invoice_items(t: Tables, as_text: Column | None = None) -> DataFrame:
    """Lines -> JSON item documents (``JSON.stringify(items)``): the invoice's
    items by product code, ``PAGE_ITEMS`` to a document, numbered by ``page``
    from 0.  No line is left out and no document grows with its invoice.
    Invoices for which ``as_text`` holds give their numbers as text."""
    keys = ["invoice_id", "branch_code"]
    d = ordered.bucketize(t.invoice_line.withColumn("_one", F.lit(1).cast("bigint")), keys, "product_code")
    d = ordered.running_sums(d, keys, ["_one"], "product_code")
    item = F.struct("product_code", "qty", "unit_price")
    docs = d.groupBy(*keys, F.floor(F.col("p__one") / PAGE_ITEMS).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    def packed(number):
        return F.to_json(F.transform("items", lambda x: F.struct(
            x["product_code"].alias(ITEM_CODE), number(x["qty"]).alias(ITEM_QTY), number(x["unit_price"]).alias(ITEM_PRICE))))

    plain, text = packed(lambda x: x), packed(lambda x: x.cast("string"))
    return docs.select(*keys, "page", (plain if as_text is None else F.when(as_text, text).otherwise(plain)).alias("items_json"))


def parse_invoice_items(t: Tables, as_text: Column | None = None) -> DataFrame:
    """S7 round trip: documents parsed back must equal the lines."""
    docs = pack_invoice_items(t, as_text)
    return explode_items(docs).select(
        "invoice_id", F.col("item_code").alias("product_code"),
        F.col("item_qty").alias("qty"), F.col("item_price").alias("unit_price"))


EVENT_PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType(), True)])


def parse_event_props(events: DataFrame) -> DataFrame:
    """S7 on the driver's ``events.props`` JSON text."""
    p = F.from_json("props", EVENT_PROPS_SCHEMA)
    return events.select("event_id", "event_type", p.getField("k").alias("k"))


def report_json_export(df: DataFrame) -> DataFrame:
    """Rows -> JSON documents (``res.json``), one per row.

    ``export_json`` writes them; this function is the in-memory form, and
    the parsed-back columns are what the oracle compares.
    """
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    """S11 sink: one JSON object per line, written by the executors."""
    df.write.mode("overwrite").json(path)
