"""Data changes of the chain as batch change-set operators.

In the reference each call changes one entity inside one transaction.  Here
an operator takes the current tables and a DataFrame of requests ordered by
``seq`` and returns the new tables plus an ``outcome`` row per request
(``accepted``, ``reject_code``), equal to handling the requests one after
the other.  Reject codes keep the procedures' error numbers; rules of the
service layer get names (``BAD_BRANCH``, ``FK_INVOICE``, ``NOT_NULL``).

None of these operators needs the bounds iteration of ``acceptance``: the
guards either look at the opening tables only, or at "the first valid
request of this key", which is a ``min(seq)`` aggregate (partial
aggregation map-side, so one hot key never lands whole in one task).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions import exprs as X
from branchwise.operators import ordered
from branchwise.operators.views import with_every_branch
from branchwise.sources.schemas import MONEY, Delta, Tables, with_defaults

BAD_BRANCH = "BAD_BRANCH"
FK_INVOICE = "FK_INVOICE"
NOT_NULL = "NOT_NULL"
CENTRAL_ONLY = "CENTRAL_ONLY"


@dataclass
class ChangeResult:
    tables: Tables
    outcome: DataFrame


def first_code(rules: list[tuple[Column, str]]) -> Column:
    """Code of the first rule that holds (guards run in this order), else NULL."""
    out = None
    for cond, code in rules:
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(F.lit(None).cast("string"))


def with_branch(req: DataFrame, t: Tables, col: str = "branch_code", out: str = "_branch") -> DataFrame:
    """Normalise a requested branch and flag it when it is not a registered,
    active branch (the service refuses it before calling a procedure)."""
    reg = t.branch.where(F.col("is_active")).select(F.col("branch_code").alias(out),
                                                    F.lit(True).alias(f"{out}_ok"))
    r = req.withColumn(out, X.normalise_branch(col))
    return r.join(reg, out, "left").withColumn(f"{out}_ok", F.coalesce(f"{out}_ok", F.lit(False)))


def central_only(req: DataFrame) -> list[tuple[Column, str]]:
    """Service rule for central operations: when requests carry a ``caller``
    column, a caller other than the central node is refused first."""
    if "caller" not in req.columns:
        return []
    return [(F.coalesce(X.normalise_branch("caller") != F.lit(X.CENTRAL), F.lit(True)), CENTRAL_ONLY)]


def _flag(df: DataFrame, other: DataFrame, keys: list[str], name: str, unique: bool = False) -> DataFrame:
    """Left join with the keys of ``other``; ``name`` = key present.

    ``unique``: the keys are the primary key of ``other`` (the store holds
    them unique, see ``dq_duplicate_keys``), so no ``distinct`` -- a full
    aggregation of the table -- is needed before the join.
    """
    o = other.select(*keys)
    o = (o if unique else o.distinct()).withColumn(name, F.lit(True))
    return df.join(o, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _first_valid(df: DataFrame, keys: list[str], valid: Column, name: str = "_first") -> DataFrame:
    """Flag the request with the smallest seq among the valid ones of its key."""
    firsts = (df.where(valid).groupBy(*keys).agg(F.min("seq").alias("_min_seq")))
    j = df.join(firsts, keys, "left")
    return j.withColumn(name, F.coalesce(F.col("seq") == F.col("_min_seq"), F.lit(False))).drop("_min_seq")


def _last_value(value: Column, seq: Column, when: Column) -> Column:
    """Value of the latest request (by seq) among those where ``when`` holds."""
    return F.max(F.when(when, F.struct(seq.alias("s"), value.alias("v")))).getField("v")


def _outcome(df: DataFrame, *cols) -> DataFrame:
    return df.select("seq", *cols, F.col("_code").isNull().alias("accepted"),
                     F.col("_code").alias("reject_code"))


# ------------------------------------------------------------------ employees
def add_employees(t: Tables, req: DataFrame, generate_ids: str | None = None) -> ChangeResult:
    """Requests (seq, branch_code, employee_id, full_name, job_title).

    Guards in order: branch (BAD_BRANCH); blank id, name, title (50000); id
    exists (50001); an earlier accepted request took the id (50001).
    ``generate_ids`` (a batch tag) applies the service form: a blank id is
    replaced by ``<branch letter><tag>_<seq>``.
    """
    if generate_ids is not None:
        letter = F.substring(X.normalise_branch("branch_code"), 1, 1)
        req = req.withColumn("employee_id", F.when(X.is_blank("employee_id"),
                                                   X.generated_id(letter, generate_ids))
                             .otherwise(F.col("employee_id")))
    r = with_branch(req, t).withColumn("_id", X.clean("employee_id"))
    r = _flag(r, t.employee.select(F.col("employee_id").alias("_id")), ["_id"], "_exists", unique=True)
    pre = first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (X.is_blank("employee_id") | X.is_blank("full_name") | X.is_blank("job_title"), str(X.E_INPUT)),
        (F.col("_exists"), str(X.E_NOT_FOUND)),
    ])
    r = r.withColumn("_pre", pre)
    r = _first_valid(r, ["_id"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_NOT_FOUND))))
    added = with_defaults(r.where(F.col("_code").isNull()).select(
        F.col("_id").alias("employee_id"), "full_name", "job_title", "_branch"), "employee", own_branch=F.col("_branch"))
    tables = t.with_tables(employee=t.employee.unionByName(added))
    return ChangeResult(tables, _outcome(r, F.col("_id").alias("employee_id"),
                                         F.col("_branch").alias("branch_code")))


NO_FIELDS = "NO_FIELDS"      # the service: a patch must give a field


def patch_employees(t: Tables, req: DataFrame, service_rules: bool = False) -> ChangeResult:
    """Overwrite only non-blank fields of an employee of the branch.

    Guards: branch (BAD_BRANCH); blank id (50000); no such employee in this
    branch (50001).  The last non-blank value of each field wins.
    ``service_rules`` also refuses a patch without any field (NO_FIELDS, after
    the blank id), as the service does before it calls the procedure.
    """
    r = with_branch(req, t).withColumn("_id", X.clean("employee_id"))
    emp = t.employee.select(F.col("employee_id").alias("_id"), F.col("branch_code").alias("_branch"))
    r = _flag(r, emp, ["_id", "_branch"], "_exists", unique=True)
    r = r.withColumn("_code", first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (X.is_blank("employee_id"), str(X.E_INPUT)),
        (F.lit(service_rules) & X.is_blank("full_name") & X.is_blank("job_title"), NO_FIELDS),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
    ]))
    ok = F.col("_code").isNull()
    latest = (r.where(ok).groupBy("_id").agg(
        _last_value(X.clean("full_name"), F.col("seq"), ~X.is_blank("full_name")).alias("_name"),
        _last_value(X.clean("job_title"), F.col("seq"), ~X.is_blank("job_title")).alias("_title")))
    e = t.employee.join(latest.withColumnRenamed("_id", "employee_id"), "employee_id", "left")
    new_emp = e.select("employee_id", F.coalesce("_name", "full_name").alias("full_name"),
                       F.coalesce("_title", "job_title").alias("job_title"), "branch_code")
    # The row as it stands right after each accepted request.
    acc = ordered.bucketize(r.where(ok), ["_id"])
    acc = ordered.running_last(acc, ["_id"], {
        "_n": F.when(~X.is_blank("full_name"), X.clean("full_name")),
        "_t": F.when(~X.is_blank("job_title"), X.clean("job_title"))})
    old = t.employee.select(F.col("employee_id").alias("_id"), F.col("full_name").alias("_n0"),
                            F.col("job_title").alias("_t0"))
    after = acc.join(old, "_id", "left").select(
        "seq", F.coalesce("_n", "_n0").alias("full_name_after"), F.coalesce("_t", "_t0").alias("job_title_after"))
    out = r.join(after, "seq", "left")
    return ChangeResult(t.with_tables(employee=new_emp),
                        _outcome(out, F.col("_id").alias("employee_id"), F.col("_branch").alias("branch_code"),
                                 "full_name_after", "job_title_after"))


def delete_employees(t: Tables, req: DataFrame) -> ChangeResult:
    """Delete employees of the branch.

    Guards: branch (BAD_BRANCH); blank id (50000); no such employee in this
    branch at that time (50001, also for a repeat after a delete); employee
    named on an invoice (FK_INVOICE: the reference's foreign key refuses it).
    """
    r = with_branch(req, t).withColumn("_id", X.clean("employee_id"))
    emp = t.employee.select(F.col("employee_id").alias("_id"), F.col("branch_code").alias("_branch"))
    r = _flag(r, emp, ["_id", "_branch"], "_exists", unique=True)
    sold = t.invoice.where(F.col("employee_id").isNotNull()).select(F.col("employee_id").alias("_id"))
    r = _flag(r, sold, ["_id"], "_used")
    pre = first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (X.is_blank("employee_id"), str(X.E_INPUT)),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
        (F.col("_used"), FK_INVOICE),
    ])
    r = r.withColumn("_pre", pre)
    r = _first_valid(r, ["_id", "_branch"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_NOT_FOUND))))
    gone = r.where(F.col("_code").isNull()).select(F.col("_id").alias("employee_id"),
                                                    F.col("_branch").alias("branch_code"))
    new_emp = t.employee.join(gone, ["employee_id", "branch_code"], "left_anti")
    return ChangeResult(t.with_tables(employee=new_emp),
                        _outcome(r, F.col("_id").alias("employee_id"), F.col("_branch").alias("branch_code")))


# ------------------------------------------------------------------ products
def create_products(t: Tables, req: DataFrame, service_rules: bool = False) -> ChangeResult:
    """Requests (seq, product_code, product_name, unit_price).

    Guards: blank code, blank name, price <= 0 (50000); NULL price
    (NOT_NULL); code exists, also when an earlier request created it
    (50000).  A created product gets a 0-stock row in every branch where
    it has none.  ``service_rules`` applies the service layer first: an
    empty or missing name becomes the code, a missing price becomes 0.
    """
    if service_rules:
        req = req.withColumn("product_name", F.when(
            F.col("product_name").isNull() | (F.col("product_name") == ""), X.clean("product_code"))
            .otherwise(F.col("product_name"))) \
            .withColumn("unit_price", F.coalesce(F.col("unit_price"), F.lit(0).cast(MONEY)))
    r = req.withColumn("_code_in", X.clean("product_code"))
    r = _flag(r, t.product.select(F.col("product_code").alias("_code_in")), ["_code_in"], "_exists", unique=True)
    r = r.withColumn("_pre", first_code(central_only(req) + [
        (X.is_blank("product_code") | X.is_blank("product_name"), str(X.E_INPUT)),
        (F.col("unit_price") <= 0, str(X.E_INPUT)),
        (F.col("_exists"), str(X.E_INPUT)),
        (F.col("unit_price").isNull(), NOT_NULL),
    ]))
    r = _first_valid(r, ["_code_in"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_INPUT))))
    new = r.where(F.col("_code").isNull()).select(
        F.col("_code_in").alias("product_code"), X.clean("product_name").alias("product_name"),
        F.col("unit_price").cast(MONEY).alias("unit_price"))
    active = t.branch.where(F.col("is_active")).select("branch_code")
    stock = (with_every_branch(new.select("product_code"), "product_code", active)
             .join(t.inventory.select("product_code", "branch_code"), ["product_code", "branch_code"],
                   "left_anti")
             .select("product_code", "branch_code", F.lit(0).cast("int").alias("qty")))
    tables = t.with_tables(product=t.product.unionByName(new),
                           inventory=t.inventory.unionByName(stock))
    res = ChangeResult(tables, _outcome(r, F.col("_code_in").alias("product_code")))
    res.created_stock = stock
    return res


def patch_products(t: Tables, req: DataFrame) -> ChangeResult:
    """P5: patch name (if non-blank) and price (if not NULL).

    Guards: blank code (50000); price given and <= 0 (50000); unknown
    product (50001).
    """
    r = req.withColumn("_code_in", X.clean("product_code"))
    r = _flag(r, t.product.select(F.col("product_code").alias("_code_in")), ["_code_in"], "_exists", unique=True)
    r = r.withColumn("_code", first_code(central_only(req) + [
        (X.is_blank("product_code"), str(X.E_INPUT)),
        (F.col("unit_price").isNotNull() & (F.col("unit_price") <= 0), str(X.E_INPUT)),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
    ]))
    ok = F.col("_code").isNull()
    latest = (r.where(ok).groupBy(F.col("_code_in").alias("product_code")).agg(
        _last_value(X.clean("product_name"), F.col("seq"), ~X.is_blank("product_name")).alias("_name"),
        _last_value(F.col("unit_price").cast(MONEY), F.col("seq"), F.col("unit_price").isNotNull())
        .alias("_price")))
    p = t.product.join(latest, "product_code", "left")
    new_prod = p.select("product_code", F.coalesce("_name", "product_name").alias("product_name"),
                        F.coalesce("_price", "unit_price").cast(MONEY).alias("unit_price"))
    # The row as it stands right after each accepted request.
    acc = ordered.bucketize(r.where(ok), ["_code_in"])
    acc = ordered.running_last(acc, ["_code_in"], {
        "_n": F.when(~X.is_blank("product_name"), X.clean("product_name")),
        "_p": F.col("unit_price").cast(MONEY)})
    old = t.product.select(F.col("product_code").alias("_code_in"), F.col("product_name").alias("_n0"),
                           F.col("unit_price").alias("_p0"))
    after = acc.join(old, "_code_in", "left").select(
        "seq", F.coalesce("_n", "_n0").alias("product_name_after"),
        F.coalesce("_p", "_p0").cast(MONEY).alias("unit_price_after"))
    out = r.join(after, "seq", "left")
    return ChangeResult(t.with_tables(product=new_prod),
                        _outcome(out, F.col("_code_in").alias("product_code"),
                                 "product_name_after", "unit_price_after"))


def delete_products(t: Tables, req: DataFrame) -> ChangeResult:
    """Delete products with their stock rows in every branch.

    Guards: blank code (50000); unknown at that time (50001, also a repeat
    after a delete); sold in any branch (50002).  All guards run before the
    change, which is one new snapshot (no half-deleted branches, Q8).
    """
    r = req.withColumn("_code_in", X.clean("product_code"))
    r = _flag(r, t.product.select(F.col("product_code").alias("_code_in")), ["_code_in"], "_exists", unique=True)
    r = _flag(r, t.invoice_line.select(F.col("product_code").alias("_code_in")), ["_code_in"], "_sold")
    r = r.withColumn("_pre", first_code(central_only(req) + [
        (X.is_blank("product_code"), str(X.E_INPUT)),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
        (F.col("_sold"), str(X.E_50002)),
    ]))
    r = _first_valid(r, ["_code_in"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_NOT_FOUND))))
    gone = r.where(F.col("_code").isNull()).select(F.col("_code_in").alias("product_code"))
    tables = t.with_tables(product=t.product.join(gone, "product_code", "left_anti"),
                           inventory=t.inventory.join(gone, "product_code", "left_anti"))
    return ChangeResult(tables, _outcome(r, F.col("_code_in").alias("product_code")))


# ------------------------------------------------------------------ stock
def _stock_requests(t: Tables, req: DataFrame) -> DataFrame:
    r = with_branch(req, t).withColumn("_code_in", X.clean("product_code"))
    inv = t.inventory.select(F.col("product_code").alias("_code_in"), F.col("branch_code").alias("_branch"))
    return _flag(r, inv, ["_code_in", "_branch"], "_exists", unique=True)


def _stock_outcome(r: DataFrame, after: DataFrame) -> DataFrame:
    out = r.join(after, "seq", "left")
    return _outcome(out, F.col("_branch").alias("branch_code"), F.col("_code_in").alias("product_code"),
                    "qty_after")


def set_stock(t: Tables, req: DataFrame) -> ChangeResult:
    """Requests (seq, branch_code, product_code, qty) overwrite a stock row.

    Guards: branch (50000); blank code (50000); qty < 0 (50000); NULL qty
    (NOT_NULL); no stock row (50001).  The last accepted value wins.
    """
    r = _stock_requests(t, req)
    r = r.withColumn("_code", first_code([
        (~F.col("_branch_ok"), str(X.E_INPUT)),
        (X.is_blank("product_code"), str(X.E_INPUT)),
        (F.col("qty") < 0, str(X.E_INPUT)),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
        (F.col("qty").isNull(), NOT_NULL),
    ]))
    ok = F.col("_code").isNull()
    last = (r.where(ok).groupBy(F.col("_code_in").alias("product_code"), F.col("_branch").alias("branch_code"))
            .agg(_last_value(F.col("qty").cast("int"), F.col("seq"), F.lit(True)).alias("_qty")))
    new_inv = (t.inventory.join(last, ["product_code", "branch_code"], "left")
               .select("product_code", "branch_code", F.coalesce("_qty", "qty").cast("int").alias("qty")))
    # Right after an accepted set, the row holds that request's quantity.
    after = r.where(ok).select("seq", F.col("qty").cast("int").alias("qty_after"))
    return ChangeResult(t.with_tables(inventory=new_inv), _stock_outcome(r, after))


def receive_stock(t: Tables, req: DataFrame) -> ChangeResult:
    """Goods receipt adds to an existing stock row (never creates one).

    Guards: branch, blank code, qty <= 0 (50000); NULL qty (NOT_NULL); no
    stock row (50001).  Accepted quantities are summed per key.
    """
    r = _stock_requests(t, req)
    r = r.withColumn("_code", first_code([
        (~F.col("_branch_ok"), str(X.E_INPUT)),
        (X.is_blank("product_code"), str(X.E_INPUT)),
        (F.col("qty") <= 0, str(X.E_INPUT)),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
        (F.col("qty").isNull(), NOT_NULL),
    ]))
    ok = F.col("_code").isNull()
    add = (r.where(ok).groupBy(F.col("_code_in").alias("product_code"), F.col("_branch").alias("branch_code"))
           .agg(F.sum(F.col("qty").cast("bigint")).alias("_add")))
    new_inv = (t.inventory.join(add, ["product_code", "branch_code"], "left")
               .select("product_code", "branch_code",
                       (F.col("qty") + F.coalesce("_add", F.lit(0))).cast("int").alias("qty")))
    # Right after an accepted receipt: opening + all accepted receipts up to it.
    keys = ["_code_in", "_branch"]
    acc = ordered.bucketize(r.where(ok).withColumn("_q", F.col("qty").cast("bigint")), keys)
    acc = ordered.running_sums(acc, keys, ["_q"])
    opening = t.inventory.select(F.col("product_code").alias("_code_in"), F.col("branch_code").alias("_branch"),
                                 F.col("qty").alias("_q0"))
    after = acc.join(opening, keys, "left").select(
        "seq", (F.col("_q0") + F.col("p__q") + F.col("_q")).cast("int").alias("qty_after"))
    return ChangeResult(t.with_tables(inventory=new_inv), _stock_outcome(r, after))


def create_stock_rows(t: Tables, req: DataFrame) -> ChangeResult:
    """P14 (create): add a stock row for a known product where none exists.

    Guards: branch (BAD_BRANCH); unknown product (50001); row exists, also
    after an earlier request created it (50000).
    """
    r = _stock_requests(t, req)
    r = _flag(r, t.product.select(F.col("product_code").alias("_code_in")), ["_code_in"], "_known", unique=True)
    r = r.withColumn("_pre", first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (~F.col("_known"), str(X.E_NOT_FOUND)),
        (F.col("_exists"), str(X.E_INPUT)),
    ]))
    r = _first_valid(r, ["_code_in", "_branch"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_INPUT))))
    new = with_defaults(r.where(F.col("_code").isNull()).select(
        F.col("_code_in").alias("product_code"), "_branch",
        F.coalesce(F.col("qty"), F.lit(0)).cast("int").alias("qty")), "inventory", own_branch=F.col("_branch"))
    new_inv = t.inventory.unionByName(new)
    after = r.where(F.col("_code").isNull()).select(
        "seq", F.coalesce(F.col("qty"), F.lit(0)).cast("int").alias("qty_after"))
    return ChangeResult(t.with_tables(inventory=new_inv), _stock_outcome(r, after))


def delete_stock_rows(t: Tables, req: DataFrame) -> ChangeResult:
    """P14 (delete): remove a stock row; missing at that time -> 50001."""
    r = _stock_requests(t, req)
    r = r.withColumn("_pre", first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
    ]))
    r = _first_valid(r, ["_code_in", "_branch"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_NOT_FOUND))))
    gone = r.where(F.col("_code").isNull()).select(F.col("_code_in").alias("product_code"),
                                                    F.col("_branch").alias("branch_code"))
    new_inv = t.inventory.join(gone, ["product_code", "branch_code"], "left_anti")
    return ChangeResult(t.with_tables(inventory=new_inv),
                        _outcome(r, F.col("_branch").alias("branch_code"),
                                 F.col("_code_in").alias("product_code")))


# ------------------------------------------------------------------ invoices
def delete_invoices(t: Tables, req: DataFrame) -> ChangeResult:
    """Delete invoices of a branch with their lines.

    Requests (seq, branch_code, invoice_id); the invoice must exist in that
    branch at that time (50001, also for a repeat).
    """
    r = with_branch(req, t).withColumn("_id", X.clean("invoice_id"))
    inv = t.invoice.select(F.col("invoice_id").alias("_id"), F.col("branch_code").alias("_branch"))
    r = _flag(r, inv, ["_id", "_branch"], "_exists", unique=True)
    r = r.withColumn("_pre", first_code([
        (~F.col("_branch_ok"), BAD_BRANCH),
        (~F.col("_exists"), str(X.E_NOT_FOUND)),
    ]))
    r = _first_valid(r, ["_id", "_branch"], F.col("_pre").isNull())
    r = r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                     .when(~F.col("_first"), F.lit(str(X.E_NOT_FOUND))))
    gone = r.where(F.col("_code").isNull()).select(F.col("_id").alias("invoice_id"),
                                                    F.col("_branch").alias("branch_code"))
    tables = t.with_tables(
        invoice=t.invoice.join(gone, ["invoice_id", "branch_code"], "left_anti"),
        invoice_line=t.invoice_line.join(gone, ["invoice_id", "branch_code"], "left_anti"))
    tables = tables.with_deltas(invoice=Delta(t.invoice, removed=gone), invoice_line=Delta(t.invoice_line, removed=gone))
    lines = t.invoice_line.join(gone, ["invoice_id", "branch_code"], "left_semi") \
        .groupBy(F.col("invoice_id").alias("_id"), F.col("branch_code").alias("_branch")) \
        .agg(F.count(F.lit(1)).alias("_lines"))
    out = r.join(lines, ["_id", "_branch"], "left")
    ok = F.col("_code").isNull()
    return ChangeResult(tables, _outcome(out, F.col("_id").alias("invoice_id"),
                                         F.col("_branch").alias("branch_code"),
                                         F.when(ok, F.coalesce("_lines", F.lit(0))).cast("bigint")
                                         .alias("lines_deleted")))


def replace_invoices(t: Tables, req: DataFrame) -> ChangeResult:
    """Replace an invoice's lines by one line (the mock store's update).

    Requests (seq, branch_code, invoice_id, product_code, product_name, qty,
    unit_price, total_amount, employee_id, note).  The invoice must exist in
    the branch (50001); while it has no line, a request must give both a
    product and a quantity (NOT_NULL).  Every field falls back to the invoice's current
    row: the product to the last given one (first line by code at the
    start), the quantity to the last positive one, the employee to the last
    non-blank one, the note to the last non-NULL one.  The price is the
    given price if > 0, else total / quantity if both > 0, else the
    catalogue price (0 when unknown); it is written to the catalogue, with
    the name (last non-blank, else the catalogue name, else the code).

    Each rule is "last value up to this request", i.e. a window ``last(...,
    ignorenulls)`` per invoice and per product ordered by seq: exact in
    request order without a row loop.
    """
    r = with_branch(req, t).withColumn("_id", X.clean("invoice_id"))
    inv = t.invoice.select(F.col("invoice_id").alias("_id"), F.col("branch_code").alias("_branch"),
                           F.col("employee_id").alias("_emp0"), F.col("note").alias("_note0"), F.lit(True).alias("_here"))
    r = r.join(inv, ["_id", "_branch"], "left").withColumn("_exists", F.coalesce("_here", F.lit(False))).drop("_here")
    r = r.withColumn("_pre", first_code([(~F.col("_branch_ok"), BAD_BRANCH),
                                         (~F.col("_exists"), str(X.E_NOT_FOUND))]))
    # The first line of the requested invoices; an invoice without lines
    # starts with the first request that gives both product and quantity.
    given = X.blank_to_null("product_code").isNotNull() & (F.col("qty") > 0)
    asked = r.where(F.col("_pre").isNull()).groupBy("_id", "_branch").agg(
        F.min(F.when(given, F.col("seq"))).alias("_start"))
    first = (t.invoice_line.select(F.col("invoice_id").alias("_id"), F.col("branch_code").alias("_branch"),
                                   "product_code", "qty")
             .join(asked.select("_id", "_branch"), ["_id", "_branch"], "left_semi").groupBy("_id", "_branch")
             .agg(F.min(F.struct("product_code", "qty")).alias("_f")))
    r = r.join(asked, ["_id", "_branch"], "left").join(first, ["_id", "_branch"], "left")
    lacking = F.col("_f").isNull() & (F.col("_start").isNull() | (F.col("seq") < F.col("_start")))
    r = r.withColumn("_code", F.coalesce(F.col("_pre"), F.when(lacking, F.lit(NOT_NULL)))).drop("_pre", "_start")
    ok, r = r.where(F.col("_code").isNull()), r.drop("_f")
    # "Last value up to this request" per invoice, then per product; both
    # are skew-safe ordered scans.
    ok = ordered.bucketize(ok, ["_id", "_branch"])
    ok = ordered.running_last(ok, ["_id", "_branch"], {
        "_p": X.blank_to_null("product_code"),
        "_q": F.when(F.col("qty") > 0, F.col("qty")),
        "_e": X.blank_to_null("employee_id"),
        "_n": F.col("note")})
    ok = ok.select(*[c for c in ok.columns if c != "bucket"],
                   F.coalesce("_p", F.col("_f.product_code")).alias("product_code_after"),
                   F.coalesce("_q", F.col("_f.qty")).cast("int").alias("qty_after"),
                   F.coalesce("_e", "_emp0").alias("employee_id_after"),
                   F.coalesce("_n", "_note0").alias("note_after"))
    cat = t.product.select(F.col("product_code").alias("product_code_after"), F.col("product_name").alias("_name0"),
                           F.col("unit_price").alias("_price0"))
    ok = ok.join(cat, "product_code_after", "left")
    explicit = (F.when(F.col("unit_price") > 0, F.col("unit_price"))
                .when((F.col("total_amount") > 0) & (F.col("qty") > 0), F.col("total_amount") / F.col("qty")))
    ok = ordered.bucketize(ok, ["product_code_after"])
    ok = ordered.running_last(ok, ["product_code_after"], {
        "_price": explicit.cast(MONEY), "_name": X.blank_to_null("product_name")})
    ok = ok.select("*",
                   F.coalesce("_price", "_price0", F.lit(0)).cast(MONEY).alias("unit_price_after"),
                   F.coalesce("_name", "_name0", "product_code_after").alias("product_name_after"))
    after = ok.select("seq", "product_code_after", "qty_after", "unit_price_after", "product_name_after",
                      "employee_id_after", "note_after")
    out = r.join(after, "seq", "left")
    # New state: each replaced invoice keeps the row of its last request.
    last_row = (ok.groupBy("_id", "_branch")
                .agg(F.max(F.struct("seq", "product_code_after", "qty_after", "unit_price_after",
                                    "employee_id_after", "note_after")).alias("l")))
    lines = last_row.select(F.col("_id").alias("invoice_id"), F.col("l.product_code_after").alias("product_code"),
                            F.col("l.qty_after").alias("qty"), F.col("l.unit_price_after").alias("unit_price"),
                            F.col("_branch").alias("branch_code"))
    gone = last_row.select(F.col("_id").alias("invoice_id"), F.col("_branch").alias("branch_code"))
    heads = (t.invoice.join(last_row.withColumnRenamed("_id", "invoice_id").withColumnRenamed("_branch", "branch_code"),
                            ["invoice_id", "branch_code"], "left")
             .select("invoice_id",
                     F.when(F.col("l").isNotNull(), F.col("l.note_after")).otherwise(F.col("note")).alias("note"),
                     "created_at", "branch_code",
                     F.when(F.col("l").isNotNull(), F.col("l.employee_id_after")).otherwise(F.col("employee_id"))
                     .alias("employee_id")))
    prods = (ok.groupBy(F.col("product_code_after").alias("product_code"))
             .agg(F.max(F.struct("seq", "product_name_after", "unit_price_after")).alias("p")))
    new_prod = (t.product.join(prods, "product_code", "full")
                .select("product_code",
                        F.coalesce(F.col("p.product_name_after"), F.col("product_name")).alias("product_name"),
                        F.coalesce(F.col("p.unit_price_after"), F.col("unit_price")).cast(MONEY).alias("unit_price")))
    tables = t.with_tables(
        invoice=heads,
        invoice_line=t.invoice_line.join(gone, ["invoice_id", "branch_code"], "left_anti")
        .unionByName(lines),
        product=new_prod)
    tables = tables.with_deltas(
        invoice=Delta(t.invoice, heads.join(gone, ["invoice_id", "branch_code"], "left_semi"), gone),
        invoice_line=Delta(t.invoice_line, lines, gone))
    ok_col = F.col("_code").isNull()
    return ChangeResult(tables, _outcome(
        out, F.col("_id").alias("invoice_id"), F.col("_branch").alias("branch_code"),
        *[F.when(ok_col, F.col(c)).alias(c) for c in ("product_code_after", "qty_after", "unit_price_after",
                                                       "product_name_after", "employee_id_after", "note_after")]))
