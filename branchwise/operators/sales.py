"""Sales and stock transfers (P9, P10, P11): ordered, stock-consuming changes.

Static guards (blank fields, unknown employee, bad items, no price) look at
each request alone.  What depends on earlier requests -- stock left, a
stock row created by an earlier transfer, an invoice line added by an
earlier sale -- goes through the exact ordered replay of ``acceptance``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.functions import exprs as X
from branchwise.operators import acceptance as A
from branchwise.operators.changes import NOT_NULL, ChangeResult, _flag, central_only, first_code, with_branch
from branchwise.operators.listings import explode_items
from branchwise.session import materialize
from branchwise.sources.schemas import AMOUNT, MONEY, TOTAL, Delta, Tables, with_defaults

PK_LINE = "PK_LINE"          # the same product again on an existing invoice (Q6)
PK_INVOICE = "PK_INVOICE"    # the invoice id belongs to another branch
PRICE_CONFLICT = "PRICE_CONFLICT"  # a product given twice at different prices


def _now_lit(now) -> Column:
    if now is None:
        return F.localtimestamp()
    if isinstance(now, _dt.date) and not isinstance(now, _dt.datetime):
        now = _dt.datetime(now.year, now.month, now.day)
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def _stock_opening(t: Tables) -> DataFrame:
    return t.inventory.select(F.lit("S").alias("kind"), F.col("product_code").alias("k1"),
                              F.col("branch_code").alias("k2"), "qty")


def _line_opening(t: Tables, invoice_ids: DataFrame) -> DataFrame:
    """Existing lines of the requested invoices only (semi join first)."""
    ids = invoice_ids.select(F.col("_inv").alias("invoice_id")).distinct()
    lines = t.lines_of(ids) if t.lines_of is not None else t.invoice_line.join(ids, "invoice_id", "left_semi")
    return lines.select(F.lit("L").alias("kind"), F.col("invoice_id").alias("k1"),
                        F.col("product_code").alias("k2"), F.lit(0).alias("qty"))


def _invoice_owner(t: Tables, r: DataFrame) -> DataFrame:
    """Flag requests whose invoice id belongs to another branch already
    (``_foreign``) and those that name a new one (``_is_new``)."""
    existing = t.invoice.select(F.col("invoice_id").alias("_inv"), F.col("branch_code").alias("_owner"))
    j = r.join(existing, "_inv", "left")
    return j.withColumn("_foreign", F.coalesce(F.col("_owner") != F.col("_branch"), F.lit(False))) \
        .withColumn("_is_new", F.col("_owner").isNull()).drop("_owner")


def _owner_moves(live: DataFrame) -> DataFrame:
    """Ownership of new invoice ids that several branches name, as moves.

    An accepted request makes the invoice exist in its branch (a credit on
    the key of invoice and branch), and it must not exist in any of the other
    branches that name it.  So a request that fails leaves the id free.
    """
    named = live.where("_is_new").select("_inv", F.col("_branch").alias("_other")).distinct()
    several = named.groupBy("_inv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_inv")
    named = named.join(several, "_inv")
    at = live.select("seq", "_inv", "_branch").join(named, "_inv")
    own = F.col("_branch") == F.col("_other")
    return at.select("seq", F.lit("O").alias("kind"), F.col("_inv").alias("k1"), F.col("_other").alias("k2"),
                     F.lit(0).cast("bigint").alias("debit"), F.when(own, 1).otherwise(0).cast("bigint").alias("credit"),
                     F.lit(False).alias("chk_exists"), F.lit(False).alias("chk_enough"), F.lit(False).alias("chk_absent"),
                     (~own).alias("chk_foreign"))


def _sale_effects(t: Tables, r: DataFrame, merged: DataFrame, settled: A.Settled | None,
                  now) -> tuple[Tables, DataFrame]:
    """Apply accepted sales: headers, lines, stock; return tables and status."""
    if settled is not None:
        dyn = settled.status.select("seq", F.col("status").alias("_st"), F.col("reject_code").alias("_dyn"))
        r = r.join(dyn, "seq", "left")
        code = F.coalesce(F.col("_code"), F.when(F.col("_st") == A.REJECTED, F.col("_dyn")))
    else:
        code = F.col("_code")
    r = r.withColumn("_final", code)
    # said twice: what the guards refuse is left out before the join
    acc = r.where(F.col("_code").isNull() & F.col("_final").isNull())
    acc_lines = merged.join(acc.select("seq", "_inv", "_branch"), "seq")
    new_lines = (acc_lines.where(F.col("_cat").isNotNull())
                 .select(F.col("_inv").alias("invoice_id"), F.col("item_code").alias("product_code"),
                         F.col("qty").cast("int").alias("qty"),
                         F.coalesce(F.nullif("price", F.lit(0)), "_cat").cast(MONEY).alias("unit_price"),
                         F.col("_branch").alias("branch_code")))
    heads = (acc.where("_is_new").groupBy("_inv")
             .agg(F.min(F.struct("seq", "note", "_branch", "_emp")).alias("h"))
             .select(F.col("_inv").alias("invoice_id"), F.col("h.note").alias("note"), F.col("h._branch"),
                     F.col("h._emp").alias("employee_id")))
    heads = with_defaults(heads, "invoice", now=_now_lit(now), own_branch=F.col("_branch"))
    deltas = {"invoice": Delta(t.invoice, heads), "invoice_line": Delta(t.invoice_line, new_lines)}
    if settled is not None:
        new_stock, deltas["inventory"] = _stock_after(t, settled.moves.where(F.col("kind") == "S"))
    else:
        new_stock = t.inventory
    tables = t.with_tables(invoice=t.invoice.unionByName(heads),
                           invoice_line=t.invoice_line.unionByName(new_lines),
                           inventory=new_stock).with_deltas(**deltas)
    return tables, r


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that ``rows`` hold more than once, as often as they do.
    Written, as the planner then knows that they are few."""
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return materialize(several.select(*keys, F.explode(F.sequence(F.lit(1), "_n"))).select(*keys), "single lines: repeated keys")


def _mark(r: DataFrame, name: str, key: Column, several: Column) -> DataFrame:
    """Flag the rows whose ``key``, a hash, is one of those where ``several``
    (an aggregate) holds.  Equal hashes only flag a row too many."""
    marked = r.select(key.alias(f"{name}_key"), "*").groupBy(f"{name}_key").agg(several.alias(name)).where(name)
    marked = materialize(marked, "single lines: marks")
    return r.withColumn(f"{name}_key", key).join(marked, f"{name}_key", "left").drop(f"{name}_key") \
        .withColumn(name, F.coalesce(name, F.lit(False)))


def _stock_after(t: Tables, moves: DataFrame) -> tuple[DataFrame, Delta]:
    """The stock after the accepted moves, and its rows that they changed."""
    def rows(balances: DataFrame) -> DataFrame:
        return balances.select(F.col("k1").alias("product_code"), F.col("k2").alias("branch_code"),
                               F.col("qty").cast("int").alias("qty"))
    opening = _stock_opening(t)
    touched = moves.select(*A.KEY).distinct()
    added = rows(A.apply_deltas(opening.join(touched, A.KEY, "left_semi"), moves))
    return rows(A.apply_deltas(opening, moves)), Delta(t.inventory, added, added.select("product_code", "branch_code"))


def items_of(req: DataFrame) -> DataFrame:
    """The item rows (seq, item_code, item_qty, item_price) of JSON documents."""
    items = explode_items(req.select("seq", "items_json"))
    return items.where(F.col("item_pos").isNotNull()).select("seq", "item_pos", "item_code", "item_qty", "item_price")


def service_items(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The item rows of API request bodies: the other columns of ``bodies``,
    item_pos, item_code, item_qty, item_price (0: none given).

    Items without code, quantity and price are dropped.  If none is left, the
    body's own product is the single item; without that the request has no
    row.  Missing and non-numeric numbers count as 0 (F16)."""
    document, at = F.try_parse_json(F.col(body)), lambda v, path, kind: F.try_variant_get(v, F.lit(path), kind)

    def item(v, pos):
        return F.struct(pos.alias("item_pos"), F.trim(F.coalesce(at(v, "$.productCode", "string"), F.lit(""))).alias("item_code"),
                        X.to_number(at(v, "$.quantity", "string")).cast("int").alias("item_qty"),
                        X.to_number(at(v, "$.unitPrice", "string")).cast(MONEY).alias("item_price"))

    own = [c for c in bodies.columns if c != body]
    rows = bodies.select(*own, document.alias("_document"))
    given = F.filter(F.transform(at(F.col("_document"), "$.items", "array<variant>"), lambda v, i: item(v, i)),
                     lambda x: (x["item_code"] != "") | (x["item_qty"] != 0) | (x["item_price"] != 0))
    rows = rows.select(*own, given.alias("_given"), item(F.col("_document"), F.lit(0)).alias("_single"))
    items = F.when(F.size("_given") > 0, F.col("_given")).when(F.col("_single.item_code") != "", F.array("_single"))
    return rows.select(*own, F.explode(items).alias("_item")).select(*own, "_item.*")


#: How the given prices of a product's items make one price, by the name of
#: the policy: the largest one (the sale procedure), the first positive one by
#: item position (the service), or one that all items must agree on.
PRICE_POLICIES = {
    "max": lambda: F.max("item_price"),
    "first_positive": lambda: F.min(F.when(F.col("item_price") > 0, F.struct("item_pos", "item_price"))).getField("item_price"),
    "error": lambda: F.max("item_price"),
}


def _conflict() -> Column:
    """Whether the items of a product give different prices (none counts as 0)."""
    price = F.coalesce(F.col("item_price"), F.lit(0).cast(MONEY))
    return F.min(price) != F.max(price)


def merge_items(items: DataFrame, price_policy: str = "max") -> DataFrame:
    """One row per (request, product): quantities summed, one given price kept
    by ``price_policy``; ``error`` adds ``conflict``.  Every policy is an
    aggregate with a partial one before the shuffle."""
    more = [_conflict().alias("conflict")] if price_policy == "error" else []
    return (items.where(F.col("item_code").isNotNull() & (F.col("item_code") != ""))
            .groupBy("seq", "item_code")
            .agg(F.sum(F.col("item_qty").cast("bigint")).alias("qty"), PRICE_POLICIES[price_policy]().alias("price"), *more))


def post_invoices(t: Tables, req: DataFrame, now=None, generate_ids: str | None = None,
                  fold_item_codes: bool = False, items: DataFrame | None = None,
                  price_policy: str = "max") -> ChangeResult:
    """P10: multi-line sales, all-or-nothing.

    Requests (seq, invoice_id, employee_id, note, branch_code) with their
    items either as a JSON document (``items_json``), as the API takes them,
    or as rows ``items`` (seq, item_code, item_qty, item_price), where a
    request may have any number.
    Guards in order: branch, blank invoice / employee / items (50000);
    employee not of the branch (50001); no items or bad JSON (50002); an
    item without code or with quantity NULL or <= 0 (50003); a product
    without a positive price (50004); invoice id of another branch
    (PK_INVOICE); stock row missing or short for any product (50005); a
    product already on the invoice (PK_LINE).

    ``price_policy`` says which given price counts where a product comes more
    than once (``PRICE_POLICIES``; rows need ``item_pos`` for the first
    positive one).  With ``error``, different prices are refused
    (PRICE_CONFLICT, after 50003).

    ``generate_ids`` (a batch tag) applies the service form: every request
    gets a new invoice id ``HD_<tag>_<seq>`` instead of the one it names.
    ``fold_item_codes`` folds the item codes of the documents like
    ``keys.fold_keys`` folds ids (case-insensitive matching, opt-in).
    """
    if generate_ids is not None:
        req = req.withColumn("invoice_id", X.generated_id("HD_", generate_ids))
    # The request batch is read once: it is materialised in the shared
    # checkpoint folder, and so are the parsed items and the guard results,
    # which every later step reads several times.
    req = materialize(req, "sales: requests")
    r = with_branch(req, t).withColumn("_inv", X.clean("invoice_id")).withColumn("_emp", X.clean("employee_id"))
    emp = t.employee.select(F.col("employee_id").alias("_emp"), F.col("branch_code").alias("_branch"))
    r = _flag(r, emp, ["_emp", "_branch"], "_emp_ok", unique=True)
    # Items are parsed once: one row per (request, item code) carries the
    # merged quantity and price and the item checks of its raw items.
    if items is None:
        items, no_items = items_of(req), X.is_blank("items_json")
    else:
        req, no_items = req.withColumn("items_json", F.lit(None).cast("string")), F.lit(False)
        r = r.withColumn("items_json", F.lit(None).cast("string"))
    if fold_item_codes:
        items = items.withColumn("item_code", F.upper(F.col("item_code")))
    bad = X.is_blank("item_code") | F.col("item_qty").isNull() | (F.col("item_qty") <= 0)
    per_item = materialize(
        items.groupBy("seq", "item_code")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(bad).alias("_bad"),
             F.sum(F.col("item_qty").cast("bigint")).alias("qty"), PRICE_POLICIES[price_policy]().alias("price"),
             (_conflict() if price_policy == "error" else F.lit(False)).alias("_conflict"))
        .join(t.product.select(F.col("product_code").alias("item_code"), F.col("unit_price").alias("_cat")),
              "item_code", "left"), "sales: items")
    merged = per_item.where(F.col("item_code").isNotNull() & (F.col("item_code") != "")) \
        .select("seq", "item_code", "qty", "price", "_cat")
    has_code = F.col("item_code").isNotNull() & (F.col("item_code") != "")
    item_stats = per_item.groupBy("seq").agg(
        F.sum("_n").alias("_n_items"), F.max("_bad").alias("_bad_item"),
        F.max(has_code & (X.resolve_price("price", "_cat") <= 0)).alias("_bad_price"), F.max(has_code & F.col("_conflict")).alias("_conflict"))
    r = r.join(item_stats, "seq", "left")
    pre = [
        (~F.col("_branch_ok"), str(X.E_INPUT)),
        (X.is_blank("invoice_id") | X.is_blank("employee_id") | no_items, str(X.E_INPUT)),
        (~F.col("_emp_ok"), str(X.E_NOT_FOUND)),
        (F.coalesce(F.col("_n_items"), F.lit(0)) == 0, str(X.E_50002)),
        (F.coalesce(F.col("_bad_item"), F.lit(False)), str(X.E_50003)),
        (F.coalesce(F.col("_conflict"), F.lit(False)), PRICE_CONFLICT),
        (F.coalesce(F.col("_bad_price"), F.lit(False)), str(X.E_50004)),
    ]
    r = r.withColumn("_pre", first_code(pre)).drop("items_json")
    r = _invoice_owner(t, r)
    r = materialize(r.withColumn("_code", F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                                 .when(F.col("_foreign"), F.lit(PK_INVOICE))), "sales: static guards")
    live = r.where(F.col("_code").isNull()).select("seq", "_inv", "_branch", "_is_new")
    m = merged.join(live, "seq")
    # A line can only collide on an invoice that exists already or that
    # several requests name; lines of any other new invoice are unique
    # (items are merged per product), so they need no line move at all.
    shared = live.groupBy("_inv").agg(F.count(F.lit(1)).alias("_uses"), F.min("_is_new").alias("_new"))
    shared = shared.where((F.col("_uses") > 1) | ~F.col("_new")).select("_inv")
    lm = m.join(shared, "_inv", "left_semi")
    moves = m.select("seq", F.lit("S").alias("kind"), F.col("item_code").alias("k1"),
                     F.col("_branch").alias("k2"), F.col("qty").alias("debit"),
                     F.lit(0).cast("bigint").alias("credit"), F.lit(True).alias("chk_exists"),
                     F.lit(True).alias("chk_enough"), F.lit(False).alias("chk_absent")) \
        .unionByName(lm.select("seq", F.lit("L").alias("kind"), F.col("_inv").alias("k1"),
                              F.col("item_code").alias("k2"), F.lit(0).cast("bigint").alias("debit"),
                              F.lit(1).cast("bigint").alias("credit"), F.lit(False).alias("chk_exists"),
                              F.lit(False).alias("chk_enough"), F.lit(True).alias("chk_absent"))) \
        .withColumn("chk_foreign", F.lit(False)).unionByName(_owner_moves(live))
    opening = _stock_opening(t).unionByName(_line_opening(t, shared))
    moves = materialize(moves, "sales: moves", "zstd")
    settled = A.settle(moves, opening, [
        (PK_INVOICE, [A.FOREIGN]), (str(X.E_50005), [A.EXISTS, A.ENOUGH]), (PK_LINE, [A.ABSENT])], balances=False)
    tables, r = _sale_effects(t, r, merged, settled, now)
    totals = (merged.where(F.col("_cat").isNotNull())
              .groupBy("seq").agg(F.count(F.lit(1)).alias("_lines"),
                                  F.sum(X.amount(F.col("qty"), X.resolve_price("price", "_cat"))).alias("_total")))
    out = r.join(totals, "seq", "left")
    ok = F.col("_final").isNull()
    outcome = out.select("seq", F.col("_inv").alias("invoice_id"), F.col("_branch").alias("branch_code"),
                         ok.alias("accepted"), F.col("_final").alias("reject_code"),
                         F.when(ok, F.col("_lines")).cast("bigint").alias("line_count"),
                         F.when(ok, F.col("_total")).cast(TOTAL).alias("total"))
    res = ChangeResult(tables, outcome)
    res.rounds = settled.rounds
    return res


def _sale_heads(t: Tables, heads: DataFrame) -> DataFrame:
    """What the guards ask of an invoice, its seller and its branch."""
    r = (with_branch(heads, t).withColumn("_inv", X.clean("invoice_id")).withColumn("_emp", X.clean("employee_id"))
         .drop("invoice_id", "employee_id", "branch_code"))
    emp = t.employee.select(F.col("employee_id").alias("_emp"), F.col("branch_code").alias("_branch"))
    return _invoice_owner(t, _flag(r, emp, ["_emp", "_branch"], "_emp_ok", unique=True))


def post_single_lines(t: Tables, req: DataFrame, strict: bool = True, now=None, heads: DataFrame | None = None) -> ChangeResult:
    """One-line sales at the catalogue price.

    Requests (seq, invoice_id, employee_id, product_code, qty, note,
    branch_code).  Guards: branch, blank ids, qty <= 0 (50000); NULL qty
    (NOT_NULL); no positive catalogue price (50001); employee not of the
    branch (50002); invoice of another branch (PK_INVOICE); stock short
    (50003); product already on the invoice (PK_LINE).  A missing stock row
    passes without a stock change when ``strict=False`` (the procedure's
    NULL comparison, Q5); by default it is refused with 50003.

    Requests of many lines an invoice may come in two tables: (seq, head,
    product_code, qty) and ``heads`` (head, invoice_id, employee_id, note,
    branch_code); a request without a head is none.  What is asked of the head
    is then asked once and does not travel with every line.
    """
    r = (_sale_heads(t, req) if heads is None else req).withColumn("item_code", X.clean("product_code")).drop("product_code")
    r = r.join(t.product.select(F.col("product_code").alias("item_code"), F.col("unit_price").alias("_cat")),
               "item_code", "left")
    if heads is not None:
        r = r.join(_sale_heads(t, heads), "head")
    stock = t.inventory.select(F.col("product_code").alias("item_code"), F.col("branch_code").alias("_branch"))
    # The strict rule finds a missing stock row in the replay, so here only
    # stock rows that come more than once matter, each of which counts.
    stock_key = ["item_code", "_branch"]
    r = _flag(r, _repeated(stock, stock_key) if strict else stock, stock_key, "_has_stock", unique=True)
    pre = [
        (~F.col("_branch_ok"), str(X.E_INPUT)),
        (X.is_blank("_inv") | X.is_blank("_emp") | X.is_blank("item_code"), str(X.E_INPUT)),
        (F.col("qty") <= 0, str(X.E_INPUT)),
        (F.col("_cat").isNull() | (F.col("_cat") <= 0), str(X.E_NOT_FOUND)),
        (~F.col("_emp_ok"), str(X.E_50002)),
        (F.col("qty").isNull(), NOT_NULL),
    ]
    r = r.withColumn("_pre", first_code(pre))
    # Every later step reads the guarded requests: they are worked out once.
    r = materialize(r.select("seq", "_inv", "_emp", "_branch", "item_code", "qty", "note", "_cat", "_has_stock", "_is_new",
                             F.when(F.col("_pre").isNotNull(), F.col("_pre"))
                             .when(F.col("_foreign"), F.lit(PK_INVOICE)).alias("_code")), "single lines: static guards", "zstd")
    live = fresh = r.where(F.col("_code").isNull())
    # A line can only collide on an invoice that exists already or with
    # another request for it; any other needs no line move at all.  Nor does
    # an invoice id that one branch names need moves of its owner.
    live = _mark(live, "_again", F.xxhash64("_inv", "item_code"), F.count(F.lit(1)) > 1)
    live = _mark(live, "_contested", F.xxhash64("_inv"), F.min("_branch") != F.max("_branch"))
    live = _mark(live, "_twice", F.col("seq"), F.count(F.lit(1)) > 1)
    on_line = F.col("_again") | ~F.col("_is_new")
    owners = _owner_moves(live.where("_contested")).withColumn("alone", F.lit(False))
    lines = live.where(on_line)
    # Without a stock row the non-strict rule neither checks nor changes stock.
    stock_live = live if strict else live.where("_has_stock")
    moves = stock_live.select("seq", F.lit("S").alias("kind"), F.col("item_code").alias("k1"),
                              F.col("_branch").alias("k2"), F.col("qty").cast("bigint").alias("debit"),
                              F.lit(0).cast("bigint").alias("credit"), F.lit(True).alias("chk_exists"),
                              F.lit(True).alias("chk_enough"), F.lit(False).alias("chk_absent"),
                              (~(on_line | F.col("_contested") | F.col("_twice"))).alias("alone")) \
        .unionByName(lines.select("seq", F.lit("L").alias("kind"), F.col("_inv").alias("k1"),
                                  F.col("item_code").alias("k2"), F.lit(0).cast("bigint").alias("debit"),
                                  F.lit(1).cast("bigint").alias("credit"), F.lit(False).alias("chk_exists"),
                                  F.lit(False).alias("chk_enough"), F.lit(True).alias("chk_absent"), F.lit(False).alias("alone"))) \
        .withColumn("chk_foreign", F.lit(False)).unionByName(owners)
    opening = _stock_opening(t).unionByName(_line_opening(t, fresh.where(~F.col("_is_new")).select("_inv")))
    settled = A.settle(moves, opening, [
        (PK_INVOICE, [A.FOREIGN]), (str(X.E_50003), [A.EXISTS, A.ENOUGH]), (PK_LINE, [A.ABSENT])], balances=False)
    merged = r.select("seq", "item_code", F.col("qty").cast("bigint").alias("qty"),
                      F.lit(None).cast(MONEY).alias("price"), "_cat")
    # Requests that the guards refuse do not meet the replay's decisions.
    tables, tried = _sale_effects(t, fresh, merged, settled, now)
    columns = ["seq", "_inv", "_branch", "item_code", "qty", "_cat", "_final"]
    r = tried.select(*columns).unionByName(r.where(F.col("_code").isNotNull()).withColumn("_final", F.col("_code")).select(*columns))
    ok = F.col("_final").isNull()
    outcome = r.select("seq", F.col("_inv").alias("invoice_id"), F.col("_branch").alias("branch_code"),
                       F.col("item_code").alias("product_code"), ok.alias("accepted"),
                       F.col("_final").alias("reject_code"),
                       F.when(ok, X.amount(F.col("qty"), F.col("_cat"))).cast(AMOUNT).alias("amount"))
    res = ChangeResult(tables, outcome)
    res.rounds = settled.rounds
    return res


def transfer_guards(t: Tables, req: DataFrame) -> DataFrame:
    """Static guards of a transfer; adds ``_from``, ``_to``, ``_code_in``, ``_code``."""
    r = with_branch(req, t, "from_branch", "_from")
    r = with_branch(r, t, "to_branch", "_to").withColumn("_code_in", X.clean("product_code"))
    return r.withColumn("_code", first_code(central_only(req) + [
        (~F.col("_from_ok") | ~F.col("_to_ok"), str(X.E_INPUT)),
        (F.col("_from") == F.col("_to"), str(X.E_INPUT)),
        (X.is_blank("product_code"), str(X.E_INPUT)),
        (F.col("qty").isNull() | (F.col("qty") <= 0), str(X.E_NOT_FOUND)),
    ]))


def transfer_stock(t: Tables, req: DataFrame) -> ChangeResult:
    """Requests (seq, from_branch, to_branch, product_code, qty).

    Guards: unknown branch, same branch, blank product (50000); qty NULL or
    <= 0 (50001); no stock row at the source at that time (50002); source
    short (50003).  Accepted: source - qty, destination + qty (the row is
    created when missing).  Before/after balances of both sides come from
    the replay's exact running balances.
    """
    r = transfer_guards(t, req)
    live = r.where(F.col("_code").isNull())
    q = F.col("qty").cast("bigint")
    moves = live.select("seq", F.lit("S").alias("kind"), F.col("_code_in").alias("k1"),
                        F.col("_from").alias("k2"), q.alias("debit"), F.lit(0).cast("bigint").alias("credit"),
                        F.lit(True).alias("chk_exists"), F.lit(True).alias("chk_enough"),
                        F.lit(False).alias("chk_absent")) \
        .unionByName(live.select("seq", F.lit("S").alias("kind"), F.col("_code_in").alias("k1"),
                                 F.col("_to").alias("k2"), F.lit(0).cast("bigint").alias("debit"), q.alias("credit"),
                                 F.lit(False).alias("chk_exists"), F.lit(False).alias("chk_enough"),
                                 F.lit(False).alias("chk_absent")))
    settled = A.settle(moves, _stock_opening(t), [(str(X.E_50002), [A.EXISTS]), (str(X.E_50003), [A.ENOUGH])])
    st = settled.status.select("seq", F.col("status").alias("_st"), F.col("reject_code").alias("_dyn"))
    r = r.join(st, "seq", "left").withColumn(
        "_final", F.coalesce(F.col("_code"), F.when(F.col("_st") == A.REJECTED, F.col("_dyn"))))
    mv = settled.moves
    src = mv.where(F.col("debit") > 0).select("seq", F.col("balance_before").alias("from_before"))
    dst = mv.where(F.col("credit") > 0).select(
        "seq", F.when(F.col("existed_before"), F.col("balance_before")).alias("to_before"))
    out = r.join(src, "seq", "left").join(dst, "seq", "left")
    ok = F.col("_final").isNull()
    outcome = out.select(
        "seq", F.col("_from").alias("from_branch"), F.col("_to").alias("to_branch"),
        F.col("_code_in").alias("product_code"), "qty", ok.alias("accepted"),
        F.col("_final").alias("reject_code"),
        F.when(ok, F.col("from_before")).alias("from_before"),
        F.when(ok, F.col("from_before") - q).alias("from_after"),
        F.when(ok, F.col("to_before")).alias("to_before"),
        F.when(ok, F.coalesce(F.col("to_before"), F.lit(0)) + q).alias("to_after"))
    new_stock, delta = _stock_after(t, mv)
    res = ChangeResult(t.with_tables(inventory=new_stock).with_deltas(inventory=delta), outcome)
    res.rounds = settled.rounds
    return res
