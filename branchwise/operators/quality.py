"""Integrity rules of the chain's schema as data-quality reports (Q-*).

The reference's database enforces primary keys, foreign keys, CHECKs and
NOT NULL on every write; Parquet enforces none, so each rule becomes a
report over whole tables.  Each report is a grouped aggregate (partial
aggregation map-side), anti/semi joins on the key, or a single-pass count;
none collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.sources.schemas import PRIMARY_KEYS, SCHEMAS, Tables

# Foreign keys: (name, child table, child columns, parent table, parent columns).
FOREIGN_KEYS = [
    ("employee_branch", "employee", ["branch_code"], "branch", ["branch_code"]),
    ("invoice_branch", "invoice", ["branch_code"], "branch", ["branch_code"]),
    ("invoice_employee", "invoice", ["employee_id"], "employee", ["employee_id"]),
    ("inventory_product", "inventory", ["product_code"], "product", ["product_code"]),
    ("inventory_branch", "inventory", ["branch_code"], "branch", ["branch_code"]),
    ("line_invoice", "invoice_line", ["invoice_id"], "invoice", ["invoice_id"]),
    ("line_product", "invoice_line", ["product_code"], "product", ["product_code"]),
]

# Fragments: a row belongs to the branch of its parent, so its key with its
# branch must be one of the parent's.
MEMBERSHIP = [
    ("invoice_line", "invoice_line", ["invoice_id", "branch_code"], "invoice", ["invoice_id", "branch_code"]),
    ("invoice_employee", "invoice", ["employee_id", "branch_code"], "employee", ["employee_id", "branch_code"]),
]

# CHECK constraints: (name, table, column, condition that must hold).
CHECKS = [
    ("product_price_nonneg", "product", "unit_price", lambda x: x >= 0),
    ("inventory_qty_nonneg", "inventory", "qty", lambda x: x >= 0),
    ("line_qty_positive", "invoice_line", "qty", lambda x: x > 0),
    ("line_price_nonneg", "invoice_line", "unit_price", lambda x: x >= 0),
]


def _key_text(cols: list[str]):
    return F.concat_ws("|", *[F.col(k).cast("string") for k in cols])


def duplicate_keys(t: Tables, extra: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """Q-PK: keys that occur more than once -> (table_name, key, row_count).

    ``extra`` adds relations that are not canonical tables yet (raw source
    rows mapped to a canonical key), where duplicates really occur.
    """
    parts = []
    items = [(n, t.get(n), PRIMARY_KEYS[n]) for n in SCHEMAS]
    items += [(n, df, keys) for n, (df, keys) in (extra or {}).items()]
    for name, df, keys in items:
        parts.append(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
                     .where(F.col("row_count") > 1)
                     .select(F.lit(name).alias("table_name"), _key_text(keys).alias("key"),
                             "row_count"))
    return reduce(DataFrame.unionByName, parts)


def orphans(t: Tables) -> DataFrame:
    """Q-FK: per foreign key, rows checked and rows without a parent.

    A NULL child key is allowed (invoice without employee) and not counted.
    """
    return _without_parent(t, FOREIGN_KEYS).select(
        F.col("rule").alias("constraint_name"), "checked_rows", F.col("missing").alias("orphan_rows"))


def _without_parent(t: Tables, rules: list[tuple]) -> DataFrame:
    """Per rule, the child rows with a key and how many of them (``missing``)
    have a key that no parent has.

    One pass: each table is scanned once and gives a row for every rule it is
    the child or the parent of; grouped on (rule, key), with a partial
    aggregate before the only shuffle, so a parent with most of the children
    is reduced in every task.
    """
    roles: dict[str, list] = {}
    for name, child, ccols, parent, pcols in rules:
        for table, cols, n in ((child, ccols, 1), (parent, pcols, 0)):
            known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cols])
            roles.setdefault(table, []).append(F.struct(
                F.lit(name).alias("rule"), F.when(known, F.struct(*[F.col(x).cast("string").alias(f"k{i}") for i, x in enumerate(cols)])).alias("key"),
                F.lit(n).cast("bigint").alias("n")))
    rows = reduce(DataFrame.unionByName, [
        t.get(table).select(F.explode(F.array(*structs)).alias("r")).select("r.*") for table, structs in roles.items()])
    by_key = rows.where("key IS NOT NULL").groupBy("rule", "key").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    found = by_key.groupBy("rule").agg(F.sum("n").alias("checked_rows"), F.sum(F.when(F.col("least") > 0, F.col("n"))).alias("missing"))
    names = t.branch.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k[0]) for k in rules])).alias("rule"))
    return names.join(found, "rule", "left").select(
        "rule", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("checked_rows", "missing")])


def check_violations(t: Tables) -> DataFrame:
    """Q-CK: per CHECK constraint, rows checked and rows violating it.

    One aggregate per table covers all of its rules in a single scan.
    """
    parts = []
    for table in sorted({tb for _, tb, _, _ in CHECKS}):
        rules = [(n, rule(F.col(col))) for n, tb, col, rule in CHECKS if tb == table]
        agg = t.get(table).agg(
            F.count(F.lit(1)).alias("checked_rows"),
            *[F.sum(F.when(~cond, 1).otherwise(0)).alias(n) for n, cond in rules])
        each = F.array(*[F.struct(F.lit(n).alias("constraint_name"),
                                  F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("violations")) for n, _ in rules])
        parts.append(agg.select(F.col("checked_rows").cast("bigint").alias("checked_rows"), F.explode(each).alias("r"))
                     .select("r.constraint_name", "checked_rows", "r.violations"))
    return reduce(DataFrame.unionByName, parts)


def null_counts(t: Tables) -> DataFrame:
    """Q-NN: NULLs per declared NOT NULL column (one aggregate per table)."""
    parts = []
    for table, schema in SCHEMAS.items():
        cols = [f.name for f in schema.fields if not f.nullable]
        agg = t.get(table).agg(*[F.sum(F.when(F.col(x).isNull(), 1).otherwise(0)).alias(x) for x in cols])
        each = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(x).alias("column_name"),
                                  F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias("null_count")) for x in cols])
        parts.append(agg.select(F.explode(each).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def fragment_membership(t: Tables) -> DataFrame:
    """Q-FR: rows stored in a fragment other than the one they belong to.

    A line belongs to its invoice's branch; an invoice's employee normally
    to the invoice's branch (reported, not enforced by the reference).  An
    invoice without employee is not counted.
    """
    return _without_parent(t, MEMBERSHIP).select(
        F.col("rule").alias("table_name"), "checked_rows", F.col("missing").alias("misplaced_rows"))
