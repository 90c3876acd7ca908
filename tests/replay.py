"""Plain-Python serial replay of the sale and transfer procedures.

One request at a time in ``seq`` order, with dictionaries as the tables:
the brute-force reference for the Spark bounds iteration.
"""

from __future__ import annotations

import json
from decimal import Decimal


def blank(x) -> bool:
    return x is None or str(x).strip(" ") == ""


def clean(x):
    return None if x is None else str(x).strip(" ")


class State:
    def __init__(self, branches, employees, products, inventory, invoices, lines):
        self.branches = set(branches)                       # active codes
        self.employees = set(employees)                     # (id, branch)
        self.products = dict(products)                      # code -> price
        self.stock = dict(inventory)                        # (code, branch) -> qty
        self.invoices = dict(invoices)                      # id -> branch
        self.lines = set(lines)                             # (invoice, product)


def with_documents(requests, items):
    """Requests with the JSON documents of their item rows."""
    docs = {}
    for i in items:
        one = {"MaSP": i["item_code"], "SoLuong": i["item_qty"]}
        if i["item_price"] is not None:
            one["DonGia"] = float(i["item_price"])
        docs.setdefault(i["seq"], []).append(one)
    return [{**r, "items_json": json.dumps(docs.get(r["seq"], []))} for r in requests]


def _items(doc):
    try:
        v = json.loads(doc)
    except (TypeError, ValueError):
        return []
    return v if isinstance(v, list) else []


def post_invoices(st: State, requests):
    """P10; returns {seq: (accepted, code, line_count, total)}."""
    def static(r):
        b = (r["branch_code"] or "").strip(" ").upper()
        if b not in st.branches:
            return "50000"
        if blank(r["invoice_id"]) or blank(r["employee_id"]) or blank(r["items_json"]):
            return "50000"
        if (clean(r["employee_id"]), b) not in st.employees:
            return "50001"
        items = _items(r["items_json"])
        if not items:
            return "50002"
        for it in items:
            q = it.get("SoLuong")
            if blank(it.get("MaSP")) or q is None or q <= 0:
                return "50003"
        for code, (q, p) in _merge(items).items():
            price = p if p not in (None, 0) else st.products.get(code)
            if price is None or price <= 0:
                return "50004"
        return None

    out = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        code = static(r)
        b = (r["branch_code"] or "").strip(" ").upper()
        inv = clean(r["invoice_id"])
        if code is None:
            owner = st.invoices.get(inv)
            if owner is not None and owner != b:
                code = "PK_INVOICE"
        if code is None:
            merged = _merge(_items(r["items_json"]))
            if any((c, b) not in st.stock or st.stock[(c, b)] < q for c, (q, _) in merged.items()):
                code = "50005"
            elif any((inv, c) in st.lines for c in merged):
                code = "PK_LINE"
        if code is not None:
            out[r["seq"]] = (False, code, None, None)
            continue
        st.invoices.setdefault(inv, b)
        total = Decimal("0.00")
        n = 0
        for c, (q, p) in merged.items():
            st.stock[(c, b)] -= q
            st.lines.add((inv, c))
            if c in st.products:
                price = p if p not in (None, 0) else st.products[c]
                total += (Decimal(q) * Decimal(price)).quantize(Decimal("0.01"))
                n += 1
        out[r["seq"]] = (True, None, n, total)
    return out


def _merge(items):
    m = {}
    for it in items:
        c = clean(it.get("MaSP"))
        if c is None or c == "":
            continue
        q, p = m.get(c, (0, None))
        given = it.get("DonGia")
        given = None if given is None else Decimal(str(given))
        p = given if p is None else (p if given is None else max(p, given))
        m[c] = (q + int(it.get("SoLuong") or 0), p)
    return m


def post_single_lines(st: State, requests, strict=True):
    """P9; returns {seq: (accepted, code)}."""
    def static(r):
        b = (r["branch_code"] or "").strip(" ").upper()
        if b not in st.branches:
            return "50000"
        if blank(r["invoice_id"]) or blank(r["employee_id"]) or blank(r["product_code"]):
            return "50000"
        if r["qty"] is not None and r["qty"] <= 0:
            return "50000"
        price = st.products.get(clean(r["product_code"]))
        if price is None or price <= 0:
            return "50001"
        if (clean(r["employee_id"]), b) not in st.employees:
            return "50002"
        if r["qty"] is None:
            return "NOT_NULL"
        return None

    out = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        code = static(r)
        b = (r["branch_code"] or "").strip(" ").upper()
        inv, c, q = clean(r["invoice_id"]), clean(r["product_code"]), r["qty"]
        if code is None:
            owner = st.invoices.get(inv)
            if owner is not None and owner != b:
                code = "PK_INVOICE"
        if code is None:
            have = st.stock.get((c, b))
            if have is None and strict:
                code = "50003"
            elif have is not None and have < q:
                code = "50003"
            elif (inv, c) in st.lines:
                code = "PK_LINE"
        if code is not None:
            out[r["seq"]] = (False, code)
            continue
        st.invoices.setdefault(inv, b)
        st.lines.add((inv, c))
        if (c, b) in st.stock:
            st.stock[(c, b)] -= q
        out[r["seq"]] = (True, None)
    return out


def transfers(st: State, requests):
    """P11; returns {seq: (accepted, code, from_before, to_before)}."""
    out = {}
    for r in sorted(requests, key=lambda r: r["seq"]):
        f = (r["from_branch"] or "").strip(" ").upper()
        t = (r["to_branch"] or "").strip(" ").upper()
        c, q = clean(r["product_code"]), r["qty"]
        code = None
        if f not in st.branches or t not in st.branches or f == t or blank(c):
            code = "50000"
        elif q is None or q <= 0:
            code = "50001"
        elif (c, f) not in st.stock:
            code = "50002"
        elif st.stock[(c, f)] < q:
            code = "50003"
        if code is not None:
            out[r["seq"]] = (False, code, None, None)
            continue
        fb, tb = st.stock[(c, f)], st.stock.get((c, t))
        st.stock[(c, f)] = fb - q
        st.stock[(c, t)] = (tb or 0) + q
        out[r["seq"]] = (True, None, fb, tb)
    return out
