"""Serial-replay check of the ordered replay at any scale factor.

Runs post_invoices and transfer_stock on the whole tables of a driver folder
and compares every outcome (and the final stock) with the plain-Python
serial replay of tests/replay.py.  Usage: python tools/replay_check.py [sf_dir]
"""

import os, sys, time, tempfile
sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
os.environ.setdefault("BRANCHWISE_TMP", tempfile.mkdtemp(prefix="bw-rp-", dir="/tmp"))
from branchwise.session import build_local_session
from branchwise.sources.store import open_tables
from branchwise.operators import sales as S
from branchwise.plans import requests as RQ
from branchwise.plans.changesets import NOW
from tests import replay
from tests.test_replay import state_of
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
spark = build_local_session(8, 16)
t = open_tables(spark, sf)
req = RQ.sale_requests(spark, sf)
items = RQ.sale_items(spark, sf)
res = S.post_invoices(t, req, now=NOW, items=items)
got = {r.seq: (r.accepted, r.reject_code, r.line_count, r.total) for r in res.outcome.collect()}
st = state_of(t)
want = replay.post_invoices(st, replay.with_documents([r.asDict() for r in req.collect()], [r.asDict() for r in items.collect()]))
print("sales", len(got), "equal:", got == want, "rounds", res.rounds,
      "accepted", sum(1 for v in want.values() if v[0]))
new_stock = {(r.product_code, r.branch_code): r.qty for r in res.tables.inventory.collect()}
print("sales stock equal:", new_stock == st.stock)
treq = RQ.transfer_requests(spark, sf)
tres = S.transfer_stock(t, treq)
got = {r.seq: (r.accepted, r.reject_code, r.from_before, r.to_before) for r in tres.outcome.collect()}
want = replay.transfers(state_of(t), [r.asDict() for r in treq.collect()])
print("transfers", len(got), "equal:", got == want, "rounds", tres.rounds,
      "accepted", sum(1 for v in want.values() if v[0]))
