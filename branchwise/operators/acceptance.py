"""Exact ordered replay of stock-consuming requests without a row loop.

Sales and transfers must give the result of handling the requests one after
the other in ``seq`` order: a rejected request consumes nothing, and one
failing line rejects the whole request.  Plain running sums cannot express
that, because whether request *n* passes depends on which earlier requests
passed.  The **bounds iteration** decides requests in rounds:

* every request is Accepted, Rejected or Undecided (U);
* per key (a stock row, an invoice line) and per move, running sums over
  the strictly earlier moves give the lowest and highest balance and
  existence the key can have, counting undecided moves both ways;
* a request whose checks all surely pass is accepted, one with a check that
  surely fails is rejected (with that check's code); the rest stay U.

The earliest undecided request has only decided requests before it, so its
bounds are exact and it is decided: every round decides at least one
request and the loop always ends, with no cap.  A round reads only what is
still open: the undecided requests, and the moves on keys that an undecided
request touches.  What a round decides is written once and never read by
later rounds; rejected moves and closed keys leave.  Both tables are written
as Parquet into the shared folder (``spark.checkpoint.dir``), so the lineage
stays one round long and a lost executor recomputes one round.  Moves alone
on their key are decided once, before the rounds.  A request of one move is
decided on the row of the move (``alone``); only requests of several moves
are grouped by request and joined with their moves again.

Running sums are skew-safe (``ordered``): a key with many moves (one product
may hold a third of all sales) is spread over several range partitions.
Other keys are joined with the opening and scanned in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchwise.operators import ordered
from branchwise.session import materialize, materialize_observed

ACCEPTED, REJECTED, UNDECIDED = "A", "R", "U"
KEY = ["kind", "k1", "k2"]


# Check names a move can carry.
# (``absent`` and ``foreign`` ask for the
# same, that the key does not exist, under different reject codes.)
EXISTS, ENOUGH, ABSENT, FOREIGN = "exists", "enough", "absent", "foreign"
CHECK_NAMES = (EXISTS, ENOUGH, ABSENT, FOREIGN)


@dataclass
class Settled:
    """Result of the replay.

    ``status``: (seq, status 'A'/'R', reject_code) for every request that had
    moves.  ``moves``: every move of an accepted request; with balances, also
    the key's balance right before it (``balance_before``) and whether the key
    existed.
    ``rounds``: number of rounds used; ``undecided_per_round``: requests
    still undecided after each round.
    """

    status: DataFrame
    moves: DataFrame
    rounds: int
    undecided_per_round: list[int]


def _bits(names) -> dict[str, int]:
    return {n: 1 << i for i, n in enumerate(names)}


#: What a move carries as one number: the checks it asks for, and whether it
#: is the only move of its request.
ALONE = "alone"
_FLAGS = _bits([*CHECK_NAMES, ALONE])


def _has(name: str):
    return F.col("flags").bitwiseAND(F.lit(_FLAGS[name])) != 0


def _prepare(moves: DataFrame, opening: DataFrame, checks: list[tuple[str, list[str]]]) -> tuple[DataFrame, bool]:
    """The moves with their flags, the opening balance, a bucket number,
    whether other moves share the key (``shared``), the sums of the key's
    earlier moves (``p_debit``, ``p_credit``), and the first decision on
    requests of one move (``status``, ``reject_code``); and whether keys are
    crowded.  Checks that no move asks for are false.  Keys that few moves
    share are joined and scanned in one shuffle; only crowded ones are spread
    over buckets."""
    op = opening.select(*KEY, F.col("qty").cast("bigint").alias("open_qty"),
                        F.lit(True).alias("open_exists"))
    flags = F.lit(0)
    for n in _FLAGS:
        name = n if n == ALONE else f"chk_{n}"
        if name in moves.columns:
            flags = flags + F.when(F.col(name), _FLAGS[n]).otherwise(0)
    moves = moves.select("seq", *KEY, "debit", "credit", flags.alias("flags"))

    def opened(m: DataFrame) -> DataFrame:
        return (m.join(op, KEY, "left")
                .withColumn("open_qty", F.coalesce("open_qty", F.lit(0).cast("bigint")))
                .withColumn("open_exists", F.coalesce("open_exists", F.lit(False))))

    def scanned(m: DataFrame) -> DataFrame:
        here = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "bucket"))
        # A key that the opening has twice gives a request two moves.
        twice = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "bucket", "seq")) > 1
        m = _earlier_sums(m, ["debit", "credit"]).withColumns({"shared": F.col("spans") | (here > 1), "_twice": twice})
        flags = F.when(F.col("_twice"), F.col("flags").bitwiseAND(F.lit(~_FLAGS[ALONE]))).otherwise(F.col("flags"))
        m = m.withColumns({"flags": flags, "acc": F.lit(False)}).drop("_twice")
        return _with_open(_decided_alone(m, checks, *_first_bounds()))

    few, crowd = ordered.by_crowd(moves, KEY)
    rows = scanned(opened(few).withColumns({"bucket": F.lit(0).cast("bigint"), "spans": F.lit(False)}))
    if crowd is not None:
        rows = rows.unionByName(scanned(ordered.bucketize(opened(crowd), KEY, "seq")))
    return rows, crowd is not None


def _earlier_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``p_<c>``: sum of ``c`` over strictly earlier moves of the same key."""
    return ordered.running_sums(df, KEY, cols)


def _sure(ex_lo, ex_hi, bal_lo, bal_hi) -> dict:
    """Per check: whether a move surely fails it, and whether it surely passes."""
    return {
        EXISTS: (~ex_hi, ex_lo),
        ENOUGH: (F.col("debit") > bal_hi, F.col("debit") <= bal_lo),
        ABSENT: (ex_lo, ~ex_hi),
        FOREIGN: (ex_lo, ~ex_hi),
    }


def _check_aggs(ex_lo, ex_hi, bal_lo, bal_hi, of=None, prefix: str = "") -> list:
    """Per-request aggregates over its moves (those where ``of`` holds):
    f_<check> (some move surely fails it) and o_<check> (every move surely
    passes it)."""
    aggs = []
    for name, (fail, ok) in _sure(ex_lo, ex_hi, bal_lo, bal_hi).items():
        on = _has(name) if of is None else _has(name) & of
        aggs.append(F.max(on & fail).alias(f"{prefix}f_{name}"))
        aggs.append(F.min(~on | ok).alias(f"{prefix}o_{name}"))
    return aggs


_STATIC = [f"s{x}_{n}" for n in CHECK_NAMES for x in "fo"]


def _verdict(checks: list[tuple[str, list[str]]], fails, passes) -> tuple:
    """(status, reject code): the first group of checks that is not surely
    passed decides; ``fails`` and ``passes`` say what is sure of a check."""
    status = None
    code = None
    for reject_code, names in checks:
        f = F.lit(False)
        o = F.lit(True)
        for n in names:
            f = f | fails(n)
            o = o & passes(n)
        status = (F.when(f, F.lit(REJECTED)) if status is None else status.when(f, F.lit(REJECTED)))
        status = status.when(~o, F.lit(UNDECIDED))
        code = (F.when(f, F.lit(reject_code)) if code is None else code.when(f, F.lit(reject_code)))
        code = code.when(~o, F.lit(None).cast("string"))
    status = F.lit(ACCEPTED) if status is None else status.otherwise(F.lit(ACCEPTED))
    code = F.lit(None).cast("string") if code is None else code.otherwise(F.lit(None).cast("string"))
    return status, code


def _decide(j: DataFrame, checks: list[tuple[str, list[str]]]) -> DataFrame:
    """The requests of ``j`` with their new status, from the bounds of this
    round and the static checks on their rows."""
    fails = lambda n: F.coalesce(F.col(f"f_{n}"), F.lit(False)) | F.coalesce(F.col(f"sf_{n}"), F.lit(False))
    passes = lambda n: F.coalesce(F.col(f"o_{n}"), F.lit(True)) & F.coalesce(F.col(f"so_{n}"), F.lit(True))
    status, code = _verdict(checks, fails, passes)
    return j.select("seq", status.alias("status"), code.alias("reject_code"), *_STATIC)


def _decided_alone(rows: DataFrame, checks: list[tuple[str, list[str]]], *bounds) -> DataFrame:
    """``rows`` with the new status of the requests of one move, on the row of
    that move; it is NULL on the moves of other requests."""
    sure = _sure(*bounds)
    fails = lambda n: F.coalesce(_has(n) & sure[n][0], F.lit(False))
    passes = lambda n: F.coalesce(~_has(n) | sure[n][1], F.lit(True))
    status, code = _verdict(checks, fails, passes)
    return rows.withColumns({"status": F.when(_has(ALONE), status), "reject_code": F.when(_has(ALONE), code)})


def _first_bounds() -> tuple:
    """In the first round every request is undecided, so the sums of all
    earlier moves are the bounds."""
    return (F.col("open_exists"), F.col("open_exists") | (F.col("p_credit") > 0),
            F.col("open_qty") - F.col("p_debit"), F.col("open_qty") + F.col("p_credit"))


def _first_round(prepared: DataFrame, checks: list[tuple[str, list[str]]]) -> DataFrame:
    """The first round.  Moves alone on their key have no earlier move: their
    checks are exact from the start and never change (``_STATIC``)."""
    shared, ex, bal = F.col("shared"), F.col("open_exists"), F.col("open_qty")
    return _decide(prepared.groupBy("seq").agg(*_check_aggs(*_first_bounds(), shared),
                                               *_check_aggs(ex, ex, bal, bal, ~shared, "s")), checks)


_BOUNDS = ["ex_lo", "ex_hi", "bal_lo", "bal_hi"]
_MOVE = ["seq", *KEY, "debit", "credit", "flags", "open_qty", "open_exists", "bucket", "spans", "acc"]


def _with_open(p: DataFrame) -> DataFrame:
    """Add ``_open``: whether an undecided request touches the key of the
    move, in this bucket.  Requests of several moves count as undecided."""
    mine = ~F.col("acc") & F.coalesce(F.col("status") == UNDECIDED, F.lit(True))
    return p.withColumn("_open", F.max(mine).over(Window.partitionBy(*KEY, "bucket")))


def _scan(m: DataFrame, checks: list[tuple[str, list[str]]]) -> DataFrame:
    """The moves of one round (accepted ones, ``acc``, and undecided ones)
    with the new status of requests of one move, and on the undecided moves of
    other requests with the bounds of their balances (``_BOUNDS``)."""
    zero = F.lit(0).cast("bigint")
    live = m.select(
        "*",
        F.when(F.col("acc"), F.col("debit")).otherwise(zero).alias("dA"),
        F.col("debit").alias("dAU"),
        F.when(F.col("acc"), F.col("credit")).otherwise(zero).alias("cA"),
        F.col("credit").alias("cAU"))
    p = _earlier_sums(live, ["dA", "dAU", "cA", "cAU"])
    bounds = (F.col("open_exists") | (F.col("p_cA") > 0), F.col("open_exists") | (F.col("p_cAU") > 0),
              F.col("open_qty") + F.col("p_cA") - F.col("p_dAU"), F.col("open_qty") + F.col("p_cAU") - F.col("p_dA"))
    p = _with_open(_decided_alone(p, checks, *bounds))
    several = ~F.col("acc") & ~_has(ALONE)
    p = p.select(*_MOVE, *[F.when(several, b).alias(n) for n, b in zip(_BOUNDS, bounds)],
                 F.when(F.col("acc"), F.lit(ACCEPTED)).otherwise(F.col("status")).alias("status"),
                 F.when(~F.col("acc"), F.col("reject_code")).alias("reject_code"), "_open")
    return p.where("NOT acc OR spans OR _open")


def _round(rows: DataFrame, state: DataFrame, checks: list[tuple[str, list[str]]]) -> DataFrame:
    """The undecided requests of several moves (``state``) with their new
    status, from the bounds on the moves of the round."""
    dyn = rows.where(~F.col("acc") & ~_has(ALONE)).groupBy("seq").agg(*_check_aggs(*map(F.col, _BOUNDS)))
    return _decide(state.join(dyn, "seq", "left"), checks)


def _next(rows: DataFrame, result: DataFrame | None, crowded: bool) -> DataFrame:
    """The moves of the next round: rejected moves leave, and keys without an
    undecided move, which can never change an undecided request again."""
    live = rows.where("_open AND NOT spans")
    if crowded:
        keys = rows.where("_open AND spans").select(*KEY).distinct()  # at most two of each bucket
        live = live.unionByName(rows.where("spans").join(F.broadcast(keys), KEY, "left_semi"))
    if result is not None:
        asked = live.where("status IS NULL").drop("status").join(result.select("seq", "status"), "seq")
        live = live.where("status IS NOT NULL").unionByName(asked)
    live = live.where(F.col("status").isin(ACCEPTED, UNDECIDED)).withColumn("acc", F.col("status") == ACCEPTED)
    return (live if crowded else live.withColumn("spans", F.lit(False))).select(*_MOVE)


def settle(moves: DataFrame, opening: DataFrame, checks: list[tuple[str, list[str]]], balances: bool = True) -> Settled:
    """Replay ``moves`` against ``opening`` in ``seq`` order.

    ``moves``: seq BIGINT, kind, k1, k2 STRING, debit, credit BIGINT (>= 0),
    and BOOLEAN chk_exists / chk_enough / chk_absent / chk_foreign (a
    missing one is false).  At most one move per
    (request, key).  A BOOLEAN ``alone`` may say that a move is the only one
    of its request: such a request is decided on the row of its move, without
    a shuffle of its own.  ``opening``: kind, k1, k2, qty for keys that exist.
    ``checks``: ordered (reject_code, [check names]) -- the first group a
    request fails gives its code, as the procedures test in that order.
    ``moves`` is read twice or more.
    Without ``balances`` the accepted moves come as a plan and without the
    state of their keys before them.
    """
    is_open, one = F.col("status") == UNDECIDED, _has(ALONE)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    prepared, crowded = _prepare(moves, opening, checks)
    # The undecided counts come from the same jobs that write the rounds.
    prepared, found = materialize_observed(prepared, "replay: moves", "zstd", undecided=count(one & is_open), several=count(~one))
    alone, several = [prepared.where(one & ~is_open)], []
    step = _first_round(prepared.where(~one), checks) if found.get("several") else None
    rows, trace = prepared.where("shared"), []
    while True:
        undecided, result, state = found.get("undecided") or 0, None, None
        if step is not None:
            result, seen = materialize_observed(step, f"replay: round {len(trace) + 1}", "zstd", undecided=count(is_open))
            several.append(result.where(~is_open).select("seq", "status", "reject_code"))
            if seen.get("undecided"):
                undecided, state = undecided + seen["undecided"], result.where(is_open).select("seq", *_STATIC)
        trace.append(undecided)
        if not undecided:
            break
        rows, found = materialize_observed(_scan(_next(rows, result, crowded), checks), "replay: open moves", "zstd",
                                           undecided=count(one & is_open))
        alone.append(rows.where(~F.col("acc") & one & ~is_open))
        step = None if state is None else _round(rows, state, checks)
    status = reduce(DataFrame.unionByName, [d.select("seq", "status", "reject_code") for d in alone] + several)
    own = ["seq", *KEY, "debit", "credit", "open_qty", "open_exists", "bucket", "spans"]
    acc = [d.where(F.col("status") == ACCEPTED).select(*own) for d in alone]
    if several:
        passed = reduce(DataFrame.unionByName, several).where(F.col("status") == ACCEPTED).select("seq")
        acc.append(prepared.where(~one).select(*own).join(passed, "seq"))
    acc = reduce(DataFrame.unionByName, acc)
    if not balances:
        return Settled(status=status, moves=acc.select(*KEY, "seq", "debit", "credit"), rounds=len(trace), undecided_per_round=trace)
    acc = acc.withColumn("net", F.col("credit") - F.col("debit"))
    bal = _earlier_sums(acc, ["net", "credit"])
    bal = materialize(bal.select(*KEY, "seq", "debit", "credit",
                                 (F.col("open_qty") + F.col("p_net")).alias("balance_before"),
                                 (F.col("open_exists") | (F.col("p_credit") > 0)).alias("existed_before")),
                      "replay: balances")
    return Settled(status=status, moves=bal, rounds=len(trace), undecided_per_round=trace)


def apply_deltas(opening: DataFrame, accepted_moves: DataFrame) -> DataFrame:
    """New balances: opening plus accepted credits minus debits per key.

    Keys first created by a credit are added.  Partial aggregation runs
    before the shuffle, then a full outer join with the opening rows.
    """
    delta = (accepted_moves.groupBy(*KEY)
             .agg(F.sum(F.col("credit") - F.col("debit")).alias("delta"),
                  F.sum("credit").alias("credits")))
    j = opening.select(*KEY, F.col("qty").cast("bigint").alias("qty")).join(delta, KEY, "full")
    keep = F.col("qty").isNotNull() | (F.col("credits") > 0)
    return j.where(keep).select(*KEY, (F.coalesce("qty", F.lit(0)) + F.coalesce("delta", F.lit(0)))
                                .alias("qty"))
