"""Secret scan with multipart credential linking.

Three base patterns report a span wherever they match.  Weaker parts of a
credential - a name of an account, a random-looking string, an endpoint - are
only candidates: one is reported when its complementary parts start within
``SCOPE`` characters of it in the same text.

Only DataFrame functions.  Matching reads each text in place; the interval
join runs over the few candidates.  Starts are cut into bins of the scope's
width, and each bin keeps just the first and last start of each part, so a
candidate meets one row that sums up its own and both neighbouring bins,
however many parts crowd there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import quoted, text_of
from branchwise.session import materialize

# The base patterns and their least lengths.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

# The weak patterns.
ACCOUNT = r"""(?i:user_?name|user_?id|login|client_?id|access_?key_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?:https?|s3|ftp|amqps?|redis|mongodb|mysql|postgres|postgresql)://[A-Za-z0-9_.:@/?&=%+-]+"

#: Order of the kinds among spans with one start.
KINDS = ("assign", "access", "hex", "linked_account", "linked_random", "linked_endpoint")
SCOPE = 400

#: Matches whose starts are summed up together.
PIECE = 256
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: str, pattern: str, holds=None, when: Column | None = None) -> Column:
    """The leftmost non-overlapping matches, in order: ``skip``, the characters
    between the match before and this one, ``take``, those of the match, and
    whether ``holds(match)``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern)
    some = F.col(text).rlike(pattern)
    return F.when(some if when is None else when & some, F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
        F.char_length(g).cast("bigint").alias("skip"), F.char_length(m).cast("bigint").alias("take"),
        (holds(m) if holds else F.lit(True)).alias("ok"))))


def _pieces(matches: str) -> Column:
    """The matches in pieces of ``PIECE``; null without any."""
    return F.when(F.size(matches) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / PIECE).cast("int")),
                                                   lambda k: F.slice(F.col(matches), k * PIECE + 1, F.lit(PIECE))))


def _begins(pieces: str) -> Column:
    """Where each piece begins."""
    zero = F.lit(0).cast("bigint")
    lengths = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x["skip"] + x["take"]))
    return F.aggregate(lengths, F.struct(F.array().cast("array<bigint>").alias("all"), zero.alias("at")), lambda acc, n: F.struct(
        F.concat(acc["all"], F.array(acc["at"])).alias("all"), (acc["at"] + n).alias("at")), lambda acc: acc["all"])


def _spans(pieces: str, begins: str, kind: int) -> Column:
    """Spans (code points, end exclusive) of the matches that hold.  Lengths
    add up to starts within a piece, so no array grows with all matches."""
    def step(acc, x):
        begin = acc["at"] + x["skip"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["take"]).alias("end"))
        return F.struct(F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
                        (begin + x["take"]).alias("at"))

    none = F.array().cast(_SPANS)
    spans = F.flatten(F.zip_with(pieces, begins, lambda p, at: F.aggregate(
        p, F.struct(none.alias("spans"), at.alias("at")), step, lambda acc: acc["spans"])))
    return F.coalesce(spans, none)


def scan(docs: DataFrame) -> DataFrame:
    """Columns ``doc`` (a struct of the columns other than text), ``base``
    (spans of the base kinds), ``weak`` (candidate spans) and ``text_key``,
    which is null where a text has no candidate."""
    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*quoted(own)).alias("doc"), text_of().alias("t"))
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    matches = [_matches("t", ASSIGN, long_value),
               _matches("t", ACCESS, lambda m: F.char_length(m) >= ACCESS_CHARS, F.contains("t", F.lit("AKIA"))),
               _matches("t", HEX), _matches("t", ACCOUNT), _matches("t", RANDOM, mixed),
               _matches("t", ENDPOINT, None, F.contains("t", F.lit("://")))]
    n = range(len(matches))
    # Step by step: each column is made once, however often the next one reads it.
    rows = rows.select("doc", "t", *[m.alias(f"m{k}") for k, m in enumerate(matches)])
    rows = rows.select("doc", "t", *[_pieces(f"m{k}").alias(f"p{k}") for k in n])
    rows = rows.select("doc", "t", *[f"p{k}" for k in n], *[_begins(f"p{k}").alias(f"b{k}") for k in n])
    spans = [_spans(f"p{k}", f"b{k}", k) for k in n]
    rows = rows.select("doc", "t", F.concat(*spans[:3]).alias("base"), F.concat(*spans[3:]).alias("weak"))
    return rows.select("doc", F.sort_array("base").alias("base"), "weak",
                       F.when(F.size("weak") > 0, F.sha2("t", 256)).alias("text_key"))


#: Which part of a credential each kind is.  Hex strings and random ones are
#: secrets only to their complements: alone they name too many other things.
PARTS = {"account": (1, 3), "secret": (0, 2, 4), "endpoint": (5,)}


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(text_key, linked): the candidates of each text whose complementary
    parts are in scope.  An account or a random string needs the other one (or
    a base span of its part); an endpoint needs both."""
    spans = found.where("text_key IS NOT NULL").select(
        "text_key", F.explode(F.concat("base", "weak")).alias("s")).select("text_key", "s.*").distinct()
    spans = materialize(spans.withColumn("bin", F.floor(F.col("start") / scope)), "secrets: candidates")
    per_bin = spans.groupBy("text_key", "bin").agg(*[
        f(F.when(F.col("kind").isin(*kinds), F.col("start"))).alias(f"{part}_{n}")
        for part, kinds in PARTS.items() for n, f in (("first", F.min), ("last", F.max))])
    # Every bin tells its neighbours and itself; a candidate then reads one row.
    around = per_bin.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.withColumn("bin", F.col("bin") + F.col("step"))
    seen = around.groupBy("text_key", "bin").agg(*[
        c for part in PARTS for c in (
            F.max(F.when(F.col("step") == 1, F.col(f"{part}_last"))).alias(f"{part}_before"),
            F.max(F.when(F.col("step") == 0, F.col(f"{part}_first"))).alias(f"{part}_here"),
            F.min(F.when(F.col("step") == -1, F.col(f"{part}_first"))).alias(f"{part}_after"))])
    near = lambda part: (F.col(f"{part}_here").isNotNull()
                         | F.coalesce(F.col("start") - F.col(f"{part}_before") <= scope, F.lit(False))
                         | F.coalesce(F.col(f"{part}_after") - F.col("start") <= scope, F.lit(False)))
    complete = (F.when(F.col("kind") == 3, near("secret")).when(F.col("kind") == 4, near("account"))
                .when(F.col("kind") == 5, near("account") & near("secret")))
    linked = spans.where("kind >= 3").join(seen, ["text_key", "bin"]).where(complete)
    return linked.groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document, repeated rows too: its columns except the text,
    ``base`` and ``spans`` (base and linked), arrays of (start, kind, end)
    sorted by start, then kind (an index into ``KINDS``).

    A null or empty text has none.  Equal texts get equal spans.  An own
    column named ``base`` or ``spans`` gives way.
    """
    own = [c for c in docs.columns if c not in ("text", "base", "spans")]
    found = materialize(scan(docs.select(*[F.col(f"`{c}`") for c in own], "text")), "secrets: scan")
    alone = found.where("text_key IS NULL").select("doc", "base", F.col("base").alias("spans"))
    with_parts = found.where("text_key IS NOT NULL").join(link(found, scope), "text_key", "left").select(
        "doc", "base", F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS)))).alias("spans"))
    both = alone.unionByName(with_parts)
    return both.select(*[F.col("doc").getField(c).alias(c) for c in own], "base", "spans")


def as_text(spans: Column | str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
