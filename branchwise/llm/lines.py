"""Repeated line runs by suffix ranks over line-ID sequences.

A document is a sequence of lines with words.  Distributed prefix doubling
ranks all suffixes by their first 1, 2, 4, ... lines: the ranks of a suffix
and of the one that many lines further on are paired, the distinct pairs
sorted, and their places are the ranks of the next level.  Suffixes of one
rank at a level are a longest-common-prefix interval of at least that many
lines.  A suffix whose rank is its own has no repeat and leaves; only lines
that occur twice ever take part.

A run counts from ``MIN_WORDS`` words on.  The shortest run that counts at a
line has a fixed number of lines, the same in every copy, so two copies share
an interval of that length: it is read from the two ranks, of the greatest
power of two, that cover the run from its two ends.  The first copy stays; the
lines of later copies are deleted.

Runs that start at a line miss the last lines of a maximal repeated run, where
what is left of it holds fewer words.  With ``whole``, as the registered query
has it, the shortest run that ends at a line is tested
too, and with a line that counts alone the pairs it makes with its neighbours.
Then all lines of a maximal run, and every two neighbours, lie in such runs:
those up to the end of the first run that starts in it, and each later one
ends a run inside of it.

A line without words belongs to no run; it goes if the lines on both sides
of it go with one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import WORD, quoted, sorted_names, text_of, words_in
from branchwise.session import materialize, materialize_observed

MIN_WORDS = 50


def _key() -> list:
    """Names a document by id and text: repeated rows are one document."""
    return [F.xxhash64("doc_id", text_of()).alias("k1"), F.xxhash64(F.lit("2"), text_of()).alias("k2")]


def lines_of(docs: DataFrame, min_words: int, whole: bool = False) -> DataFrame:
    """(doc, k1, k2, pos, line, words, need, h1, h2): the lines with words;
    ``pos`` counts these, ``line`` all; ``need`` is how many lines from here
    on hold ``min_words`` words, or null if they never do.  h1 and h2 (128
    bits) stand for the line's content.  With ``whole``, also ``back``: as
    ``need``, of the lines up to here."""
    split = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(
        i.alias("line"), words_in(x).alias("words"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("2"), x).alias("h2")))
    rows = docs.select("doc_id", *_key(), F.filter(split, lambda s: s["words"] > 0).alias("l"))
    # Every line has a word, so no run that counts needs more than min_words lines.
    def need(some):
        reach = F.aggregate(some, F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(0).alias("n")), lambda a, x: F.when(
            a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x["words"]).alias("w"), (a["n"] + 1).alias("n"))))
        return F.when(reach["w"] >= min_words, reach["n"])
    rows = rows.withColumn("need", F.transform("l", lambda _, i: need(F.slice("l", i + 1, min_words))))
    reaches = ["need"]
    if whole:
        upto = lambda i: F.slice("l", F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words)))
        rows, reaches = rows.withColumn("back", F.transform("l", lambda _, i: need(F.reverse(upto(i))))), ["need", "back"]
    # Outer: else the optimiser would add a filter that makes the arrays twice.
    rows = rows.select("doc_id", "k1", "k2", F.posexplode_outer(F.arrays_zip("l", *reaches)).alias("pos", "z")).where("pos IS NOT NULL")
    return rows.select("doc_id", "k1", "k2", "pos", "z.l.line", "z.l.words", *[f"z.{c}" for c in reaches], "z.l.h1", "z.l.h2")


def _ranked(values: DataFrame, keys: list[str], label: str, out: str = "rank") -> DataFrame:
    """Ranks of the distinct keys that occur more than once."""
    repeated, seen = materialize_observed(
        values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), label, rows=F.count(F.lit(1)))
    return sorted_names(repeated, keys, seen["rows"], out)


def repeated_runs(lines: DataFrame, longest: int) -> DataFrame:
    """(k1, k2, pos, need): the shortest runs that count and are later copies;
    if ``lines`` has ``back``, those that end at a line too."""
    at = ["k1", "k2", "pos"]
    ranks = [materialize(lines.select(*at, "h1", "h2").join(_ranked(lines, ["h1", "h2"], "lines: level 0").hint("merge"), ["h1", "h2"])
                         .select(*at, "rank"), "lines: ranks 0")]
    while (1 << len(ranks)) <= longest:
        level, last = len(ranks), ranks[-1]
        ahead = last.select("k1", "k2", (F.col("pos") - (1 << (level - 1))).alias("pos"), F.col("rank").alias("next"))
        pairs = materialize(last.join(ahead, at), f"lines: pairs {level}")
        names = _ranked(pairs, ["rank", "next"], f"lines: level {level}", "new")
        ranks.append(materialize(pairs.join(names, ["rank", "next"]).select(*at, F.col("new").alias("rank")),
                                 f"lines: ranks {level}"))
    starts = lines.where("need IS NOT NULL").select("doc_id", *at, "need")
    if "back" in lines.columns:
        to = lines.where("back IS NOT NULL").select(
            "doc_id", "k1", "k2", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("need"))
        # A line that counts alone also pairs with its neighbours, so that
        # lines without words between two lines of one run are seen in it.
        alone = lines.where("need = 1").withColumn("pos", F.explode(F.array(F.col("pos") - 1, F.col("pos"))))
        pairs = alone.where("pos >= 0").select("doc_id", *at, F.lit(2).alias("need"))
        starts = starts.unionByName(to).unionByName(pairs).distinct()
    ends = None
    for level, rank in enumerate(ranks):
        of = starts.where((F.col("need") >= 1 << level) & (F.col("need") < 2 << level)).join(rank, at)
        tail = rank.select("k1", "k2", (F.col("pos")).alias("tail"), F.col("rank").alias("last"))
        of = of.withColumn("tail", F.col("pos") + F.col("need") - (1 << level)).join(tail, ["k1", "k2", "tail"])
        of = of.select("doc_id", *at, "need", "rank", "last")
        ends = of if ends is None else ends.unionByName(of)
    ends = materialize(ends, "lines: runs")
    here = F.struct("doc_id", "k1", "k2", "pos")
    # Written, so that the join back is one of plain shuffles and a run with
    # many copies can be split in it.
    first = materialize(ends.groupBy("need", "rank", "last").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").drop("n"), "lines: first copies")
    found = ends.join(first, ["need", "rank", "last"])
    same = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))
    later = ~same | (F.col("first.pos") + F.col("need") <= F.col("pos"))
    return found.where(later).select(*at, "need")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """(k1, k2, gone): the numbers of the lines that go, per document."""
    longest = F.max(F.greatest("need", "back", F.lit(2)) if whole else F.col("need"))
    lines, seen = materialize_observed(lines_of(docs, min_words, whole).distinct(), "lines: lines", longest=longest)
    runs = repeated_runs(lines, seen["longest"] or 0)
    covered = runs.select("k1", "k2", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("need") - 1)).alias("pos"),
                          (F.col("pos") + F.col("need") - 1).alias("to"))
    covered = covered.groupBy("k1", "k2", "pos").agg((F.max("to") > F.col("pos")).alias("on"))
    place = lines.select("k1", "k2", "pos", "line")
    after = place.select("k1", "k2", (F.col("pos") - 1).alias("pos"), F.col("line").alias("next_line"))
    gone = covered.join(place, ["k1", "k2", "pos"]).join(after, ["k1", "k2", "pos"], "left")
    upto = F.when(F.col("on"), F.col("next_line") - 1).otherwise(F.col("line"))
    gone = gone.select("k1", "k2", F.explode(F.sequence(F.col("line"), upto)).alias("line"))
    return gone.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Every row of ``docs`` with its columns, ``clean_text``, ``n_lines``,
    ``gone`` (numbers of the deleted lines) and ``runs`` (of consecutive ones,
    from and to).  Own columns of these names give way.

    Copies are ordered by doc_id (null first), then text key and line; a copy
    in the same document counts if it does not overlap the first.  Repeated
    rows (equal id and text) are one document and get the same result.  Null
    and empty texts have one line without words and lose nothing.  ``whole``
    deletes maximal repeated runs to their last line.
    """
    added = ("clean_text", "n_lines", "gone", "runs")
    own = [c for c in docs.columns if c not in added]
    gone = materialize(deleted_lines(docs, min_words, whole), "lines: deleted")
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("doc"), *_key())
    # A merge join: what goes grows with the documents and is never broadcast.
    both = keyed.join(gone.hint("merge"), ["k1", "k2"], "left").select(
        "doc", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
        F.split(F.coalesce(F.col("doc.text"), F.lit("")), "\n").alias("l"))
    # Line numbers are sorted; the lines between two deleted ones stay.
    cuts = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("l")))
    stay = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice(
        F.col("l"), F.get(F.col("cuts"), i - 1) + 2, F.get(F.col("cuts"), i) - F.get(F.col("cuts"), i - 1) - 1)))
    both = both.withColumn("cuts", cuts).withColumn("stay", stay)
    first = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    last = F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return both.select(*[F.col("doc").getField(c).alias(c) for c in own], F.array_join("stay", "\n").alias("clean_text"),
                       F.size("l").cast("bigint").alias("n_lines"), "gone", runs.alias("runs"))
