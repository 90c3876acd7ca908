"""Quality rules, exact dedup, secrets and line dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from branchwise.llm import exact, lines, quality, secrets
from tests.llm.conftest import docs_table, words


def measured(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    ls = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls), len(ls) - len(set(ls)), len(covered))


def test_measurements_and_base_rules(awkward):
    rows = {(r.doc_id, r.text): r for r in quality.measure(awkward, ["doc_id", "text"]).select("doc.*", *quality.MEASURES).collect()}
    for r in awkward.collect():
        got = rows[(r.doc_id, r.text)]
        assert tuple(got[m] for m in quality.MEASURES) == measured(r.text)


def test_policies_and_ablations(awkward, empty):
    rows = quality.ledger(awkward).cache()
    bits = [r.fail_bits for r in rows.collect()]
    assert len(bits) == awkward.count() and "size" in rows.columns
    for policy in quality.POLICIES:
        mask = quality.policy_mask(policy)
        assert rows.where(quality.passes(policy)).count() == sum(not b & mask for b in bits)
        for r in quality.ablations(rows, policy).collect():
            assert r.n_failed == sum(bool(b & r.bit) for b in bits)
            assert r.n_only_this == sum((b & mask) == r.bit for b in bits)
            assert r.n_kept_without == sum(not b & mask & ~r.bit for b in bits)
    assert quality.ledger(empty).count() == 0
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(not b for b in bits)


def test_clean_documents_pass(spark):
    text = "\n".join(f"A plain sentence number {i} about matter {i * 7} and thing {i * i}." for i in range(30))
    assert quality.keep_good(docs_table(spark, [(1, text)])).count() == 1


def test_junk_goes_and_clean_text_stays(spark):
    sentence = lambda i: f"The plain report number {i} speaks of matter {i * 7} & of thing {i * i}."
    clean = "\n".join(sentence(i) for i in range(20))
    rows = [(1, clean), (2, "Note.\n" + sentence(1) + " " + sentence(2) + "\nNote."), (3, "\n".join("一段没有空格的普通文字第%d行" % i for i in range(30))),
            (10, " ".join(f"*word{i}$$" for i in range(60))), (11, clean.replace(" matter ", " #matter| ")),
            (12, "\n".join([*map(sentence, range(5)), *["Read more here"] * 5])), (13, " ".join("abcdefghij"[i % 10] + str(i % 7) for i in range(70))),
            (14, " ".join(f"/usr/share/library/{i}/file" for i in range(50)))]
    docs = docs_table(spark, rows)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [1, 2, 3]
    assert {10, 11, 14} <= {r.doc_id for r in quality.keep_good(docs, "v1").collect()}
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(docs).collect()}
    failed = {i: {r for r in quality.RULES if b & quality.rule_bit(r)} for i, b in bits.items()}
    assert failed[10] >= {"many_symbols"} and failed[11] == {"many_symbols"} and failed[14] == {"word_length"}
    assert "repeated_lines" in failed[12] and "word_length" in failed[13]


def exact_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return groups


def check_exact(docs, **how):
    rows = docs.collect()
    groups = exact_groups(rows)
    got = exact.decide(docs, **how).collect()
    assert Counter((g.doc_id, g.text_sha256) for g in got) == Counter(
        (r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for g in got:
        ids = by_sha[g.text_sha256]
        assert g.group_size == len(ids)
        assert g.keep_id == max((i for i in ids if i is not None), default=None)
        kept[g.text_sha256] += g.kept
        assert not g.kept or g.doc_id == g.keep_id
    assert set(kept.values()) <= {1}
    return len(groups)


def test_exact_groups(awkward, empty):
    check_exact(awkward)
    assert exact.decide(empty).count() == 0


def test_exact_names_do_not_collide(awkward):
    """All blocks share three hashes; short blocks give many levels."""
    n = check_exact(awkward.where("length(text) < 12000 OR text IS NULL"), chars=16, hashed=lambda b: F.pmod(F.xxhash64(b), F.lit(3)))
    assert n > 40


def test_exact_stage_keeps_one_row_of_each(awkward, empty):
    kept = exact.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(exact_groups(awkward.collect()))
    assert exact.deduplicated(empty).count() == 0


BASE = [(secrets.ASSIGN, lambda m: len(m.group(2)) >= 6), (secrets.ACCESS, lambda m: len(m.group()) >= 20), ("[0-9a-f]+", lambda m: len(m.group()) >= 24)]


def test_base_spans(awkward):
    texts = ["token=token=abcdef secret=token:abcdef123456 api_key : 'Zz/+=._-9'", "PASSWORD =abcdefg é password='abcdef\"",
             "AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 16, "k" * 10 + "Key", "toKen: = abcdefghi passwd=abc"]
    docs = awkward.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(
        awkward.select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, r.text or "", re.A) if ok(m))
        want[(r.doc_id, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans))] += 1
    got = Counter((r.doc_id, r.s) for r in secrets.find_secrets(docs).select("doc_id", secrets.as_text("base").alias("s")).collect())
    assert got == want


def test_weak_parts_need_their_complements(spark):
    random40, access = "aB3" * 13 + "x", "AKIA" + "Q" * 16
    rows = [(1, f"{random40}"), (2, f"{access} then {random40}"), (3, f"{access} {'.' * 900} {random40}"),
            (4, f"see https://db.example.com/x {access} and {random40}"), (5, "https://db.example.com login=bob99"),
            (6, f"login=bob99 at https://db.example.com password=abcdefgh"), (7, f"{random40} " * 300 + access)]
    got = {r.doc_id: r.s for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).select(
        "doc_id", secrets.as_text("spans").alias("s")).collect()}
    assert got[1] == "" and got[5] == "" and "linked" not in got[3]
    assert got[2] == f"access:0:20,linked_random:26:66"
    assert got[4].startswith("linked_endpoint:4:28,access:") and "linked_random" in got[4]
    assert "linked_account" in got[6] and "linked_endpoint" in got[6]
    # Of the many random strings those that start within the scope are reported.
    assert got[7].count("linked_random") == sum(12300 - 41 * i <= secrets.SCOPE for i in range(300))


def lines_left(rows, least):
    """Deleted line numbers by brute force: the shortest runs that count."""
    docs = sorted({(r.doc_id, r.text or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, gone = {}, defaultdict(set)
    for doc, (_, text) in enumerate(docs):
        ls = text.split("\n")
        seq = [(i, x) for i, x in enumerate(ls) if words(x)]
        for p in range(len(seq)):
            n = total = 0
            while total < least and p + n < len(seq):
                total += len(words(seq[p + n][1]))
                n += 1
            if total >= least:
                run = tuple(x for _, x in seq[p:p + n])
                fd, fp = first.setdefault(run, (doc, p))
                if fd != doc or fp + n <= p:
                    gone[doc].update(range(seq[p][0], seq[p + n - 1][0] + 1))
    return {(d, t): sorted(gone[i]) for i, (d, t) in enumerate(docs)}


def test_repeated_runs_go(spark, awkward, empty):
    extra = [(200 + i, "\n".join(x for x in ("head %d" % i, "alpha beta gamma", "", "delta epsilon", "zeta eta theta iota", "own %d" % i)))
             for i in range(5)] + [(300, "\n".join(["a b", "c d e"] * 6))]
    docs = awkward.where("doc_id IS NOT NULL AND doc_id NOT IN (8)").select("doc_id", "text", "n_chars").unionByName(
        spark.createDataFrame(extra, "doc_id bigint, text string").withColumn("n_chars", F.lit(0).cast("bigint")))
    for least in (7, 50):
        want = lines_left(docs.collect(), least)
        got = lines.without_repeats(docs, least).collect()
        for r in got:
            assert r.gone == want[(r.doc_id, r.text or "")], (least, r.doc_id)
            left = [x for i, x in enumerate((r.text or "").split("\n")) if i not in set(r.gone)]
            assert r.clean_text == "\n".join(left)
            assert sorted(i for a, b in r.runs for i in range(a, b + 1)) == r.gone
    assert lines.without_repeats(empty).count() == 0
    assert lines.without_repeats(awkward).count() == awkward.count()


def whole_runs(rows, least):
    """Deleted line numbers by brute force: every run of lines, of any length,
    that holds enough words and has an earlier copy."""
    docs = sorted({(r.doc_id, r.text or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, gone = {}, defaultdict(set)
    for doc, (_, text) in enumerate(docs):
        seq = [(i, x) for i, x in enumerate(text.split("\n")) if words(x)]
        for p in range(len(seq)):
            total = 0
            for n in range(1, len(seq) - p + 1):
                total += len(words(seq[p + n - 1][1]))
                if total >= least:
                    fd, fp = first.setdefault(tuple(x for _, x in seq[p:p + n]), (doc, p))
                    if fd != doc or fp + n <= p:
                        gone[doc].update(range(seq[p][0], seq[p + n - 1][0] + 1))
    return {(d, t): sorted(gone[i]) for i, (d, t) in enumerate(docs)}


def test_whole_repeated_runs_go(spark):
    """The lines after the last run that starts in a repeated passage go too."""
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = [line("a", 60), line("b", 20), "", line("c", 20)]
    small = [line(x, n) for x, n in zip("pqrstuv", (3, 4, 30, 2, 6, 25, 1), strict=True)]
    rows = [(i, "\n".join([line(f"x{i}_", 7), *passage, line(f"y{i}_", 7)])) for i in range(3)]
    rows += [(10 + i, "\n".join([*small[i % 3:], line(f"z{i}_", 80), *small[:7 - i % 2]])) for i in range(6)]
    docs = docs_table(spark, rows)
    got = {r.doc_id: r.gone for r in lines.without_repeats(docs, whole=True).collect()}
    assert got[0] == [] and got[1] == got[2] == [1, 2, 3, 4]
    assert {r.doc_id: r.gone for r in lines.without_repeats(docs).collect()}[1] == [1]
    for least in (7, 50):
        want = whole_runs(docs.collect(), least)
        for r in lines.without_repeats(docs, least, whole=True).collect():
            assert r.gone == want[(r.doc_id, r.text)], (least, r.doc_id)


def test_parts_of_credentials_of_any_length(spark):
    """Mixed strings from 20 characters on, url-safe ones, and hex spans are
    secrets beside an account; an endpoint then belongs to them."""
    near = "login=bob99 https://db.example.com/x "
    parts = ["aB3" * 11, "aB3_-" * 5, "aB3" * 7 + "==", "0123456789abcdef" * 2]
    rows = [(i, near + p) for i, p in enumerate(parts)] + [(10, parts[0]), (11, near + "aB3" * 6), (12, near + "xy3" * 9)]
    got = {r.doc_id: r.s for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).select(
        "doc_id", secrets.as_text("spans").alias("s")).collect()}
    for i, p in enumerate(parts):
        kind = "hex" if i == 3 else "linked_random"
        assert got[i] == f"linked_account:0:11,linked_endpoint:12:36,{kind}:37:{37 + len(p)}", i
    assert got[10] == got[11] == got[12] == ""


def test_many_matches_in_one_text(spark):
    """Starts are right beyond one piece of matches, and found in linear time."""
    n = 80_000
    text = "token=abcdef " * n
    r = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).select("base").first()
    assert [(s.start, s.end) for s in r.base] == [(13 * i, 13 * i + 12) for i in range(n)]


def test_the_registered_rules_reject_beyond_the_base(spark):
    from branchwise.llm import queries
    from tests.conftest import SF01
    rows = queries.op7_quality_rules(spark, SF01).select("base_failed", "kept").collect()
    assert sum(not r.base_failed and not r.kept for r in rows) > 20
    assert not any(r.base_failed and r.kept for r in rows)
