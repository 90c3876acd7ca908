"""Chat windows, HTML rendering and SentencePiece."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from branchwise.llm import chat, html, pieces
from branchwise.llm.queries import tokenizer_model
from tests.conftest import SF001

CHAT = "conv_id bigint, turn bigint, role string, text string"


def conversations(spark):
    rng = random.Random(8)
    control = ["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<\\|im_end|>", "<\\\\/s>", "[\\INST]", "\\n", "\n", "<", "é"]
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 25)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "tool"])
            rows.append((c, t, role, "".join(rng.choice(control + [" word"] * 9) for _ in range(rng.randrange(0, 160)))))
    rows += [(50, 0, "user", None), (50, 0, "user", None), (50, None, None, "x"), (51, 0, "odd\nrole\\n", "t"), (51, 1, "\\", "u"),
             (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (52, 0, "system", "s" * 9000), (52, 1, "assistant", "a" * 9000),
             (53, 3, "assistant", ""), (54, 5, "assistant", "tie"), (54, 5, "assistant", "tie")]
    return spark.createDataFrame(rows, CHAT)


def test_windows_read_back(spark):
    rows = conversations(spark)
    want = {}
    for r in rows.collect():
        want.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.windows(rows, 300, 80)).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        target = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), sha(target))


def test_windows_keep_the_budget(spark):
    made = chat.windows(conversations(spark), 300, 80).collect()
    system = {}
    for w in made:
        body = w.formatted
        assert body.startswith(chat.OPEN) and body.endswith(chat.CLOSE + "\n")
        assert body.count(chat.OPEN) == body.count(chat.CLOSE + "\n")
        if w.first_pos == 0 and body.startswith(chat.OPEN + "system"):
            system[w.key] = body[:body.index(chat.CLOSE)]
    assert any(w.new_from > 1 for w in made)
    for w in made:
        if w.first_pos > 0 and w.key in system:
            assert w.formatted.startswith(system[w.key])
        if w.over_budget:  # one turn, or the system turn, is too long
            assert max(len(t.encode()) for t in w.formatted.split(chat.CLOSE)) > 4 * 100
    assert chat.windows(spark.createDataFrame([], CHAT)).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<ul><li>x<li>y<ol><li>z</ol></ul>after", "- x\n- y\n  1. z\n\nafter"),
    ("<table><tr><th>n<th>long name<tr><td>aaa<td>b</table>", "n    long name\naaa  b"),
    ("<p>a <b>b</b>c <i> d</i></p>", "a bc d"),
    ("<script>var t='<p>no</p>'</script><style>p{}</style><p hidden>no</p><p style='DISPLAY: none'>no</p>yes", "yes"),
    ("<title>no</title><h1>T</h1>body", "T\n\nbody"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<p>unclosed <b>bold <![bad <!-- x", "unclosed bold"),
    ("</p></div>text</li>", "text"),
    ("<select><option>a<option selected>b</select><details><summary>s</summary>no</details>", "b\ns"),
])
def test_rendering(page, text):
    assert html.visible_text(page).split("<![bad")[0].rstrip() == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><p>Hello", "Hello"),
    ("<html><head><meta charset=x><script>no</script>\n Hello <b>you</b>", "Hello you"),
    ("<head><title>a</title>\n<link href=x><style>p{}</style></head><body>yes", "yes"),
    ("<head><template><p>no</p></template><noscript><p>no</p></noscript><h1>T</h1>x</head>y", "T\n\nxy"),
    ("a<svg width=1 />b<math/>c", "abc"),
    ("<p>a <svg><path d=x /><g/>no<text x=1>one <tspan>two</tspan></text><text>three</text><desc>no</desc></svg> b", "a one two three b"),
    ("<svg><foreignObject><div>in</div></foreignObject><defs><text>no</text></defs></svg>out", "in\nout"),
    ("so <math><mi>x</mi><mspace/><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>.", "so x=1 2."),
    ("<svg><title>no</title><path><p>broken out</p>", "broken out"),
])
def test_heads_and_drawings_hide_no_text(page, text):
    assert html.visible_text(page) == text


def test_deep_pages_do_not_fail():
    assert html.visible_text("<div>" * 5000 + "x") == "x"
    assert "y" in html.visible_text("<table><tr><td>" * 300 + "y")


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>a</p>", "own"), (1, "u", "<p>a</p>", "own"), (None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a")]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(*pieces.load_vocabulary(tokenizer_model()))


TEXTS = ["", " ", "  a  b ", "日本語 テキスト hello", "\n\n\t\x00", "é 😀😀 é", "a" * 700, "zz日本" * 30, "Hello, world!\r\nThe end.",
         "https://a.b/c?d=e&f", "ab" * 50 + " " * 40 + "x"]


def by_hand(text, v):
    """Viterbi by the definition, one character after another."""
    ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
    s = [chr(pieces.SPACE), *("\0x" if c == chr(pieces.SPACE) else chr(pieces.SPACE) if c == " " else c for c in text)] if text else []
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            piece = "".join(s[i:j])
            if piece in ids or j - i == 1:
                score = best[i] + (v.scores[ids[piece]] if piece in ids else v.unknown_score)
                if score > best[j]:
                    best[j], back[j] = score, (i, piece)
    out, j = [], len(s)
    while j:
        j, piece = back[j]
        out.append([ids[piece]] if piece in ids else [int(v.byte_ids[b]) for b in (chr(pieces.SPACE) if piece == "\0x" else piece).encode()])
    return [x for part in reversed(out) for x in part]


def test_viterbi_is_the_best_segmentation(vocabulary):
    texts = [*TEXTS, "a▁b ▁"]
    ids, counts = pieces.encode_batch(texts, pieces.Memo(vocabulary))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == by_hand(text, vocabulary), text


def test_merges_equal_the_library(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    ids, counts = pieces.encode_batch(TEXTS, pieces.Memo(vocabulary, pieces.merges))
    for text, own in zip(TEXTS, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == model.encode(text), text


def test_round_trip(spark, awkward, empty):
    model = tokenizer_model()
    for algorithm in ("viterbi", "merges"):
        rows = pieces.decode(pieces.encode(awkward, model, algorithm=algorithm), model)
        assert rows.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
        assert rows.count() == awkward.count() and rows.where("n_chars = 0 AND size(ids) > 0").count() == 0
    assert pieces.decode(pieces.encode(empty, model), model).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>")
    assert {r.decoded for r in pieces.decode(lists, model).collect()} == {""}


def test_remembered_words_change_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_CODES", 40)
    rng = random.Random(8)
    memo = pieces.Memo(vocabulary)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "Ünï", "a▁b", "xyzzy", "日本", "é"]) for _ in range(rng.randrange(9))) for _ in range(4)]
        ids, counts = pieces.encode_batch(texts, memo)
        fresh, fresh_counts = pieces.encode_batch(texts, pieces.Memo(vocabulary))
        assert ids.tolist() == fresh.tolist() and counts.tolist() == fresh_counts.tolist()


@pytest.mark.parametrize("method", [pieces.viterbi, pieces.merges])
def test_a_word_of_a_million_letters(vocabulary, method):
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin") for _ in range(1_000_000))
    ids, counts = pieces.encode_batch([text], pieces.Memo(vocabulary, method))
    assert counts.tolist() == [len(ids)] and pieces.decode_batch(ids, counts, vocabulary) == [text]


def test_odd_column_names_pass_through(spark):
    model = tokenizer_model()
    docs = spark.createDataFrame([("a b", "x", 1, "y")], "text string, `a.b` string, ids int, decoded string")
    r = pieces.decode(pieces.encode(docs, model), model).first()
    assert r["a.b"] == "x" and r.decoded == "a b" and r.text == "a b"


def test_merges_of_a_whole_table_equal_the_library(spark):
    """What the query once carried beside the method: the library's ids."""
    model = tokenizer_model()
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in pieces.encode(docs, model, algorithm="merges").collect():
        if "\u2581" not in r.text:
            assert list(r.ids) == library.encode(r.text), r.doc_id
