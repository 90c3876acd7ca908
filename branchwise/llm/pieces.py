"""SentencePiece encoding and decoding in numpy batches.

A batch of texts becomes one array of code points, cut into words wherever no
piece holds the two characters at the cut, so words are encoded apart without
changing the result.  Words of equal length form a matrix; equal words are
encoded once, and remembered by the worker.  Substrings are hashed by prefix sums, the hashes probe the
sorted keys of the pieces (and the characters are compared, so a hash decides
nothing by itself), and all words of a length advance together:

- ``viterbi``: the segmentation of the highest total score; vectorised maxima
  over the last piece store its length and id as backpointers;
- ``merges``, beside the method and word by word: the best-scored neighbours
  merge until none can, which is what the library does for a model of merges.

Characters without a piece become the byte pieces of their UTF-8 form, so
decoding gives back the text exactly.  A U+2581 in a text is also written as
bytes, because the piece with that character stands for a space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from branchwise.llm.bytepairs import neighbours_merged
from branchwise.llm.common import with_arrow_column

# The mark of a space, and the code that stands for its own
# character in a text (no code point).
SPACE, LITERAL_MARK = 0x2581, 0x110000
#: Stands for that mark while neighbours are merged; no character.
NO_PIECE = 0x10FFFF
#: What a character without a piece costs below the lowest score.
UNKNOWN_COST = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The model is read on the driver and sent to the tasks.
MOST_MODEL_BYTES = 64 << 20
#: Code points that are encoded together.
BATCH_CODES = 1 << 19
#: Code points of the words that a worker remembers.
MEMO_CODES = 1 << 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * BASE + rows[:, k].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Vocabulary:
    """Pieces by length: sorted keys, their ids, scores and characters."""
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self):
        ids = np.flatnonzero(self.normal)
        self.longest = max((len(self.pieces[i]) for i in ids), default=1)
        self.unknown_score = float(self.scores[ids].min(initial=0.0)) - UNKNOWN_COST
        self.by_length = {}
        for n in range(1, self.longest + 1):
            own = np.array([i for i in ids if len(self.pieces[i]) == n], np.int64)
            if len(own):
                rows = np.stack([_codes(self.pieces[i]) for i in own])
                keys = _hash_rows(rows)
                order = np.argsort(keys, kind="stable")
                self.by_length[n] = (keys[order], own[order], self.scores[own[order]], rows[order])
        # Neighbours inside of pieces, as pairs of character classes.
        chars = np.unique(np.concatenate([_codes(self.pieces[i]) for i in ids if len(self.pieces[i]) > 1] or [np.empty(0, np.int64)]))
        self.classes = np.zeros(LITERAL_MARK + 1, np.int32)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        self.n_classes = len(chars) + 1
        self.together = np.zeros(self.n_classes * self.n_classes, bool)
        for n, (_, _, _, rows) in self.by_length.items():
            for k in range(n - 1):
                self.together[self.classes[rows[:, k]] * np.int64(self.n_classes) + self.classes[rows[:, k + 1]]] = True
        # Merging: ids and ranks (0 is the best) of the pieces.
        self.ids = {self.pieces[i]: int(i) for i in ids}
        _, ranks = np.unique(-self.scores[ids], return_inverse=True)
        self.ranks = dict(zip(self.ids, ranks.tolist(), strict=True))
        self.powers = np.cumprod(np.array([1] + [int(BASE)] * self.longest, np.uint64), dtype=np.uint64)
        # Decoding: the bytes of every id, end to end.
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        texts = [of_byte.get(i) or (self.pieces[i].replace(chr(SPACE), " ").encode() if self.normal[i] else b"")
                 for i in range(len(self.pieces))]
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes

    def find(self, n: int, hashes: np.ndarray, at) -> np.ndarray:
        """Index among the pieces of length ``n``, or -1.  ``at(hits)`` gives
        the characters of the hits, which must be those of the piece."""
        keys, _, _, rows = self.by_length[n]
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hits = np.flatnonzero(keys[place] == hashes)
        same = (at(hits) == rows[place[hits]]).all(axis=1)
        out = np.full(len(hashes), -1, np.int64)
        out[hits[same]] = place[hits[same]]
        return out


def load_vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, scores, which are ordinary, and the ids of the byte pieces."""
    import os

    import sentencepiece
    if os.path.getsize(path) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids])
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(model.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the model has no byte pieces; texts could not be decoded exactly")
    return [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids], np.float64), normal, byte_ids


def viterbi(words: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (right-aligned) and their number for a matrix of words; -1 - c
    stands for a character c without a piece."""
    m, n = words.shape
    prefix = np.zeros((m, n + 1), np.uint64)
    for k in range(n):
        prefix[:, k + 1] = prefix[:, k] * BASE + words[:, k].astype(np.uint64) + np.uint64(1)
    most = min(v.longest, n)
    score = np.full((most, n, m), -np.inf)  # of the piece of length k + 1 that ends after position j
    piece = np.full((most, n, m), -1, np.int64)
    for size in range(1, most + 1):
        if size not in v.by_length:
            continue
        ends = np.arange(size, n + 1)
        h = (prefix[:, ends] - prefix[:, ends - size] * v.powers[size]).ravel()
        chars = lambda hits, w=size, e=len(ends): words[(hits // e)[:, None], (hits % e)[:, None] + np.arange(w)]
        found = v.find(size, h, chars).reshape(m, -1).T
        _, ids, scores, _ = v.by_length[size]
        score[size - 1, size - 1:] = np.where(found >= 0, scores[found], -np.inf)
        piece[size - 1, size - 1:] = np.where(found >= 0, ids[found], -1)
    alone = piece[0] < 0
    score[0][alone] = v.unknown_score
    piece[0][alone] = (-1 - words.T)[alone]
    best, length, token = np.zeros((n + 1, m)), np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
    columns = np.arange(m)
    for j in range(1, n + 1):
        k = min(most, j)
        total = score[:k, j - 1] + best[j - k:j][::-1]
        size = k - np.argmax(total[::-1], axis=0)  # of equal totals the longest last piece
        best[j], length[j], token[j] = total[size - 1, columns], size, piece[size - 1, j - 1, columns]
    out, count, at = np.zeros((m, n), np.int64), np.zeros(m, np.int64), np.full(m, n)
    while (live := np.flatnonzero(at > 0)).size:
        count[live] += 1
        out[live, n - count[live]] = token[at[live], live]
        at[live] -= length[at[live], live]
    return out, count


def merges(words: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Like ``viterbi``, by merging the best-scored neighbours."""
    m, n = words.shape
    out, count = np.zeros((m, n), np.int64), np.zeros(m, np.int64)
    own_mark = np.where(words == LITERAL_MARK, NO_PIECE, words).astype("<u4")
    for i in range(m):
        text = own_mark[i].tobytes().decode("utf-32-le", "surrogatepass")
        ends = neighbours_merged(text, v.ranks)
        ids = [v.ids.get(text[a:b], -1 - int(words[i, a])) for a, b in zip([0, *ends], ends, strict=False)]
        out[i, n - len(ids):], count[i] = ids, len(ids)
    return out, count


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start + size]`` end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Memo:
    """Words encoded so far, and their tokens.  Words are few where texts are
    many, so a worker keeps what it made for the batches that follow, up to
    ``MEMO_CODES`` characters; then it begins anew."""

    def __init__(self, v: Vocabulary, method=viterbi):
        self.v, self.method = v, method
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.codes, self.n_tokens = 0, 0
        self.tokens, self.start, self.count = (np.empty(1 << 12, np.int64) for _ in range(3))

    def begin(self) -> None:
        """Before a batch: places from here on hold until the next one."""
        if self.codes > MEMO_CODES:
            self._clear()

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        array = getattr(self, name)
        if used + more > len(array):
            array = np.concatenate([array[:used], np.empty(max(used, more), np.int64)])
            setattr(self, name, array)
        return array

    def place(self, words: np.ndarray) -> np.ndarray:
        """Places of the different words of a matrix; new ones are encoded."""
        m, n = words.shape
        keys = np.ascontiguousarray(words.astype("<u4")).view(np.dtype((np.void, 4 * n))).ravel().tolist()
        out = np.fromiter((self.places.get(k, -1) for k in keys), np.int64, m)
        new = np.flatnonzero(out < 0)
        if len(new):
            tokens, count = self.method(words[new], self.v)
            flat, first = tokens[np.arange(n) >= n - count[:, None]], len(self.places)
            self._room("tokens", self.n_tokens, len(flat))[self.n_tokens:self.n_tokens + len(flat)] = flat
            for name, values in (("start", self.n_tokens + np.cumsum(count) - count), ("count", count)):
                self._room(name, first, len(new))[first:first + len(new)] = values
            out[new] = first + np.arange(len(new))
            self.places.update(zip([keys[i] for i in new.tolist()], out[new].tolist(), strict=True))
            self.n_tokens, self.codes = self.n_tokens + len(flat), self.codes + n * len(new)
        return out


def encode_batch(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and how many each has."""
    v = memo.v
    memo.begin()
    codes, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            c = _codes(t)
            c = np.where(c == SPACE, LITERAL_MARK, np.where(c == 0x20, SPACE, c))
            codes += [np.array([SPACE]), c]
            sizes[i] = len(c) + 1
    if not codes:
        return np.empty(0, np.int64), sizes
    flat = np.concatenate(codes)
    kind = v.classes[flat].astype(np.int64)
    cut = np.ones(len(flat), bool)
    cut[1:] = ~v.together[kind[:-1] * v.n_classes + kind[1:]]
    text_ends = np.cumsum(sizes)
    cut[text_ends[text_ends < len(flat)]] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(flat)))
    place = np.empty(len(starts), np.int64)
    order = np.argsort(lengths, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        words = flat[starts[own][:, None] + np.arange(lengths[own[0]])]
        _, one, which = np.unique(_hash_rows(words), return_index=True, return_inverse=True)
        if not (words == words[one][which]).all():  # two words share a hash
            _, one, which = np.unique(words, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        place[own] = memo.place(words[one])[which]
    per_word = memo.count[place]
    ids = _gathered(memo.tokens, memo.start[place], per_word)
    word_text = np.searchsorted(text_ends, starts, side="right")
    owner = np.repeat(word_text, per_word)
    missing = ids < 0
    if missing.any():
        codes_of, inverse = np.unique(-1 - ids[missing], return_inverse=True)
        as_bytes = [chr(SPACE if c == LITERAL_MARK else c).encode("utf-8", "surrogatepass") for c in codes_of.tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[missing] = np.array([len(b) for b in as_bytes])[inverse]
        at = np.cumsum(wide) - wide
        out = np.repeat(ids, wide)
        for k in range(4):
            nth = np.array([b[k] if k < len(b) else 0 for b in as_bytes])[inverse]
            some = np.array([k < len(b) for b in as_bytes])[inverse]
            out[at[missing][some] + k] = v.byte_ids[nth[some]]
        ids, owner = out, np.repeat(owner, wide)
    return ids, np.bincount(owner, minlength=len(texts))


def decode_batch(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[str]:
    """The texts of ids end to end.  The space put before a text goes; bytes
    that are no UTF-8 become U+FFFD; control ids have no text."""
    sizes = v.text_sizes[ids]
    ends = np.cumsum(sizes)
    source = np.repeat(v.text_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    data = v.text_bytes[source].tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_LOADED: dict[tuple, Memo | Vocabulary] = {}


def _vocabulary(parts: tuple) -> Vocabulary:
    """The tables are built once per Python worker."""
    key = (hashlib.sha256("\0".join(parts[0]).encode() + parts[1].tobytes()).hexdigest(), "")
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(*parts)
    return _LOADED[key]


def _memo(parts: tuple, algorithm: str) -> Memo:
    """The words that this Python worker has encoded."""
    v = _vocabulary(parts)
    for known in _LOADED.values():
        if isinstance(known, Memo) and known.v is v and known.method.__name__ == algorithm:
            return known
    _LOADED[algorithm, str(len(_LOADED))] = memo = Memo(v, {"viterbi": viterbi, "merges": merges}[algorithm])
    return memo


def _parts_of(texts: list, most: int = BATCH_CODES) -> Iterator[list[str]]:
    """The texts, null as empty, in parts of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoded(column: pa.Array, parts: tuple, algorithm: str) -> pa.Array:
    memo = _memo(parts, algorithm)
    made = [encode_batch(some, memo) for some in _parts_of(column.to_pylist())]
    ids = np.concatenate([i for i, _ in made] or [np.empty(0, np.int64)]).astype(np.int32)
    counts = np.concatenate([c for _, c in made] or [np.empty(0, np.int64)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _decoded(lists: pa.Array, parts: tuple) -> pa.Array:
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return pa.array(decode_batch(np.asarray(lists.flatten(), np.int64), counts, _vocabulary(parts)), pa.string())


def encode(rows: DataFrame, model: str, column: str = "text", out: str = "ids", algorithm: str = "viterbi") -> DataFrame:
    """``rows`` with ``out``, the ids of each text, in place of a column of
    that name.  A null or empty text has no ids.  Rows stay as they are
    otherwise.  ``model`` is a path on the driver."""
    parts = load_vocabulary(model)
    return with_arrow_column(rows, column, out, T.ArrayType(T.IntegerType()), lambda texts: _encoded(texts, parts, algorithm))


def decode(rows: DataFrame, model: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text of each list of ids; null and empty
    lists give an empty text."""
    parts = load_vocabulary(model)
    return with_arrow_column(rows, column, out, T.StringType(), lambda lists: _decoded(lists, parts))
