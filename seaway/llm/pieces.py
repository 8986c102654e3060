"""SentencePiece encoding and decoding with batched numpy Viterbi (operator 5).

Distinct words of equal length advance together: substring hashes are probed in the sorted hashes of the pieces, and at each
position the best piece that ends there is kept as a backpointer. For a unigram model best means the largest sum of
scores. For a merge-ranked (BPE) model scores do not add up; there a piece may follow another only if merging the two by rank
would keep their border, which leaves exactly one way to every position, the one that merging gives.

Records: the engine stores no free remarks, so the operator runs on any (id, text) table; its defaults are those of
passage plans (``route_id``, ``plan_text``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from seaway.llm.shingles import mix
from seaway.llm.texts import code_points, small_batches
from seaway.llm.wordcache import WordCache, with_blanks

BLANK = "▁"  # stands for a space inside pieces
NONE = np.iinfo(np.int64).max
SIEVE = np.uint64(44)
PAIRS = 1 << 21  # places for pairs of pieces whose border is remembered
PLACE = np.uint64(64 - 21)
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


@dataclass(frozen=True)
class PieceModel:
    """Pieces by id with scores; ``kinds``: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte. Only identity normalisation is supported."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    merges: bool
    dummy_prefix: bool = True
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "kinds": self.kinds, "merges": self.merges, "dummy_prefix": self.dummy_prefix, "_made": {}}

    @property
    def coder(self) -> PieceCoder:
        """The tables of the model, made once in each worker."""
        if "coder" not in self._made:
            self._made["coder"] = _CODERS.get(self) or _CODERS.setdefault(self, PieceCoder(self))
        return self._made["coder"]


_CODERS: dict[PieceModel, PieceCoder] = {}


def load_pieces(model_file: str) -> PieceModel:
    """Read a ``.model`` file of the sentencepiece library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind not in (1, 2) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with identity normalisation are supported")
    p = proto.pieces
    return PieceModel(tuple(x.piece for x in p), tuple(float(x.score) for x in p), tuple(int(x.type) for x in p), kind == 2, norm.add_dummy_prefix)


class PieceCoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.usable = [i for i, k in enumerate(model.kinds) if k in (1, 4) and model.pieces[i]]
        text = [model.pieces[i] for i in self.usable]
        self.ids = np.array(self.usable, np.int64)
        self.longest = max(map(len, text), default=1)
        self.length = np.array([len(t) for t in text], np.int64)
        self.score = np.array([model.scores[i] for i in self.usable])
        self.raw = np.array([self._raw(t) for t in text], np.uint64)
        keys = mix(self.raw + self.length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << (64 - int(SIEVE)), bool)  # a first look: whether any piece has these leading hash bits
        self.maybe[(keys >> SIEVE).astype(np.int64)] = True
        self.known, self.kept = np.full(PAIRS, -1), np.zeros(PAIRS, bool)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.power = np.array([pow(_STEP, n, 1 << 64) for n in range(self.longest + 2)], np.uint64)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        self.bytes = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == 6}
        self.index = {t: i for i, t in enumerate(text)}
        self.lines_apart = not any("\n" in t for t in text)
        self.words_apart = not any(BLANK in t.lstrip(BLANK) for t in text)
        self.left = self.right = np.arange(len(text))
        self.rank = np.full(len(text), -1, np.int64)
        self.tied: set[str] = set()
        if model.merges:
            self._ranks(text)
        self.apart = self.words_apart and self.lines_apart
        segments = with_blanks if self.apart else lambda buffer, docs: (docs[:-1][docs[:-1] < docs[1:]], docs[1:][docs[:-1] < docs[1:]])
        self.cache = WordCache(self.words_together, segments, b" " if model.dummy_prefix else b"", b"")

    @staticmethod
    def _raw(text: str) -> int:
        h = 0
        for j, cp in enumerate(code_points(text).tolist()):
            h = (h + (cp + 1) * pow(_STEP, j, 1 << 64)) % (1 << 64)
        return h

    def _find(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of the piece with that hash and length, -1 if none."""
        return self._probe(mix(raw + np.asarray(length, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    def _probe(self, k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)

    # merge-ranked models

    def _ranks(self, text: list[str]) -> None:
        """Rank of every merge, and the two halves each piece is merged from; pieces that merging never makes get no way in."""
        many = np.array([len(t) > 1 for t in text])
        distinct = np.unique(-self.score[many])
        self.rank = np.where(many, np.searchsorted(distinct, -self.score), -1)
        common = {s for s, n in zip(*np.unique(self.score[many], return_counts=True), strict=True) if n > 1}
        self.tied = {t for t, m, s in zip(text, many, self.score, strict=True) if m and s in common}
        self.tie = min(self.tied, key=len, default="")[:2]
        self.tie = self.tie if all(self.tie in t for t in self.tied) else ""
        self.left, self.right = np.arange(len(text)), np.arange(len(text))
        self.reached = ~many
        for i, t in enumerate(text):
            if many[i]:
                parts = self.merged(t, stop_before_last=True)
                if len(parts) == 2 and all(p in self.index for p in parts):
                    self.left[i], self.right[i], self.reached[i] = self.index[parts[0]], self.index[parts[1]], True

    def merged(self, word: str, stop_before_last: bool = False) -> list[str]:
        """Plain merging: always the best pair, the leftmost of equals, from a heap of the pairs that stand side by side.

        Used for the table of halves and for words with tied ranks (runs of spaces); n log n steps for n characters.
        """
        n = len(word)
        size, ahead, behind = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = ahead[i]
            if j < n:
                k = self.index.get(word[i : j + size[j]]) if size[i] + size[j] <= self.longest else None
                if k is not None:
                    heap.append((-self.score[k], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        heapify(heap)
        parts = n
        while heap and not (stop_before_last and parts == 2):
            _, i, x, y = heappop(heap)
            j = ahead[i]
            if size[i] != x or j >= n or size[j] != y:  # one of the two has been merged since
                continue
            size[i], size[j], ahead[i] = x + y, 0, ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            parts -= 1
            for left in (behind[i], i):
                if left >= 0:
                    before = len(heap)
                    offer(left)
                    if len(heap) > before:
                        heappush(heap, heap.pop())
        return [word[i : i + size[i]] for i in range(n) if size[i]]

    def keeps_border(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves the border between each two pieces: their merges are undone from the last, and no pair across the border may come earlier."""
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), NONE)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            both = self._find(self.raw[x] + self.raw[y] * self.power[np.minimum(self.length[x], self.longest + 1)], self.length[x] + self.length[y])
            broken = (both >= 0) & (np.where(both >= 0, self.rank[both], NONE) < limit[live])
            good[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            ended = broken | ((rx < 0) & (ry < 0))
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~ended]
        return good

    def _borders(self, pairs: np.ndarray) -> np.ndarray:
        """``keeps_border`` of pairs given as ``first * pieces + second``. Answers stay in a table of ``PAIRS`` places by hash; a later pair takes the place of an earlier one."""
        place = (mix(pairs.astype(np.uint64)) >> PLACE).astype(np.int64)
        out, new = self.kept[place], np.flatnonzero(self.known[place] != pairs)
        if len(new):
            uniq, inverse = np.unique(pairs[new], return_inverse=True)
            found = self.keeps_border(uniq // len(self.ids), uniq % len(self.ids))
            out[new] = found[inverse]
            self.known[place[new]], self.kept[place[new]] = pairs[new], out[new]
        return out

    # encoding

    def words_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_words(words)
        return np.concatenate(ids).astype(np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, words of equal length together."""
        texts = [w.replace(" ", BLANK) for w in words]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            if self.tied and self.tie in t and any(p in t for p in self.tied):
                out[i] = self._emit([(self.ids[self.index[p]] if p in self.index else -1, p) for p in self.merged(t)])
            elif t:
                by.setdefault(len(t), []).append(i)
        for n, rows in by.items():
            for j in range(0, len(rows), max(1, 200_000 // n)):
                some = rows[j : j + max(1, 200_000 // n)]
                for i, ids in zip(some, self._viterbi([texts[i] for i in some], n), strict=True):
                    out[i] = ids
        return out

    def _viterbi(self, texts: list[str], n: int) -> list[np.ndarray]:
        points = code_points("".join(texts)).reshape(len(texts), n)
        up = np.empty(n, np.uint64)
        down = np.empty(n, np.uint64)
        up[:] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_STEP))]))
        down[:] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(_BACK))]))
        total = np.zeros((len(texts), n + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=total[:, 1:])
        rows = np.arange(len(texts))
        best = np.full((len(texts), n + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((len(texts), n + 1), np.int32)
        last = np.full((len(texts), n + 1), -1)  # piece that ends at each position; -1: an unknown character
        ends, starts, owners, found = [], [], [], []  # of all pieces that occur
        single = np.zeros((len(texts), n), bool)
        for size in range(1, min(self.longest, n) + 1):
            h = mix((total[:, size:] - total[:, :-size]) * down[: n - size + 1] + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
            end, row = np.nonzero(self.maybe[(h >> SIEVE).astype(np.int64)].T)
            piece = self._probe(h[row, end])
            real = piece >= 0
            if self.model.merges:
                real &= self.reached[piece]
            end, row, piece = end[real], row[real], piece[real]
            if size == 1:
                single[row, end] = True
            ends.append(end + size)
            starts.append(end)
            owners.append(row)
            found.append(piece)
        ends, starts, owners, found = map(np.concatenate, (ends, starts, owners, found))
        order = np.argsort(ends.astype(np.int32), kind="stable")  # shorter pieces first among those with one end
        starts, owners, found = starts[order], owners[order], found[order]
        cuts = np.searchsorted(ends[order], np.arange(n + 2))
        floor = float(self.score.min(initial=0.0)) - 10.0
        for e in range(1, n + 1):
            lone = np.flatnonzero(~single[:, e - 1])  # an unknown character is a way of its own
            best[lone, e] = 0.0 if self.model.merges else best[lone, e - 1] + floor
            some = slice(cuts[e], cuts[e + 1])
            if cuts[e] == cuts[e + 1]:
                continue
            row, start, piece = owners[some], starts[some], found[some]
            if self.model.merges:  # one way at most is open to each position, and all values are 0
                open_ = best[row, start] == 0.0
                before = last[row, start]
                check = np.flatnonzero(open_ & (before >= 0))
                open_[check] = self._borders(before[check] * len(self.ids) + piece[check])
                row, start, piece = row[open_], start[open_], piece[open_]
                best[row, e] = 0.0
            else:
                value = best[row, start] + self.score[piece]
                np.maximum.at(best[:, e], row, value)
                won = value >= best[row, e]
                row, start, piece = row[won], start[won], piece[won]
            back[row, e], last[row, e] = e - start, piece
        if self.model.merges and not np.isfinite(best[:, n]).all():
            raise RuntimeError("a word has no way through the pieces")
        at, steps = np.full(len(texts), n), []
        while (at > 0).any():
            live = at > 0
            steps.append(np.where(live, last[rows, at], -2))
            at = np.where(live, at - back[rows, at], 0)
        path = np.array(steps)[::-1].T
        plain = ~(path == -1).any(axis=1)
        out = []
        for t, p, simple in zip(texts, path, plain, strict=True):
            p = p[p > -2]
            if simple:
                out.append(self.ids[p].astype(np.int32))
                continue
            i, parts = 0, []
            for q in p:
                size = 1 if q < 0 else int(self.length[q])
                parts.append((-1 if q < 0 else self.ids[q], t[i : i + size]))
                i += size
            out.append(self._emit(parts))
        return out

    def _emit(self, parts: list[tuple[int, str]]) -> np.ndarray:
        """Ids with unknown characters as bytes, or as the unknown piece where the model has no bytes."""
        ids: list[int] = []
        for i, t in parts:
            if i >= 0:
                ids.append(int(i))
            elif self.bytes:
                ids += [self.bytes[b] for b in t.encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, np.int32)

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of texts. Where no piece reaches across words they are encoded word by word, else each text is one word."""
        return list(self.cache.encode_texts((t or "").replace(BLANK, " ") for t in texts))

    # decoding

    @cached_property
    def written(self) -> np.ndarray:
        m = self.model
        out = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(BLANK, " ").encode("utf-8", "surrogatepass") for p, k in zip(m.pieces, m.kinds, strict=True)]
        return np.array(out, dtype=object)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if ids is None or not len(ids):
            return ""
        raw = b"".join(self.written[np.asarray(ids)])
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encode_pieces(plans: DataFrame, model: PieceModel, plan_text: str = "plan_text") -> DataFrame:
    """``plans`` with ``piece_ids``, the ids of the whole text without begin and end marks.

    Null and empty texts get an empty array; a column of that name is replaced. Equal texts get equal ids. One pass, no shuffle.
    """

    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(model.coder.encode(texts), dtype=object)

    return small_batches(plans).withColumn("piece_ids", F.pandas_udf(made, ArrayType(IntegerType()))(F.col(plan_text)))


def decode_pieces(plans: DataFrame, model: PieceModel, out: str = "decoded_text") -> DataFrame:
    """``plans`` with the text of ``piece_ids``. It equals the encoded text, but for U+2581, which reads as a space, and lone surrogates."""

    def made(ids: pd.Series) -> pd.Series:
        return pd.Series([model.coder.decode(x) for x in ids], dtype=object)

    return small_batches(plans).withColumn(out, F.pandas_udf(made, StringType())(F.col("piece_ids")))
