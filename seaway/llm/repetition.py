"""Quality rules on repetition inside a text, by a suffix array of its words.

Defaults are the columns of passage plans as texts (``route_id``, ``plan_text``: the lines of a plan joined by line breaks). A text is a
sequence of words (runs of anything but blanks). The suffix array of the words is built by prefix doubling in numpy, for many texts at
once: words are numbered per text, so suffixes of different texts never compare equal. Longest common prefixes of neighbours come from
the ranks of the doubling. Their intervals are the repeated word strings; those that can be extended neither to the right (by
construction) nor to the left are the maximal repeats. The union of their occurrences is what is covered.

A text is dropped when a base rule fails (few words, or too many words in repeated five-word windows), when its maximal repeats of
at least ``min_words`` words cover more than ``covered_percent`` of its word characters, or when its longest repeat has more than
``longest_words`` words and the repeat also covers more than ``longest_percent`` of the text.

Each text is judged alone, so nothing is shuffled. Memory per task: the texts of one Arrow batch, and about 4 bytes a word for every
doubling round (the rounds are the logarithm of the longest repeat) of at most ``CHUNK`` words, or of one text if that is longer.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged each; a null id is kept as it is; an
empty table gives no rows; columns other than the two are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
CHUNK = 500_000


class Rules(NamedTuple):
    """Limits; percents are of a text's word characters."""

    least_words: int = 10
    repeat_percent: int = 20
    min_words: int = 3
    covered_percent: float = 30.0
    longest_words: int = 40
    longest_percent: float = 15.0


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) of a sequence of dense symbols; ``lcp[r]`` is what suffix r has in common with the one before it.

    Prefix doubling: ranks of strings of length 1, 2, 4 and so on; only suffixes whose rank is still shared are sorted again. The kept
    ranks give the longest common prefixes from the longest strings down.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ranks, width = [], 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank: where a class begins
        rank = np.empty(n, np.int64)
        rank[order] = start
        ranks.append(rank.astype(np.int32))
        last = np.empty(n, bool)
        last[:-1], last[-1] = new[1:], True
        shared = np.flatnonzero(~(new & last))
        if not len(shared):
            break
        who = order[shared]
        after = who + width
        tail = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        where = np.lexsort((tail, start[shared]))
        order[shared] = who[where]
        keys = np.zeros(n, np.int64)
        keys[shared] = tail[where]
        fresh = new.copy()
        fresh[1:] |= (start[1:] == start[:-1]) & (keys[1:] != keys[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        width *= 2
    lcp = np.zeros(n, np.int64)
    a, b, same = order[1:].copy(), order[:-1].copy(), lcp[1:]
    for level in range(len(ranks) - 1, -1, -1):
        within = (a < n) & (b < n)
        hit = np.zeros(n - 1, bool)
        hit[within] = ranks[level][a[within]] == ranks[level][b[within]]
        same[hit] += 1 << level
        a[hit] += 1 << level
        b[hit] += 1 << level
    return order, lcp


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a first word, words, occurrences) of each maximal repeat of at least ``least`` words, from the intervals of ``lcp``."""
    long = lcp >= least
    if not long.any():
        return []
    before = np.where(order > 0, symbols[np.maximum(order - 1, 0)], -1)
    turns = np.zeros(len(order), np.int64)
    turns[1:] = np.cumsum(before[1:] != before[:-1])
    found, stack = [], []  # stack: (lcp, first rank)
    border = np.flatnonzero(long)
    runs = np.split(border, np.flatnonzero(np.diff(border) > 1) + 1)
    for run in runs:
        stack.clear()
        for r in (*run.tolist(), run[-1] + 1):
            depth = int(lcp[r]) if r < len(lcp) and long[r] else 0
            left = r - 1
            while stack and stack[-1][0] > depth:
                size, left = stack.pop()
                if turns[r - 1] > turns[left]:
                    found.append((int(order[left]), size, r - left))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))
    return found


def _covered(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words: the deepest interval over each suffix covers its start."""
    n = len(order)
    reach = np.zeros(n, np.int64)
    reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    at = np.flatnonzero(reach >= least)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + reach[at], -1)
    return np.cumsum(marks[:-1]) > 0


def _judge(texts: list[str], words: list[list[str]], rules: Rules) -> list[tuple]:
    numbers, base = [], 0
    for w in words:
        ids: dict[str, int] = {}
        numbers.extend([ids.setdefault(x, base + len(ids)) for x in w])
        base += len(ids)
    symbols = np.array(numbers, np.int64)
    sizes = np.fromiter((len(x) for w in words for x in w), np.int64, len(symbols))
    order, lcp = suffix_array(symbols)
    starts = np.cumsum([0, *map(len, words)])
    windows, covered = _covered(order, lcp, WINDOW), _covered(order, lcp, rules.min_words)
    total = lambda v: np.concatenate([[0], np.cumsum(v)])
    chars, in_windows, in_repeats = total(sizes), total(windows), total(sizes * covered)
    repeats: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for first, size, count in maximal_repeats(symbols, order, lcp, rules.min_words):
        k = int(np.searchsorted(starts, first, "right")) - 1
        repeats[k].append((first - int(starts[k]), size, count))
    out = []
    for k, (text, w) in enumerate(zip(texts, words, strict=True)):
        lo, hi = starts[k], starts[k + 1]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n_chars, n_covered, n_repeat = int(chars[hi] - chars[lo]), int(in_repeats[hi] - in_repeats[lo]), int(in_windows[hi] - in_windows[lo])
        longest = max((r[1] for r in repeats[k]), default=0)
        share = 100.0 * n_covered / n_chars if n_chars else 0.0
        failed = len(w) < rules.least_words or 100 * n_repeat > rules.repeat_percent * len(w)
        kept = not failed and share <= rules.covered_percent and not (longest > rules.longest_words and share > rules.longest_percent)
        on = np.flatnonzero(np.diff(np.concatenate([[False], covered[lo:hi], [False]]).astype(np.int8)))
        spans = [{"first_word": int(a), "n_words": int(b - a)} for a, b in zip(on[::2], on[1::2], strict=True)]
        out.append((len(w), n_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, n_covered, longest, len(repeats[k]), spans, failed, kept))
    return out


SPAN = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered_chars", pa.int64()),
          ("longest_repeat", pa.int64()), ("n_repeats", pa.int64()), ("repeat_spans", SPAN), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_chars bigint, longest_repeat bigint, n_repeats bigint, "
          "repeat_spans array<struct<first_word:bigint,n_words:bigint>>, base_failed boolean, kept boolean")


def _rows(batch: pa.RecordBatch, rules: Rules) -> Iterator[pa.RecordBatch]:
    """Results of a batch, in pieces of at most ``CHUNK`` words (or one text)."""
    ids, column, begin = batch.column(0), batch.column(1), 0

    def done(lo: int, hi: int, texts: list[str], words: list[list[str]]) -> pa.RecordBatch:
        parts = list(zip(*_judge(texts, words, rules), strict=True))
        return pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(v, t) for v, (_, t) in zip(parts, FIELDS, strict=True))], names=[batch.schema.field(0).name, *(n for n, _ in FIELDS)])

    texts, words, count = [], [], 0
    for k in range(batch.num_rows):
        text = column[k].as_py() or ""
        found = WORD.findall(text)
        if texts and count + len(found) > CHUNK:
            yield done(begin, k, texts, words)
            begin, texts, words, count = k, [], [], 0
        texts.append(text)
        words.append(found)
        count += len(found)
    if texts:
        yield done(begin, batch.num_rows, texts, words)


def repetition(plans: DataFrame, rules: Rules = Rules(), *, plan_id: str = "route_id", plan_text: str = "plan_text") -> DataFrame:
    """Per text: its counts, the spans of its maximal repeats and the verdict.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (signs of ``#*$%&|<>``); ``n_dup_lines`` (lines with a word that equal an
    earlier line); ``n_repeat_words`` (words in five-word windows found twice or more); ``covered_chars`` and ``repeat_spans`` (what repeats of
    ``rules.min_words`` words and more cover, in word characters and as runs of words); ``longest_repeat`` (words); ``n_repeats``
    (maximal repeats); ``base_failed``; ``kept``.
    """
    kind = plans.schema[plan_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch, rules)

    return plans.select(F.col(plan_id), F.col(plan_text)).mapInArrow(run, f"`{plan_id}` {kind}, {SCHEMA}")
