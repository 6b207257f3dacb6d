"""Quality rules from repetition inside a text, found with suffix arrays over its words.

A shard of whole texts gets one suffix array by prefix doubling; words count as equal only within
the same text, so no repeat spans two texts.  The longest common prefixes of neighbours come from
the ranks that the doubling leaves behind.  Intervals of common prefixes whose members differ in the
word before are the maximal repeated substrings; the union of their spans is the union, over all
suffixes, of what each shares with a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, raw_texts, shards

SYMBOLS = b"#*$%&|<>"
SHARD = 4 << 20


@dataclass(frozen=True)
class Rules:
    """A repeat counts from ``least_words`` words on.  A text is dropped if repeats cover more than
    ``max_percent`` of its words' characters, or one is longer than ``max_words`` words."""

    least_words: int = 5
    max_percent: int = 30
    max_words: int = 100
    least_text_words: int = 50
    max_repeat_percent: int = 50


def suffix_array(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks after 1, 2, 4, ... words (0 past a text's end).

    ``ids``: word numbers; ``first``: where each text begins, and the end.  Only suffixes that still
    share their rank with another are sorted again.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    key = doc.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    ranks, h = [rank], 1
    same = np.zeros(n, bool)
    same[1:] |= ~new[1:]
    same[:-1] |= ~new[1:]
    at = np.flatnonzero(same)  # places in order whose suffixes share a rank
    while len(at):
        rank = rank.copy()
        old = ranks[-1]
        suffix = order[at]
        ahead = suffix + h
        second = np.where(ahead < end[suffix], old[np.minimum(ahead, n - 1)], 0)
        by = np.lexsort((second, old[suffix]))
        suffix, second = suffix[by], second[by]
        group = old[suffix]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        # within a group, a rank is the group's first place moved on by the place of the first equal
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], place, 0))
        rank[suffix] = group + np.maximum.accumulate(np.where(new, place, 0)) - head
        ranks.append(rank)
        shared = np.zeros(len(at), bool)
        shared[1:] |= ~new[1:]
        shared[:-1] |= ~new[1:]
        at = at[shared]
        h *= 2
    return order, ranks


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Words that each suffix in order shares with the one before it."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.r_[False, ranks[0][order[1:]] == ranks[0][order[:-1]]]) if n else np.zeros(0, np.int64)
    a, b = order[at - 1], order[at]
    size = np.zeros(len(at), np.int64)
    for k in reversed(range(len(ranks))):
        x, y = a + size, b + size
        inside = (x < end[a]) & (y < end[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        size += np.where(inside & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
    lcp[at] = size
    return lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, ids: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a place, words, occurrences) of each maximal repeat of at least ``least`` words: the
    intervals of common prefixes that can't be made longer to the left for all members."""
    starts = np.zeros(len(ids), bool)
    starts[first[:-1][first[:-1] < len(ids)]] = True
    before = np.where(starts, -1 - np.arange(len(ids)), np.r_[-1, ids[:-1]]) if len(ids) else ids
    left = before[order]
    changes = np.cumsum(np.r_[0, left[1:] != left[:-1]]) if len(ids) else left
    found, stack = [], []  # (words, first place in order)
    high = np.flatnonzero(lcp >= least)
    previous = -2
    for k in [*high.tolist(), len(lcp) + 1]:
        if k != previous + 1:
            _close(stack, 0, previous, order, changes, found)
        if k <= len(lcp) - 1:
            words, begin = int(lcp[k]), k - 1
            begin = _close(stack, words, k - 1, order, changes, found, begin)
            if not stack or stack[-1][0] < words:
                stack.append((words, begin))
        previous = k
    return found


def _close(stack, words, last, order, changes, found, begin=0):
    while stack and stack[-1][0] > words:
        size, begin = stack.pop()
        if changes[last] > changes[begin]:
            found.append((int(order[begin]), size, last - begin + 1))
    return begin


def measure(texts: list[bytes], rules: Rules = Rules()) -> list[dict]:
    """The counts and verdict of each text."""
    number: dict[bytes, int] = {}
    put = number.setdefault
    split, rows = [], []
    for t in texts:
        words = t.split()
        seen, dup = set(), 0
        for line in t.split(b"\n"):
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
        joined = b"".join(words)
        rows.append({
            "n_words": len(words),
            "word_chars": len(joined.decode("utf-8", "replace")),
            "n_symbols": len(t) - len(t.translate(None, SYMBOLS)),
            "n_dup_lines": dup,
        })
        split.append(words)
    first = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)])
    n = int(first[-1])
    flat = [w for words in split for w in words]
    ids = np.fromiter([put(w, len(number)) for w in flat], np.int64, n)
    chars = np.fromiter(map(len, flat), np.int64, n)
    order, ranks = suffix_array(ids, first)
    lcp = neighbour_prefixes(order, ranks, first)
    longest = np.zeros(n, np.int64)
    if n:
        longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    base = _union(np.flatnonzero(longest >= 3), 3, n)
    at = np.flatnonzero(longest >= rules.least_words)
    covered = _union(at, longest[at], n)
    size = len(texts)
    n_repeat = np.bincount(doc, base, size)
    covered_chars, all_chars = np.bincount(doc, covered * chars, size), np.bincount(doc, chars, size)
    covered_words = np.bincount(doc, covered, size)
    most = np.zeros(size, np.int64)
    np.maximum.at(most, doc[at], longest[at])
    repeats = np.zeros(size, np.int64)
    for place, _, _ in maximal_repeats(order, lcp, ids, first, rules.least_words):
        repeats[doc[place]] += 1
    for k, r in enumerate(rows):
        r["n_repeat_words"] = int(n_repeat[k])
        r["n_repeats"], r["repeated_words"], r["longest_repeat"] = int(repeats[k]), int(covered_words[k]), int(most[k])
        r["base_failed"] = r["n_words"] < rules.least_text_words or 100 * r["n_repeat_words"] > rules.max_repeat_percent * r["n_words"]
        r["kept"] = not r["base_failed"] and bool(100 * covered_chars[k] <= rules.max_percent * all_chars[k]) and r["longest_repeat"] <= rules.max_words
    return rows


def _union(at: np.ndarray, size, n: int) -> np.ndarray:
    """True at each word inside a span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:-1]) > 0


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_repeats bigint, "
    "repeated_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)


def repetition_rules(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the word, symbol, line and repeat counts, and the verdicts.

    Words are runs without ASCII white space.  n_repeat_words: words inside 3-word windows that stand
    twice or more in the text.  n_repeats: maximal repeated substrings of at least
    ``rules.least_words`` words; repeated_words: words inside any; longest_repeat: words of the
    longest.  A null or empty text has no words, so base_failed is true and kept is false.  Repeated
    rows are judged each on their own; an empty table gives no rows; other columns are not looked at.  No shuffle; texts are worked on in shards of a few MB (or
    one text, if longer).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = raw_texts(b), []
            for x, y in shards(map(len, texts), SHARD):
                rows += measure(texts[x:y], rules)
            kinds = {name: pa.bool_() if kind == "boolean" else pa.int64() for name, kind in (c.split() for c in SCHEMA.split(", "))}
            columns = {name: pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | columns)

    return map_texts(df, run, f"doc_id {df.schema[id_col].dataType.simpleString()}, {SCHEMA}", doc_id=id_col, text=text_col)
