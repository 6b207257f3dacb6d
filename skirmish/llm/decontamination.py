"""Benchmark decontamination by suffix arrays over the training texts.

Every shard of training texts (a run of whole documents) gets a suffix array over all its words: ranks of
the first 2, 4, 8, ... words come from doubling, and two overlapping ranks order the suffixes by as many
words as a window has.  Every test suffix of a window or more is searched in it by bisection, which gives
all places where its first words stand verbatim; places that follow each other in text and item are joined
into the longest matches.  Items shorter than a window are searched by what they have, in the same order.

The test set is what travels.  It goes out in blocks of a checked size, one pass over the texts for
each block; what a pass finds is stored with the rows before the next block goes out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import cut, map_texts, named, raw_texts, shards

#: Words of a window, and bytes of test texts that go to the workers at once.
WINDOW = 10
BLOCK_BYTES = 16 << 20

_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_FOUND = pa.list_(
    pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())])
)


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_WORDS).split()


class TestSet:
    """The words of a block of test items as numbers, and the places that are searched for: the suffixes of
    at least ``window`` words, and items that are shorter as a whole."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        ids, spots = [], []
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            length = min(window, len(own))
            spots += [(len(self.names), i, len(ids) + i, length) for i in range(len(own) - length + 1 if own else 0)]
            ids += [*own, 0]
            self.names.append(name)
        self.ids = np.array(ids, np.int64)
        self.item, self.place, self.at, self.length = np.array(spots, np.int64).reshape(-1, 4).T

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Searched places and where in a shard's word numbers (0: not a word of the test set) they stand."""
        if not len(self.at) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _Prefixes(ids, self.ids, len(self.vocabulary))
        array = np.argsort(keys.of(self.window)[: len(ids)], kind="stable")
        which, places = [], []
        for length in np.unique(self.length).tolist():
            key = keys.of(length)
            mine = np.flatnonzero(self.length == length)
            wanted, ordered = key[len(ids) :][self.at[mine]], key[: len(ids)][array]
            a, b = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
            n = b - a
            which.append(np.repeat(mine, n))
            places.append(array[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(which), np.concatenate(places)

    def matches(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[str, int, int, int]]]]:
        """For each text its number of words and its longest matches: (item, first word in the
        text, first word in the item, words), windows that follow each other joined."""
        get = self.vocabulary.get
        counts, ids = [], []
        for t in texts:
            w = words(t)
            counts.append(len(w))
            ids.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
            ids.append(np.zeros(1, np.int64))
        which, at = self.search(np.concatenate(ids) if ids else np.zeros(0, np.int64))
        found: list[list[tuple[str, int, int, int]]] = [[] for _ in texts]
        if len(at):
            starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
            doc = np.searchsorted(starts, at, "right") - 1
            item, place, length, at = self.item[which], self.place[which], self.length[which], at - starts[doc]
            order = np.lexsort((at, at - place, item, doc))
            doc, item, place, at, length = (x[order] for x in (doc, item, place, at, length))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(at) != 1) | (np.diff(place) != 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at)) - 1
            total = at[tail] + length[tail] - at[head]
            for d, i, s, p, k in zip(*(x.tolist() for x in (doc[head], item[head], at[head], place[head], total)), strict=True):
                found[d].append((self.names[i], s, p, k))
        return counts, found


class _Prefixes:
    """Numbers by which the suffixes of a shard and of the test items (one behind the other) are ordered by
    their first words, and that are equal only where these are.  Words that no test has are all 0, as is what
    ends a text or an item; no searched place reaches one."""

    def __init__(self, ids: np.ndarray, tests: np.ndarray, words: int):
        """``words``: the largest number of a word.  As many words as fit are put side by side in one number."""
        both = np.concatenate([ids, tests]).astype(np.int64)
        bits = max(1, int(words).bit_length())
        self.ranks = {1: both}
        size = 1
        while 2 * size * bits <= 62:
            moved = np.zeros_like(both)
            moved[:-size] = both[size:]
            both = both << size * bits | moved
            size *= 2
            self.ranks[size] = both
        self.dense: dict[int, np.ndarray] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray, ahead: int) -> np.ndarray:
        """Numbers of the pairs (a here, b some words ahead); past the end 0."""
        moved = np.zeros(len(b), np.int64)
        moved[: len(b) - ahead] = b[ahead:]
        return a * (int(moved.max(initial=0)) + 1) + moved

    def _rank(self, size: int) -> np.ndarray:
        """Ranks by the first words, their number a power of two."""
        if size not in self.ranks:
            half = self._dense(size // 2)
            self.ranks[size] = self._pair(half, half, size // 2)
        return self.ranks[size]

    def _dense(self, size: int) -> np.ndarray:
        """The same without gaps, so that two fit into one number."""
        if size not in self.dense:
            key = self._rank(size)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
            self.dense[size] = rank
        return self.dense[size]

    def of(self, length: int) -> np.ndarray:
        size = 1 << length.bit_length() - 1
        return self._rank(size) if size == length else self._pair(self._dense(size), self._dense(size), length - size)


def _covered(spans: Iterable[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where ``window`` consecutive words of a test item stand in a document.

    An item with fewer words, but not none, is one window.  Gives one row per input row, also for
    repeated ids: doc_id, n_words, n_hit (words inside any match), item_ids (distinct, sorted as
    strings) and matches (item_id, doc_start, item_start, n_words: the longest runs, in words from
    0).  Null and empty texts have no words and no hit; a null item id is the empty string; an empty
    test set hits nothing, an empty table of documents gives no rows.  Texts are read whole: memory holds the
    suffix array of a shard, or of one text that is longer.  Columns may have any names.  The test set is
    read in blocks of about ``block_bytes``, one after the other, so that what goes to the workers is
    bounded whatever its size.
    """
    found = _scan(docs, benchmark, [named(docs, id_col).alias("doc_id")], text_col, item_col, item_text_col, window, block_bytes)
    return found.select("_kept.doc_id", "n_words", "n_hit", "item_ids", F.col("_found").alias("matches"))


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents in which no window of a test item stands, with all their columns."""
    found = _scan(docs, benchmark, [named(docs, c) for c in docs.columns], text_col, item_col, item_text_col, window, block_bytes)
    return found.filter("n_hit = 0").select("_kept.*")


def _scan(docs, benchmark, kept, text_col, item_col, item_text_col, window, block_bytes) -> DataFrame:
    spark = docs.sparkSession
    tests = benchmark.select(
        F.coalesce(named(benchmark, item_col).cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(named(benchmark, item_text_col), F.lit("")).cast("binary").alias("text"),
    )
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    match = StructType([StructField("item_id", StringType()), *(StructField(c, LongType()) for c in ("doc_start", "item_start", "n_words"))])
    found = StructField("_found", ArrayType(match))
    state = docs.select(
        F.struct(*kept).alias("_kept"), named(docs, text_col).alias("_text"), F.lit(None).cast(found.dataType).alias("_found")
    )
    carried = state.schema["_kept"]
    for k in range(blocks):
        mine = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in mine.collect()])
        last = k == blocks - 1
        counts = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("item_ids", ArrayType(StringType()))]
        more = counts if last else [StructField("_text", StringType())]
        columns = {c: c for c in ("_text", "_kept", "_found")}
        state = map_texts(state, _pass(sent, window, last), StructType([carried, *more, found]), **columns)
        if not last:
            state = cut(state)
            sent.destroy()
    return state


def _pass(sent, window: int, last: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = None
        for batch in batches:
            tests = tests or _prepared(sent.value, window)
            texts = raw_texts(batch, "_text")
            for a, b in shards(map(len, texts)):
                part = batch.slice(a, b - a)
                counts, found = tests.matches(texts[a:b])
                if part.column("_found").null_count < len(part):
                    earlier = part.column("_found").to_pylist()
                    found = [[tuple(x.values()) for x in e or ()] + f for e, f in zip(earlier, found, strict=True)]
                out = {"_kept": part.column("_kept")}
                if last:
                    hit = [_covered((s, s + k) for _, s, _, k in f) if f else 0 for f in found]
                    out["n_words"], out["n_hit"] = pa.array(counts, pa.int64()), pa.array(hit, pa.int64())
                    out["item_ids"] = pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string()))
                else:
                    out["_text"] = part.column("_text")
                keys = ("item_id", "doc_start", "item_start", "n_words")
                out["_found"] = pa.array([[dict(zip(keys, x, strict=True)) for x in f] for f in found], _FOUND)
                yield pa.RecordBatch.from_pydict(out)

    return run


_ready: list[tuple[list, int, TestSet]] = []


def _prepared(items: list, window: int) -> TestSet:
    """The test set of a broadcast, built once a worker; only the last two are kept."""
    for value, w, tests in _ready:
        if value is items and w == window:
            return tests
    del _ready[:-1]
    _ready.append((items, window, TestSet(items, window)))
    return _ready[-1][2]
