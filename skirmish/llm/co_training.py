"""Quality classifier by co-training on two views of a document.

One view sees the text: which words it holds, and the shape and repetition of its words, lines and
symbols, each measure cut into levels.  The other sees the page's metadata: source, language and
declared length.  A view knows for every word, level and value how many good and bad documents have it,
so it is fitted by counting: round by round each view labels all unlabelled documents of which it is sure,
and their counts are added to the other view's.  Nothing of a document is gathered but these counts, whose
number is fixed.  All pseudo-labels of a round together weigh at most as much as the labelled rows.

The log odds of a document's words (their mean), of each of its levels and of its values are the inputs of a
logistic calibration, fitted on labelled rows that the counts leave out; the two calibrated views are
combined by a logistic stack, and all documents are scored.

The fit sees at most ``MOST_LABELLED`` labelled documents, those with the smallest digests of their ids;
pseudo-labels are sought, and scores computed, over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import cut, map_texts, named, raw_texts, remainder_of

MOST_LABELLED = 20_000
ROUNDS = 3
#: Probability from which a view is sure.
SURE = 0.95
WORDS, LEVELS, SHAPES = 1 << 15, 16, 13
SOURCES, LANGUAGES, SIZES = 1024, 256, 32
#: Rows of the table of counts: words, levels of shapes, then the metadata's values.
TEXT_SLOTS = WORDS + SHAPES * LEVELS
META_SLOTS = SOURCES + LANGUAGES + SIZES
_SYMBOLS = b"#*$%&|<>"
_HELD_WORDS = 500_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxh32_intdigest(word) % WORDS
        if len(self) >= _HELD_WORDS:
            self.clear()
        self[word] = value
        return value


_buckets = _Buckets()


def shapes(text: bytes, words: list[bytes]) -> np.ndarray:
    """Levels of the measures of a text's shape."""
    n, size = len(words), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    symbols, digits = (size - len(text.translate(None, x)) for x in (_SYMBOLS, b"0123456789"))
    shares = np.array([
        symbols / size, sum(w[-1] in b"#*$%&|<>!" for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, digits / size,
        words.count(b"|") / n, 1 - len(counts) / n, max(counts.values()) / n, max(pairs.values(), default=0) / n,
        1 - len(set(lines)) / len(lines), min(1.0, text.count(b"!") / n), min(1.0, text.count(b".") / n),
    ])
    measures = np.append(np.sqrt(shares), [np.log1p(n) / 14, sum(map(len, words)) / n / 16])
    return np.clip(measures * LEVELS, 0, LEVELS - 1).astype(np.uint8)


def steps(buckets: np.ndarray) -> bytes:
    """Sorted distinct numbers as their steps, a byte each: 255 goes on, less ends a number."""
    d = np.diff(buckets, prepend=0)
    full = d // 255
    out = np.full(len(d) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = d % 255
    return out.tobytes()


def unsteps(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several ``steps``, and how many each has."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    total = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    ends = raw != 255
    size = np.array([len(p) for p in parts], np.int64)
    last = np.cumsum(size)
    which = np.repeat(np.arange(len(parts)), size)
    value = total[1:] - np.repeat(total[last - size], size)
    return value[ends], np.bincount(which[ends], minlength=len(parts))


def text_features(text: bytes) -> tuple[bytes, bytes]:
    """The buckets of the text's words as ``steps``, and the levels of its shapes (none without a word)."""
    words = text.split()
    if not words:
        return b"", b""
    own = np.unique(np.fromiter(map(_buckets.__getitem__, set(text.lower().split())), np.int64))
    return steps(own), shapes(text, words).tobytes()


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Slots of the source, the language and the declared length; null is a value of its own."""
    bucket = lambda x, n: 0 if x is None else 1 + xxh32_intdigest(x) % (n - 1)
    size = 0 if n_chars is None else min(SIZES - 1, 1 + max(0, n_chars).bit_length())
    return [bucket(source, SOURCES), SOURCES + bucket(lang, LANGUAGES), SOURCES + LANGUAGES + size]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Ridge logistic regression by Newton steps on standardized columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, spread = x.mean(0), x.std(0)
        self.spread = np.where(spread > 1e-9, spread, 1)
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(25):
            p = _sigmoid(z @ w)
            gradient = z.T @ (p - y) + penalty * w
            curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread @ self.w[:-1] + self.w[-1], -12, 12)


class Rows:
    """The features of a batch, decoded."""

    def __init__(self, b: pa.RecordBatch | pa.Table):
        column = lambda c: b.column(c).to_pylist()
        self.words, self.n_words = unsteps(column("words"))
        levels = column("levels")
        self.has = np.array([len(x) > 0 for x in levels], bool)
        self.levels = np.zeros((len(levels), SHAPES), np.int64)
        self.levels[self.has] = np.frombuffer(b"".join(levels), np.uint8).reshape(-1, SHAPES)
        self.levels += WORDS + np.arange(SHAPES) * LEVELS
        self.meta = np.array(column("meta"), np.int64).reshape(-1, 3)

    def counts(self, view: int, weight: np.ndarray) -> np.ndarray:
        """How much weight of the rows falls on each slot of a view."""
        if view:
            return np.bincount(self.meta.ravel(), np.repeat(weight, 3), META_SLOTS)
        out = np.bincount(self.words, np.repeat(weight, self.n_words), TEXT_SLOTS)
        return out + np.bincount(self.levels[self.has].ravel(), np.repeat(weight[self.has], SHAPES), TEXT_SLOTS)


class Counts:
    """What a view has counted: documents of both classes, and those on each slot."""

    def __init__(self, total: np.ndarray, slots: np.ndarray):
        self.odds = np.log((slots[1] + 1) / (total[1] + 2)) - np.log((slots[0] + 1) / (total[0] + 2))

    def inputs(self, rows: Rows, view: int) -> np.ndarray:
        """The calibration's inputs: log odds of what a document has."""
        if view:
            return self.odds[rows.meta]
        own = np.bincount(np.repeat(np.arange(len(rows.n_words)), rows.n_words), self.odds[rows.words], len(rows.n_words))
        levels = self.odds[rows.levels] * rows.has[:, None]
        return np.c_[own / np.maximum(rows.n_words, 1), levels]


class View:
    def __init__(self, counts: Counts, calibration: Logistic, number: int):
        self.counts, self.calibration, self.number = counts, calibration, number

    def logits(self, rows: Rows) -> np.ndarray:
        return self.calibration.logits(self.counts.inputs(rows, self.number))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        meta = [meta_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
        text = [text_features(t) for t in raw_texts(b)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("doc_id"), "words": pa.array([t[0] for t in text], pa.binary()), "levels": pa.array([t[1] for t in text], pa.binary()),
            "meta": pa.array(meta, pa.list_(pa.int32())),
        })


def _counted(rows: DataFrame, weigh) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over all rows: documents by view and class, and by view, class and slot.  ``weigh`` gives for a
    batch and its rows, by view, the weights of both classes.  Tasks sum their own rows first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, TEXT_SLOTS + 1)), np.zeros((2, META_SLOTS + 1))]
        for b in batches:
            own = Rows(b)
            for view, both in enumerate(weigh(b, own)):
                for y, weight in enumerate(both):
                    held[view][y, 0] += weight.sum()
                    held[view][y, 1:] += own.counts(view, weight)
        for view, table in enumerate(held):
            y, slot = np.nonzero(table)
            columns = [np.full(len(y), view), y, slot, table[y, slot]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["view", "y", "slot", "n"])

    sums = rows.mapInArrow(run, "view bigint, y bigint, slot bigint, n double").groupBy("view", "y", "slot").agg(F.sum("n").alias("n")).toArrow()
    view, y, slot, n = (sums.column(c).to_numpy() for c in ("view", "y", "slot", "n"))
    total, tables = np.zeros((2, 2)), [np.zeros((2, TEXT_SLOTS)), np.zeros((2, META_SLOTS))]
    for v in (0, 1):
        own = view == v
        first = own & (slot == 0)
        total[v, y[first]] = n[first]
        rest = own & (slot > 0)
        tables[v][y[rest], slot[rest] - 1] = n[rest]
    return total, tables


def _trained(rows: DataFrame, rounds: int) -> tuple[list[View], Logistic] | None:
    """Both views and the stack, or None without labels of both classes."""
    known = rows.filter("y is not null")
    fitted = _counted(known.filter("not calibrates"), _by_label)
    total, tables = fitted
    if (total[0] == 0).any():
        return None
    held = known.filter("calibrates").select("y", "words", "levels", "meta").toArrow()
    y = held.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():  # a class of one row: it must serve for both
        held = known.select("y", "words", "levels", "meta").toArrow()
        y = held.column("y").to_numpy().astype(float)
    told = Rows(held)
    views = None
    for turn in range(rounds + 1):
        counts = [Counts(total[v], tables[v]) for v in (0, 1)]
        views = [View(c, Logistic(c.inputs(told, v), y), v) for v, c in enumerate(counts)]
        if turn == rounds:
            break
        sent = rows.sparkSession.sparkContext.broadcast(views)
        found, slots = _counted(rows.filter("not labelled"), _by_views(sent))
        sent.destroy()
        total, tables = fitted[0].copy(), [t.copy() for t in fitted[1]]
        for v in (0, 1):
            share = min(1.0, fitted[0][v].sum() / max(found[v].sum(), 1e-9))
            total[v] += share * found[v]
            tables[v] += share * slots[v]
    logits = np.stack([v.logits(told) for v in views], 1)
    return views, Logistic(logits, y)


def _by_label(b: pa.RecordBatch, rows: Rows) -> list[list[np.ndarray]]:
    y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
    return [[1 - y, y]] * 2


def _by_views(sent):
    """A view counts the rows of which the other one is sure."""

    def weigh(b: pa.RecordBatch, rows: Rows) -> list[list[np.ndarray]]:
        p = [_sigmoid(v.logits(rows)) for v in sent.value]
        return [[(p[1 - v] <= 1 - SURE).astype(float), (p[1 - v] >= SURE).astype(float)] for v in (0, 1)]

    return weigh


def co_trained_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", size_col: str = "n_chars", label_id_col: str = "doc_id", label_col: str = "quality",
    most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, text_score, meta_score, score (0 to 1) and kept.

    Labels of ids whose crc32 modulo 5 is 2 are held out: never fitted on, nor pseudo-labelled.  An id with
    several labels counts as good if most are; null labels count as none.  Null and empty texts have no words
    and no shape, null metadata are a value of their own.  Of the labelled ids that are fitted every fourth
    of each class calibrates and is not counted; only where a class has one id serves it for both.  Without
    labels of both classes all scores are the smoothed share of good ones (one half without any).  Rows that
    repeat an id share its label; equal rows are scored alike.  Texts are read whole, of any length; an empty
    table gives no rows; other columns are not looked at.  kept: score of at least one half.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_texts(
        docs, _features, f"doc_id {kind}, words binary, levels binary, meta array<int>", doc_id=id_col, text=text_col,
        source=named(docs, source_col).cast("string"), lang=named(docs, lang_col).cast("string"), n_chars=named(docs, size_col).cast("bigint"),
    )
    marks = labels.select(named(labels, label_id_col).alias("doc_id"), named(labels, label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    marks = cut(marks.groupBy("doc_id").agg((F.avg("y") > 0.5).cast("int").alias("y")))
    here = docs.select(named(docs, id_col).alias("doc_id")).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marks.filter(remainder_of("doc_id", 5) != 2).join(here, "doc_id", "left_semi").orderBy(*order).limit(most_labelled)
    fourth = F.row_number().over(Window.partitionBy("y").orderBy(*order)) % 4 == 2  # the second, sixth, ... of a class
    sample = cut(sample.select("doc_id", "y", fourth.alias("calibrates")))
    listed = marks.select("doc_id", F.lit(True).alias("labelled")).join(F.broadcast(sample), "doc_id", "left")  # at most most_labelled rows
    rows = cut(rows.join(listed, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False))))
    model = _trained(rows, rounds)
    good, n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    prior = (good + 1) / (n + 2)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if sent.value is None:
                found = [np.full(len(b), prior)] * 3
            else:
                views, stack = sent.value
                own = Rows(b)
                logits = [v.logits(own) for v in views]
                found = [*map(_sigmoid, logits), _sigmoid(stack.logits(np.stack(logits, 1)))]
            columns = [b.column("doc_id"), *(pa.array(s, pa.float64()) for s in found), pa.array(found[2] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_score", "meta_score", "score", "kept"])

    out = rows.select("doc_id", "words", "levels", "meta").mapInArrow(score, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")
    return out.withColumn("held_out", remainder_of("doc_id", 5) == 2)
