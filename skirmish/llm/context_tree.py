"""Language-model scores by context-tree weighting over bytes, beside a word-frequency score.

Every byte is eight binary decisions; each decision has its own node in every context, a context
being the bytes before (the nearest 0, 1, ... up to ``depth`` of them).  A node's Krichevsky-Trofimov
estimate is weighted against the product of its children's weighted probabilities, down to the
deepest contexts, so that all depths are mixed by the evidence of the training texts.  A text's score
is its code length under the mixture, with the counts as training left them.

Every context of the training texts counts, however rare.  The texts are dealt into shards of about
``SHARD`` bytes; a shard gives its distinct grams (a context and the byte after it) with their counts,
dealt by the context's nearest three bytes.  Each of these buckets holds whole subtrees, which are weighted
bottom-up there; only the sums by the nearest two bytes (at most 65,536 contexts whatever the corpus)
meet on the driver, which sends their mixtures back to the buckets.  Each bucket then answers its grams
to the shards that asked, where they are added up by text.  The words that make up at least
``HEAD_SHARE`` of the training tokens are broadcast; the counts of all other words reach their documents
by a shuffle, so the word score is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import BATCH_ROWS, cut, map_texts, raw_texts, shards

DEPTH = 5
HEAD_SHARE = 2e-6
#: Stands before and after each text; no byte of UTF-8.
END = 0xFF
_END_KEY = xxh3_64_intdigest(b"") - (1 << 63)  # no word is empty
_HELD_WORDS = 400_000
#: Text bytes of a shard, buckets a shard, and how many of the nearest bytes choose a bucket.
SHARD, BUCKETS, NEAREST = 16 << 20, 4, 3
#: Counts below this have their gamma functions in a table.
_SMALL = 1 << 16
#: Sums of logarithms are exact in this fraction, so that they do not depend on the order of tasks.
_FINE = float(1 << 20)


def _key(word: bytes) -> int:
    return xxh3_64_intdigest(word) - (1 << 63)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and of their ends, with the ``depth`` bytes before it, the byte itself
    lowest; and where each text's own begin.  A-Z count as lower case."""
    pad = bytes([END]) * max(depth, 1)
    data = np.frombuffer(pad.join([b"", *(t.lower() for t in texts), b""]), np.uint8)
    n = len(data) - depth
    code = np.zeros(max(n, 0), np.uint64)
    for k in range(depth + 1):
        code = code << np.uint64(8) | data[k : k + n].astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes + len(pad) - 1) - (sizes + len(pad) - 1) + len(pad) - depth
    take = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return code[take], np.concatenate([[0], np.cumsum(sizes)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5."""
    shift = np.zeros_like(x)
    small = x < 8
    y = x.copy()
    for _ in range(8):
        shift = np.where(small, shift - np.log(np.where(small, y, 1)), shift)
        y = np.where(small, y + 1, y)
        small = small & (y < 8)
    z = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts by byte, those of a 0 and of a 1 at each of the 255 nodes of the byte's decisions,
    in the order of a heap: node 1 is the first bit, nodes 2k and 2k + 1 follow node k."""
    n = len(counts)
    zero, one = np.zeros((n, 256)), np.zeros((n, 256))
    level = counts
    for bit in reversed(range(8)):
        pair = level.reshape(n, 1 << bit, 2)
        zero[:, 1 << bit : 2 << bit], one[:, 1 << bit : 2 << bit] = pair[:, :, 0], pair[:, :, 1]
        level = pair.sum(2)
    return zero, one


def _evidence(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of the counts."""
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1.0) - np.log(np.pi)


class ContextTree:
    """A tree in memory, of given contexts only; the distributed one holds the same with all contexts.

    ``codes[d]``: the contexts of d bytes, sorted; ``first[d]``: their first row in ``table``,
    which holds log10 of each byte's probability where that is the deepest known context."""

    def __init__(self, depth: int, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``counts[d]``: context, byte and count, for all kept contexts of d bytes."""
        self.codes, dense = [], []
        for context, byte, n in counts[: depth + 1]:
            codes, row = np.unique(context, return_inverse=True)
            c = np.zeros((len(codes), 256))
            np.add.at(c, (row, byte), n)
            self.codes.append(codes)
            dense.append(c)
        if not len(self.codes[0]):  # nothing was learnt
            self.codes[0], dense[0] = np.zeros(1, np.uint64), np.zeros((1, 256))
        parents = [None] + [
            np.searchsorted(self.codes[d - 1], self.codes[d] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)
        ]
        weight, own, rest = [], [], []
        below = None  # log of weighted probability, by context of the depth below
        for d in reversed(range(depth + 1)):
            zero, one = _bits(dense[d])
            alone = _evidence(zero, one)
            own.append((one + 0.5) / (zero + one + 1))
            if d == depth:
                weight.append(np.ones_like(alone))
                rest.append(own[-1])
                below = alone
                continue
            pooled = dense[d].copy()
            inside = np.zeros_like(alone)
            np.subtract.at(pooled, parents[d + 1], dense[d + 1])
            np.add.at(inside, parents[d + 1], below)
            zero, one = _bits(np.maximum(pooled, 0))
            rest.append((one + 0.5) / (zero + one + 1))
            split = inside + _evidence(zero, one)
            below = np.logaddexp(alone, split) - np.log(2)
            weight.append(np.exp(alone - np.log(2) - below))
        weight, own, rest = weight[::-1], own[::-1], rest[::-1]
        tables = []
        for d in range(depth + 1):
            q = weight[d] * own[d] + (1 - weight[d]) * rest[d]
            row = np.arange(len(q))
            for up in reversed(range(d)):
                row = parents[up + 1][row]
                q = weight[up][row] * own[up][row] + (1 - weight[up][row]) * q
            tables.append(_by_byte(q))
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
        self.table = np.concatenate(tables).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        if not texts:
            return np.zeros(0)
        code, first = grams(texts, len(self.codes) - 1)
        own, back = np.unique(code, return_inverse=True)
        context, byte = own >> np.uint64(8), (own & np.uint64(255)).astype(np.int64)
        row = np.zeros(len(own), np.int64)
        for d in range(1, len(self.codes)):
            if len(self.codes[d]):
                c = context & np.uint64((1 << 8 * d) - 1)
                k = np.minimum(np.searchsorted(self.codes[d], c), len(self.codes[d]) - 1)
                row = np.where(self.codes[d][k] == c, self.first[d] + k, row)
        value = self.table[row, byte].astype(np.float64)
        return np.add.reduceat(value[back], first[:-1])


def _by_byte(q: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probability of a 1 at each node."""
    one, zero = np.log10(q), np.log10(1 - q)
    out = np.zeros((len(q), 1))
    for bit in range(8):
        nodes = slice(1 << bit, 2 << bit)
        out = np.stack([out + zero[:, nodes], out + one[:, nodes]], 2).reshape(len(q), 2 << bit)
    return out


def _lgamma_from(shift: float, table: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of the gamma function of n + shift, for whole n."""
    out = table[np.minimum(n, _SMALL - 1)]
    big = n >= _SMALL
    if big.any():
        out[big] = _lgamma(n[big] + shift)
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(_SMALL)
    return _lgamma(n + 0.5), _lgamma(n + 1.0)


def _evidence_of(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """``_evidence`` for whole counts; exactly 0 without any."""
    half, whole = _tables()
    out = _lgamma_from(0.5, half, zero) + _lgamma_from(0.5, half, one) - _lgamma_from(1.0, whole, zero + one) - np.log(np.pi)
    return np.where(zero + one > 0, out, 0.0)


def _joint(alone: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and the weight of the node's own estimate."""
    below = np.logaddexp(alone, inside) - np.log(2)
    return below, np.exp(alone - np.log(2) - below)


def _mask(d: int) -> np.uint64:
    """Of a gram (context, then byte) or a node's key (context, then node): the last byte and the ``d`` before."""
    return np.uint64((1 << 8 * (d + 1)) - 1)


class _Subtrees:
    """All nodes of the grams' contexts of ``low`` to ``depth`` bytes; grams without a count only ask."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, low: int):
        """``keys``: sorted and distinct."""
        self.depth, self.low, self.keys = depth, low, keys
        grams_of, counts, self.back = {depth: keys}, {depth: n}, {}
        for d in reversed(range(low, depth)):
            grams_of[d], self.back[d] = np.unique(grams_of[d + 1] & _mask(d), return_inverse=True)
            counts[d] = np.bincount(self.back[d], counts[d + 1], len(grams_of[d])).astype(np.int64)
        self.levels = [self._level(bit, grams_of, counts) for bit in range(8)]

    def _level(self, bit: int, grams_of: dict, counts: dict) -> dict:
        found = {}
        for d, g in grams_of.items():
            node = (g >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << bit) | (g & np.uint64(255)) >> np.uint64(8 - bit)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            of_gram = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))
            ones = (g >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
            one = np.add.reduceat(counts[d] * ones, start)
            zero = np.add.reduceat(counts[d], start) - one
            found[d] = {"node": node[start], "start": start, "of_gram": of_gram, "ones": ones, "zero": zero, "one": one}
        inside = None
        for d in reversed(range(self.low, self.depth + 1)):
            x = found[d]
            alone = _evidence_of(x["zero"], x["one"])
            if d == self.depth:
                x["below"], x["weight"] = alone, np.ones(len(alone))
            else:
                x["below"], x["weight"] = _joint(alone, inside)
            if d > self.low:
                x["parent"] = found[d - 1]["of_gram"][self.back[d - 1][x["start"]]]
                inside = np.bincount(x["parent"], x["below"], len(found[d - 1]["node"]))
        return found

    def top(self) -> list[tuple[np.ndarray, ...]]:
        """Of each bit, the nodes of the shallowest contexts: key, counts of 0 and 1, log probability."""
        return [(x[self.low]["node"], x[self.low]["zero"], x[self.low]["one"], x[self.low]["below"]) for x in self.levels]

    def answers(self, mixture) -> np.ndarray:
        """log10 probability of each gram's byte in its context, under the mixture of all depths."""
        out = np.zeros(len(self.keys))
        for found in self.levels:
            for d in range(self.low, self.depth + 1):
                x = found[d]
                q, left = mixture(x["node"]) if d == self.low else (q[x["parent"]], left[x["parent"]])  # noqa: F821
                own = (x["one"] + 0.5) / (x["zero"] + x["one"] + 1.0)
                q, left = q + left * x["weight"] * own, left * (1 - x["weight"])
            x = found[self.depth]
            p = q[x["of_gram"]]
            out += np.log10(np.where(x["ones"] == 1, p, 1 - p))
        return out


class _Crown:
    """The mixture down to contexts of ``depth`` bytes, from the sums over the subtrees below them."""

    def __init__(self, depth: int, node: np.ndarray, zero: np.ndarray, one: np.ndarray, inside: np.ndarray):
        self.depth = depth
        if depth < 0:
            return
        found, back = {}, {}
        for d in reversed(range(depth + 1)):
            keys, row = np.unique(node & _mask(d), return_inverse=True)
            back[d] = row
            zero, one, inside = (np.bincount(row, v, len(keys)) for v in (zero, one, inside))
            below, weight = _joint(_evidence_of(zero.astype(np.int64), one.astype(np.int64)), inside)
            found[d] = (keys, weight, (one + 0.5) / (zero + one + 1.0))
            node, inside = keys, below
        q, left = np.zeros(len(found[0][0])), np.ones(len(found[0][0]))
        for d in range(depth + 1):
            keys, weight, own = found[d]
            if d:
                q, left = q[back[d - 1]], left[back[d - 1]]
            q, left = q + left * weight * own, left * (1 - weight)
        self.nodes, self.q, self.left = found[depth][0], q, left

    def __call__(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes in contexts one byte longer: the mixture so far, and the part that is left for them."""
        if self.depth < 0:
            return np.zeros(len(nodes)), np.ones(len(nodes))
        k = np.searchsorted(self.nodes, nodes & _mask(self.depth))
        return self.q[k], self.left[k]


def _sums(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the texts, sorted, and how often each stands there."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for x, y in shards(map(len, texts)):
        own, n = np.unique(grams(texts[x:y], depth)[0], return_counts=True)
        keys, back = np.unique(np.concatenate([held[0], own]), return_inverse=True)
        held = [keys, np.bincount(back, np.concatenate([held[1], n]), len(keys)).astype(np.int64)]
    return held[0], held[1]


def _packed(grams_of: np.ndarray) -> bytes:
    """Sorted grams as compressed steps, behind their number."""
    raw = np.diff(grams_of, prepend=np.uint64(0)).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.uint64), dtype=np.uint64)


def _asked(depth: int, low: int, buckets: int):
    """From a shard's texts, its distinct grams by bucket, with their counts in training texts."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        held_out = t.column("held_out").to_pylist()
        texts = raw_texts(t)
        taught, n = _sums([x for x, h in zip(texts, held_out, strict=True) if not h], depth)
        others, _ = _sums([x for x, h in zip(texts, held_out, strict=True) if h], depth)
        others = np.setdiff1d(others, taught, assume_unique=True)
        keys, n = np.concatenate([taught, others]), np.concatenate([n, np.zeros(len(others), np.int64)])
        near = (keys >> np.uint64(8)) & np.uint64((1 << 8 * low) - 1)
        bucket = ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        which, start = np.unique(bucket, return_index=True)
        ends = np.append(start[1:], len(keys))
        return pa.table({
            "bucket": pa.array(which.astype(np.int64)), "shard": pa.array(np.full(len(which), key[0].as_py(), np.int64)),
            "grams": pa.array([_packed(keys[a:b]) for a, b in zip(start, ends, strict=True)], pa.binary()),
            "n": pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
        })

    return run


def _subtrees(t: pa.Table, depth: int, low: int) -> tuple[_Subtrees, np.ndarray, np.ndarray]:
    """A bucket's subtrees, and its rows' grams as rows of the subtrees, with where each row's begin."""
    parts = [_unpacked(x) for x in t.column("grams").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("n").to_pylist()])
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(back, n, len(keys)).astype(np.int64)
    return _Subtrees(keys, total, depth, low), back, np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _rising(depth: int, low: int):
    def run(t: pa.Table) -> pa.Table:
        top = _subtrees(t, depth, low)[0].top()
        node, zero, one, below = (np.concatenate(x) for x in zip(*top, strict=True))
        keys, row = np.unique(node & _mask(low - 1), return_inverse=True)
        exact = np.round(np.bincount(row, below, len(keys)) * _FINE).astype(np.int64)
        zero, one = (np.bincount(row, v, len(keys)).astype(np.int64) for v in (zero, one))
        return pa.table({"node": keys.astype(np.int64), "zero": zero, "one": one, "inside": exact})

    return run


def _falling(depth: int, low: int, sent):
    def run(t: pa.Table) -> pa.Table:
        tree, back, first = _subtrees(t, depth, low)
        value = tree.answers(sent.value).astype(np.float32)[back]
        found = [value[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.table({"shard": t.column("shard"), "grams": t.column("grams"), "value": pa.array(found, pa.binary())})

    return run


def _words_counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[bytes] = Counter()

    def all_words() -> pa.RecordBatch:
        keys, n = np.fromiter(map(_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    ends = 0
    for b in batches:
        for t in raw_texts(b):
            words.update(t.lower().split())
            ends += 1
        if len(words) > _HELD_WORDS:
            yield all_words()
    yield all_words()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([_END_KEY]), pa.array([ends])], ["key", "n"])


def _scored(sent, depth: int):
    common: dict[int, float] = {}
    known: dict[bytes, float] = {}

    def scores(texts: list[bytes], grams_of: np.ndarray, value: np.ndarray) -> np.ndarray:
        code, first = grams(texts, depth)
        own, back = np.unique(code, return_inverse=True)
        return np.add.reduceat(value[np.searchsorted(grams_of, own)].astype(np.float64)[back], first[:-1])

    def run(texts_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not common:
            keys, n = sent.value
            common.update(zip(keys.tolist(), np.log10(n + 1.0).tolist(), strict=True))
        grams_of = np.concatenate([_unpacked(x) for x in answers.column("grams").to_pylist()])
        value = np.concatenate([np.frombuffer(x, np.float32) for x in answers.column("value").to_pylist()])
        order = np.argsort(grams_of)
        grams_of, value = grams_of[order], value[order]
        out = []
        for b in texts_table.to_batches(max_chunksize=BATCH_ROWS):
            texts = raw_texts(b)
            tokens, head, head_known, tail, score = [], [], [], [], []
            for x, y in shards(map(len, texts)):
                score += scores(texts[x:y], grams_of, value).tolist()
                for t in texts[x:y]:
                    words = t.lower().split()
                    words.append(b"")  # the end
                    total, rare = 0.0, []
                    for w in words:
                        v = known.get(w)
                        if v is None:
                            v = common.get(_key(w), -1.0)
                            if len(known) >= _HELD_WORDS:
                                known.clear()
                            known[w] = v
                        if v < 0:
                            rare.append(_key(w))
                        else:
                            total += v
                    tokens.append(len(words))
                    head.append(total)
                    head_known.append(len(words) - len(rare))
                    tail.append(rare)
            out.append(pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "row": b.column("row"), "held_out": b.column("held_out"),
                "n_tokens": pa.array(tokens, pa.int64()), "head": pa.array(head, pa.float64()),
                "head_known": pa.array(head_known, pa.int64()), "score": pa.array(score, pa.float64()),
                "tail": pa.array(tail, pa.list_(pa.int64())),
            }))
        return pa.Table.from_batches(out)

    return run


def language_scores(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, shard_bytes: int = SHARD
) -> DataFrame:
    """Scores of all texts under models of those that are not ``held_out``.

    Words are runs without ASCII white space, A-Z in lower case; a text is its words and one end.
    Gives one row per input row: doc_id, held_out, n_tokens, n_known (tokens that the training texts
    have), train_tokens, base_score (log10, add-one word frequencies) and score (log10 probability of
    the text's bytes and end by context-tree weighting: -score * log2(10) is the code length, which the
    number of bytes and one end divide).  Null counts as empty: one token, the end.  Repeated rows are
    scored alike.
    Without training texts every count is 0 and every bit has probability 1/2.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    low = min(NEAREST, depth)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    bytes_held = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    n_shards = max(1, -(-bytes_held // shard_bytes))
    row = F.xxhash64(docs[id_col], docs[text_col])
    texts = docs.select(docs[id_col].alias("doc_id"), row.alias("row"), held_out.alias("held_out"), text.alias("text"))
    shard = F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_shards)).cast("bigint")
    dealt = texts.withColumn("shard", shard)
    asked = dealt.select("shard", "held_out", "text").groupBy("shard").applyInArrow(
        _asked(depth, low, BUCKETS * n_shards), "bucket bigint, shard bigint, grams binary, n binary"
    )
    asked = cut(asked.repartition("bucket"))
    crown = _Crown(-1, *[np.zeros(0)] * 4)
    if low:
        sums = asked.groupBy("bucket").applyInArrow(_rising(depth, low), "node bigint, zero bigint, one bigint, inside bigint")
        sums = sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "inside"))).toArrow()
        node, zero, one, inside = (sums.column(c).to_numpy() for c in ("node", "zero", "one", "inside"))
        crown = _Crown(low - 1, node.astype(np.uint64), zero, one, inside / _FINE)
    answers = asked.groupBy("bucket").applyInArrow(
        _falling(depth, low, spark.sparkContext.broadcast(crown)), "shard bigint, grams binary, value binary"
    )
    words = map_texts(docs.filter(~held_out), _words_counted, "key bigint, n bigint", text=text)
    words = cut(words.groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    often = words.filter(F.col("n") >= F.lit(HEAD_SHARE * n)).toArrow()
    sent = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("n").to_numpy()))
    rows = cut(dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _scored(sent, depth),
        f"doc_id {kind}, row bigint, held_out boolean, n_tokens bigint, head double, head_known bigint, score double, tail array<bigint>",
    ))
    # equal rows share a key: each adds one to ``copies``, by which their sums are divided
    tail = rows.select("row", F.explode("tail").alias("key")).join(words, "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail"), F.count("n").alias("tail_known"))
    copies = rows.filter(F.size("tail") > 0).groupBy("row").agg(F.count("*").alias("copies"))
    rows = rows.drop("tail").join(tail.join(copies, "row"), "row", "left")
    part = F.coalesce(F.col("copies"), F.lit(1))
    base = F.col("head") + F.coalesce(F.col("tail") / part, F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))
    return rows.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce((F.col("tail_known") / part).cast("bigint"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
    )
