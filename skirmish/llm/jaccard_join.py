"""Jaccard similarity join on word n-grams by PartEnum signatures, and its connected components.

Sets whose sizes lie in the same band are compared under one bound K on the size of their symmetric
difference.  The feature domain is cut into groups and each group into cells; every subset of
``cells - slack`` cells of every group gives a signature, a digest of the features in it.  K differing
features can spoil only so many of these subsets, so two sets that link share at least ``least_shared``
signatures.  Subsets in which a set has no feature give none, as long as one of the shared ones is left.

Equal sets are one node from the start.  A node whose signatures are found elsewhere less often than a
link needs can't link, so it goes, and with it what only it shared, until nothing more falls away: a
passage that many documents quote leaves next to nothing.  What stays is linked in two steps, so that a
group of copies never becomes all its pairs: first each node against the two ends of its group, and of
the parts of the group that agree in a piece of a parity sketch; then, only where a signature's nodes
still lie in several components, against the nodes of the others, by the rarest signatures that a link
must share one of.  The sketch, whose distance never
exceeds the symmetric difference, rejects inside the joins what cannot link; what remains is checked
exactly on the sets.  Features and nodes are 64-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, drop, map_texts, named, raw_texts, shards

#: Groups beyond those that a link needs to share one signature.
SPARE = 2
#: Of the groups that a link needs, with four cells a group, one in so many is added (``SPARE`` at least).
SPARE_PART = 4
#: Bits of the filter that keeps texts without a shared signature from being shuffled.
FILTER_BITS = 1 << 24
#: Nodes that a task remembers so as not to give the signatures of equal texts again.
REMEMBERED_NODES = 200_000
#: Longs of a parity sketch at most.
SKETCH_LONGS = 64
#: Pieces of the sketch by which parts of a group are found.
SHORT_LONGS = 4
#: Longs at most of the sketch that goes with each signature where components are compared.
SIDE_LONGS = 16
#: Parts into which the edges of a node are dealt, so that the centre of a star is no task of its own.
PARTS = 32
#: Bytes of texts whose words are digested at once.
STEP_BYTES = 1 << 17

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M2
    x = (x ^ x >> np.uint64(29)) * _M1
    return x ^ x >> np.uint64(32)


#: A number for each byte; A-Z count as lower case.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_BYTES[65:91] = _BYTES[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = int(_M1)
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(b)
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes begin, and a 64-bit digest of each: a polynomial in its bytes."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = turn[::2], turn[1::2]
    up, down = _powers(1 << max(16, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)], dtype=np.uint64)])
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def all_shingles(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Of each text the distinct word shingles as sorted 64-bit digests; A-Z count as lower case.  Fewer words
    than ``size`` are one shingle; no words, none."""

    def joined(h: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(h) - size + 1)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mix(out * _M1 + h[k : k + n])
        return out

    for a, b in shards(map(len, texts), STEP_BYTES):
        start, h = _words(b" ".join(texts[a:b]))
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        first = np.searchsorted(start, begins).tolist()
        whole = joined(h, size)
        for x, y in zip(first[:-1], first[1:], strict=True):
            if y - x >= size:
                yield np.unique(whole[x : y - size + 1])
            else:
                yield joined(h[x:y], y - x) if y > x else np.zeros(0, np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    return next(all_shingles([text], size), np.zeros(0, np.uint64))


class Scheme:
    """Bands, bounds and signatures for links where 100 * intersection >= percent * union."""

    def __init__(self, percent: int = 90, cells: int | None = None, slack: int | None = None):
        # the lower the similarity, the fewer elements a cell holds: then subsets of more cells
        self.cells = cells or (2 if 100 + percent >= 16 * (100 - percent) else 4)
        self.percent, self.slack = percent, self.cells // 2 if slack is None else slack
        cells, slack = self.cells, self.slack
        #: The turns of each pass over the texts, in which signatures are dealt: the more signatures, the fewer at
        #: once.  A set signs for one band or two neighbours, so in a turn for one.
        self.passes = [[0, 1]] if cells == 2 else [[0], [1], [2], [3]]
        self.turns = sum(map(len, self.passes))
        #: A part of the groups in addition, so that sets that link share a good part of their signatures, and large
        #: sets that only quote the same passages fall away before they are paired.
        self.spare = 1 << 40 if cells == 2 else SPARE_PART
        #: Each band is wide enough for a set's partners to lie in it or the next.
        wider = max(1.5, 100 / percent * 1.05)
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * wider + 0.999)))
        self.subsets = list(combinations(range(cells), cells - slack))
        self.picks = np.zeros((len(self.subsets), cells), bool)
        for k, s in enumerate(self.subsets):
            self.picks[k, list(s)] = True

    def most_apart(self, total: int) -> int:
        """The largest symmetric difference of linked sets with ``total`` elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def bands(self, n: int) -> list[int]:
        """The bands in which a set of n elements gives signatures: its own, and the one below if
        a partner can lie there."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        return [own] if own == 0 or self.least_partner(n) >= self.edges[own] else [own - 1, own]

    @lru_cache(maxsize=256)
    def shape(self, band: int) -> tuple[int, int]:
        """(K, groups) of a band."""
        top = self.edges[band + 1] - 1
        k = self.most_apart(top + top * 100 // self.percent)
        needed = -(-(k + 1) // (self.slack + 1))
        return k, needed + max(SPARE, needed // self.spare)

    @lru_cache(maxsize=256)
    def least_shared(self, band: int) -> int:
        """How many signatures of a band two sets that link share at least.  A group with j spoilt cells
        keeps comb(cells - j, cells - slack) subsets, so every further cell costs it less than the one
        before: K differences spoil most when they are spread evenly."""
        k, groups = self.shape(band)
        kept = [comb(self.cells - j, self.cells - self.slack) for j in range(self.cells + 1)]
        shared = groups * kept[0]
        for j in range(self.cells):
            shared -= min(k, groups) * (kept[j] - kept[j + 1])
            k -= min(k, groups)
        return shared

    def signatures(self, features: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
        """The signatures of a set in the bands of one turn, and how many of them it must share to link.
        Bands with K = 0 give none: there only equal sets link."""
        for band in self.bands(len(features)):
            k, groups = self.shape(band)
            if k and band % self.turns == turn:
                break
        else:
            return np.zeros(0, np.uint64), 1
        mixed = _mix(features ^ _M2)
        n = groups * self.cells
        cell = ((features * _M1 >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=n)
        sums = np.r_[np.uint64(0), np.cumsum(mixed[order], dtype=np.uint64)]
        ends = np.cumsum(counts)
        digest = (sums[ends] - sums[ends - counts]).reshape(groups, self.cells)
        counts = counts.reshape(groups, self.cells)
        total = np.stack([(digest * p).sum(1, dtype=np.uint64) for p in self.picks.astype(np.uint64)], 1)
        filled = np.stack([(counts * p).sum(1) > 0 for p in self.picks.astype(np.int64)], 1)
        number = np.arange(filled.size, dtype=np.uint64).reshape(filled.shape)
        signature = _mix(total * _M1 + _mix(number + (np.uint64(band) << np.uint64(40))))
        # of the shared ones some may be of empty subsets; if all may be, a set keeps those as well
        least = self.least_shared(band) - int((~filled).sum())
        return (signature[filled], least) if least > 0 else (signature.ravel(), 1)

    def sketch(self, features: np.ndarray) -> np.ndarray:
        """Bit j: whether an odd number of features fall on j.  The number of bits follows the band
        of the largest partner, then is one of few powers of two; sketches of different length are
        folded to the shorter, which keeps the bound."""
        longs = 8
        while longs < SKETCH_LONGS and longs * 64 < 4 * len(features):
            longs *= 2
        bit = features >> np.uint64(64 - 12)
        odd = np.bincount((bit % np.uint64(longs * 64)).astype(np.int64), minlength=longs * 64) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _node(features: np.ndarray) -> int | None:
    return xxh3_64_intdigest(features.tobytes()) - (1 << 63) if len(features) else None


def _sketches(scheme: Scheme, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(all_shingles(raw_texts(b), size))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "key": b.column("key"), "node": pa.array(map(_node, found), pa.int64()),
                "n": pa.array(map(len, found), pa.int64()),
                "sketch": pa.array([scheme.sketch(f) if len(f) else None for f in found], pa.list_(pa.int64())),
            })

    return run


def _signed(scheme: Scheme, size: int, turns: list[int]):
    """(signature, node, turn, least), once for equal texts that a task sees close together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
            for f in all_shingles(raw_texts(b), size):
                node = _node(f)
                if node is None or node in seen:
                    continue
                if len(seen) >= REMEMBERED_NODES:
                    seen.clear()
                seen.add(node)
                for turn in turns:
                    own, least = scheme.signatures(f, turn)
                    n = len(own)
                    out.append((own.view(np.int64), np.full(n, node, np.int64), np.full(n, turn, np.int32), np.full(n, least, np.int32)))
            columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "node", "turn", "least"])

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(all_shingles(raw_texts(b), size))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(map(_node, found), pa.int64()),
                "features": pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
            })

    return run


def _with_least(edges: DataFrame, and_own: bool) -> DataFrame:
    """The edges (a, b) with m, the smallest b of their a (or a itself).  Both sides are dealt by a and a
    part of b, so the edges of one node stand in up to ``PARTS`` tasks."""
    part = F.pmod(F.hash("b"), F.lit(PARTS))
    own = edges.groupBy("a", part.alias("part")).agg(F.min("b").alias("m"))
    least = own.groupBy("a").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))
    m = F.least("m", "a") if and_own else F.col("m")
    least = least.select("a", m.alias("m"), F.explode("parts").alias("part"))
    return edges.withColumn("part", part).join(least, ["a", "part"]).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): label is the smallest node it is
    connected to.  Alternates large-star and small-star steps, each a minimum by node and a join,
    until nothing changes; a step's rows are never gathered in one place."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        large = _with_least(both, True).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a != b").distinct())
        small = _with_least(large, False)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(large.groupBy("a").agg(F.min("b").alias("b")))
        before, now = now, cut(small.filter("a != b").distinct())
        drop(before, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def _apart(a: str, b: str) -> str:
    """SQL: the distance of two parity sketches, a lower bound of the symmetric difference.  Folding
    a longer sketch onto a shorter one is exclusive-or of its parts."""
    fold = (
        "aggregate(sequence(0, greatest(size({x}), size({y})) div least(size({x}), size({y})) - 1), slice({x}, 1, least(size({x}), size({y}))),"
        " (s, k) -> if(k = 0 or size({x}) <= size({y}), s, zip_with(s, slice({x}, k * size({y}) + 1, size({y})), (p, q) -> p ^ q)))"
    )
    x, y = fold.format(x=a, y=b), fold.format(x=b, y=a)
    plain = "aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    return f"if(size({a}) = size({b}), {plain.format(x=a, y=b)}, {plain.format(x=x, y=y)})"


#: SQL: the k-th of SHORT_LONGS longs onto which a sketch is folded.
_FOLDED = f"aggregate(sequence(0, cast(size(sketch) div {SHORT_LONGS} as int) - 1), 0L, (s, j) -> s ^ element_at(sketch, k + j * {SHORT_LONGS}))"

#: SQL: a sketch folded to SIDE_LONGS, if it is longer.
_SIDE = (
    f"transform(sequence(1, least(size(sketch), {SIDE_LONGS})), k -> aggregate(sequence(0, greatest(size(sketch) div {SIDE_LONGS}, 1) - 1), 0L,"
    f" (s, j) -> s ^ element_at(sketch, cast(k + j * {SIDE_LONGS} as int))))"
)


def _may_link(scheme: Scheme) -> str:
    """SQL on x and y with n and sketch: false only if they cannot link."""
    p = scheme.percent
    sizes = f"100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n)"
    return f"{sizes} and {_apart('x.sketch', 'y.sketch')} <= ((x.n + y.n) * {100 - p}) div {100 + p}"


def similarity_classes(
    docs: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, key (a digest of the text), and
    first_of_class: whether the row has the smallest id of its class, and of rows with this id the
    smallest key (true for all that have no set).

    A document's set are its distinct ``size``-word shingles, or its whole word sequence if shorter;
    two documents link if 100 * intersection >= ``percent`` * union.  component_id is the smallest
    doc_id that links reach, the row's own included.  Null, empty and blank texts have no set, 0
    shingles and their own id.  Rows that repeat an id are each judged by their own text.  Texts of any
    length are read whole: memory holds the shingles of one text at a time.  An empty table gives no
    rows; other columns, whatever their names, are not looked at.
    """
    scheme = scheme or Scheme(percent)
    text = named(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(map_texts(
        docs, _sketches(scheme, size),
        f"doc_id {kind}, key bigint, node bigint, n bigint, sketch array<bigint>",
        doc_id=id_col, key=F.xxhash64(text), text=text_col,
    ))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(own).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes)
    slim = cut(rows.select("doc_id", "key", "node", "n"))
    drop(rows)
    label = components(_links(docs, nodes, scheme, size, id_col, text_col))
    linked = label.join(nodes.select("node", "rep"), "node")
    best = linked.groupBy("label").agg(F.min("rep").alias("best"))
    found = nodes.select("node", "rep").join(label.join(best, "label").select("node", "best"), "node", "left")
    found = found.select("node", F.coalesce("best", "rep").alias("best"))
    return slim.join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"), "key",
        F.when(F.col("best").isNull(), True).otherwise(own.eqNullSafe(F.col("best"))).alias("first_of_class"),
    )


def _members(docs: DataFrame, scheme: Scheme, size: int, text_col: str, turns: list[int]) -> DataFrame:
    """(signature, node, turn, least) of one pass, of the nodes that share as many signatures as a link needs."""

    def shared(rows: DataFrame) -> DataFrame:
        # the sum keeps all columns in use, so that both sides read the same shuffle
        several = rows.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.col("turn") + F.col("least")).alias("used"))
        return rows.join(several.filter("low < high and used >= 0").select("signature").hint("shuffle_hash"), "signature")

    dealt = map_texts(docs, _signed(scheme, size, turns), "signature bigint, node bigint, turn int, least int", text=text_col).repartition("signature")
    now = cut(shared(dealt).distinct())
    n = now.count()
    while True:
        enough = now.groupBy("node", "turn").agg(F.count("*").alias("n"), F.first("least").alias("least")).filter("n >= least")
        before, now = now, cut(shared(now.join(enough.select("node", "turn"), ["node", "turn"], "left_semi")))
        drop(before)
        was, n = n, now.count()
        if n >= 0.9 * was:
            return now


def _links(docs, nodes, scheme: Scheme, size: int, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) between nodes, enough of them to connect all that are connected."""
    passes = [_members(docs, scheme, size, text_col, turns) for turns in scheme.passes]
    member = passes[0]
    for more in passes[1:]:
        member = member.union(more)
    whole = nodes.join(member.select("node").distinct(), "node", "left_semi")
    folded = F.expr(f"transform(sequence(1, {SHORT_LONGS}), k -> {_FOLDED})")
    whole = cut(whole.select("node", "rep", "n", "sketch", folded.alias("short")))

    def verified(pairs: DataFrame) -> DataFrame:
        x = whole.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x"))
        y = whole.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y"))
        near = cut(pairs.distinct().join(x, "a").join(y, "b").filter(_may_link(scheme)).select("a", "b"))
        wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        sets = _sets_of(docs, whole, wanted, size, id_col, text_col)
        links = _verified(near, sets, scheme)
        drop(near, sets)
        return links

    # each node against the ends of its group, and of the parts of the group with an equal piece of the sketch
    pairs = [_ends(member.select("signature", "node"), ["signature"])]
    for k in range(SHORT_LONGS):
        part = member.select("signature", "node").join(whole.select("node", F.col("short")[k].alias("piece")), "node")
        pairs.append(_ends(part, ["signature", "piece"]))
    first = verified(reduce(DataFrame.union, pairs))
    drop(*pairs)
    # a signature whose members are all in one component has nothing left to find
    where = member.join(components(first), "node", "left").withColumn("label", F.coalesce("label", "node"))
    where = cut(where)
    left = where.groupBy("signature").agg(F.min("label").alias("p"), F.max("label").alias("q")).filter("p < q").select("signature")
    side = _foremost(where.join(left, "signature", "left_semi"))
    side = cut(side.join(whole.select("node", "n", F.expr(_SIDE).alias("sketch")), "node"))
    drop(where, *passes)
    across = side.alias("x").join(side.alias("y"), F.expr(
        f"x.signature = y.signature and x.label < y.label and {_may_link(scheme)}"
    )).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    across = cut(across.distinct())
    second = verified(across)
    drop(side, across, whole)
    return first.union(second)


def _foremost(rows: DataFrame) -> DataFrame:
    """(signature, node, label): of the signatures of a node and turn those that must hold one that it shares with
    each node it links with.  Of n signatures, a link shares ``least``; in one order for all nodes, the rarest
    first, the first of the shared ones has ``least - 1`` others behind it, so it is among the first
    n - least + 1 of both.  A node with fewer than ``least`` has none."""
    sizes = rows.groupBy("signature").agg(F.count("*").alias("size"))
    own = Window.partitionBy("node", "turn")
    rows = rows.join(sizes, "signature").withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("size", "signature")))
    return rows.filter("place <= n - least + 1").select("signature", "node", "label")


def _ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of each node with the smallest and the largest of its group."""
    ends = rows.join(rows.groupBy(*keys).agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), keys)
    pairs = ends.select(F.col("low").alias("a"), F.col("node").alias("b")).union(ends.select("node", "high")).filter("a < b")
    return cut(pairs.distinct())


def _sets_of(docs, nodes, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The sets of some nodes, made again from one text each; most texts share no signature."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rep = nodes.join(wanted, "node", "left_semi").select(name(F.col("rep.doc_id")).alias("rep_name"), F.col("rep.key").alias("rep_key"))
    rep = cut(rep)
    text = named(docs, text_col)
    texts = docs.select(F.xxhash64(text).alias("own_key"), name(named(docs, id_col)).alias("own_name"), text.alias("text"))
    texts = _on_bits(texts, "own_key", docs.sparkSession.sparkContext.broadcast(_bits(rep, "rep_key")))
    texts = texts.join(rep, F.expr("own_key = rep_key and own_name = rep_name"), "left_semi")
    texts = texts.dropDuplicates(["own_key", "own_name"])
    sets = cut(map_texts(texts, _sets(size), "node bigint, features array<bigint>", text="text"))
    drop(rep)
    return sets


def _bits(keys: DataFrame, key: str) -> np.ndarray:
    """A set of FILTER_BITS bits on which the keys fall, whatever their number: 2 MB on the driver."""
    slot = keys.select(F.pmod(key, F.lit(FILTER_BITS)).alias("k"))
    words = slot.groupBy(F.expr("k div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 32 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _on_bits(rows: DataFrame, key: str, bits, wanted: bool = True) -> DataFrame:
    """The rows whose key falls on a set bit, or the others.  A key of the set always does.  In SQL a join
    that follows would be pushed below such a filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(key).to_numpy() % FILTER_BITS
            yield b.filter(pa.array((bits.value[k // 32] >> (k % 32).astype(np.uint32) & np.uint32(1)).astype(bool) == wanted))

    return map_texts(rows, run, rows.schema, **{c: c for c in rows.columns})


def _verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs that link, by their sets."""
    x = sets.select(F.col("node").alias("a"), F.col("features").alias("f"))
    y = sets.select(F.col("node").alias("b"), F.col("features").alias("g"))
    both = pairs.join(x, "a").join(y, "b").withColumn("same", F.size(F.array_intersect("f", "g")))
    return cut(both.filter(f"100 * same >= {scheme.percent} * (size(f) + size(g) - same)").select("a", "b"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, one of each class of ``similarity_classes``: that with the
    smallest id, of several rows with this id that with the smallest digest of its text; of rows equal in id
    and text one stays.  Texts without words are in no class and all stay.  Only documents whose digest falls
    on a bit of a dropped or repeated one are shuffled with their texts."""
    spark = docs.sparkSession
    rows = classes.filter("n_shingles > 0").groupBy("doc_id", "key").agg(F.count("*").alias("n"), (~F.bool_or("first_of_class")).alias("gone"))
    rows = cut(rows.filter("gone or n > 1").select("gone", F.col("doc_id").alias("id"), "key", F.xxhash64("doc_id", "key").alias("digest")))
    bits = spark.sparkContext.broadcast(_bits(rows, "digest"))
    own_id, own_key = named(docs, id_col), F.xxhash64(named(docs, text_col))
    packed = docs.select(F.struct(*(named(docs, c) for c in docs.columns)).alias("row"), own_id.alias("id"), own_key.alias("key"), F.xxhash64(own_id, own_key).alias("digest"))
    clear = _on_bits(packed, "digest", bits, wanted=False).select("row.*")
    same = F.expr("x.digest = g.digest and x.key = g.key and x.id <=> g.id")
    maybe = _on_bits(packed, "digest", bits).alias("x").join(rows.alias("g"), same, "left").select("x.*", "g.gone")
    once = maybe.filter("gone is not null and not gone").dropDuplicates(["id", "key"])
    return clear.union(maybe.filter("gone is null").select("row.*")).union(once.select("row.*"))
