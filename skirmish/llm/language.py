"""Language identification with a bit-sliced Bloom filter over character n-grams.

Each slot of the filter is a bit mask with one bit per language.  The masks of an n-gram's slots,
ANDed, give in one look-up all languages that contain the n-gram.  A text's n-grams are looked up at
once; for each language the set bits are counted, and the share of hits is corrected by the filter's
false-positive rate for that language.

A language contains every n-gram of its training texts, however rare, but for those that another language
uses ``FOREIGN`` times as often: quotations and wrongly labelled texts bring a few of every language's
n-grams into every other, the more the larger the corpus.  The filter's size follows the counted n-grams up
to ``MOST_FILTER_BYTES``; beyond, it gets denser, which its false-positive rate tells and the correction
takes into account.  It is built by the executors, slot by slot; only its finished blocks reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_texts, named, raw_texts, shards

NGRAM = 4  # bytes
FOREIGN = 50
SLOTS_BITS = 20
#: Bits of slots at least, slots in a block, and bytes of all masks at most.
LEAST_BITS, BLOCK, MOST_FILTER_BYTES = 16, 1 << 16, 256 << 20
HASHES = 2
#: Bytes of texts whose n-grams are looked up at once.
STEP_BYTES = 1 << 17
UNKNOWN = "und"

#: ASCII letters in lower case; all other ASCII is a word break.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_TABLE = np.frombuffer(_FOLD, np.uint8)
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the folded texts, as 32-bit numbers, and where each text's n-grams begin.
    A text is padded by spaces; grams that would span two texts are cut off by the padding."""
    pad = b" " * NGRAM
    data = np.frombuffer(pad.join([b"", *texts, b""]), np.uint8)
    data = _TABLE[data]
    sizes = np.array([len(t) for t in texts], np.int64) + NGRAM
    # dropping the last NGRAM - 1 positions leaves exactly sum(sizes) + 1 grams; the first is all blank
    g = data[: len(data) - 3].astype(np.uint32)
    for k in range(1, NGRAM):
        g |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    return g[1:], np.concatenate([[0], np.cumsum(sizes)])


def _blank(g: np.ndarray) -> np.ndarray:
    """Grams without a letter."""
    return g == np.uint32(0x20202020)


def slots(g: np.ndarray, k: int, bits: int = SLOTS_BITS) -> np.ndarray:
    return (g * np.uint32(_MULTIPLIERS[k]) ^ g >> np.uint32(15)) * np.uint32(0x2545F491) >> np.uint32(32 - bits)


def has_letter(text: bytes) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode("utf-8", "ignore")))


class BloomModel:
    """languages, and for each slot a mask in words of 8 languages (the bit slices)."""

    def __init__(self, languages: list[str], contained: Iterable[tuple[str, np.ndarray]], bits: int = SLOTS_BITS):
        self.languages, self.bits = languages, bits
        number = {name: k for k, name in enumerate(languages)}
        self.masks = np.zeros((max(1, -(-len(languages) // 8)), 1 << bits), np.uint8)
        for name, g in contained:
            word, bit = divmod(number[name], 8)
            for k in range(HASHES):
                s = slots(g.astype(np.uint32), k, bits)
                self.masks[word, s] |= np.uint8(1 << bit)
        self._measure()

    def _measure(self) -> None:
        set_bits = [np.count_nonzero(self.masks[k // 8] >> (k % 8) & 1) for k in range(len(self.languages))]
        self.false_positive = (np.array(set_bits, float) / (1 << self.bits)) ** HASHES

    def fill(self, blocks: Iterable[tuple[int, int, bytes]]) -> BloomModel:
        """Set whole blocks of masks: (word, block, its bytes)."""
        for word, block, raw in blocks:
            own = np.frombuffer(raw, np.uint8)
            self.masks[word, block * BLOCK : block * BLOCK + len(own)] = own
        self._measure()
        return self

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language the corrected share of n-grams that the language contains."""
        if not self.languages or not texts:
            return np.zeros((len(texts), len(self.languages)))
        g, first = grams(texts)
        real = ~_blank(g)
        total = np.maximum(np.add.reduceat(real, first[:-1], dtype=np.int64), 1)
        places = [slots(g, k, self.bits) for k in range(HASHES)]
        out = np.empty((len(texts), len(self.languages)))
        for word, masks in enumerate(self.masks):
            both = masks[places[0]]
            for p in places[1:]:
                both &= masks[p]
            both[~real] = 0
            for bit in range(min(8, len(self.languages) - 8 * word)):
                out[:, 8 * word + bit] = np.add.reduceat(both >> np.uint8(bit) & np.uint8(1), first[:-1], dtype=np.int64)
        fp = self.false_positive
        return np.clip((out / total[:, None] - fp) / (1 - np.minimum(fp, 0.999)), 0, 1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language with the largest share (the first by name of equals), and the share."""
        share = self.shares(texts)
        names, score = [], np.zeros(len(texts))
        best = share.argmax(1) if share.shape[1] else np.zeros(len(texts), int)
        for k, t in enumerate(texts):
            if not self.languages or not has_letter(t):
                names.append(UNKNOWN)
            else:
                names.append(self.languages[best[k]])
                score[k] = share[k, best[k]]
        return names, score


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n-gram, count) of a partition, summed up as often as the sums grow large."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(name: str, g: np.ndarray, n: np.ndarray) -> None:
        if name in held:
            g, n = np.concatenate([held[name][0], g]), np.concatenate([held[name][1], n])
            g, back = np.unique(g, return_inverse=True)
            n = np.bincount(back, n).astype(np.int64)
        held[name] = g, n

    def out() -> Iterator[pa.RecordBatch]:
        for name, (g, n) in held.items():
            columns = [pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        texts, langs = raw_texts(b), b.column("lang").to_pylist()
        by: dict[str, list[bytes]] = {}
        for t, name in zip(texts, langs, strict=True):
            by.setdefault(name, []).append(t)
        for name, own in by.items():
            for x, y in shards(map(len, own)):
                g, _ = grams(own[x:y])
                add(name, *np.unique(g[~_blank(g)], return_counts=True))
        if sum(len(g) for g, _ in held.values()) > 2_000_000:
            yield from out()
    yield from out()


def filter_bits(most: int, languages: int) -> int:
    """Bits of the slots: eight slots for each n-gram of the language with the most, within the bound."""
    bits = max(LEAST_BITS, (8 * max(most, 1) - 1).bit_length())
    while bits > LEAST_BITS and (1 << bits) * -(-languages // 8) > MOST_FILTER_BYTES:
        bits -= 1
    return min(bits, 31)


def _set_bits(bits: int):
    """(word, slot, mask) of each n-gram of a numbered language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, g = b.column("number").to_numpy(), b.column("gram").to_numpy().astype(np.uint32)
            slot = np.concatenate([slots(g, k, bits) for k in range(HASHES)]).astype(np.int64)
            columns = [np.tile(number // 8, HASHES), slot, np.tile(1 << number % 8, HASHES)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "slot", "mask"])

    return run


def _block(key: tuple, t: pa.Table) -> pa.Table:
    out = np.zeros(BLOCK, np.uint8)
    out[t.column("slot").to_numpy() % BLOCK] = t.column("mask").to_numpy()
    return pa.table({"word": [key[0].as_py()], "block": [key[1].as_py()], "raw": pa.array([out.tobytes()], pa.binary())})


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", foreign: float = FOREIGN) -> BloomModel:
    """Count n-grams by language over all the given documents with a text and a language.  The driver gets the
    languages' names and the finished filter.  No documents: a model without languages."""
    spark = docs.sparkSession
    text, lang = named(docs, text_col), named(docs, lang_col)
    rows = docs.filter(text.isNotNull() & lang.isNotNull())
    counts = map_texts(rows, _count, "lang string, gram bigint, n bigint", text=text, lang=lang.cast("string"))
    counts = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        drop(counts)
        return BloomModel([], (), LEAST_BITS)
    numbers = spark.createDataFrame([(x, k, float(total[x])) for k, x in enumerate(languages)], "lang string, number bigint, total double")
    shared = counts.join(numbers, "lang").withColumn("share", F.col("n") / F.col("total"))
    own = shared.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") * foreign >= F.col("most"))
    kept = cut(own.select("number", "gram"))
    most = kept.groupBy("number").count().agg(F.max("count")).first()[0]
    model = BloomModel(languages, (), filter_bits(most, len(languages)))
    masks = kept.mapInArrow(_set_bits(model.bits), "word bigint, slot bigint, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    blocks = masks.groupBy("word", F.expr(f"slot div {BLOCK}").alias("block")).applyInArrow(_block, "word bigint, block bigint, raw binary")
    model.fill((r.word, r.block, bytes(r.raw)) for r in blocks.toLocalIterator())
    drop(counts, kept)
    return model


def identify(docs: DataFrame, model: BloomModel, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """One row per input row: doc_id, the columns named in ``keep``, lang_pred and score (0 to 1,
    the corrected share of the text's n-grams that the language contains).

    ``und`` with score 0 where the text is null, empty or without a letter, or if the model knows no
    language.  Ties go to the first language by name.  Repeated rows are judged alike; texts are read whole,
    of any length, an empty table gives no rows, and other columns, whatever their names, are not looked at.
    No shuffle; the model is broadcast, its size is bounded by ``MOST_FILTER_BYTES``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts, names, score = raw_texts(b), [], []
            for x, y in shards(map(len, texts), STEP_BYTES):
                n, s = m.predict(texts[x:y])
                names += n
                score += s.tolist()
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", *keep, "lang_pred", "score"],
            )

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {kinds}lang_pred string, score double"
    return map_texts(docs, run, schema, doc_id=id_col, **{f"keep_{c}": c for c in keep}, text=text_col)


def keep_identified(docs: DataFrame, model: BloomModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns as they are, whose text has a language with at least this score;
    null and empty texts have none.  Repeated rows stay or go alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = raw_texts(b, text_col), []
            for x, y in shards(map(len, texts), STEP_BYTES):
                names, score = sent.value.predict(texts[x:y])
                keep += [n != UNKNOWN and s >= least_score for n, s in zip(names, score.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, run, docs.schema, **{c: c for c in docs.columns})
