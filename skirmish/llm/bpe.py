"""Byte-pair merging: a heap with a linked list for counts, a segment tree for identifiers.

Both operators read a tokenizer file of the ``tokenizers`` library whose pieces come from a
normalizer and a pre-tokenizer and whose words end in a suffix symbol.  The pieces of a text are
found chunk by chunk: pre-tokens never hold white space, so a run between white space is a unit
whose result can be remembered.  The memory of such results is bounded and only saves time.

Special strings inside a text become their own token, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts, texts_of

#: Chunks remembered by a worker at most; when full the memory starts afresh.
REMEMBERED_COUNTS = 1_000_000
REMEMBERED_IDS = 600_000

#: Characters on which Python's lower() and split() surely agree with the library's normalizer.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
_FAR = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte that is
    printable in Latin-1 stands for itself, the others follow from code point 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Merges and symbols of a tokenizer file, and its way of cutting texts into pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.shift = max(vocab.values()).bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << self.shift | vocab[b], r)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id, "") of each special string, (None, text) of what stands between."""
        if self.marks is None or "<" not in text:
            yield None, text
            return
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                yield self.special[part], ""
            elif part:
                yield None, part

    def chunks(self, text: str) -> list[str]:
        """The runs between white space, normalized: what the cache is keyed by.  Texts with
        characters beyond Latin letters go through the library's own normalizer."""
        if _OTHER.search(text) is None:
            return text.lower().split()
        return [c for c in self.normalize(text).split(" ") if c]

    def pieces(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a normalized chunk, as bytes."""
        if _OTHER.search(chunk) is None:
            return [p.encode() for p in self.find(chunk)]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cut(chunk)]

    def start(self, piece: bytes) -> list[int]:
        inner = self.inner
        ids = [inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        return ids

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: symbols minus merges.  A heap holds the ranks of adjacent pairs with
        their places; a linked list holds the symbols that are left."""
        n = len(piece)
        if n == 1:
            return 1
        ids, rank, made, shift = self.start(piece), self.rank, self.made, self.shift
        get = rank.get
        heap, a = [], ids[0]
        for i in range(1, n):  # an entry is the rank with the place below it
            b = ids[i]
            if (r := get(a << shift | b)) is not None:
                heap.append(r << 32 | i - 1)
            a = b
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            a = ids[i]
            j = after[i]
            if a < 0 or j >= n or get(a << shift | ids[j]) != r:
                continue  # one of the two has changed since
            a = ids[i] = made[r]
            ids[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(a << shift | ids[k])) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(ids[h] << shift | a)) is not None:
                push(heap, r << 32 | h)
        return left

    def encode(self, piece: bytes) -> list[int]:
        """Identifiers of a piece.  A segment tree holds, for each place, the rank of the pair that
        begins there with the place itself below it; its root is the leftmost lowest rank.  A merge
        changes at most three leaves."""
        n = len(piece)
        ids = self.start(piece)
        if n == 1:
            return ids
        get, made, shift = self.rank.get, self.made, self.shift
        base = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_FAR] * (2 * base)
        found = False
        for i in range(n - 1):
            r = get(ids[i] << shift | ids[i + 1])
            if r is not None:
                tree[base + i] = r << 32 | i
                found = True
        if not found:
            return ids
        for k in range(base - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = base + i
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                least = value if value < other else other
                k >>= 1
                if tree[k] == least:
                    return
                tree[k] = value = least

        while (top := tree[1]) < _FAR:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = made[top >> 32], -1
            if j < n - 1:
                put(j, _FAR)
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(ids[i] << shift | ids[k])
                put(i, _FAR if r is None else r << 32 | i)
            else:
                put(i, _FAR)
            h = before[i]
            if h >= 0:
                r = get(ids[h] << shift | ids[i])
                put(h, _FAR if r is None else r << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between, as the library decodes where a file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


class _Memory(dict):
    """Results by chunk, in two generations: when the younger is full it becomes the older, so what
    is asked for again and again stays."""

    limit = REMEMBERED_COUNTS

    def __init__(self, make):
        self.make = make
        self.older = {}

    def __missing__(self, chunk):
        value = self.older.pop(chunk, None)
        if value is None:
            value = self.make(chunk)
            if len(chunk) > 64:
                return value
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[chunk] = value
        return value


class _Ids(_Memory):
    limit = REMEMBERED_IDS


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def counter(path: str):
    """A function: text -> number of tokens.  Kept by the worker from task to task."""
    v = vocabulary(path)
    one = _Memory(lambda chunk: sum(map(v.count, v.pieces(chunk)))).__getitem__

    def count(text: str) -> int:
        return sum(sum(map(one, v.chunks(part))) if mark is None else 1 for mark, part in v.parts(text))

    return count


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function: text -> identifiers as little-endian unsigned 32-bit integers, in bytes."""
    v = vocabulary(path)

    def chunk_ids(chunk: str) -> bytes:
        return np.array([i for p in v.pieces(chunk) for i in v.encode(p)], "<u4").tobytes()

    one = _Ids(chunk_ids).__getitem__

    def encode(text: str) -> bytes:
        return b"".join(
            b"".join(map(one, v.chunks(part))) if mark is None else mark.to_bytes(4, "little")
            for mark, part in v.parts(text)
        )

    return encode


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text, by heap merging; no identifier is made.

    ``tokenizer`` is the path of the tokenizer file, at the same place on every machine.  Gives one
    row (doc_id, n_bytes, n_tokens) per input row, repeated rows and null ids included; a null text
    counts as empty (0 bytes, 0 tokens).  An empty table gives no rows.  Texts are counted whole, of any
    length; other columns, whatever their names, are not looked at.  No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            texts = texts_of(b)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(map(count, texts), pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", doc_id=id_col, text=text_col)


def encode_decode(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, decoded: bool = True
) -> DataFrame:
    """Every text as identifiers, by a segment tree of pair ranks, and decoded again.

    Gives one row per input row: doc_id, n_tokens, ids_sha256 (of the identifiers as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8), and with ``ids`` also
    the identifiers (array) and, if ``decoded``, the decoded text.  A null text counts as empty: no tokens,
    and the digests of nothing.  Repeated rows are each encoded; an empty table gives no rows.  Texts are
    encoded whole, of any length, by chunks that white space parts; other columns are not looked at.  No
    shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, v = encoder(tokenizer), vocabulary(tokenizer)
        for b in batches:
            raw = [encode(t) for t in texts_of(b)]
            arrays = [np.frombuffer(r, "<u4") for r in raw]
            n, first, second, texts = [], [], [], []
            for r, a in zip(raw, arrays, strict=True):
                text = v.decode(a)
                n.append(len(a))
                first.append(hashlib.sha256(r).hexdigest())
                second.append(hashlib.sha256(text.encode()).hexdigest())
                if ids and decoded:
                    texts.append(text)
            out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64())}
            out |= {"ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            if ids:
                out["ids"] = pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))
            if ids and decoded:
                out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded string" * (ids and decoded)
    return map_texts(df, run, schema, doc_id=id_col, text=text_col)
