"""Secret scan: three fixed patterns, and a battery of randomness tests for all other tokens.

A token is a run of 20 or more characters of the usual encodings.  ``=`` that is not padding at its end
parts it, and where no alphabet holds a part, so do the characters that do not fit.  Its encoding is the
smallest alphabet that holds all its characters.  Three tests ask whether it could be uniformly random in
that alphabet: chi-squared of the character counts, runs above and below the alphabet's middle, and
correlation of each character with the next.  Their p-values are combined after Fisher; tokens that
they reject are ordered data, not secrets.

Passing is weak evidence if the token is short, so a second p-value asks how likely text in a
language would look as uniform at this length: the chi-squared statistic under the noncentral law
that a language's uneven letters give.  Benjamini-Hochberg over the tokens of all texts on these p-values
holds the share of false discoveries in the corpus at ``rate``, at every length alike.  For that a first
pass counts the tokens by level, the p-value's place on a fixed logarithmic grid, rounded towards 1, so
that the number of counts is fixed; the second pass reports the tokens from the level on that the counts
allow.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from bisect import bisect_left
from math import ceil, erfc, exp, factorial, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of

KINDS = ("assign", "access", "hex", "random")
RATE = 0.01
#: Levels of p-values: GRID a halving, TOP at most.
GRID, TOP = 16, 1 << 14
#: A token whose combined p-value of randomness is below this is not random.
LEAST_RANDOM = 1e-3
#: Probability that two letters of a text in a language are equal, from below.
LANGUAGE_COLLISION = 0.06


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # a maximal run, as a run's later parts are shorter
_TOKEN = re.compile("[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by size of their alphabets; decimal numbers are never secrets.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = sorted(((name, frozenset(a), {c: k for k, c in enumerate(a)}) for name, a in ALPHABETS.items()), key=lambda x: len(x[1]))


def encoding_of(token: str) -> str | None:
    """The encoding with the smallest alphabet that holds the token without its padding."""
    own = set(token.rstrip("="))
    return next((name for name, a, _ in _SETS if own <= a), None)


#: Where no alphabet holds a run: each alphabet's stretches of it, from the widest alphabets.
_FITTING = [re.compile(x) for x in ("[A-Za-z0-9+/]+", "[A-Za-z0-9_-]+", "[A-Za-z0-9]+")]
#: A run up to "=" that something follows; padding that ends the run stays with it.
_PART = re.compile("[^=]+(?:=+$)?")


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the sorted, disjoint spans overlaps start to end."""
    k = bisect_left(spans, (end, end))
    return k > 0 and spans[k - 1][1] > start


def tokens_of(run: str) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of the parts of a run that are long enough to be tested."""
    out = []
    for m in _PART.finditer(run):
        a, part = m.start(), m.group()
        kind = encoding_of(part)
        if kind is not None:
            out.append((a, a + len(part), kind))
            continue
        # the stretches of the wide alphabets overlap, so the longest go first
        body = part.rstrip("=")
        spans = sorted({x.span() for f in _FITTING for x in f.finditer(body)}, key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int]] = []
        for s, e in spans:
            if e - s >= 20 and not _meets(taken, s, e):
                taken.insert(bisect_left(taken, (s, e)), (s, e))
                end = len(part) if e == len(body) else e
                out.append((a + s, a + end, encoding_of(body[s:e])))
    return sorted((a, b, k) for a, b, k in out if len(run[a:b].rstrip("=")) >= 20)


def _normal_tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def _chi_tail(x: float, mean: float, variance: float) -> float:
    """P(X > x) for a chi-squared-like X with these moments, after Wilson and Hilferty."""
    scale = variance / (2 * mean)
    df = mean / scale
    return _normal_tail(((max(x, 1e-9) / scale / df) ** (1 / 3) - 1 + 2 / (9 * df)) / sqrt(2 / (9 * df)))


def battery(token: str, encoding: str) -> dict[str, float]:
    """p-values of the three tests and of their combination, and that of text in a language."""
    index = next(i for name, _, i in _SETS if name == encoding)
    x = np.array([index[c] for c in token.rstrip("=")])
    n, a = len(x), len(index)
    counts = np.bincount(x, minlength=a)
    chi = float(a / n * (counts.astype(float) ** 2).sum() - n)
    p_uniform = _chi_tail(chi, a - 1, 2 * (a - 1) * (1 - 1 / n))
    high = x >= a / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * up * down / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    power = float((y * y).sum())
    p_serial = 2 * _normal_tail(abs(float((y[1:] * y[:-1]).sum()) / power * n + 1) / sqrt(n)) if power else 0.0
    half = -sum(log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    p_random = min(1.0, exp(-half) * sum(half**k / factorial(k) for k in range(3)))
    collision = max(LANGUAGE_COLLISION, 1.9 / a)
    far = n * (a * collision - 1)
    p_language = 1 - _chi_tail(chi, a - 1 + far, 2 * (a - 1 + 2 * far))
    return {"uniform": p_uniform, "runs": min(1.0, p_runs), "serial": p_serial, "random": p_random, "language": p_language}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def level_of(p: float) -> int:
    """The level of a p-value; the larger the level, the smaller p.  Never beyond p."""
    return TOP if p <= 0 else min(TOP, int(-log2(p) * GRID))


def tested(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, level, p-value of randomness) of the tokens outside ``taken`` that the battery tests."""
    out, joined = [], []
    for a, _, b in sorted(taken):
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    for m in _TOKEN.finditer(text):
        for x, y, kind in tokens_of(m.group()):
            a, b = m.start() + x, m.start() + y
            token = text[a:b]
            if kind == "decimal" or _UUID.fullmatch(token) or _meets(joined, a, b):
                continue
            p = battery(token, kind)
            out.append((a, b, level_of(p["language"]), p["random"]))
    return out


def first_level(counts: dict[int, int], rate: float = RATE) -> int:
    """The level from which Benjamini-Hochberg rejects, from the number of tokens at each level; beyond TOP
    if nowhere.  A token at a level has a p-value of at most 2 ** (-level / GRID)."""
    total, so_far, found = sum(counts.values()), 0, TOP + 1
    for level in sorted(counts, reverse=True):
        so_far += counts[level]
        if 2.0 ** (-level / GRID) <= rate * so_far / total:
            found = level
    return found


def random_spans(text: str, taken: list[tuple[int, int, int]], level: int | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the tokens outside ``taken`` that the battery takes for random, from a level on:
    that of the corpus, or else of one token alone."""
    least = ceil(-log2(RATE) * GRID) if level is None else level
    return [(a, 3, b) for a, b, found, r in tested(text, taken) if found >= least and r >= LEAST_RANDOM]


def corpus_level(df: DataFrame, rate: float = RATE, text_col: str = "text") -> int:
    """The level from which tokens are reported, from those of all texts: at most TOP + 1 sums leave the
    executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TOP + 1, np.int64)
        for b in batches:
            for t in texts_of(b):
                for _, _, level, _ in tested(t, base_spans(t)):
                    counts[level] += 1
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["level", "n"])

    sums = map_texts(df, run, "level bigint, n bigint", text=text_col).groupBy("level").agg(F.sum("n").alias("n")).collect()
    return first_level({r.level: r.n for r in sums}, rate)


def spans_of(text: str, level: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by start and then by kind as listed."""
    base = sorted(base_spans(text))
    return base, sorted(base + random_spans(text, base, level))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(df: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans: ``kind:start:end`` by start and then by kind in the order assign, access, hex, random,
    joined by commas; code points from 0, end exclusive.  base_sha256: digest of the same without
    the kind random.  A null or empty text has no spans, an empty table no rows; repeated rows are judged
    alike and count each.  Texts are read whole, of any length; other columns are not looked at.  Two passes,
    no shuffle of texts.
    """
    level = corpus_level(df, rate, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(t, level) for t in texts_of(b)]
            columns = {"doc_id": b.column("doc_id")}
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(s[1] == k for s in spans) for _, spans in found], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s, _ in found], pa.string())
            columns["spans"] = pa.array([_joined(s) for _, s in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, {counts}, base_sha256 string, spans string"
    return map_texts(df, run, schema, doc_id=id_col, text=text_col)


def redact(text: str, level: int | None = None, mark: str = "[{}]") -> str:
    """The text with each found span replaced by its kind; spans that overlap are one."""
    out, at = [], 0
    for a, k, b in spans_of(text, level)[1]:
        if a >= at:
            out += [text[at:a], mark.format(KINDS[k])]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(df: DataFrame, rate: float = RATE, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in ``text_col`` replaced by their kind in brackets.
    Null stays null; the table's own tokens set the level."""
    level = corpus_level(df, rate, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = [t if t is None else redact(t, level) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

    return map_texts(df, run, df.schema, **{c: c for c in df.columns})
