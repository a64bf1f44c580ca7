"""Language of a text by unigram pieces, with every segmentation of every word summed.

The pieces are a fixed public vocabulary of byte strings, read from a file of ranks; single bytes are among them, so
every word can be spelt. A word is a maximal run of letters, lower-cased, behind one blank, in UTF-8; a text is its words. For
each language the probability of a word is the sum over all its segmentations of the product of the pieces'
probabilities, by the forward algorithm; a text's is the product over its words. The score is the language's share, with
equal prior weights.

Piece probabilities are learnt by expectation and maximisation over the word counts of all training rows, with
expected counts of pieces from forward and backward sums. Words of any length are learnt from; those longer than ``SHORT`` bytes
take part by themselves, with sums that are scaled on the way. ``MIXED`` of each language's probability is the pooled one, ``FLOOR`` of that is uniform. The table that tasks get
has one number for each piece of at most ``LONGEST`` bytes and each language; more than ``LANGUAGES`` languages are an error, so its size is bounded.

Null texts and texts without letters are ``und`` with score 0, as is everything when there is no training row.
Equal scores go to the first language in code-point order. Null languages are not learnt. Repeated rows count and are scored each.
A very long text is scored whole; its words are looked up in a cache that is emptied at ``CACHE`` words.
Only ``doc_id``, ``text`` and, for training rows, ``lang`` are read.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

from .wordbytes import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST, SHORT = 24, 48
ROUNDS = 3
MIXED, FLOOR = 0.01, 0.1
LANGUAGES = 256
CACHE = 400_000
BLOCK = 1 << 18
#: Probabilities are multiplied by this for every byte of a piece, so that sums over a word stay near one.
GAIN = 64.0
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
_CODES = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SLOT_BITS = 20


class Pieces(NamedTuple):
    """Sorted hashes of the pieces, by their upper bits a table that most other strings fail and the first place, and the longest."""

    hashes: np.ndarray
    sizes: np.ndarray
    seen: np.ndarray
    first: np.ndarray
    longest: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the strings with these hashes, ``len(self.hashes)`` for those that are no piece."""
        out = np.full(len(hashes), len(self.hashes), dtype=np.int32)
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        maybe = np.flatnonzero(self.seen[slot])
        at, sought = self.first[slot[maybe]], hashes[maybe]
        while len(maybe):
            here = self.hashes[at]
            right = here == sought
            out[maybe[right]] = at[right]
            on = (here < sought) & (at < len(self.hashes) - 1)  # the pieces of a slot stand in order
            maybe, at, sought = maybe[on], at[on] + 1, sought[on]
        return out


class Words:
    """Words of bytes, longest first, with prefix sums that give the hash of every substring."""

    def __init__(self, words: list[bytes]) -> None:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.start = (np.cumsum(sizes) - sizes)[self.order]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.up, self.down = (np.full(len(data) + 1, base, dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 2**64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * self.up[:-1], out=self.sums[1:])
        self.end, self.upto = -1, self.sums[:0]

    def reaching(self, t: int) -> int:
        """How many words have at least ``t`` bytes."""
        return int(np.searchsorted(-self.sizes, -t, "right"))

    def hashes(self, t: int, size: int) -> np.ndarray:
        """Of the ``size`` bytes that end at place ``t`` of each word that reaches it."""
        if t != self.end:  # the same for all sizes that end there
            self.end, self.upto = t, self.sums[self.start[: self.reaching(t)] + t]
        at = self.start[: len(self.upto)] + (t - size)
        return mix((self.upto - self.sums[at]) * self.down[at] + np.uint64(size))


def pieces(vocabulary: list[bytes]) -> Pieces:
    """The pieces of ``vocabulary`` that words can hold: a blank in front at most, no other ASCII than small letters."""
    inside = lambda b: b >= 128 or 97 <= b <= 122
    held = [p for p in vocabulary if 0 < len(p) <= LONGEST and all(map(inside, p[1:])) and (p[0] == 32 or inside(p[0]))]
    held = sorted({*held, b" ", *(bytes([b]) for b in range(256) if inside(b))})
    words = Words(held)
    hashes = np.zeros(len(held), dtype=np.uint64)
    for size in set(words.sizes.tolist()):
        same = words.sizes == size
        at = words.start[same]
        hashes[same] = mix((words.sums[at + size] - words.sums[at]) * words.down[at] + np.uint64(size))
    order = np.argsort(hashes)
    hashes = hashes[order]
    slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    seen = np.bincount(slot, minlength=1 << _SLOT_BITS) > 0
    first = np.searchsorted(slot, np.arange(1 << _SLOT_BITS)).astype(np.int32)
    return Pieces(hashes, words.sizes[order].astype(np.int16), seen, first, int(words.sizes[0]))


def read_vocabulary(path: str) -> list[bytes]:
    """Byte strings of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def log_marginals(words: list[bytes], known: Pieces, table: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability summed over its segmentations, one column for each of ``table``'s.

    ``table`` has a row for each piece and a last row of zeros.
    """
    out = np.zeros((len(words), table.shape[1]))
    if not words:
        return out
    held = Words(words)
    gained = table * GAIN ** np.append(known.sizes, 0)[:, None]
    ways = {0: np.ones((len(words), table.shape[1]))}
    shift = np.zeros(len(words))
    for t in range(1, int(held.sizes[0]) + 1):
        n = held.reaching(t)
        now = np.zeros((n, table.shape[1]))
        for size in range(1, min(t, known.longest) + 1):
            at = known.find(held.hashes(t, size))
            hit = np.flatnonzero(at < len(known.hashes))
            now[hit] += ways[t - size][hit] * gained[at[hit]]
        ways[t] = now
        ways.pop(t - known.longest, None)
        if t % 16 == 0:  # keep sums near one; all places of a word still in use are scaled alike
            top = now.max(axis=1)
            far = np.flatnonzero((top < 1e-60) | (top > 1e60))
            for way in ways.values():
                way[far] /= top[far, None]
            shift[far] += np.log(top[far])
        ended = slice(held.reaching(t + 1), n)
        out[held.order[ended]] = np.log(np.maximum(now[ended], 1e-300)) + shift[ended, None] - t * np.log(GAIN)
    return out


def expected_counts(words: list[bytes], weight: np.ndarray, language: np.ndarray, known: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected count of every piece in every language over all segmentations; each word is of one language."""
    counts = np.zeros(table.size)
    if not words:
        return counts.reshape(table.shape)
    held, v = Words(words), len(known.hashes)
    weight, language = weight[held.order], language[held.order]
    gained = table * GAIN ** np.append(known.sizes, 0)[:, None]
    longest = int(held.sizes[0])
    places, ways = {}, [np.ones(len(words))]
    # Logarithms of what the sums at a place were divided by, for the places that were; one array for all places of a step.
    shifts, shift = {}, np.zeros(len(words))

    def ending(t: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = known.find(held.hashes(t, size))
        hit = np.flatnonzero(at < v)
        return hit, at[hit]

    for t in range(1, longest + 1):
        n = held.reaching(t)
        now = np.zeros(n)
        for size in range(1, min(t, known.longest) + 1):
            hit, at = ending(t, size)
            if len(hit):
                if t <= SHORT:  # found again on the way back in longer words, whose places would fill the memory
                    places[t, size] = hit, at
                now[hit] += ways[t - size][hit] * gained[at, language[hit]]
        ways.append(now)
        if shifts:
            shifts[t] = shift[:n].copy()
        far = np.flatnonzero((now < 1e-60) | (now > 1e60)) if t % 16 == 0 else ()
        if len(far):  # keep sums near one; all places of a word still in use are scaled alike
            by = now[far].copy()
            for u in range(max(0, t - known.longest + 1), t + 1):
                shifts[u] = shifts[u] if u in shifts else np.zeros(len(ways[u]))
                ways[u][far] /= by
                shifts[u][far] += np.log(by)
            shift[far] += np.log(by)
    after = {longest: np.zeros(len(ways[longest]))}
    for t in range(longest, 0, -1):
        ended = slice(held.reaching(t + 1), held.reaching(t))
        now = after.pop(t, np.zeros(len(ways[t])))
        now[ended] = weight[ended] / ways[t][ended]  # the backward sum starts at the word's weight over its probability
        for size in range(1, min(t, known.longest) + 1):
            hit, at = ending(t, size) if t > SHORT else places.get((t, size), ((), ()))
            if len(hit):
                back = now[hit] * gained[at, language[hit]]
                if t in shifts:
                    back *= np.exp((shifts[t - size][hit] if t - size in shifts else 0.0) - shifts[t][hit])
                if t - size not in after:
                    after[t - size] = np.zeros(len(ways[t - size]))
                after[t - size][hit] += back
                np.add.at(counts, at * table.shape[1] + language[hit], back * ways[t - size][hit])
    return counts.reshape(table.shape)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities of pieces by language from their counts, with the last row of zeros."""
    held = counts[:-1]
    pooled = held.sum(axis=1) / max(held.sum(), 1e-300)
    pooled = (1 - FLOOR) * pooled + FLOOR / len(held)
    total = held.sum(axis=0)
    own = np.where(total > 0, held / np.maximum(total, 1e-300), pooled[:, None])
    return np.vstack([(1 - MIXED) * own + MIXED * pooled[:, None], np.zeros(counts.shape[1])])


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``rows(text, lang)``, over all rows whose language is not null."""
    found = rows.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.explode(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}]+")).alias("word"))
    return found.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


class Model(NamedTuple):
    languages: list[str]
    pieces: Pieces
    table: np.ndarray


def fit(rows: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language in ``rows(text, lang)``."""
    known = pieces(read_vocabulary(vocabulary))
    counted = materialise(word_counts(rows), "language-words")
    names = sorted(r["lang"] for r in counted.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in the training rows")
    v = len(known.hashes)
    table = np.vstack([np.full((v, len(names)), 1 / v), np.zeros(len(names))])
    for _ in range(rounds if names else 0):
        found = counted.mapInArrow(partial(_expect, {name: k for k, name in enumerate(names)}, known, table), "at int, language int, n double")
        summed = found.groupBy("at", "language").agg(F.sum("n").alias("n")).toPandas()  # pieces times languages at most
        counts = np.zeros(table.shape)
        counts[summed["at"], summed["language"]] = summed["n"]
        table = normalised(counts)
    return Model(names, known, table)


def _expect(number: dict[str, int], known: Pieces, table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(table.shape)
    for batch in batches:
        words = [b" " + w.encode() for w in batch.column(1).to_numpy(zero_copy_only=False)]
        language = np.array([number[x] for x in batch.column(0).to_numpy(zero_copy_only=False)], dtype=np.int64)
        weight = batch.column(2).to_numpy().astype(float)
        short = np.array([len(w) <= SHORT for w in words], dtype=bool)
        for part in (short, ~short):
            counts += expected_counts([w for w, k in zip(words, part, strict=True) if k], weight[part], language[part], known, table)
    at, language = np.nonzero(counts)
    columns = [pa.array(at.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(counts[at, language])]
    yield pa.RecordBatch.from_arrays(columns, names=["at", "language", "n"])


@cache
def _letters() -> np.ndarray:
    """Which code points ``LETTERS`` takes."""
    out = np.zeros(0x110000, dtype=bool)
    # Surrogates, which no text holds, stand as blanks.
    for found in LETTERS.finditer("".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(len(out)))):
        out[found.start() : found.end()] = True
    return out


def runs(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The runs of ``LETTERS`` in the lower-cased texts as places in a list of distinct ones, that list, and the runs of each text."""
    lowered = [text.lower() for text in texts]
    ends = np.cumsum([len(text) + 1 for text in lowered], dtype=np.int64)
    codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le"), dtype=np.uint32)  # a zero is no letter
    inside = _letters()[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    sizes = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    held = codes[inside]
    width = 1 + (held > 0x7F).astype(np.int64) + (held > 0x7FF) + (held > 0xFFFF)  # bytes in UTF-8
    offsets = np.append((np.cumsum(width) - width)[first[inside]], width.sum())
    data = held.tobytes().decode("utf-32-le").encode()
    words = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    found = words.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist(), sizes


class _Scorer:
    """Log probabilities of words, kept for the next texts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.scores = np.zeros((0, len(self.model.languages)))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        if len(self.number) > CACHE:
            self.clear()
        number = self.number
        at, words, sizes = runs(texts)
        flat = np.array([number[w] for w in words], dtype=np.int64)[at]
        new = [b" " + w.encode() for w in list(number)[len(self.scores) :]]
        parts = [log_marginals(new[i : i + BLOCK // 8], self.model.pieces, self.model.table) for i in range(0, len(new), BLOCK // 8)]
        self.scores = np.concatenate([self.scores, *parts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        out = np.stack([np.bincount(owner, self.scores[flat, k], len(texts)) for k in range(self.scores.shape[1])], axis=1)
        return out, sizes


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for batch in batches:
        texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 8 * BLOCK):
                size += len(texts[to])
                to += 1
            logs, sizes = scorer.texts(texts[at:to])
            best = logs.argmax(axis=1)
            score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            best[sizes == 0] = len(model.languages)
            score[sizes == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
            at = to


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return texts.mapInArrow(partial(_scored, model), "doc_id long, lang_pred string, score double")
