"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels words as outside, or as first or later word of a kind.
Its features are the word's shape (letters, digits and signs, runs shortened), a few counts, the shapes of the
words beside it, and the word before the run. It is trained by exact gradients on a small labelled table of two parts:

* ``taught_lines``: ``TAUGHT`` lines made by a seeded rule from the hand-labelled sentences and forms below. Most of the forms are
  ones that the patterns miss: numbers with brackets, dots or leading zeros and no plus sign, cards with dots, addresses with letters
  beyond ASCII, IPv6. Sentences with dates, versions, ISBNs, order numbers and the like teach what is outside.
* runs of words of a bounded sample of documents, labelled by the base spans. A run in which a stretch outside them keeps
  the rule of a kind is left out, as its label is open.

Only words with a digit or an at sign may carry a label; so the best path of a whole text splits, without loss, at all other
words, and runs are decoded by Viterbi in numpy batches, all runs of one length at once. What the field finds beside the base
spans is trimmed and checked against the kind's own rule (``field_span``) and returned as ``crf_kind``.

Bounds of the corpus part of the training table, none of which touches what is searched: at most ``SAMPLE`` documents with a
digit or an at sign, by a hash of their ids; of each at most ``PIECES`` pieces of whole words (a word with such a character, up to
four before and six after it, 400 characters at most), by a hash of the piece; of all pieces ``2 * SAMPLE``, by a hash. A
word's shape is taken from its first 80 characters.

Null counts as empty, long texts are searched whole, and an empty table gives no rows. Repeated rows are searched each.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. A look-behind keeps a failed run of digits from being tried again
# at each of its digits, which could not match either.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, NOT_LOCAL, WORD = re.compile(r"[0-9]"), re.compile(r"[^A-Za-z0-9._%+-]"), re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")

# Rules of the field's spans, after signs around them are cut off.
FIELD_EMAIL = re.compile(r"[^\s@<>()\[\]\"',;:]+@[\w-]+(?:\.[\w-]+)+")
FIELD_CARD = re.compile(r"[0-9](?:[\x20./-]*[0-9])+")
FIELD_PHONE = re.compile(r"[+(]?[0-9][0-9\x20()./-]*[0-9]")
AROUND = ".,;:!?\"'*#%$&<>[]{}="

# Hand-labelled sentences, and forms of what stands in their braces: D is a digit, L the check digit, O a number up to 255,
# X a hex group, W a letter.
SENTENCES = (
    "call {phone} before noon", "phone: {phone}", "{phone}", "Tel. {phone} or {phone}", "fax {phone}, second floor", "reach me at {phone} tonight",
    "tel:{phone}", "his number is {phone}.", "ring {phone} after 18:30", "please write to {email} soon", "e-mail: <{email}>", "{email}", "({email})",
    "from {email} to {email}", "contact {email} or {phone}", "host {ip} is down", "{ip}", "[{ip}]", "from {ip} to {ip}", "login by {ip} at 10:45",
    "card {card} was charged", "{card}", "paid with {card} on 2021-04-05", "number {card}, valid thru 09/27",
    "on 20DD-0D-1D at 1D:DD", "order no. DDDDDD", "order DDDDDDDDDD was sent", "version D.D.DD", "see page DDD of DDDD", "ISBN DDD-D-DDD-DDDDD-D",
    "DD/DD/20DD", "it costs $D,DDD.DD today", "between 19DD and 20DD", "id DDDDDDDD-DDDD", "thanks @WWW", "about DD % of DDDD", "ratio D:D", "rooms DDD DDD DDD",
    "section D.D.D.D.D of it", "serial DDDD-DDDD-DDDD-DDDD", "invoice DDDD DDDD DD", "DDDD DDDD DDDD items", "at 1D:DD:DD on 0D.0D.20DD", "key XXXXXXXXXX",
    "rows D D D D D D D D D D", "scores DD DD DD DD DD DD", "DD DDD D DD DDD DD D", "D, D, DD, DD, DDD and DDDD",
)
FORMS = {
    "phone": ("(DDD) DDD-DDDD", "DDD-DDD-DDDD", "DDD.DDD.DDDD", "(0DD) DDDD DDDD", "00DD DD DDDDDDD", "00DD DDD DDD DDD", "0DD/DDDDDDD", "DDD DDD DDDD", "+D (DDD) DDD-DDDD"),
    "email": ("WWW.é@WWW.com", "WWWü@WWW.de", "WWW@WWWß.de", "W+W!W@WWW.org", "WWW@WWW.example.com", "WWW.WD@WWW.co"),
    "ip": ("O.O.O.O", "X:X:X:X:X:X:X:X", "X:X::X", "X::D"),
    "card": ("DDDD.DDDD.DDDD.DDDL", "DDDD/DDDD/DDDD/DDDL", "DDDD.DDDDDD.DDDDL", "DDDD DDDD DDDD DDDL", "DDDDDDDDDDDDDDDL"),
}

SAMPLE = 2000
PIECES = 20
TAUGHT = 1500
EPOCHS = 12
RATE = 0.5
FEATURES = 1 << 13
LABELS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    at = text.find("@")
    return at > 0 and DOMAIN.match(text, at + 1) is not None


def field_span(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without signs around it, if what is left keeps the rule that the field's spans of this kind have."""
    cut = AROUND + "()" if kind == "email" else AROUND
    while b > a and text[b - 1] in cut:
        b -= 1
    while b > a and text[a] in cut:
        a += 1
    if kind in ("phone", "card"):  # a label may be joined to the number: tel:030...
        while b > a and text[a] not in ("+(0123456789" if kind == "phone" else "0123456789"):
            a += 1
    found = text[a:b]
    if kind == "email":
        ok = FIELD_EMAIL.fullmatch(found) is not None
    elif kind == "ip":
        ok = valid(kind, found) or _is_ipv6(found)
    else:
        ok = (FIELD_PHONE if kind == "phone" else FIELD_CARD).fullmatch(found) is not None and valid(kind, found)
    return (a, b) if ok else None


def _is_ipv6(text: str) -> bool:
    try:
        return 2 < len(text) <= 45 and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the patterns, in order."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        low = at
        while low > done and NOT_LOCAL.match(text, low - 1) is None:
            low -= 1
        domain = DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            found.append((low, 0, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            if kind != 3 or "+" in text:
                found.extend((m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m[0]))
    return sorted(found)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Neighbouring words with a digit or an at sign."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for m in MARKED.finditer(text):
        near = end >= 0 and not text[end : m.start()].strip(" \t") and "\n" not in text[end : m.start()]
        if near:
            out[-1].append(m.span())
        else:
            out.append([m.span()])
        end = m.end()
    return out


def shape(word: str) -> str:
    plain = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word[:80]))
    return re.sub(r"(a)\1+", r"\1", re.sub(r"(9)\1{4,}", r"\1\1\1\1\1", plain))


def word_features(text: str, run: list[tuple[int, int]]) -> np.ndarray:
    """Hashed features of each word of a run, ``words x features``."""
    words = [text[a:b].strip(".,;:!?\"'*#%$&") for a, b in run]
    shapes = ["<", *map(shape, words), ">"]
    before = WORD.findall(text[max(0, run[0][0] - 40) : run[0][0]].rpartition("\n")[2])
    before = before[-1].strip(AROUND).lower() if before else ""
    rows = []
    for k, word in enumerate(words):
        digits = sum(c.isdigit() for c in word)
        signs = "".join(sorted({c for c in word if not c.isalnum()}))
        names = (
            "bias", "s" + shapes[k + 1], "p" + shapes[k], "n" + shapes[k + 2], f"d{min(digits, 20)}", "c" + signs, f"l{min(len(word), 40) // 4}",
            "h" + shapes[k + 1][:2], "e" + shapes[k + 1][-2:], "b" + before, f"b{k}" + before,
        )
        rows.append([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "big") % FEATURES for n in names])
    return np.array(rows)


def labels_of(run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside, ``1 + 2 * kind`` for the first word of a span, one more for later words."""
    out = np.zeros(len(run), dtype=np.int64)
    for start, kind, end in spans:
        inside = [k for k, (a, b) in enumerate(run) if a < end and b > start]
        for k in inside:
            out[k] = 1 + 2 * kind + (k != inside[0])
    return out


@dataclass
class Field:
    """Weights: features x labels, and labels x labels with row 0 also the start."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each run; runs of one length go through Viterbi together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
        lengths = np.array([len(x) for x in batch])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            scores = self.emit[np.stack([batch[i] for i in at])].sum(axis=2)
            best, back = scores[:, 0] + self.move[0], []
            for t in range(1, n):
                step = best[:, :, None] + self.move[None]
                back.append(step.argmax(axis=1))
                best = step.max(axis=1) + scores[:, t]
            path = [(best + self.move[:, 0]).argmax(axis=1)]
            for pointers in reversed(back):
                path.append(pointers[np.arange(len(at)), path[-1]])
            for i, row in zip(at, np.stack(path[::-1], axis=1), strict=True):
                out[i] = row
        return out


def _allowed() -> np.ndarray:
    """A later word follows a word of its own kind only."""
    ok = np.ones((LABELS, LABELS), dtype=bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[1 + 2 * kind : 3 + 2 * kind, 2 + 2 * kind] = True
    return ok


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the labels ``y`` of one run, and its gradient by each word's label scores and by the moves."""
    n, scores = len(x), field.emit[x].sum(axis=1)
    ahead, behind = np.zeros((n, LABELS)), np.zeros((n, LABELS))
    ahead[0] = scores[0] + field.move[0]
    for t in range(1, n):
        ahead[t] = scores[t] + _lse(ahead[t - 1][:, None] + field.move, 0)
    behind[-1] = field.move[:, 0]
    for t in range(n - 2, -1, -1):
        behind[t] = _lse(field.move + (scores[t + 1] + behind[t + 1])[None], 1)
    z = _lse(ahead[-1] + behind[-1], 0)
    off = np.exp(ahead + behind - z)
    move = np.zeros_like(field.move)
    move[0] += off[0]
    move[:, 0] += off[-1]
    for t in range(1, n):
        move += np.exp(ahead[t - 1][:, None] + field.move + scores[t][None] + behind[t][None] - z)
    off[np.arange(n), y] -= 1
    move[0, y[0]] -= 1
    move[y[-1], 0] -= 1
    np.subtract.at(move, (y[:-1], y[1:]), 1)
    path = field.move[0, y[0]] + field.move[y[:-1], y[1:]].sum() + field.move[y[-1], 0] + scores[np.arange(n), y].sum()
    return float(z - path), off, move


def fit_field(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by forward-backward and per-coordinate rates, in the given order."""
    field = Field(np.zeros((FEATURES, LABELS)), np.where(_allowed(), 0.0, -1e4))
    grown_emit, grown_move = np.full_like(field.emit, 1e-2), np.full_like(field.move, 1e-2)
    for _ in range(epochs):
        for x, y in examples:
            _, off, move = gradient(field, x, y)
            for k in range(len(x)):
                grown_emit[x[k]] += off[k] ** 2
                field.emit[x[k]] -= RATE * off[k] / np.sqrt(grown_emit[x[k]])
            grown_move += move**2
            field.move -= np.where(_allowed(), RATE * move / np.sqrt(grown_move), 0)
    return field


def taught_lines(count: int = TAUGHT, seed: int = 6) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines of the hand-labelled table with their spans: sentences in turn, forms and characters by a seeded rule."""
    rng = random.Random(seed)

    def filled(form: str) -> str:
        out = ""
        for c in form:
            if c == "L":
                out += next(d for d in "0123456789" if luhn(re.sub("[^0-9]", "", out) + d))
            else:
                made = {"D": rng.choice("0123456789"), "O": str(rng.randrange(256)), "X": f"{rng.getrandbits(16):x}", "W": rng.choice("abcdefghijklmnopqrstuvwxyz")}
                out += made.get(c, c)
        return out

    lines = []
    for k in range(count):
        text, spans = "", []
        for j, part in enumerate(re.split(r"[{}]", SENTENCES[k % len(SENTENCES)])):
            start = len(text)
            text += filled(rng.choice(FORMS[part]) if j % 2 else part)
            if j % 2:
                spans.append((start, KINDS.index(part), len(text)))
        lines.append((text, spans))
    return lines


def taught_runs() -> list[tuple[np.ndarray, np.ndarray]]:
    return [(word_features(text, run), labels_of(run, spans)) for text, spans in taught_lines() for run in runs(text)]


def labelled_runs(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Runs labelled by the base spans, without those of an open label."""
    out = []
    for text in texts:
        spans = base_spans(text)
        out.extend((word_features(text, run), labels_of(run, spans)) for run in runs(text) if not _open(text, run, spans))
    return out


def _open(text: str, run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> bool:
    """Whether a stretch of neighbouring words of the run, none of them in a span, keeps the rule of a kind."""
    free = [not any(a < e and b > s for s, _, e in spans) for a, b in run]
    for i in range(len(run)):
        for j in range(i, min(i + 8, len(run))):  # a card of 19 digits in groups of three has seven words
            if not free[j]:
                break
            if any(field_span(kind, text, run[i][0], run[j][1]) for kind in KINDS):
                return True
    return False


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field learnt from the hand-labelled lines and at most ``sample`` documents that hold a digit or an at sign."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = marked.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(sample).distinct()
    around = F.lit(r"(?<!\S)((?:[^\s0-9@]++ ){0,4}[^\s0-9@]*+[0-9@]\S*+(?: \S++){0,6})")
    held = F.filter(F.regexp_extract_all(F.col("text").cast("string"), around, F.lit(1)), lambda p: F.length(p) <= 400)
    chosen = F.slice(F.array_sort(F.transform(held, lambda p: F.struct(F.xxhash64(p, F.lit(6)).alias("at"), p.alias("piece")))), 1, PIECES)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(ids), "doc_id")  # at most `sample` ids
    pieces = rows.select("doc_id", F.explode(chosen).alias("held")).select("doc_id", "held.piece")
    pieces = pieces.orderBy(F.xxhash64("piece", "doc_id"), "piece", "doc_id").limit(2 * sample)
    return fit_field(labelled_runs([r.piece for r in pieces.collect()]) + taught_runs())


def field_spans(text: str, base: list[tuple[int, int, int]], field: Field, found_runs: list, labels: list) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span and keep the rule of their kind."""
    out = []
    for run, path in zip(found_runs, labels, strict=True):
        k = 0
        while k < len(run):
            first = int(path[k])
            if first % 2 == 1:
                end = k
                while end + 1 < len(run) and path[end + 1] == first + 1:
                    end += 1
                kind = (first - 1) // 2
                span = field_span(KINDS[kind], text, run[k][0], run[end][1])
                if span and not any(span[0] < e and span[1] > s for s, _, e in base):
                    out.append((span[0], kind, span[1]))
                k = end
            k += 1
    return out


def _digest(spans: list[tuple[int, int, int]], prefix: str = "") -> list[tuple[int, int, str]]:
    return [(a, k + len(KINDS) * bool(prefix), f"{prefix}{KINDS[k]}:{a}:{b}") for a, k, b in spans]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_field`` for every row; the counts are of base spans."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            base = [base_spans(t) for t in texts]
            found = [runs(t) for t in texts]
            flat = [word_features(t, r) for t, rs in zip(texts, found, strict=True) for r in rs]
            paths = iter(field.decode(flat))
            out: dict[str, list] = {f"n_{k}": [sum(s[1] == i for s in spans) for spans in base] for i, k in enumerate(KINDS)}
            out |= {"base_sha256": [], "spans": [], "n_field": []}
            for text, spans, rs in zip(texts, base, found, strict=True):
                more = field_spans(text, spans, field, rs, [next(paths) for _ in rs])
                listed = _digest(spans)
                out["base_sha256"].append(hashlib.sha256(",".join(x[2] for x in listed).encode()).hexdigest())
                out["spans"].append(",".join(x[2] for x in sorted(listed + _digest(more, "crf_"))))
                out["n_field"].append(len(more))
            yield pd.DataFrame({"doc_id": batch["doc_id"], **out})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(search, f"doc_id long, {counts}, base_sha256 string, spans string, n_field long")
