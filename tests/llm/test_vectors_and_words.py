"""Whitening, language and spelling operators against brute force, closed forms and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breezeframe.llm import language, line_dedup, mixing, queries, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int, x string"


def with_values(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1.0],
        [1 + 1e-9, 1, 1 - 1e-9, 0.5, 1e-3],  # a cluster below float32
        [2, 2, 2, 1, 1, 0],
        [1e8, 1, 1 - 1e-12, 1e-8],
        [0.0, 0, 0],
        list(1 + 1e-8 * np.arange(40)),
    ],
)
def test_refined_vectors_are_eigenvectors_to_double_precision(values):
    a = with_values(values)
    found, x = whitening.refined_eigen(a)
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=1e-14 * max(values) * len(values))
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(a @ x - x * found).max() <= 1e-14 * max(values) * len(values)


def test_one_round_improves_float32_and_clusters_need_the_sub_solve():
    a = with_values([3.0, 2.0, 1.0, 0.5])
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    once = whitening.refined_eigen(a, rounds=1)[1]
    residue = lambda x: np.abs(a @ x - x * np.einsum("ij,ij->j", x, a @ x)).max()
    assert residue(once) < 1e-3 * residue(start)
    assert [len(g) for g in whitening.clusters(np.array([1.0, 3.0, 1.05, 1.1]), 0.06)] == [3, 1]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(6, 6)) * [3, 2, 1, 0.5, 0.1, 0.1]
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=6) @ spread], 1, 1, "x") for k in range(300)]
    rows += [(1000 + k, rows[7][1], 1, 1, "x") for k in range(150)]  # a vector that a third of all rows hold
    rows += [rows[3], (None, rows[4][1], None, None, None), (2000, None, 1, 1, "x"), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, "x")]
    rows += [(2002, [math.nan, 0.0, 0.0, 0.0, 0.0, 0.0], 1, 1, "x"), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1, 1, "x"), (2004, [1.0, 2.0], 1, 1, "x"), (2005, [], 1, 1, "x")]
    return spark.createDataFrame(rows, VECTORS), rows[:452]


def test_whitening_equals_brute_force(spark, vectors):
    table, held = vectors
    x = np.array([[math.floor(256 * c) for c in r[1]] for r in held])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:4], components[:, ::-1][:, :4]
    got = whitening.whiten(table).toPandas()
    assert len(got) == 4 * len(held) and (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    want = {(r[0], k + 1): w for r, row in zip(held, (x - sums / n) @ components / np.sqrt(values), strict=True) for k, w in enumerate(row)}
    signs = {}
    for row in got.itertuples():
        key = (None if math.isnan(row.vec_id) else int(row.vec_id), row.component)
        ratio = row.whitened / want[key]
        assert abs(abs(ratio) - 1) < 1e-8
        assert signs.setdefault(row.component, ratio > 0) == (ratio > 0)
        assert abs(row.explained - values[row.component - 1] / (centred**2).sum() * n) < 1e-10
    exact = {r[0]: sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for r, v in zip(held, x, strict=True)}
    assert {None if math.isnan(i) else int(i): int(d) for i, d in zip(got["vec_id"], got["deviation"], strict=True)} == exact


def test_whitening_without_spread_or_rows(spark, vectors):
    table, held = vectors
    assert whitening.whiten(table.where("vec_id < 0")).count() == 0
    assert whitening.whiten(table.where("vec_id >= 1000 and vec_id < 2001")).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], "vec_id int, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 5


def test_deviations_are_exact_beyond_long():
    x = np.array([[2**40, -(2**40)], [3, 5]])
    sums = [int(v) for v in x.sum(axis=0)]
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert [int(v) for v in whitening._deviations(x, sums, 2)] == want and max(want) > 2**64


# --- language -----------------------------------------------------------------------------------------------------


def segmentations(word: bytes, probability: dict[bytes, float]) -> list[tuple[list[bytes], float]]:
    if not word:
        return [([], 1.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in probability:
            out += [([word[:k], *rest], probability[word[:k]] * p) for rest, p in segmentations(word[k:], probability)]
    return out


@pytest.fixture(scope="module")
def small_pieces():
    known = language.pieces([b" th", b"th", b"the", b"he", b" the", b"e\xc3", b"\xc3\xa9", b"A", b"x!", b"ab" * 20])
    names = [b" ", *(bytes([b]) for b in range(256) if b >= 128 or 97 <= b <= 122), b" th", b"th", b"the", b"he", b" the", b"e\xc3", b"\xc3\xa9"]
    held = language.Words(names)
    order = [names[i] for i in held.order]
    place = {}
    for name in order:
        one = language.Words([name])
        place[name] = int(known.find(one.hashes(len(name), len(name)))[0])
    return known, place


def test_pieces_are_found_and_others_are_not(small_pieces):
    known, place = small_pieces
    assert sorted(place.values()) == list(range(len(known.hashes)))
    other = language.Words([b"A", b"zz", b"ab" * 20])
    assert all((known.find(other.hashes(t, s)) == len(known.hashes)).all() for t, s in ((1, 2), (2, 2)) if t >= s)


def test_marginals_and_expected_counts_sum_all_segmentations(small_pieces):
    known, place = small_pieces
    rng = np.random.default_rng(1)
    table = np.vstack([rng.dirichlet(np.ones(len(known.hashes)), 2).T, np.zeros(2)])
    words = [b" the", "théth".encode(), b" ", b" thethe", b" x", b" the"]
    got = language.log_marginals(words, known, table)
    spelt = {}
    for k in range(2):
        p = {name: table[at, k] for name, at in place.items()}
        for w in words:
            spelt[w, k] = segmentations(w, p)
        assert np.allclose(got[:, k], [math.log(sum(q for _, q in spelt[w, k])) for w in words], atol=1e-12)
    weight, owner = np.array([2.0, 1, 3, 1, 5, 1]), np.array([0, 1, 0, 1, 1, 1])
    want = np.zeros(table.shape)
    for w, n, k in zip(words, weight, owner, strict=True):
        total = sum(q for _, q in spelt[w, k])
        for parts, q in spelt[w, k]:
            for part in parts:
                want[place[part], k] += n * q / total
    assert np.allclose(language.expected_counts(words, weight, owner, known, table), want)


def test_long_words_do_not_underflow(small_pieces):
    known, _ = small_pieces
    table = np.vstack([np.full((len(known.hashes), 1), 1e-9), np.zeros((1, 1))])
    assert np.isclose(language.log_marginals([b"x" * 5000], known, table)[0, 0], 5000 * math.log(1e-9))


def test_long_words_are_learnt_from(small_pieces):
    """Words beyond every stop are counted in full: sums far below and far above one, alone and beside short words."""
    known, place = small_pieces
    words = [b"x" * 700, b"the" * 40, "théth".encode() * 30, b" the", b"th" + b"x" * 60]
    language_of, weight = np.array([0, 1, 0, 1, 1]), np.array([2.0, 1, 3, 1, 5])
    for low in (1e-9, 0.04, 0.9):
        p = np.random.default_rng(4).uniform(0.5, 1, (len(known.hashes), 2)) * low
        table = np.vstack([p, np.zeros(2)])
        got = language.expected_counts(words, weight, language_of, known, table)
        want = np.zeros(table.shape)
        for w, n, k in zip(words, weight, language_of, strict=True):
            spans = [(t - len(b), t, at) for b, at in place.items() for t in range(len(b), len(w) + 1) if w[t - len(b) : t] == b]
            q = [math.log(p[at, k]) for _, _, at in spans]
            fore, back = [-math.inf] * (len(w) + 1), [-math.inf] * (len(w) + 1)
            fore[0] = back[-1] = 0.0
            for (a, b, _), g in sorted(zip(spans, q, strict=True), key=lambda s: s[0][1]):
                fore[b] = np.logaddexp(fore[b], fore[a] + g)
            for (a, b, _), g in sorted(zip(spans, q, strict=True), key=lambda s: -s[0][0]):
                back[a] = np.logaddexp(back[a], back[b] + g)
            for (a, b, at), g in zip(spans, q, strict=True):
                want[at, k] += n * math.exp(fore[a] + g + back[b] - fore[-1])
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-8, atol=1e-10)


def test_fit_reads_words_of_every_length(small_pieces):
    known, _ = small_pieces
    table = np.vstack([np.full((len(known.hashes), 1), 0.1), np.zeros((1, 1))])
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a"], "word": ["x" * 300, "the"], "n": [2, 1]})
    (found,) = language._expect({"a": 0}, known, table, [batch])
    by_piece = dict(zip(found["at"].to_pylist(), found["n"].to_pylist(), strict=True))
    assert by_piece[int(known.find(language.Words([b"x"]).hashes(1, 1))[0])] > 590


TEXTS = "doc_id long, text string, lang string, word string, n long"


def test_runs_of_letters_are_found_at_once():
    """The same words in the same order as by the pattern, for letters of all widths and texts without any."""
    texts = ["", "\u0130stanbul \u03a3\u0391\u03a3 STRASSE stra\u00dfe", "a\0b a\u00b2 x\u0301y \u01c5", "\U0001d49c\U0001d505 \u4e2d\u6587 12 \ud55c", "\0", " a", "a", "b A_b"]
    at, words, sizes = language.runs(texts)
    found = [language.LETTERS.findall(t.lower()) for t in texts]
    assert [words[k] for k in at] == [w for f in found for w in f] and sizes.tolist() == [len(f) for f in found]
    assert len(words) == len(set(words)) and [len(x) for x in language.runs(["", ""])] == [0, 0, 2]


def test_pieces_of_a_slot_are_all_found():
    known = language.pieces([bytes([97 + i, 97 + j, 97 + k]) for i in range(26) for j in range(26) for k in range(26)])
    assert np.bincount((known.hashes >> np.uint64(64 - language._SLOT_BITS)).astype(np.int64)).max() > 1
    assert (known.find(known.hashes) == np.arange(len(known.hashes))).all()
    assert (known.find(known.hashes + np.uint64(1)) == len(known.hashes)).all()


def test_languages_are_told_apart(spark, sf):
    rng = random.Random(2)
    tongues = {"a": "the and with house".split(), "b": "der und mit haus".split()}
    rows = [(k, " ".join(rng.choices(tongues[x], k=12)).title(), x, "w", 1) for k, x in enumerate("ab" * 60)]
    rows += [(500, None, "a", "w", 1), (501, "", "b", "w", 1), (502, "12 + 3!", "a", None, None), (None, "haus und haus", None, "w", 1), rows[0]]
    rows.append((503, "mit haus " * 40_000, None, "w", 1))
    docs = spark.createDataFrame(rows, TEXTS)
    model = language.fit(docs)
    got = language.predict(docs, model).collect()
    assert model.languages == ["a", "b"] and len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[500] == by[501] == by[502] == ("und", 0.0)
    assert by[None][0] == by[503][0] == "b" and all(by[r[0]][0] == r[2] for r in rows[:120])
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs.where("lang is null"))).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model).count() == 0
    tables = language.fit(docs.where("doc_id < 120")).table
    assert np.allclose(tables.sum(axis=0), 1)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_language(spark, folder)
    judged = got.where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


# --- spelling -----------------------------------------------------------------------------------------------------


def apart(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_forms(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and apart(v, w) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def test_scan_finds_exactly_the_words_one_edit_away():
    rng = random.Random(6)
    listed = sorted({"".join(rng.choices("abé", k=rng.randrange(6, 10))) for _ in range(700)})
    shared, following = spelling.prefixes(listed)
    for place in range(0, len(listed), 7):
        word = listed[place]
        want = [i for i, v in enumerate(listed) if apart(word, v) == 1]
        assert spelling.one_edit_away(word, listed, shared, following) == want
        assert spelling.one_edit_away(word, listed, shared, following, place) == [i for i in want if i > place]
    assert spelling.one_edit_away("absent", ["absents", "other"], *spelling.prefixes(["absents", "other"])) == [0]


@pytest.mark.parametrize("most", [4, 64, spelling.LIST])
def test_spelling_variants_equal_brute_force(spark, most):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcé", k=rng.randrange(6, 11))) for _ in range(60)] + ["prefix" + "".join(rng.choices("ab", k=3)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "÷÷÷÷÷÷ " * 6), (None, "Haufen " * 30), (3, "x" * 90_000 + " 12 " + "Ünder " * 7)]
    chain = {"aaaaaa": 700, "aaaaab": 130, "aaaabb": 25, "aaabbb": 5}
    rows += [(4, " ".join(w for w, n in chain.items() for _ in range(n)))]
    for k in range(10, 260):
        line = []
        for w in rng.choices(stems, weights=[1 + 40 * (i % 5 == 0) for i in range(len(stems))], k=60):
            at = rng.randrange(len(w))
            slip = rng.random()
            line.append(w if slip < 0.8 else w[:at] + w[at + 1 :] if slip < 0.9 else w[:at] + "z" + w[at:] if slip < 0.95 else w.upper())
        rows.append((k, ", ".join(line)))
    rows += [rows[9], rows[9]]
    docs = spark.createDataFrame([(*r, "en", "w", 1) for r in rows], TEXTS)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, most).collect()}
    assert got == brute_forms(brute_words(rows))
    assert got["aaabbb"][4] == "aaaaaa"


def test_pairs_are_reported_once_and_empty_tables_give_none(spark):
    words = sorted({"".join(p) for p in itertools.product("ab", repeat=7)} | {"".join(p) for p in itertools.product("ab", repeat=6)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_words(table, 16).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a != b and apart(a, b) == 1}
    empty = spark.createDataFrame([], TEXTS)
    assert spelling.variants(empty).count() == 0


# --- lines --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("whole", [False, True])
def test_lines_of_shared_ids_and_clashing_columns(spark, whole):
    """Rows of one id keep their own lines, null ids count as rows, equal rows share a verdict, internal names may occur."""
    near = " ".join(f"w{k}" for k in range(60))
    rows = [
        (0, "x y z w v"), (1, "x y z w v"), (1, "other unique line here"), (1, None), (2, ""), (None, "x y z w v\nalone without an id"),
        (None, "second without an id"), (3, near), (4, near.replace("w59", "changed")), (5, "twice the very same\ntwice the very same"), (6, "a copied row stands here"),
        (6, "a copied row stands here"),
    ]
    schema = "doc_id long, text string, _id long, _cut string, _n_cut long, `left` string, address string, n_chars long, `row` long, `of` long"
    df = spark.createDataFrame([(*r, 1, "c", 2, "l", "a", None if r[1] is None else len(r[1]), 7, 8) for r in rows], schema)
    out = line_dedup.without_repeats(df, whole=whole)
    assert sorted(out.columns) == sorted([*df.columns, "_n_lines"])
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert (r["_cut"], r["left"], r["address"], r["row"], r["of"]) == ("c", "l", "a", 7, 8)
        assert r.n_chars == (None if r.text is None else len(r.text))
    texts = [t for v in got.values() for t in v]
    assert len(texts) == len(rows)
    lines = Counter(line for t in texts if t for line in t.split("\n"))
    assert lines["x y z w v"] == 1 and lines["other unique line here"] == 1 and lines["alone without an id"] == 1 and lines["second without an id"] == 1
    assert lines["twice the very same"] == 1 and got[6] == ["a copied row stands here"] * 2 and None in got[1] and got[2] == [""]
    assert line_dedup.without_repeats(df.limit(0), whole=whole).count() == 0


# --- schedule -----------------------------------------------------------------------------------------------------


def test_slots_equal_brute_force_van_der_corput_ranks(spark):
    """Slots are points of the sequence in the sources' shares, numbered in slot order; sources short of points get even slots."""
    sizes = {"a": 9_000, "b": 4_000, "c": 150, None: 70}
    docs = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n // 10)], "k long, source string")
    targets = mixing.source_targets(docs.select("source", F.lit(10).cast("long").alias("size"))).persist()
    block = 16
    rows = {r.number: r for r in targets.collect()}
    n_slots = math.ceil(sum(r.target for r in rows.values()) / block)
    mirror = lambda i: sum((i >> k & 1) / 2 ** (k + 1) for k in range(i.bit_length()))
    want = {}
    for number, r in rows.items():
        words = min(round(r.target), 2 * r.source_size)
        blocks = math.ceil(words / block)
        own = [(i, 0) for i in range(n_slots) if r.low <= mirror(i) < r.high]
        own = own[:blocks] + [(math.floor((b + 0.5) / blocks * n_slots), number) for b in range(len(own), blocks)]
        for b, (slot, turn) in enumerate(own):
            want[number, b] = (slot, turn, min(block, words - b * block))
    got = {(r.number, r.block): (r.slot, r.turn, r.words) for r in mixing.schedule(targets, block).collect()}
    assert got == want
    assert mixing.mixed(spark.createDataFrame([(1, "a b c", "s", 3)], "doc_id long, text string, source string, `of` int")).count() == 2
