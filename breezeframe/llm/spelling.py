"""Words one edit apart, by dynamic programming over sorted word lists, and the form that each word leads to.

A list is sorted and scanned once for each of its words. The edit matrix of the word and a listed word needs
three cells a row (distances of one edit at most), and row ``k`` depends on the first ``k`` letters of the listed
word only. So rows up to the common prefix of neighbours (LCP) are reused, and where a row has no cell of one or less,
all following words with that prefix are skipped, by links to the next smaller LCP. A scan begins behind
the word itself, whose own rows are known, so each pair meets once.

The lists come from halves: of two words one edit apart, the shorter of ``s`` letters, either the first ``s // 2`` letters
agree or the last ``s - s // 2`` do. Words are dealt by such prefixes, and reversed by such suffixes, so
every pair meets in exactly one list and is reported for one half only. A list of more than ``LIST`` words is cut by
hash into parts, and each pair of parts is scanned as a list of its own, so a prefix with a third of
all words is spread over tasks, no task holds more than two parts, and no pair is lost.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased in A-Z. Null and empty texts have none; a null id
deletes no letter. Counts cover all rows, repeated ones too. Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

SLIPS = 199
SHORTEST, LEAST, RATIO = 6, 5, 5
LIST = 2048
TASK_ROWS = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word with at least ``SHORTEST`` letters and ``LEAST`` occurrences, slips applied."""
    text = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.col("doc_id").alias("doc_id"), F.explode(F.split(text, "[^a-zÀ-ÿ]+")).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIPS == 0, without).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST)


def _halves(length: Column) -> Column:
    """``(backward, size)`` of the halves a word is dealt by: as the shorter or equal word, and as the longer by one."""
    own, less = F.floor(length / 2).cast("int"), F.floor((length - 1) / 2).cast("int")
    pairs = [(own, length - own), (less, length - 1 - less)]
    entry = lambda backward, size: F.struct(F.lit(backward).alias("backward"), size.cast("int").alias("size"))
    return F.array_distinct(F.array(*(entry(k == 1, pair[k]) for pair in pairs for k in (0, 1))))


def lists(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """``backward, size, half, cell, queries, word, n``: every word in each list it must be compared in."""
    spread = vocabulary.select("word", "n", F.explode(_halves(F.length("word"))).alias("h"))
    spelt = F.when(F.col("h.backward"), F.reverse("word")).otherwise(F.col("word"))
    spread = spread.select("h.backward", "h.size", F.substring(spelt, F.lit(1), F.col("h.size")).alias("half"), spelt.alias("word"), "n")
    key = ["backward", "size", "half"]
    counts = spread.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    large = materialise(counts.select(*key, F.ceil(F.col("rows") / (most // 2)).cast("int").alias("parts")), "spelling-large")
    split = spread.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    cells = split.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cell = F.when(low == high, -1 - low.cast("long")).otherwise(low.cast("long") * F.col("parts") + high)  # below zero: one part by itself
    queries = (F.col("own") == high) & (low != high)
    return cells.select(*key, cell.alias("cell"), queries.alias("queries"), "word", "n")


def prefixes(listed: list[str]) -> tuple[list[int], list[int]]:
    """Of each word of a sorted list: the length of the prefix shared with the word before, and the next place with a shorter one."""
    shared = [0] * len(listed)
    for i in range(1, len(listed)):
        a, b = listed[i - 1], listed[i]
        k, end = 0, min(len(a), len(b))
        while k < end and a[k] == b[k]:
            k += 1
        shared[i] = k
    following, waiting = [len(listed)] * len(listed), []
    for i, k in enumerate(shared):
        while waiting and shared[waiting[-1]] > k:
            following[waiting.pop()] = i
        waiting.append(i)
    return shared, following


def one_edit_away(word: str, listed: list[str], shared: list[int], following: list[int], start: int = -1) -> list[int]:
    """Places in a sorted list of the words at edit distance one; behind ``start`` if ``word`` stands there, else all."""
    m, padded, found = len(word), word + "\0\0", []
    # Row k: distances of the listed word's first k letters to the first k - 1, k, k + 1 of the word.
    rows = [(2, 0, 1)] + [(1, 0, 1)] * m if start >= 0 else [(2, 0, 1)]
    depth, i, n = len(rows) - 1, start + 1, len(listed)
    while i < n:
        if shared[i] < depth:
            depth = shared[i]
        other = listed[i]
        if not -2 < len(other) - m < 2:
            i += 1
            continue
        del rows[depth + 1 :]
        a, b, c = rows[depth]
        for k in range(depth, len(other)):
            letter = other[k]
            # Cells (k, k - 1), (k, k), (k, k + 1) from the row above: substitution, deletion, insertion.
            below = a if k and padded[k - 1] == letter else a + 1
            if b + 1 < below:
                below = b + 1
            same = b if padded[k] == letter else b + 1
            if c + 1 < same:
                same = c + 1
            if below + 1 < same:
                same = below + 1
            above = c if padded[k + 1] == letter else c + 1
            if same + 1 < above:
                above = same + 1
            a, b, c = below, same, above
            rows.append((a, b, c))
            if a > 1 and b > 1 and c > 1:
                break
        depth = len(rows) - 1
        if a > 1 and b > 1 and c > 1:
            i += 1
            while i < n and shared[i] >= depth:
                i = following[i]
            continue
        if (a, b, c)[m - len(other) + 1] == 1:
            found.append(i)
        i += 1
    return found


def _once(a: str, b: str, backward: bool, size: int) -> bool:
    """Whether a pair is to be reported by the list of this half: the first half decides where both agree."""
    short = min(len(a), len(b))
    first = short // 2
    if not backward:
        return size == first
    return size == short - first and a[len(a) - first :] != b[len(b) - first :]


def _list_pairs(key: tuple, listed: list[tuple[str, int]], asking: list[tuple[str, int]]) -> Iterator[tuple[str, str, int]]:
    """``(word, near word, its count)`` of both words of every pair of a part, or of a part and the part that asks it."""
    backward, size, _, cell = key
    names = [w for w, _ in listed]
    shared, following = prefixes(names)
    spell = (lambda w: w[::-1]) if backward else (lambda w: w)
    for place, (word, n) in enumerate(listed if cell < 0 else asking):
        for i in one_edit_away(word, names, shared, following, place if cell < 0 else -1):
            if _once(word, names[i], backward, size):
                yield spell(word), spell(names[i]), listed[i][1]
                yield spell(names[i]), spell(word), n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists arrive whole and sorted, one after another, across batches; a list of two parts has its asking part last."""
    key, listed, asking, out = None, [], [], []

    def packed() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    for batch in batches:
        for *now, queries, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    out.extend(_list_pairs(key, listed, asking))
                key, listed, asking = now, [], []
                if len(out) > 50_000:
                    yield packed()
                    out.clear()
            (asking if queries else listed).append((word, n))
    if key is not None:
        out.extend(_list_pairs(key, listed, asking))
    yield packed()


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of words one edit apart, once each."""
    dealt = lists(vocabulary, most)
    key = ["backward", "size", "half", "cell"]
    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    dealt = dealt.select(*key, "queries", "word", "n").repartition(tasks, *key).sortWithinPartitions(*key, "queries", "word")
    return dealt.mapInArrow(_scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the table ``word, form``, whose forms lead nowhere back: the last form of each word.

    Every round doubles the steps taken; each step multiplies counts by ``RATIO``, so rounds are few.
    """
    reached = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("to"))
        longer = materialise(reached.join(further, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-roots")
        reached = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, most: int = LIST) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word: its commonest near word, if that is ``RATIO`` times as common."""
    vocabulary = materialise(words(docs), "spelling-words")
    near = near_words(vocabulary, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    found = vocabulary.join(near, "word", "left")
    leads = -F.col("best.less") >= RATIO * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"),
        F.when(leads, -F.col("best.less")).alias("form_n"),
    )
    found = materialise(found, "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
