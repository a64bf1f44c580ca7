"""Mixing sources to target weights with a low-discrepancy schedule over equal-token blocks.

Each source's documents, in a hashed order, form an endless stream that is cut off after two rounds and cut
into blocks of ``BLOCK`` words. Slot ``i`` of the schedule belongs to the source whose share of the cumulated
targets holds the van der Corput point of ``i``; the ``k``-th slot of a source takes its ``k``-th block. Every
stretch of the schedule therefore holds all sources near their weights, reruns agree, and no document is
taken more than twice. A source gives its target, rounded to words, so its last block is partial; points beyond
its blocks stay void, and blocks beyond its points stand at even distances after the slots there, with ``turn`` not 0.
As a source's slots take its blocks in order, they cover a prefix of its stream; ``scheduled`` joins the blocks'
pieces of documents in the order of ``slot, turn``.

Only DataFrame functions are used. Positions in a stream and ranks in the schedule are two-level prefix sums:
a total per (source, bucket), then a window inside one bucket, so a source with a third of all rows is spread
over as many tasks as the others. Only the table of sources meets in one task.

Null or empty texts have size 0 and are never taken. A null source is a source, ordered last. Repeated rows
are documents of their own. Other columns are carried along by ``mixed`` and ignored by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeframe.core.shared import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
ROUNDS = 2
BLOCK = 256
BUCKET = 10_000
GRID = 1 << 12
_BITS = 44


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, number, n, source_size, target, low, high`` of each source of ``sizes(source, size)``.

    Weights go by the order of the sources. Targets share ``SHARE`` of all words by weight; those above
    ``ROUNDS`` times their source stop there and the rest is shared again. The capped sources are the first
    ones by size over weight, so one ordered pass finds them. ``low`` and ``high`` cumulate the targets.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("number", F.row_number().over(first)).withColumn(
        "weight", F.element_at(weights, (F.col("number") - 1) % len(WEIGHTS) + 1).cast("double")
    )
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(float(ROUNDS)) * F.col("source_size")
    rest = F.lit(SHARE) * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / left).withColumn("rank", F.row_number().over(by_ratio))
    per = per.withColumn("free", F.min(F.when(cap > F.col("level") * F.col("weight"), F.col("rank"))).over(whole))
    level = F.max(F.when(F.col("rank") == F.col("free"), F.col("level"))).over(whole)
    capped = F.col("free").isNull() | (F.col("rank") < F.col("free"))
    per = per.withColumn("target", F.when(capped, cap).otherwise(level * F.col("weight")))
    total = F.sum("target").over(whole)
    upto = F.sum("target").over(Window.orderBy("number"))
    return per.select(
        "source", "number", "n", "source_size", "target",
        F.when(total > 0, (upto - F.col("target")) / total).alias("low"),
        F.when(total > 0, F.when(upto >= total, 2.0).otherwise(upto / total)).alias("high"),
    )


def van_der_corput(i: Column) -> Column:
    """The binary digits of ``i`` mirrored at the point, exact in a double."""
    mirrored = F.reverse(F.lpad(F.bin(i), _BITS, "0"))
    return F.conv(mirrored, 2, 10).cast("double") / F.lit(float(1 << _BITS))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, turn, number, block, words``: which block of which source each slot takes; void slots are left out."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    n_slots = int(-(-total // block))
    chunk = 1 << max(8, (n_slots.bit_length() + 1) // 2)  # slots of a chunk and chunks of a source both follow the square root
    slots = spark.range(0, n_slots).withColumnRenamed("id", "slot").withColumn("x", van_der_corput(F.col("slot")))
    slots = slots.withColumn("cell", F.floor(F.col("x") * GRID))
    last = F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1).cast("long"))
    needed = targets.withColumn("covered", covered_words()).where("covered > 0")
    spans = needed.select("number", "low", "high", "covered", F.explode(F.sequence(F.floor(F.col("low") * GRID), last)).alias("cell"))
    owned = slots.join(spans, "cell").where("x >= low and x < high").withColumn("chunk", F.floor(F.col("slot") / chunk))
    counts = owned.groupBy("number", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    points = counts.groupBy("number").agg(F.sum("c").alias("points"))
    counts = counts.select("number", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = owned.withColumn("inner", inner).join(counts, ["number", "chunk"])
    ranked = ranked.select("slot", F.lit(0).cast("long").alias("turn"), "number", (F.col("base") + F.col("inner")).alias("block"), "covered")
    blocks = F.ceil(F.col("covered") / block)
    left = needed.join(points, "number", "left").fillna(0, ["points"]).withColumn("blocks", blocks).where("points < blocks")
    left = left.select("number", "covered", "blocks", F.explode(F.sequence(F.col("points"), F.col("blocks") - 1)).alias("block"))
    even = F.floor((F.col("block") + 0.5) / F.col("blocks") * n_slots)
    ranked = ranked.unionByName(left.select(even.alias("slot"), F.col("number").cast("long").alias("turn"), "number", "block", "covered"))
    words = F.least(F.lit(block).cast("long"), F.col("covered") - F.col("block") * block)
    return ranked.withColumn("words", words).where("words > 0").drop("covered")


def covered_words() -> Column:
    """A source's target in whole words."""
    return F.least(F.round("target").cast("long"), ROUNDS * F.col("source_size"))


def mixture(docs: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, slot, turn, block`` for every row, and the columns of ``carry`` as ``_name``.

    ``taken_first`` and ``taken_again`` split ``taken`` by round; each is a prefix of the document's words. ``slot``
    and ``turn`` hold the place in the schedule of ``block``, the source's block in which the document begins.
    """
    rows, slots = _places(docs, block, carry)
    begins = F.when(F.col("taken_first") > 0, F.floor(F.col("start") / block))
    placed = rows.withColumn("block", begins).join(slots.drop("words"), ["number", "block"], "left")
    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("taken_first") + F.col("taken_again")).alias("taken"), "slot", "turn", "block",
        "taken_first", "taken_again", *(f"_{c}" for c in carry),
    )


def _places(docs: DataFrame, block: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``number``, ``start`` in their source's stream and words taken, and the schedule."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        *(F.col(f"`{c}`").alias(f"_{c}") for c in carry),
    )
    targets = materialise(source_targets(rows.select("source", "size")), "mix-targets")
    slots = materialise(schedule(targets, block), "mix-slots")
    targets = targets.withColumn("covered", covered_words())
    n = targets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET))

    place = F.xxhash64("doc_id", F.lit(17))
    bucket = F.floor((place / F.lit(2.0**64) + F.lit(0.5)) * buckets)
    lookup = targets.select(F.col("source").alias("wanted_source"), "number", "source_size", "target", "covered")
    rows = rows.withColumns({"place": place, "bucket": bucket}).join(lookup, F.col("source").eqNullSafe(F.col("wanted_source")))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.select("number", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")), "mix-buckets")
    inside = Window.partitionBy("number", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["number", "bucket"])
    start = F.col("base") + F.col("inner")
    clamp = lambda at: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("covered") - at))
    rows = rows.withColumns({"taken_first": clamp(start), "taken_again": clamp(start + F.col("source_size"))})
    return rows.withColumn("start", start), slots


def split_words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, joined by spaces."""
    return F.array_join(F.slice(split_words(text), F.lit(1), n.cast("int")), " ")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each round in which a document is taken.

    A document taken in part, of which each source has one at most, holds its first words only.
    """
    taken = mixture(docs, block, tuple(docs.columns)).withColumn("words", F.explode(F.array("taken_first", "taken_again")))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("_text"), F.col("words"))).otherwise(F.col("_text"))
    cut = taken.where("words > 0").withColumn("_text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("_n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def scheduled(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in its order: ``slot, turn, block, at`` and the columns of ``docs``, a row for each piece of a document in a block.

    Sorted by ``slot, turn, at``, the texts are the mixed stream; ``at`` is the piece's place in its source's stream.
    """
    rows, slots = _places(docs, block, tuple(docs.columns))
    rounds = F.explode(
        F.array(
            F.struct(F.col("start").alias("from"), F.col("taken_first").alias("words")),
            F.struct((F.col("start") + F.col("source_size")).alias("from"), F.col("taken_again").alias("words")),
        )
    )
    rows = rows.select("*", rounds.alias("r")).withColumns({"start": F.col("r.from"), "words": F.col("r.words")}).where("words > 0")
    end = F.col("start") + F.col("words")

    def pieces(words: Column) -> Column:  # the text is split once for all of its pieces
        def piece(b: Column) -> Column:
            at = F.greatest(F.col("start"), b * block)
            n = F.least(end, (b + 1) * block) - at
            return F.struct(b.alias("block"), at.alias("at"), F.array_join(F.slice(words, (at - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("text"))

        return F.transform(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)), piece)

    cut = F.element_at(F.transform(F.array(split_words(F.col("_text"))), pieces), 1)
    rows = rows.select("number", *(f"_{c}" for c in docs.columns if c != "text"), F.explode(cut).alias("p"))
    rows = rows.select("*", "p.block", "p.at", F.col("p.text").alias("_text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("_n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rows.join(slots, ["number", "block"]).select("slot", "turn", "block", "at", *(F.col(f"_{c}").alias(c) for c in docs.columns))
