"""Mixing sources to target weights by Pareto order sampling.

Size is counted in words.  Sources in code-point order (null last) get the
weights in turn; targets share all words by weight, stop at ``max_copies``
times a source's own words, and the excess is reshared until none is above.

Within a source, every document gets ``floor(target / words)`` certain whole
copies.  The words still missing are drawn: a document of size class
``h = floor(log2(words))`` has inclusion probability ``p = min(1, c * (h + 1))``,
with ``c`` set so that the expected words are the missing ones, and documents
are taken in ascending order of the random odds ``u / (1 - u)`` divided by the
inclusion odds ``p / (1 - p)``.  The sample's fixed size is a number of words:
the order is followed up to the document that brings the sum nearest to what
is missing.  ``u`` comes from the md5 of the seed and the document id.

Ranks are never sorted as a whole: three rounds of histograms of the order's
key narrow each source's cut-off down to a 2**-36 part of the key's range, and
only what lies there is sorted.  A document's copies then follow from its own row and its
source's row, so the texts are not shuffled.

Defined cases: null and empty texts have size 0 and are never taken; null
sources are one source; rows without id draw by the hash of their text; of rows
alike in id, text and source each draws for itself, by its place in the table;
an empty table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, word_count, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix"

#: Source tables of up to this many rows are broadcast; larger ones are joined.
BROADCAST_SOURCES = 20_000
#: Each round of histograms cuts the key's range in so many parts.
PARTS, ROUNDS = 1 << 12, 3


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add ``weight`` and ``target`` to a table of distinct ``source`` and ``words``.

    The number of sources may be large: their order is numbered range by range.
    """
    spark = sources.sparkSession
    path = new_path(spark, "mix-order")
    has, name = F.col("source").isNull().cast("int"), F.coalesce("source", F.lit(""))
    ordered = sources.repartitionByRange(has, name).sortWithinPartitions(has, name)
    ordered.select("source", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")).write.parquet(path)
    table = spark.read.schema("source string, words long, part int, row long").parquet(path)
    # One row per partition, as many as there are shuffle partitions at most.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).drop("n")
    inner = F.row_number().over(Window.partitionBy("part").orderBy("row"))
    place = F.pmod(F.col("before") + inner - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), place + 1)
    table = written(table.join(F.broadcast(parts), "part").select("source", "words", weight.cast("long").alias("weight")), "mix-weights")

    total = table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    # Reshare: sources whose share is above their cap stop there; two sums a round.
    capped = F.lit(False)
    cap = F.col("words") * max_copies
    done = -1
    while True:
        rest, free, n = table.agg(
            F.lit(total) - F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(capped.cast("int")), F.lit(0)),
        ).first()
        share = F.col("weight") * F.lit(float(rest)) / F.lit(float(free)) if free else F.lit(0.0)
        if n == done or not free:
            break
        # A share only grows from round to round, so what stopped stays stopped.
        done, capped = n, share > cap
    return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def uniform(id_col: Column, text_hash: Column, seed: str = SEED, place: Column | None = None) -> Column:
    """A number above 0 and under 1 from the md5 of seed, id (or text hash) and, where it is not null, a place."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.concat(F.lit("t"), text_hash.cast("string"))))
    key = key if place is None else F.concat(key, F.coalesce(F.concat(F.lit(":"), place.cast("string")), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def size_class(words: Column) -> Column:
    """``floor(log2(words))`` by integer arithmetic; 0 for no words."""
    return F.length(F.bin(F.greatest(words, F.lit(1)))) - 1


def order_key(u: Column, p: Column) -> Column:
    """``k / (1 + k)`` of the Pareto key ``k``: random odds over inclusion odds."""
    safe = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))
    k = (u / (F.lit(1.0) - u)) / (safe / (F.lit(1.0) - safe))
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0)).otherwise(k / (F.lit(1.0) + k))


def _with_rates(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: certain copies, missing words and the factor ``c``.

    ``classes`` has the words per source and size class, a few dozen rows a source.
    ``c`` is found from the largest class down: the classes from ``j`` up stop at
    probability 1 where the factor that the others then need would pass it.
    """
    base = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0)).cast("long")
    s = targets.withColumn("base", base).withColumn("missing", F.when(F.col("words") > 0, F.col("target") - F.col("base") * F.col("words")).otherwise(F.lit(0.0)))
    packed = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("h", "class_words")), asc=False).alias("cs"))
    j = s.join(packed, s["source"].eqNullSafe(packed["source"])).drop(packed["source"])
    # Fold over classes, largest first: (words stopped at 1, weight of the rest, factor).
    weight = "aggregate(cs, cast(0 as bigint), (a, x) -> a + (x.h + 1) * x.class_words)"
    fold = f"""aggregate(cs, named_struct('sure', cast(0 as bigint), 'load', {weight}, 'c', cast(null as double)),
        (a, x) -> CASE
          WHEN a.c IS NOT NULL THEN a
          WHEN a.load <= 0 THEN named_struct('sure', a.sure, 'load', a.load, 'c', cast(0.0 as double))
          WHEN (missing - a.sure) / cast(a.load as double) * (x.h + 1) <= 1.0D
            THEN named_struct('sure', a.sure, 'load', a.load, 'c', (missing - a.sure) / cast(a.load as double))
          ELSE named_struct('sure', a.sure + x.class_words, 'load', a.load - (x.h + 1) * x.class_words, 'c', cast(null as double))
        END)"""
    return j.withColumn("fit", F.expr(fold)).select("source", "words", "weight", "target", "base", "missing", F.col("fit.c").alias("c"))


#: What a row draws by: its id, the hash of its text, its source.
_DRAWS_BY = ["hs_mix_id", "hs_mix_text", "hs_mix_source"]


def _with_draws(rows: DataFrame, alike: DataFrame | None, seed: str) -> DataFrame:
    """Add ``u`` to rows with ``_DRAWS_BY`` and ``hs_mix_place``; ``alike``: what several rows draw by."""
    place = None
    if alike is not None:
        same = [F.coalesce(rows[c].cast("string"), F.lit("")) == F.coalesce(alike[c].cast("string"), F.lit("")) for c in _DRAWS_BY]
        nulls = [rows[c].isNull() == alike[c].isNull() for c in _DRAWS_BY]
        on = same[0]
        for c in same[1:] + nulls:
            on = on & c
        marked = alike.withColumn("hs_mix_alike", F.lit(True))
        rows = rows.join(marked, on, "left").select(*(rows[c] for c in rows.columns), "hs_mix_alike")
        place = F.when(F.col("hs_mix_alike"), F.col("hs_mix_place"))
    made = rows.withColumn("u", uniform(F.col("hs_mix_id"), F.col("hs_mix_text"), seed, place))
    return made.drop("hs_mix_alike")


def _drawn_by(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").cast("long").alias("hs_mix_id"), F.xxhash64(text).alias("hs_mix_text"), F.col(f"`{source_col}`").cast("string").alias("hs_mix_source"), F.monotonically_increasing_id().alias("hs_mix_place"), word_count(text).alias("size")]


def mix_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED) -> tuple[DataFrame, DataFrame, int, DataFrame | None]:
    """The compact table of documents, the table of sources with their cut-offs, its length, and what several rows draw by.

    The compact table has ``doc_id, source, size, h, u``; a document is taken
    ``base + 1`` times if its ``(v, tie)`` is not above its source's cut-off.
    """
    narrow = written(_with_draws(docs.select(*_drawn_by(docs, id_col, text_col, source_col)), None, seed), "mix-rows")
    alike = written(narrow.filter("size > 0").groupBy(*_DRAWS_BY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "mix-alike")
    alike = None if alike.isEmpty() else alike
    drawn = narrow if alike is None else written(_with_draws(narrow.drop("u"), alike, seed), "mix-drawn")
    compact = drawn.select(F.col("hs_mix_id").alias("doc_id"), F.col("hs_mix_source").alias("source"), "size", "u", size_class(F.col("size")).alias("h"))
    classes = written(compact.groupBy("source", "h").agg(F.sum("size").alias("class_words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_words").alias("words")), weights, max_copies)
    sources = written(_with_rates(classes, targets), "mix-sources")
    n = sources.count()

    # Narrow each source's cut-off: the part of the key's range in which its
    # cumulative words pass what is missing, then a part of that, and so on.
    live = compact.join(_small(sources.select(F.col("source").alias("s"), "c", "missing"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    live = live.withColumn("v", keyed(F.col("c"))).filter("size > 0").select("source", "missing", "size", "u", "v")
    taken = F.lit(0).cast("long")
    for level in range(1, ROUNDS + 1):
        cell = F.floor(F.col("v") * float(PARTS**level)).cast("long")
        cells = live.withColumn("cell", cell)
        if level > 1:
            cells = cells.join(_small(edge, n), (F.col("source").eqNullSafe(F.col("s"))) & (F.floor(F.col("v") * float(PARTS ** (level - 1))).cast("long") == F.col("at"))).drop("s", "at")
        else:
            cells = cells.withColumn("before", taken)
        sums = cells.groupBy("source", "cell", "missing", "before").agg(F.sum("size").alias("size"))
        running = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        # Cells wholly under the missing words are taken; the cut-off lies in the next.
        reached = sums.withColumn("upto", running).filter(F.col("upto") > F.col("missing"))
        first = reached.groupBy("source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("size")).alias("before")), "cell").alias("x"))
        edge = written(first.select(F.col("source").alias("s"), F.col("x.cell").alias("at"), F.col("x.before").alias("before")), f"mix-edge{level}")
    inside = live.join(_small(edge, n), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("v") * float(PARTS**ROUNDS)).cast("long") == F.col("at")))
    ties = inside.groupBy("source", "missing", "before", "v", "u", "at").agg(F.sum("size").alias("size"))
    running = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("v", "u").rowsBetween(Window.unboundedPreceding, 0))
    told = ties.withColumn("upto", running).withColumn("takes", F.col("upto") + F.col("upto") - F.col("size") <= 2 * F.col("missing"))
    last = told.groupBy("source", "at").agg(F.max(F.when(F.col("takes"), F.struct("v", "u"))).alias("last"))
    cut = last.select(F.col("source").alias("s"), F.coalesce(F.col("last.v"), F.col("at") / float(PARTS**ROUNDS)).alias("cut_v"), F.coalesce(F.col("last.u"), F.lit(-1.0)).alias("cut_u"))
    # A source without an edge misses at least all its documents' words.
    every = sources.join(_small(cut, n), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    every = every.withColumn("cut_v", F.coalesce("cut_v", F.when(F.col("missing") > 0, F.lit(2.0)).otherwise(F.lit(-1.0)))).withColumn("cut_u", F.coalesce("cut_u", F.lit(-1.0)))
    return compact, written(every, "mix-cuts"), n, alike


def keyed(c: Column) -> Column:
    return order_key(F.col("u"), F.least(F.lit(1.0), c * (F.col("h") + 1)))


def copies(base: Column, c: Column, cut_v: Column, cut_u: Column) -> Column:
    """How often a row with ``size, h, u`` is taken."""
    v = keyed(c)
    drawn = (v < cut_v) | ((v == cut_v) & (F.col("u") <= cut_u))
    return F.when(F.col("size") > 0, base + drawn.cast("long")).otherwise(F.lit(0).cast("long"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``."""
    compact, sources, n, _ = mix_plan(docs, id_col, text_col, source_col, **how)
    j = compact.join(_small(sources.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    k = copies(F.col("base"), F.col("c"), F.col("cut_v"), F.col("cut_u"))
    return j.withColumn("copies", k).select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    seed = how.get("seed", SEED)
    _, sources, n, alike = mix_plan(docs, id_col, text_col, source_col, **how)
    mine = ["hs_mix_s", "hs_mix_base", "hs_mix_c", "hs_mix_v", "hs_mix_u"]
    cuts = sources.select(*(F.col(a).alias(b) for a, b in zip(["source", "base", "c", "cut_v", "cut_u"], mine)))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("hs_mix_row"), *_drawn_by(docs, id_col, text_col, source_col))
    packed = _with_draws(packed, alike, seed).withColumn("h", size_class(F.col("size")))
    j = packed.join(_small(cuts, n), F.col("hs_mix_source").eqNullSafe(F.col("hs_mix_s")))
    k = copies(*(F.col(x) for x in mine[1:]))
    often = j.withColumn("hs_mix_copies", k).filter("hs_mix_copies > 0").withColumn("hs_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("hs_mix_copies"))))
    return often.select(*(F.col("hs_mix_row")[c].alias(c) for c in docs.columns))
