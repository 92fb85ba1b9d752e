"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of equal token blocks are dealt to sources by golden-ratio points mapped
through cumulative weights; a source's slots are ranked, and rank r takes the
r-th block of that source's shuffled, endlessly repeated stream of words. What a
source gives is what its slots take: no slot is added and none taken away.
Everything here is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import WORD, saved

#: Points lie on a circle of this many steps; the golden section of it is the stride (odd, so all points are met).
CIRCLE, STRIDE = 1 << 32, 1640531527
#: Slots that are dealt together, slots of a source that meet its blocks together, and cells of the circle by which points meet sources.
CHUNK, GROUP, CELLS = 4096, 4096, 4096
#: Chunks whose slots a task makes, and tasks at most.
TASK_CHUNKS, MOST_TASKS = 64, 20_000
#: Up to so many sources their arcs and targets go to every task; beyond, rows are shuffled to them.
MOST_SOURCES = 100_000
#: Rows of a hash range of a source's stream, and ranges whose sums are added up in one go.
RANGE_ROWS, RANGES = 500, 4096


def n_words(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """k, source, source_size, weight, target and the source's arc of the circle.

    Sources in code-point order, null last, weigh ``weights``, repeating. A
    target stops at ``max_repeats`` times its source; what is over goes to the
    others by weight. One row a source, so these windows are as small as the
    list of sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("k", F.row_number().over(by_name))
    cycle = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("k") - 1) % len(weights) + 1).cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources fill up in the order of cap by weight: the level is right for the first one that stays under its cap.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ).cast("double")
    ranked = ranked.withColumn("level", level).withColumn("i", F.row_number().over(fill))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("i", "level"))
    right = F.min(fits).over(everything)["level"]
    ranked = ranked.withColumn("target", F.least(F.col("cap").cast("double"), right * F.col("weight")))
    total = F.sum("target").over(everything)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("hi", F.when(total > 0, F.round(F.sum("target").over(upto) / total * CIRCLE)).cast("long"))
    ranked = ranked.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0)))
    return ranked.select("k", "source", "source_size", "weight", "target", "lo", "hi")


def prefix(sums: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The rows with ``before``: the sum of ``value`` over the rows of their keys with a smaller ``at`` (a long, different in each row of a key).

    Added up in two steps, within and over runs of RANGES numbers, so that no task orders all rows of a key.
    """
    rows = sums.withColumn("_run", F.floor(F.col(at) / RANGES).cast("long"))
    whole = rows.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(whole, [*keys, "_run"]).withColumn("before", (F.col("_before") + F.col("_inside")).cast("long")).drop("_run", "_inside", "_before")


def schedule(plan: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix in groups: k (source), part, ``slots``: the source's slots of rank part * GROUP and on, in order.

    Slot i is the point i * STRIDE on the circle; it belongs to the source on
    whose arc it lies. There are as many slots as blocks fit into the whole mix,
    the last one begun; low discrepancy leaves each source a few blocks off its
    target at most, and the mix is what the slots say.
    """
    n = math.ceil(round(plan.agg(F.sum("target").alias("words")).collect()[0].words or 0.0, 3) / block_words)
    n_chunks = -(-n // CHUNK)
    # One row a chunk, dealt so that a task makes the slots of some chunks and groups them where they are.
    chunks = plan.sparkSession.range(n_chunks).select(F.col("id").alias("chunk")).repartition(min(MOST_TASKS, max(1, n_chunks // TASK_CHUNKS)), "chunk")
    slots = (
        chunks.select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.lit(n - 1), F.col("chunk") * CHUNK + (CHUNK - 1)))).alias("slot"))
        .withColumn("point", (F.col("slot") % CIRCLE) * STRIDE % CIRCLE)
        .withColumn("cell", F.floor(F.col("point") / (CIRCLE // CELLS)).cast("long"))
    )
    width = CIRCLE // CELLS
    arcs = plan.where("hi > lo").select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") - 1) / width).cast("long"))).alias("cell"))
    # A row a source and CELLS more: checked, as slots must not be the side that is sent around.
    arcs = F.broadcast(arcs) if plan.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else arcs.hint("merge")
    dealt = slots.join(arcs, "cell").where("point >= lo AND point < hi")
    # At most CHUNK slots a row; the counts of earlier chunks give each its first rank.
    groups = saved(dealt.groupBy("k", "chunk").agg(F.sort_array(F.collect_list("slot")).alias("own")))
    firsts = prefix(groups.select("k", "chunk", F.size("own").cast("long").alias("n")), ["k"], "chunk", "n").select("k", "chunk", F.col("before").alias("first"))
    ranked = groups.join(firsts, ["k", "chunk"])
    # A chunk's slots have ranks in one part or in two that follow one another.
    part = F.floor(F.col("first") / GROUP).cast("long")
    room = ((part + 1) * GROUP - F.col("first")).cast("int")
    first = F.struct(part.alias("part"), F.slice("own", 1, F.least(room, F.size("own"))).alias("own"))
    second = F.struct((part + 1).alias("part"), F.slice("own", room + 1, F.size("own") - room).alias("own"))
    cut = F.when(F.size("own") <= room, F.array(first)).otherwise(F.array(first, second))
    pieces = ranked.select("k", F.explode(cut).alias("piece")).select("k", "piece.*")
    # Slots grow with ranks, so the order of the first ones is that of the ranks.
    return pieces.groupBy("k", "part").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("own")[0].alias("at"), "own"))), lambda x: x["own"])).alias("slots"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    block_words: int = 32,
) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken (words the mix takes, repeats counted), n_slots and first_slot.

    A document is taken as far as it lies in blocks that a slot of its source
    takes: ``n_slots`` such slots hold a word of it, ``first_slot`` is the first
    one's place in the mix (null if there is none). A source's stream is its
    shuffled words, ``max_repeats`` times over and no more, so a document is
    taken ``max_repeats`` times its size at most.

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own. Rows that repeat an id are mixed each by itself, other
    columns are ignored. An empty table gives no rows; a source without words
    has target 0. A hot source is spread over hash ranges of some RANGE_ROWS
    rows, whose sums give the offsets.
    """
    sizes = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    plan = saved(targets(sizes, weights, max_repeats))
    of = plan.select("k", F.col("source").alias("s"), "source_size", "target")
    of = F.broadcast(of) if plan.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else of.hint("merge")
    placed = positions(sizes.join(of, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rounds = F.sequence(F.lit(0), F.when(F.col("size") > 0, F.lit(max_repeats - 1)).otherwise(F.lit(0)))
    some = placed.withColumn("round", F.explode(rounds)).withColumn("from", F.col("start") + F.col("round") * F.col("source_size"))
    # The blocks that hold words of the document, in groups of ranks; documents without words have none, and are spread over parts of their own.
    some = some.withColumn("to", F.col("from") + F.col("size"))
    span = block_words * GROUP
    parts = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / span).cast("long"), F.floor((F.col("to") - 1) / span).cast("long"))).otherwise(F.array(-1 - F.pmod(F.xxhash64("id", "row"), F.lit(1 << 20))))
    pieces = some.withColumn("part", F.explode(parts)).withColumn("a", F.greatest("from", F.col("part") * span)).withColumn("b", F.least("to", (F.col("part") + 1) * span))
    # Groups of slots grow with the words; they are never broadcast, however small Spark takes them to be.
    met = pieces.join(schedule(plan, block_words).hint("merge"), ["k", "part"], "left")
    # The ranks of a group are held without gaps, from its first one on.
    reach = F.col("part") * span + F.coalesce(F.size("slots"), F.lit(0)).cast("long") * block_words
    words = F.when(F.col("size") > 0, F.greatest(F.least("b", reach) - F.col("a"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    rank = F.floor((F.col("a") - F.col("part") * span) / block_words).cast("int")
    met = met.withColumn("words", words).withColumn("slot", F.when(F.col("words") > 0, F.col("slots")[rank]))
    blocks = F.when(F.col("words") > 0, F.floor((F.col("a") + F.col("words") - 1) / block_words) - F.floor(F.col("a") / block_words) + 1).otherwise(0)
    keys = ["k", "start", "id", "source", "size", "source_size", "target", "row"]
    taken = met.groupBy(*keys).agg(F.sum("words").cast("long").alias("taken"), F.sum(blocks.cast("long")).alias("n_slots"), F.min("slot").alias("first_slot"))
    return taken.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "n_slots", "first_slot")


def positions(rows: DataFrame) -> DataFrame:
    """Each row's first word in its source's shuffled stream, ``start``, and its number ``row`` among the rows with that start's hash range.

    The order is a hash of the id, then id and size. A source has as many hash ranges as make RANGE_ROWS rows each.
    """
    most = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).collect()[0].n or 0
    digits = 1
    while most > RANGE_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("b", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    offsets = prefix(rows.groupBy("k", "b").agg(F.sum("size").alias("n")), ["k"], "b", "n").select("k", "b", F.col("before").alias("offset"))
    inside = Window.partitionBy("k", "b").orderBy("h", "id", "size")
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(inside))
    return rows.join(offsets, ["k", "b"]).withColumn("start", F.col("offset") + F.col("inside")).drop("h", "b", "offset", "inside")
