"""Mixing sources to target weights with a low-discrepancy schedule.

Sizes are words. A source's documents, in hashed order, are one stream of words, cut into blocks of ``block`` words. Slot
i of the schedule takes the van der Corput point of i, mapped through the cumulative targets, so every stretch of slots
holds the sources nearly in proportion; the slots of a source are ranked, and rank r takes block r modulo the number of
blocks, so that a source is taken whole before it is repeated. A source stops at its target. Sources that the schedule
leaves short of it get the missing slots at the end. Joining slots with the documents' pieces of blocks gives the mix.

Running sums and ranks are taken in two steps, in small parts and then over the parts, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, n_words

#: Bits of a schedule point.
POINT = 40
#: Rows of a part in a running sum; slots of a part in a ranking.
PART_ROWS, PART_SLOTS = 1024, 4096
#: Sources of a part.
PART_SOURCES = 1 << 16
#: The schedule's points are met with the sources in so many equal stretches.
STRETCHES = 4096
#: No document is taken more often than this.
MOST = 3
#: Copies of a row that are written in one step.
STRETCH = 4096


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df with ``part``: parts by the order, of some PART_SOURCES rows, one after the other."""
    parts = 1 + df.count() // PART_SOURCES
    return keep(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")


def _upto(ranged: DataFrame, order: list, **sums: Column) -> DataFrame:
    """ranged with running sums, a row's own value included: in each part, and over the parts."""
    rows = ranged.select("*", *[c.alias(f"own_{n}") for n, c in sums.items()])
    whole = rows.groupBy("part").agg(*[F.sum(f"own_{n}").alias(n) for n in sums])
    before = whole.select(F.col("part").alias("of"), *[(F.sum(n).over(Window.orderBy("part")) - F.col(n)).alias(f"before_{n}") for n in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, F.col("part") == F.col("of"))
    return out.select(*ranged.columns, *[(F.sum(f"own_{n}").over(inside) + F.col(f"before_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sizes (source, source_size) to target (double), goal (long, the target rounded) and goal_upto (goals up to it) of every source.

    The sources, by code point and null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the rest is shared again by weight. In order of size over weight the stopped sources
    come first, so running sums find them. Any number of sources: sums run in parts.
    """
    by_name, by_share, by_place = [F.col("source").asc_nulls_last()], [F.col("per"), F.col("place")], [F.col("place")]
    turn = F.array(*[F.lit(w) for w in weights])
    s = _upto(_ranged(sizes, by_name), by_name, upto=F.lit(1)).withColumn("place", F.col("upto").cast("long") - 1).drop("upto", "part")
    s = s.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    s = _ranged(s.withColumn("per", F.col("source_size") / F.col("weight")), by_share)
    total = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    every, all_weights = (total["size"] or 0), (total["weight"] or 0)
    s = _upto(s, by_share, sizes=F.col("source_size"), weights=F.col("weight"))
    before, past = F.col("sizes") - F.col("source_size"), F.col("weights") - F.col("weight")
    # most * size < weight * (all - most * sizes before) / weights left, without a division
    over = F.col("source_size").cast("decimal(38,0)") * most * (F.lit(all_weights) - past) <= F.col("weight") * (F.lit(every).cast("decimal(20,0)") - before * most)
    s = keep(s.withColumn("over", over).drop("sizes", "weights"), "shares")
    s = keep(_upto(s, by_share, open=(~F.col("over")).cast("int")).withColumn("stopped", F.col("open") == 0).drop("open", "over", "part"), "shares")
    stopped = s.filter("stopped").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, left = every - (stopped["size"] or 0) * most, all_weights - (stopped["weight"] or 0)
    share = F.when(F.col("stopped"), (F.col("source_size") * most).cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(max(left, 1))))
    s = s.withColumn("target", share)
    s = s.select("place", "source", "source_size", "weight", "target", F.least(F.round("target").cast("long"), F.col("source_size") * most).alias("goal"))
    return _upto(_ranged(s, by_place), by_place, goal_upto=F.col("goal")).drop("part")


def point(slot: Column) -> Column:
    """The van der Corput point of a slot, base 2, times 2**POINT: its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), POINT, "0")), 2, 10).cast("long")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """targets() to slots: place (of the source), slot, epoch, block_no, take (the first words of that block)."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("goal")).first()[0] or 0
    slots = -(-total // block)
    if slots >= 1 << POINT:
        raise ValueError("more slots than points; take larger blocks")
    width = 1 << POINT
    line = lambda c: F.floor(c.cast("double") / max(total, 1) * width).cast("long")
    bounds = sources.withColumn("hi", line(F.col("goal_upto"))).withColumn("lo", line(F.col("goal_upto") - F.col("goal"))).filter("hi > lo")
    per = width // STRETCHES
    bounds = bounds.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / per), F.floor((F.col("hi") - 1) / per))))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x")).withColumn("stretch", F.floor(F.col("x") / per))
    drawn = drawn.join(bounds.select("stretch", "lo", "hi", "place"), "stretch").filter("x >= lo AND x < hi")
    drawn = drawn.select("place", "slot", F.floor(F.col("slot") / PART_SLOTS).alias("part"))
    in_part = drawn.groupBy("place", "part").agg(F.count("*").alias("n"))
    before = in_part.withColumn("before", F.sum("n").over(Window.partitionBy("place").orderBy("part")) - F.col("n")).select("place", "part", "before")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy("slot")) - 1).join(before, ["place", "part"])
    ranked = ranked.select("place", "slot", (F.col("rank") + F.col("before")).alias("rank"))
    got = in_part.groupBy("place").agg(F.sum("n").alias("got"))
    whole = F.floor((F.col("source_size") + block - 1) / block)
    need = F.floor(F.col("goal") / F.col("source_size")) * whole + F.floor((F.col("goal") % F.col("source_size") + block - 1) / block)
    sized = sources.filter("source_size > 0 AND goal > 0").join(got, "place", "left").select("place", "source_size", "goal", whole.alias("blocks"), need.alias("need"), F.coalesce("got", F.lit(0)).alias("got"))
    late = sized.filter("need > got").select("place", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    late = late.select("place", (F.col("rank") + slots).alias("slot"), "rank")
    every = ranked.unionByName(late).join(sized.select("place", "source_size", "goal", "blocks"), "place")
    every = every.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block_no", F.col("rank") % F.col("blocks"))
    done = F.col("epoch") * F.col("source_size") + F.col("block_no") * block
    take = F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block, F.col("goal") - done)
    return every.withColumn("take", take).filter("take > 0").select("place", "slot", "epoch", "block_no", "take")


def _row_key(seed: int, *columns: str) -> Column:
    """A seeded hash of the columns that tells a null from a value moved to another column."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = 1024, weights: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, streams, slots). streams: one row per input row, with row_key and the stretch [begin, begin + size) of its source's stream.

    Rows alike in id, source and text share a row_key and stand side by side. Null texts have size 0; a null source is a
    source of its own, the last.
    """
    key = _row_key(seed, id_col, source_col, text_col)
    rows = docs.select(key.alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))
    # repeated rows are one from here until each gets its place
    rows = keep(rows.groupBy("row_key", "doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")
    count = rows.count()
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
    sources = keep(targets(sources, weights), "targets")
    parts = max(1, count // PART_ROWS)
    placed = rows.join(sources.select("place", F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("part", F.pmod(F.shiftrightunsigned("row_key", 16), F.lit(parts)))
    span = F.col("size") * F.col("copies")
    in_part = placed.groupBy("place", "part").agg(F.sum(span).alias("words"))
    before = in_part.withColumn("before", F.sum("words").over(Window.partitionBy("place").orderBy("part")) - F.col("words")).select("place", "part", "before")
    running = F.sum(span).over(Window.partitionBy("place", "part").orderBy("row_key", F.col("doc_id"), "size")) - span
    streams = placed.withColumn("running", running).join(before, ["place", "part"])
    streams = streams.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    streams = streams.select("row_key", "copy", "copies", "doc_id", "place", "source", "size", "source_size", "target", (F.col("before") + F.col("running") + F.col("copy") * F.col("size")).cast("long").alias("begin"))
    return sources, keep(streams, "streams"), keep(schedule(sources, block), "slots")


def pieces(streams: DataFrame, slots: DataFrame, block: int = 1024) -> DataFrame:
    """The mix: slot, row_key, copy, from_word, to_word (in the document), for every piece of a document that a slot takes."""
    parts = streams.filter("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    met = parts.join(slots, ["place", "block_no"])
    start = F.greatest("begin", F.col("block_no") * block)
    end = F.least(F.col("begin") + F.col("size"), F.col("block_no") * block + F.col("take"))
    return met.withColumn("start", start).withColumn("end", end).filter("end > start").select("slot", "row_key", "copy", "size", (F.col("start") - F.col("begin")).alias("from_word"), (F.col("end") - F.col("begin")).alias("to_word"))


def mix(docs: DataFrame, block: int = 1024, **columns) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have size 0 and are not taken; a null source is a source; repeated rows have a place each; very long texts span
    many blocks. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    _, streams, slots = plan(docs, block=block, **columns)
    taken = pieces(streams, slots, block).groupBy("row_key", "copy").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return streams.join(taken, ["row_key", "copy"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = 1024, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs, each row as often as the mix takes it: its words taken over its size, rounded. Only the document at a source's end is cut, so only it is rounded.

    Rows alike in id, source and text are dealt what their copies are taken, as evenly as can be, the first by their other columns
    as JSON. Null and wordless texts have no words and are not taken. An empty table gives an empty one. Columns of any type and name stay.
    """
    _, streams, slots = plan(docs, id_col, text_col, source_col, seed, block, weights)
    taken = pieces(streams, slots, block).groupBy("row_key", "copy").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.first("size").alias("size"))
    often = taken.withColumn("often", F.round(F.col("taken") / F.col("size")).cast("long")).groupBy("row_key").agg(F.sum("often").alias("often")).filter("often > 0")
    copies = streams.groupBy("row_key").agg(F.first("copies").alias("copies"))
    often = keep(often.join(copies, "row_key").withColumnRenamed("row_key", "taken_key"), "often")
    rows = docs.select(_row_key(seed, id_col, source_col, text_col).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(often.hint("merge"), rows["row_key"] == often["taken_key"])  # dealt out by rows at any size
    out = met.filter("copies = 1").select("row", "often")
    if often.filter("copies > 1").limit(1).count():
        # equal rows become one before their key's rows meet; a variant then has a stretch of the key's copies
        alike = met.filter("copies > 1").groupBy("row_key", F.to_json("row").alias("variant")).agg(F.first("row").alias("row"), F.count("*").alias("n"), F.first("often").alias("often"), F.first("copies").alias("copies"))
        begin = F.sum("n").over(Window.partitionBy("row_key").orderBy("variant")) - F.col("n")
        more = F.col("often") % F.col("copies")
        times = F.col("n") * F.floor(F.col("often") / F.col("copies")) + F.greatest(F.lit(0), F.least(F.col("n"), more - F.col("begin")))
        alike = alike.withColumn("begin", begin).withColumn("times", times.cast("long")).filter("times > 0")
        # many copies are written by many tasks, STRETCH of them in each step
        steps = alike.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / STRETCH)))).repartition("row_key", "step")
        out = out.unionByName(steps.select("row", F.least(F.lit(STRETCH), F.col("times") - F.col("step") * STRETCH).alias("often")))
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("often").cast("long"))))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
