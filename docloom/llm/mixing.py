"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import fresh, join_groups, stage, table

#: Weights by rank of the source, repeating, and the most passes over a source.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: A block holds a 2**20th of all words, 1 to 1,024: small tables are cut finely, large ones in blocks of 1,024.
SLOT_BITS = 20
MOST_WORDS = 1024
#: Rows that are ordered in one task: a bucket of a source's shuffle or schedule.
BUCKET_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def bit_reversed(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse, van der Corput's order of the grid points."""
    return F.conv(F.reverse(F.lpad(F.bin(value), max(bits, 1), "0")), 2, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """(key, source, source_size, rows) with rank, weight and target of each source.

    Sources rank by code point, null last. A target is the smaller of ``passes`` times the size
    and level times weight; the level makes the targets add up to all sizes. In the order of
    size over weight, the sources that hit their limit are a prefix, so running sums find it.
    This table has one row per source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights)).cast("int") + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * passes).withColumn("total", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("full", F.col("most") <= level * F.col("weight"))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    level = left / F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")).cast("double")).drop("most", "total", "full", "weight")


def _offsets(rows: DataFrame, bucket: Column, order: Sequence[str], size: str, name: str) -> DataFrame:
    """Running sum of ``size`` before each row of its source; buckets are summed first, then each is ordered alone."""
    tagged = rows.withColumn("_bucket", bucket)
    sums = tagged.groupBy("src", "_bucket").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("src", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tagged.join(sums, ["src", "_bucket"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_bucket", "_base")


def _bits(n: int) -> int:
    return max(int(n - 1).bit_length(), 0) if n > 0 else 0


def schedule(sources: DataFrame, slots: int, count: int, spark: SparkSession) -> DataFrame:
    """The schedule: (position, src, slot_rank) of ``slots`` slots over ``count`` sources.

    Grid point v of ``slots`` lies at v / slots and maps through the cumulative shares
    (``first_slot``, ``n_slots`` of each source); its position is its place in van der Corput's
    order, so each source's slots are spread evenly over any stretch of the schedule.
    """
    bits = _bits(slots)
    cell_bits = max(bits - max(_bits(count), 10), 0)
    points = spark.range(slots).select(F.col("id").alias("v"), F.shiftright("id", cell_bits).alias("cell"), bit_reversed(F.col("id"), bits).alias("position"))
    last = F.col("first_slot") + F.col("n_slots") - 1
    shares = sources.where("n_slots > 0").select(
        "src", "first_slot", last.alias("last_slot"), F.explode(F.sequence(F.shiftright("first_slot", cell_bits), F.shiftright(last, cell_bits))).alias("cell")
    )
    placed = points.join(shares, "cell").where(F.col("v").between(F.col("first_slot"), F.col("last_slot"))).select("position", "src")
    bucket_bits = min(_bits(slots // BUCKET_ROWS + 1), bits)
    ranked = _offsets(placed.withColumn("one", F.lit(1)), F.shiftright("position", bits - bucket_bits), ["position"], "one", "slot_rank")
    return ranked.select("position", "src", "slot_rank")


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """How many words the mix takes from each row, and its schedule.

    ``rows`` holds row (unique), source, size and shuffle (a hash that gives each source's order).
    Each source is a stream of its shuffled rows, cut into blocks of equal numbers of words; the
    source's n-th slot takes its n-th block, from the first again after the last. The last slot
    takes what the target still lacks, so a source gives its target, rounded down, and no row is
    taken more than ``passes`` times. Returns (row, source_size, target, taken) for every row,
    and (position, src, slot_rank, pass, block) for every slot.

    Null sources form one source, the last. Rows of size 0 are taken 0 times; a table without
    words or without rows has an empty schedule.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    sizes = keyed.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    total_rows, total, count = sizes.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    words = max(1, min(MOST_WORDS, total >> SLOT_BITS))
    size, wanted = F.col("source_size"), F.floor("target").cast("long")
    sources = source_targets(sizes, weights, passes).where(F.col("source_size") >= 0)
    sources = sources.withColumn("n_blocks", F.ceil(size / words).cast("long")).withColumn("whole", F.when(size > 0, F.expr(f"floor(target) div source_size")).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.when(size > 0, wanted - F.col("whole") * size).otherwise(0).cast("long"))
    sources = sources.withColumn("n_slots", (F.col("whole") * F.col("n_blocks") + F.ceil(F.col("rest") / words)).cast("long"))
    running = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    sources = stage(sources.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(running), F.lit(0))), "sources")
    slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

    facts = sources.select("src", "n_blocks", "whole", "rest", F.col("n_slots").alias("in_source"))
    plan = join_groups(schedule(sources, slots, count, spark), facts, "src", "in_source", slots, "position")
    plan = plan.withColumn("pass", F.expr("slot_rank div n_blocks")).withColumn("block", F.expr("slot_rank % n_blocks"))
    rest = F.when(F.col("pass") == F.col("whole"), F.least(F.lit(words), F.col("rest") - F.col("block") * words)).otherwise(0)
    blocks = plan.groupBy("src", "block").agg(F.sum(F.when(F.col("pass") < F.col("whole"), 1).otherwise(0)).alias("times"), F.sum(rest).alias("first_words"))

    known = join_groups(keyed.select("row", "key", "size", "shuffle"), sources.select("key", "src", "source_size", "target", "n_rows"), "key", "n_rows", total_rows, "row")
    bucket = F.shiftrightunsigned("shuffle", 64 - max(_bits(total_rows // BUCKET_ROWS + 1), 1))
    streams = _offsets(known.select("row", "src", "size", "shuffle").where("size > 0"), bucket, ["shuffle", "row"], "size", "start")
    stop = F.col("start") + F.col("size")
    pieces = streams.select("row", "src", "start", stop.alias("stop"), F.explode(F.sequence(F.expr(f"start div {words}"), F.expr(f"(start + size - 1) div {words}"))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * words, F.lit(0))
    high = F.least(F.col("stop") - F.col("block") * words, F.lit(words))
    taken = pieces.select("row", "src", "block", low.alias("low"), high.alias("high")).join(blocks, ["src", "block"])
    part = F.col("times") * (F.col("high") - F.col("low")) + F.greatest(F.least("high", "first_words") - F.col("low"), F.lit(0))
    taken = taken.groupBy("row").agg(F.sum(part).cast("long").alias("taken"))
    out = known.select("row", "source_size", "target").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out, plan.select("position", "src", "slot_rank", "pass", "block")


def sized(docs: DataFrame, text: str, doc_id: str, source: str, keep: Sequence[str], name: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` staged with a row id, its number of words and its place in the shuffle; ``keep`` names the columns to carry."""
    new: dict[str, str] = {}
    for base in ("row", "size", "shuffle"):
        new[base] = fresh([*docs.columns, *new.values()], base)
    count = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.xxhash64(F.xxhash64(doc_id), F.xxhash64(text))
    return stage(docs.select(*keep, F.monotonically_increasing_id().alias(new["row"]), count.alias(new["size"]), hashed.alias(new["shuffle"])), name), new


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its words are taken, rounded; same columns."""
    rows, new = sized(docs, text, doc_id, source, docs.columns, "mixed")
    takes, _ = mix(rows.select(F.col(new["row"]).alias("row"), F.col(source).alias("source"), F.col(new["size"]).alias("size"), F.col(new["shuffle"]).alias("shuffle")))
    times = takes.select(F.col("row").alias(new["row"]), F.col("taken").alias(fresh(rows.columns, "taken")))
    taken = times.columns[1]
    found = rows.join(times, new["row"]).withColumn(taken, F.round(F.col(taken) / F.greatest(new["size"], F.lit(1))).cast("int")).where(F.col(taken) > 0)
    copy = fresh(found.columns, "copy")
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(taken)))).select(*docs.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size, its source's size and target, words taken."""
    rows, new = sized(table(spark, sf_dir, "documents"), "text", "doc_id", "source", ["doc_id", "source"], "sizes")
    takes, _ = mix(rows.select(F.col(new["row"]).alias("row"), "source", F.col(new["size"]).alias("size"), F.col(new["shuffle"]).alias("shuffle")))
    found = rows.select("doc_id", F.col(new["row"]).alias("row"), F.col(new["size"]).alias("size")).join(takes, "row")
    return found.select("doc_id", "size", "source_size", "target", "taken")
