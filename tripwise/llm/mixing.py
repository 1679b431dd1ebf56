"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwise.llm.common import KEY_BITS, WORD, packed, seeded_key, tidy, whole
from tripwise.operators.staging import as_lookup, lookup_join, materialize

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCKS = 1024
TREE_DEPTH = 5


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def _stratum(source: Column) -> Column:
    """A join key that is never null and tells a null source from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def measured(documents: DataFrame, size: Column, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", blocks: int = BLOCKS, seed: str = SEED) -> DataFrame:
    """Each row with `_stratum`, `_size`, `_key` (a seeded number) and `_block`, all made where the row is read."""
    key = seeded_key(seed, F.col(id_col), F.md5(whole(F.col(text_col))))
    return documents.select(packed(documents), F.col(source_col).alias("_source"), size.alias("_size"), key.alias("_key")).select(
        "_row", "_source", _stratum(F.col("_source")).alias("_stratum"), "_size", "_key",
        F.pmod("_key", F.lit(blocks)).cast("int").alias("_block"))


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add `place` (order of the source), `all_sizes` and `target` to a table of `source`, `stratum`, `source_size`.

    Sources in order (null last) take the weights in turn. A target stops at `most` times the source's size, and what is
    over goes to the others by weight until none is above. Seen from the source that fills up first, those that stop are
    a prefix: each is full if its share of what the ones before leave over reaches its limit. One row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = totals.withColumn("place", place).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    table = table.withColumn("all_sizes", F.sum("source_size").over(everything))
    left = F.col("all_sizes") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    table = table.withColumn("level", left / F.sum("weight").over(onward))
    full = F.col("level") * F.col("weight") >= F.col("limit")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * level)
    return table.withColumn("target", target).drop("weight", "limit", "level")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` from `total`, of which `marked` are marked, are marked: the quantile of `u`, as bigint.

    Walks the distribution up from twelve deviations below the mean to twelve above (less than 1e-30 lies outside), by the
    ratio of each probability to the one before: once for the sum of the masses, once to the share `u` of it.
    """
    total, marked, drawn = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = drawn * marked / F.greatest(total, F.lit(1.0))
    spread = 12 * F.sqrt(mean * (total - marked) * (total - drawn) / F.greatest(total * (total - 1), F.lit(1.0))) + 1
    low = F.ceil(F.greatest(F.lit(0.0), drawn + marked - total, mean - spread)).cast("bigint")
    high = F.floor(F.least(marked, drawn, mean + spread)).cast("bigint")
    values = F.sequence(low, F.greatest(low, high))

    def ratio(x: Column) -> Column:
        x = x.cast("double")
        return (marked - x) * (drawn - x) / ((x + 1) * (total - marked - drawn + x + 1))

    masses = F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("mass")), lambda acc, x: F.struct(
        (acc["sum"] + acc["mass"]).alias("sum"), (acc["mass"] * ratio(x)).alias("mass")))
    wanted = u * masses["sum"]
    start = F.struct(low.alias("found"), F.lit(0.0).alias("below"), F.lit(1.0).alias("mass"), wanted.alias("wanted"))
    return F.aggregate(values, start, lambda acc, x: F.struct(
        F.when(acc["below"] < acc["wanted"], x).otherwise(acc["found"]).alias("found"), (acc["below"] + acc["mass"]).alias("below"),
        (acc["mass"] * ratio(x)).alias("mass"), acc["wanted"].alias("wanted")))["found"]


def split_quotas(quotas: DataFrame, depth: int = TREE_DEPTH, seed: str = SEED) -> DataFrame:
    """`shard`, `quota` (array of bigint by source) for 2^depth shards, from one row with `quota` for all of them.

    Each node of a binary tree deals its blocks to two halves: the left half draws its number of blocks without
    replacement, source after source, each by the hypergeometric law given what is drawn already. So the blocks of every
    source are dealt out exactly, and shard totals differ by one at most.
    """
    nodes = quotas.select(F.lit(0).cast("bigint").alias("shard"), "quota")

    def drawing(level: int):
        def draw(acc: Column, item: Column) -> Column:
            hashed = F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), item["i"])
            u = F.pmod(hashed, F.lit(1 << 52)).cast("double") / float(1 << 52)
            got = hypergeometric(acc["total"], item["q"], acc["drawn"], u)
            return F.struct((acc["total"] - item["q"]).alias("total"), (acc["drawn"] - got).alias("drawn"),
                            F.concat(acc["left"], F.array(got)).alias("left"))
        return draw

    for level in range(depth):
        size = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, q: a + q)
        # the half with one more block alternates, or the leftmost shard would get one more at every level
        half = F.floor((F.col("size") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard")), F.lit(2))) / 2).cast("bigint")
        start = F.struct(F.col("size").alias("total"), half.alias("drawn"), F.array().cast("array<bigint>").alias("left"))
        items = F.transform("quota", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
        nodes = nodes.withColumn("size", size).withColumn("left", F.aggregate(items, start, drawing(level))["left"])
        right = F.zip_with("quota", "left", lambda q, x: q - x)
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quota")),
                         F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quota")))
        nodes = nodes.select(F.explode(halves).alias("half")).select("half.*")
    return nodes


def plan_mix(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, depth: int = TREE_DEPTH, seed: str = SEED) -> DataFrame:
    """One row for each block: `_stratum`, `_block`, `source_size`, `target` and `copies`, an array of
    struct(epoch, shard, cut) with one item for each time the mix takes the block.

    A source takes whole passes over its blocks and then, in a seeded order of blocks, as many as fit the rest of its
    target. The block in which the target ends is taken in part: its rows up to the key `cut`. Only block totals and
    the rows of those last blocks are ever grouped.
    """
    blocks = rows.groupBy("_stratum", "_source", "_block").agg(F.sum("_size").alias("size"))
    blocks = materialize(blocks, "mix-blocks")
    sources = targets(blocks.groupBy("_stratum", F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")),
                      weights, most)
    blocks = blocks.drop("_source").join(sources.drop("source"), "_stratum")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    order = Window.partitionBy("_stratum").orderBy(seeded_key(seed + "-blocks", F.col("_stratum"), F.col("_block")), "_block")
    blocks = blocks.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    blocks = blocks.withColumn("nth", F.row_number().over(order) - 1).withColumn(
        "end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy("_stratum")))
    partial = (F.col("end") - F.col("size") < F.col("rest")) & (F.col("end") > F.col("rest"))
    more = (F.col("end") <= F.col("rest")) | partial
    blocks = materialize(blocks.select(
        "_stratum", "_block", "place", "source_size", "target", "nth", "blocks", "passes", partial.alias("partial"),
        (F.col("rest") - (F.col("end") - F.col("size"))).alias("room"), (F.col("passes") + more.cast("int")).alias("times")), "mix-plan")

    tidy(rows.sparkSession)
    last = as_lookup(blocks.filter("partial").select("_stratum", "_block", "room"))
    running = Window.partitionBy("_stratum", "_block").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    ends = lookup_join(rows.select("_stratum", "_block", "_key", "_size"), last, ["_stratum", "_block"], "inner")
    ends = ends.withColumn("upto", F.sum("_size").over(running)).filter("upto <= room")
    cuts = ends.groupBy("_stratum", "_block").agg(F.max("_key").alias("cut"))

    quota = blocks.groupBy("place").agg(F.sum("times").alias("q"))
    quota = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "q"))), lambda x: x["q"]).alias("quota"))
    per_shard = materialize(split_quotas(quota, depth, seed), "mix-quotas").select(
        "shard", F.posexplode("quota").alias("place", "n"))
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    per_shard = per_shard.withColumn("upto", F.sum("n").over(upto)).filter("n > 0")
    slots = per_shard.select("place", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("turn"))

    # turn t of a source is block t mod blocks, in the seeded order, of pass t div blocks: shards get disjoint runs of turns
    turns = blocks.filter("times > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("epoch"))
    turns = turns.withColumn("turn", F.col("epoch") * F.col("blocks") + F.col("nth"))
    turns = turns.join(slots, ["place", "turn"]).join(cuts, ["_stratum", "_block"], "left")
    no_cut, none_fits = F.lit(1 << KEY_BITS), F.lit(-1)
    cut = F.when(F.col("partial") & (F.col("epoch") == F.col("passes")), F.coalesce("cut", none_fits)).otherwise(no_cut)
    copies = turns.groupBy("_stratum", "_block").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "shard", cut.cast("bigint").alias("cut")))).alias("copies"))
    return blocks.select("_stratum", "_block", "source_size", "target").join(copies, ["_stratum", "_block"], "left")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add `source_size`, `target` and `copies` (struct(epoch, shard), one for each time the mix takes the row)."""
    taken = F.filter(F.coalesce("copies", F.array().cast("array<struct<epoch:bigint,shard:bigint,cut:bigint>>")),
                     lambda c: F.col("_key") <= c["cut"])
    lookup = as_lookup(plan, stage="mix-lookup")
    return lookup_join(rows, lookup, ["_stratum", "_block"], "inner").withColumn("copies", taken)


def mix_table(documents: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Sizes are counts of words. Null texts have size 0 and are never short of room; null sources are one source, null ids
    values like any other. Rows that are equal in id and text are taken alike, so a source that consists of copies of
    one row may miss its target by as much as these copies weigh. An empty table gives no rows; a corpus without words
    has targets of 0.
    """
    narrow = measured(documents.select("doc_id", "text", "source"), word_count(F.col("text")), seed=seed).select(
        F.col("_row.doc_id").alias("doc_id"), "_source", "_stratum", "_size", "_key", "_block")
    narrow = materialize(narrow, "mix-rows")
    rows = with_copies(narrow, plan_mix(narrow, weights, most, seed=seed))
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                       (F.col("_size") * F.size("copies")).alias("taken"))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, depth: int = TREE_DEPTH, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: a row for each time a document is taken, with all its columns (as `row`), its output `shard` and
    a seeded `turn` by which `local_shuffle` orders the shard."""
    rows = measured(documents, word_count(F.col(text_col)), id_col, text_col, source_col, seed=seed)
    narrow = materialize(rows.drop("_row"), "mix-rows")
    drawn = with_copies(rows, plan_mix(narrow, weights, most, depth, seed))
    each = drawn.select("_row", "_key", F.explode("copies").alias("copy"))
    return each.select(F.col("_row").alias("row"), F.col("copy.shard").alias("shard"),
                       F.xxhash64(F.lit(seed), "_key", "copy.epoch").alias("turn"))


def local_shuffle(mixed: DataFrame, parts_per_shard: int = 1) -> DataFrame:
    """Bring each output shard into its seeded order; a large shard may be cut into consecutive parts of that order."""
    part = F.pmod(F.shiftrightunsigned("turn", 40), F.lit(parts_per_shard))
    return mixed.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn")
