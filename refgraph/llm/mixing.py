"""Mixing sources to target weights.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, ...; the words of all documents are shared by weight, and no
source is taken more than MOST times: what lies above goes to the others by weight until none is above.

Every source is dealt into blocks by a hash of its ids; block order and the order in a block are the permutation that draws
follow. A source's target gives its quota of block draws: whole passes over all blocks, then the first ones of one more pass,
the last of them and its last document cut to the word. A splitting tree divides these quotas among the output shards: at each
node the draws of the left half are a multivariate-hypergeometric sample of the node's draws, down to one shard, so that every
shard has an exact number of draws and each source its exact quota. The shards draw disjoint runs of a source's permuted
blocks; what a document gives to the mix are the draws of its block, and nothing else. Inside a shard, copies are ordered by
another hash (of seed, id and pass).

Nothing is drawn on the driver: a node of the tree puts its draws (a row for each block and pass, not for each document) in the
order of a hash, in one task a node; sources are ordered in one task, one row each. Nothing else is windowed over a whole source: sums run over the blocks of a source and over the rows of a block,
and blocks grow in number with the rows (BLOCK_ROWS).

Nulls: a null text has no words; a null source is a source of its own, the last; a null id is hashed as an empty one. Texts
without words, empty ones too, are never copied. Very long texts count whole; at most one document of a source is cut. Ties:
rows of one id lie in one block, in order of size. Rows that repeat are rows of their own. Without any word all targets are 0.
An empty table gives an empty result. Other columns are ignored by mix() and kept by mixed_documents(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, words, written

#: A source is taken at most so many times.
MOST = 3
#: Blocks of a source: 2 to this power at least, and so many that a source with all the rows has this number of them in a block.
BLOCK_BITS, BLOCK_ROWS = 10, 1 << 14
SHARDS = 16
#: Up to so many blocks (100 bytes each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_BLOCKS = 100_000
#: Runs of a shard's order that may lie in different tasks: 2 to this power.
RUN_BITS = 10


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds place, weight and target to rows (source, source_size), one per source. The cap binds for the sources with the
    least size per weight, so the level that the others share follows from running sums in that order."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    placed = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", (F.col("place") - 1) % 3 + 1)
    by_cap = Window.orderBy(MOST * F.col("source_size") / F.col("weight"), F.col("place"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = placed.withColumn("level", level)
    # Capping a source that lies above the level raises it, capping one below it lowers it: the right one is the highest.
    open_ = F.max("level").over(Window.partitionBy())
    return leveled.withColumn("target", F.least(F.lit(float(MOST)) * F.col("source_size"), F.coalesce(open_, F.lit(0.0)) * F.col("weight")).cast("double")).drop("level")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, shard, first, end) from (place, quota): of the draws 0 .. quota - 1 of each place a shard gets those from first on,
    before end; shards without draws of a place have no row.

    A tree over the shards: a node gives its left half the share of its draws that its shards are of the node's, taken without
    replacement, as the ones that a hash of the node puts first. So what a half has of each place is a multivariate-hypergeometric
    sample of what the node has."""
    items = quotas.where("quota > 0").select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("item"), F.lit(0).alias("low"), F.lit(shards).alias("high"))
    wide = shards
    while wide > 1:
        middle, node = F.floor((F.col("low") + F.col("high")) / 2).cast("int"), Window.partitionBy("low", "high")
        lot = F.md5(F.concat_ws(":", F.lit(seed), "low", "high", "place", "item"))
        half = F.floor(F.count(F.lit(1)).over(node) * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        items = items.withColumns({"middle": middle, "left": F.row_number().over(node.orderBy(lot, "place", "item")) <= half})
        one = F.col("high") - F.col("low") == 1
        items = items.select("place", "item", F.when(one | F.col("left"), F.col("low")).otherwise(F.col("middle")).alias("low"), F.when(one | ~F.col("left"), F.col("high")).otherwise(F.col("middle")).alias("high"))
        wide = (wide + 1) // 2
    counts = items.groupBy("place", F.col("low").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("place", "shard", (end - F.col("n")).alias("first"), end.alias("end"))


def _same(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join in which null equals null; the keys of left stay."""
    renamed = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return left.join(renamed, same, how).drop(*(f"r_{k}" for k in keys))


def _key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _block(key: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")


def _order(id_col: Column, draw: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("order"), F.coalesce(id_col.cast("string"), F.lit("")), draw)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, seed: int, least_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, source, of, size, key, block) of docs; blocks (source, block, before, words, source_size, target, passes, rest,
    draws) with draws (pass, shard) of each block; and the bits of a block number."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(f"`{text_col}`").alias("of"), n_words(F.col(f"`{text_col}`")).alias("size"))
    rows = written(rows.withColumn("key", _key(F.col("id"), seed)), "mix-rows")
    bits = min(31, max(least_bits, (rows.count() // BLOCK_ROWS).bit_length()))
    rows = rows.withColumn("block", _block(F.col("key"), bits))

    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("block_rank", F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1)
    running = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))), "mix-blocks")
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("n_blocks")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = written(sources.withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-sources")

    known = _same(blocks, sources, "source")
    drawn = known.groupBy("place").agg((F.max(F.col("passes") * F.col("n_blocks")) + F.sum((F.col("before") < F.col("rest")).cast("long"))).alias("quota"))
    runs = split_quotas(drawn, shards, seed)
    # a shard's run of draws, of which there are block count times passes
    draws = runs.select("place", "shard", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("draw"))
    draws = draws.join(sources.select("place", "n_blocks"), "place").groupBy("place", (F.col("draw") % F.col("n_blocks")).alias("block_rank"))
    draws = draws.agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("draw") / F.col("n_blocks")).alias("pass"), "shard"))).alias("draws"))
    known = known.join(draws, ["place", "block_rank"], "left").withColumn("draws", F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>")))
    return rows, written(known.select("source", "block", "before", "words", "source_size", "target", "passes", "rest", "draws"), "mix-draws"), bits


def _copies(id_col: Column, size: Column, part: Column, seed: int) -> Column:
    """What the draws of a row's block take of it: (shard, order, words), the last pass only its part."""
    taken = F.transform("draws", lambda d: F.struct(d["shard"].alias("shard"), _order(id_col, d["pass"], seed).alias("order"), F.when(d["pass"] < F.col("passes"), size).otherwise(part).alias("words")))
    return F.filter(taken, lambda c: c["words"] != 0)


def _part(rows: DataFrame) -> DataFrame:
    """Adds part: the words of each row that lie before the end of its source's last pass."""
    in_block = Window.partitionBy("source", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(in_block), F.lit(0)))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows (id_col, source, size, source_size, target, taken, copies), one per row of docs. taken: words that the mix takes,
    repeats counted: the sum of the words of copies. copies: (shard, order, words), whole ones and at last a cut one."""
    rows, blocks, _ = _drawn(docs, id_col, text_col, source_col, shards, seed, bits)
    placed = _part(_same(rows, blocks, "source", "block")).withColumn("copies", _copies(F.col("id"), F.col("size"), F.col("part"), seed))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = 0, bits: int = BLOCK_BITS, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """The mix itself: the rows and columns of docs, each as often as it is taken, dealt out by shard and sorted by its order. A
    copy that is cut holds the document's first words, joined by one space."""
    rows, blocks, bits = _drawn(docs, id_col, text_col, source_col, shards, seed, bits)
    cut = (F.col("passes") * F.col("source_size") < F.col("target")) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    blocks = blocks.where(F.size("draws") > 0).select("source", "block", "before", "rest", "passes", "draws", cut.alias("cut"))
    few = blocks.limit(broadcast_blocks + 1).count() <= broadcast_blocks
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    of_doc = lambda c: F.col("doc").getField(c)
    held = docs.select(doc).withColumns({"id": of_doc(id_col), "source": of_doc(source_col).cast("string"), "block": _block(_key(of_doc(id_col), seed), bits)})
    held = _same(held, F.broadcast(blocks) if few else blocks, "source", "block")

    some = F.when(n_words(of_doc(text_col)) > 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")  # of words: -1 stands for the whole text
    whole = held.where("not cut").withColumn("copies", _copies(F.col("id"), some, some, seed))
    # the one block of a source that its last pass ends in: each row takes the row of the plan with its id, source and text
    nth = lambda order: F.row_number().over(Window.partitionBy("id", "source", "of").orderBy(order))
    ends = _part(_same(rows, blocks.where("cut"), "source", "block")).select("id", "source", "of", "part", "size").withColumn("nth", nth(F.col("part")))
    others = F.to_json(F.struct(*(of_doc(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col)))
    last = held.where("cut").withColumn("of", F.xxhash64(of_doc(text_col))).withColumn("nth", nth(F.xxhash64(others)))
    all_ = F.when(F.col("size") > 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    last = _same(last, ends, "id", "source", "of", "nth").withColumn("copies", _copies(F.col("id"), all_, F.when(F.col("part") == F.col("size"), all_).otherwise(F.col("part")), seed))
    taken = whole.select("doc", F.explode("copies").alias("copy")).union(last.select("doc", F.explode("copies").alias("copy")))

    run = F.shiftrightunsigned("copy.order", 64 - RUN_BITS)
    dealt = taken.select("doc", F.col("copy.words").alias("take"), F.col("copy.shard").alias("shard"), run.alias("run"), F.col("copy.order").alias("order"))
    dealt = dealt.repartition("shard", "run").sortWithinPartitions("shard", "run", "order")
    text = F.when(F.col("take") < 0, of_doc(text_col)).otherwise(F.array_join(F.slice(words(of_doc(text_col)), F.lit(1), F.col("take").cast("int")), " "))
    return dealt.select(*((text if c == text_col else of_doc(c)).alias(c) for c in docs.columns))
