"""Sharding by balanced label propagation, law `rows`: shard sizes in rows are at most one apart.

Documents are linked when their texts are equal; a group is kept as the tally of its members over shards, so that no pair is
ever made. Documents start in shards dealt by hash. The groups above one part in HEAVY of a shard, at most HEAVY for each
shard, are placed by the driver, largest first: whole in the fullest shard that holds them, else over the emptiest ones, as few
as possible. Of all other groups the members of one shard are a part. In each round the parts are joined with the labels that
their neighbours have now, counted anew: a part asks for the shard where most members of its group are, among those
that heavy groups leave room in, ties by hash. How many
may move is settled for each pair of shards: as many as ask for the way back, and as many more as the shard has room, a share
of the parts by hash. Parts that meet become one. Rounds end when the edges between shards are no longer fewer, or after ROUNDS.
Groups that are still in several parts then go whole to a shard by the room left. Members move together. Documents without neighbours then fill the room that
is left. At the end the rows stand in order of shard and group, in each shard between two halves of the documents without
neighbours, and that line is cut into even parts; it moves only what stands over the quotas, and each border cuts at most one
group of those that were placed whole.

Rows of heavy groups meet their shards by broadcast and are ordered in blocks by row, all others by group; so no task holds
more than a small part of a shard.

Nulls: a null text has no bytes and is equal to an empty one; a null id comes first in its group. Very long texts are only
hashed and measured. Ties, of shards and of groups, go by hash. Rows that repeat are rows of their own. With fewer rows than
shards the last shards stay empty. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS, ROUNDS = 24, 6
#: A group above one part in so many of a shard is placed by the driver.
HEAVY = 64
#: Blocks of the final order: parts of a shard by group, and parts by row of a heavy group in a shard.
GROUP_BLOCKS, ROW_BLOCKS = 256, 64
PLACED = "g1 long, g2 long, heavy int, tos array<int>, ends array<double>"


def _lot(salt: str, *keys: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _by_room(room: list[float], lot: Column) -> Column:
    """A shard in proportion to the room; all alike if there is none."""
    room = room if sum(room) > 0 else [1.0] * len(room)
    ends, at = [], 0.0
    for r in room:
        at += r / sum(room)
        ends.append(at)
    return F.least(F.lit(len(room) - 1), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= lot)))


def place_heavy(groups: list[tuple[int, dict[int, int]]], left: list[float]) -> list[list[tuple[int, float]]]:
    """groups: (size, members by shard), largest first. The shards of each group with the rows that they take; left is taken from."""
    out = []
    for size, parts in groups:
        rest, taken = float(size), []
        while rest > 0:
            fits = [s for s, r in enumerate(left) if r >= rest]
            if fits:  # of a split group the rest stays beside the last piece
                s = min(fits, key=lambda s: (bool(taken) and s - 1 != taken[-1][0], left[s], -parts.get(s, 0), s))
            else:
                s = max(range(len(left)), key=lambda s: (left[s], -s))
            piece = rest if fits or left[s] < 1e-6 else left[s]
            taken.append((s, piece))
            left[s] -= piece
            rest -= piece
        out.append(taken)
    return out


def accepted(wish: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of the members that ask to go from shard to shard, the share that may: what is asked for the way back, and what there is room
    for. No shard takes in more than it gives up and has room for."""
    go = np.minimum(wish, wish.T)
    rest = wish - go
    coming = rest.sum(axis=0)
    go = go + rest * np.minimum(1, room / np.maximum(coming, 1e-9))
    return np.divide(go, wish, out=np.zeros_like(go), where=wish > 0)


def propagate(rows: DataFrame, shards: int, rounds: int) -> DataFrame:
    """rows: (id, g1, g2, u, shard, ...). Gives rows with their new shard, heavy (the number of a heavy group, or null) and alone (in no group)."""
    spark = rows.sparkSession
    room = max(1.0, rows.count() / shards)
    tally = rows.groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n"))
    part = F.struct((-F.col("n")).alias("less"), F.xxhash64("g1", "g2", "shard").alias("tie"), "shard")
    groups = written(tally.groupBy("g1", "g2").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(part)).alias("parts")).where("size > 1"), "shard-groups")

    big = F.col("size") > F.lit(room / HEAVY)
    heavy = sorted(groups.where(big).collect(), key=lambda r: (-r["size"], r["g1"], r["g2"]))  # at most HEAVY for each shard
    left = [room] * shards
    taken = place_heavy([(r["size"], {p["shard"]: -p["less"] for p in r["parts"]}) for r in heavy], left)
    ends = lambda pieces, size: [sum(n for _, n in pieces[: k + 1]) / size for k in range(len(pieces))]
    placed = spark.createDataFrame([(r["g1"], r["g2"], k, [s for s, _ in t], ends(t, r["size"])) for k, (r, t) in enumerate(zip(heavy, taken, strict=True))], PLACED)

    few = groups.where(~big).select("g1", "g2", "size")
    parts = written(tally.join(few, ["g1", "g2"]), "shard-parts")  # n members of a group of `size` have the label `shard`
    takes = F.get(F.array(*(F.lit(r >= 1) for r in left)), F.col("shard"))  # shards that heavy groups fill take nothing in
    least = None
    for k in range(rounds):
        order = F.struct(takes.alias("takes"), "n", F.xxhash64("g1", "g2", "shard").alias("tie"))
        most = parts.groupBy("g1", "g2").agg(F.max_by("shard", order).alias("to"))
        asked = parts.join(most, ["g1", "g2"])
        flows = asked.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("size") - F.col("n"))).alias("cut")).collect()  # a row for each pair of shards
        cut = sum(r["cut"] for r in flows) // 2
        if not cut or (least is not None and cut >= least):
            break
        least, wish, held = cut, np.zeros((shards, shards)), np.zeros(shards)
        for r in flows:
            held[r["shard"]] += r["n"]
            wish[r["shard"], r["to"]] += r["n"] * (r["shard"] != r["to"])
        share = F.array(*(F.array(*map(F.lit, x)) for x in accepted(wish, np.maximum(0, np.array(left) - held)).tolist()))
        goes = _lot(f"go {k}", "g1", "g2", "shard") < F.get(F.get(share, F.col("shard")), F.col("to"))
        moved = asked.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard")))
        parts = written(moved.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n"), F.first("size").alias("size")), f"shard-round{k}")
    stays = (F.col("n") == F.col("size")) & takes
    whole = parts.where(stays).select("g1", "g2", "size", F.col("shard").alias("to"))
    full = {r["to"]: r["n"] for r in whole.groupBy("to").agg(F.sum("size").alias("n")).collect()}  # one row per shard
    start, left = left, [max(0.0, r - full.get(s, 0)) for s, r in enumerate(left)]
    split = parts.where(~stays).select("g1", "g2", "size").distinct().withColumn("to", _by_room(left, _lot("rest", "g1", "g2")).cast("int"))
    light = written(whole.unionByName(split), "shard-settled")
    full = {r["to"]: r["n"] for r in light.groupBy("to").agg(F.sum("size").alias("n")).collect()}  # one row per shard
    left = [max(0.0, r - full.get(s, 0)) for s, r in enumerate(start)]

    rows = rows.join(F.broadcast(placed), ["g1", "g2"], "left")
    spread = F.get("tos", F.least(F.size("tos") - 1, F.size(F.filter("ends", lambda e: e <= _lot("piece", "u")))))
    rows = rows.withColumn("k1", F.when(F.col("heavy").isNull(), F.col("g1")).otherwise(F.col("u")))  # rows of one heavy group don't meet
    rows = rows.join(light.select(F.col("g1").alias("k1"), "g2", "to"), ["k1", "g2"], "left")
    where = F.when(F.col("heavy").isNotNull(), spread).otherwise(F.coalesce("to", _by_room(left, _lot("fill", "u"))))
    rows = rows.withColumns({"shard": where.cast("int"), "alone": F.col("heavy").isNull() & F.col("to").isNull()})
    return written(rows.select("id", "size", "crc", "g1", "g2", "u", "shard", "heavy", "alone"), "shard-filled")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id_col, size, text_crc32, shard, slot, pulled), one per row of docs. pulled: the shard that propagation gave."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text).alias("g2"),
    )
    rows = rows.withColumn("u", F.xxhash64("id", "g1")).withColumn("shard", F.pmod(F.col("u"), F.lit(shards)).cast("int"))
    rows = propagate(written(rows, "shard-rows"), shards, rounds)

    # In a shard: half of the rows that are alone, the light groups, the heavy ones, the other half.
    lone = F.pmod(F.xxhash64("u", F.lit("lone")), F.lit(GROUP_BLOCKS))
    of_group = F.when(F.col("heavy").isNotNull(), 2 * GROUP_BLOCKS + F.col("heavy")).otherwise(GROUP_BLOCKS + F.pmod(F.col("g2"), F.lit(GROUP_BLOCKS)))
    gb = F.when(~F.col("alone"), of_group).otherwise(F.when(lone < GROUP_BLOCKS // 2, lone).otherwise((1 << 30) + lone))
    rb = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("u", F.lit("block")), F.lit(ROW_BLOCKS))).otherwise(F.lit(0))
    rows = rows.withColumns({"gb": gb.cast("long"), "rb": rb.cast("long")})
    blocks = rows.groupBy("shard", "gb", "rb").agg(F.count(F.lit(1)).alias("n"))
    wide = blocks.groupBy("shard", "gb").agg(F.sum("n").alias("wide"))
    wide = wide.withColumn("wide", F.coalesce(F.sum("wide").over(Window.orderBy("shard", "gb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "gb").orderBy("rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("near", near).join(wide, ["shard", "gb"]).select("shard", "gb", "rb", (F.col("wide") + F.col("near")).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "gb", "rb").orderBy("g1", "g2", "id")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["shard", "gb", "rb"]).withColumn("rank", F.col("start") + F.col("place"))

    total = rows.count()
    base, more = divmod(total, shards)
    wide_end = more * (base + 1)  # the first `more` shards hold one row more
    late = F.col("rank") - F.lit(wide_end)
    number = F.when(F.col("rank") < wide_end, F.floor(F.col("rank") / F.lit(base + 1))).otherwise(F.lit(more) + F.floor(late / F.lit(max(base, 1))))
    slot = F.when(F.col("rank") < wide_end, F.col("rank") % F.lit(base + 1)).otherwise(late % F.lit(max(base, 1)))
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), number.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.col("shard").alias("pulled"))
