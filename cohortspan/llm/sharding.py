"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked. They begin in hashed shards; in each round the rows that a group
has in one shard move to the shard where the group has more, as far as that shard's quota goes. Rows that
moved together stay together, so a round works on at most ``shards`` rows per group, however large it is.
Groups that the rounds leave split are packed whole into the room that all whole groups leave, large ones
first; if that cuts a group, all groups are packed anew and the packing with fewer cuts is taken. The plan
is made from the counts of group sizes, of which N rows have at most about sqrt(2 N) different ones.
At last every shard is cut to its quota, unlinked documents first, and what is over fills the gaps.
"""

from __future__ import annotations

from collections import Counter
from heapq import heapify, heappop, heappush
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, checkpointed, numbered, running_total

SHARDS = 8
ROUNDS = 12
WHOLE_ROWS = 256  # a group's rows in one shard are ranked as one block up to this number


def quotas(n_rows: int, shards: int = SHARDS) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def _pick(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (shard + 1).cast("int"))


def propagate(cells: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move cells (g1, g2, home: the rows of a group that began in one shard; n) and return them with ``shard``.

    A round moves a cell to the shard, of those with room for it, where its group has most rows (the lower one
    on a tie), if that is more than its own. Large moves enter a shard first, until its quota is used.
    Ends when nothing can move, or after ``rounds`` rounds; ``settle`` places the groups that are still split.
    """
    state = checkpointed(cells.withColumn("shard", F.col("home")))
    bits = bucket_bits(state.count())
    group = Window.partitionBy("g1", "g2")
    for _ in range(rounds):
        load = dict(state.groupBy("shard").agg(F.sum("n")).collect())
        room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quota)]
        here = state.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("m")).withColumn(
            "held", F.collect_list(F.struct("m", (-F.col("shard")).alias("minus"))).over(group))  # one entry per shard
        own = F.struct("m", (-F.col("shard")).alias("minus"))
        better = F.array_max(F.filter("held", lambda x: (x > own) & (_pick(room, -x["minus"]) >= F.col("n"))))
        moves = state.join(here, ["g1", "g2", "shard"]).withColumn("goal", -better["minus"]).filter("goal IS NOT NULL").select(
            "g1", "g2", "home", "n", "goal",  # the top six bits of the order are the size's, large first
            (F.shiftrightunsigned(F.xxhash64("g1", "g2", "home"), 6) - F.shiftleft(F.floor(F.log2("n")).cast("long"), 58)).alias("h"))
        moves = running_total(moves, ["goal"], ["h", "g1", "g2", "home"], "n", "entering", bits + 6)
        moves = checkpointed(moves.filter(F.col("entering") <= _pick(room, F.col("goal"))).select("g1", "g2", "home", "goal"))
        if moves.isEmpty():
            break
        state = checkpointed(state.join(moves, ["g1", "g2", "home"], "left").select(
            "g1", "g2", "home", "n", F.coalesce("goal", "shard").alias("shard")))
    return state


def pack(sizes: dict[int, int], room: list[int]) -> tuple[list[tuple], int]:
    """Plan for groups, given how many have each size: (size, first, last, shard, pieces) and the number of cuts.

    Groups first to last (from 1) of a size go to ``shard``; one that no shard has room for is cut and has
    ``pieces`` instead, (rows up to, shard). Large groups come first, each into the least room that holds it.
    A cut fills the largest room whole, so there are fewer cuts than shards, and what is left of the group
    is packed like a group of its size. ``room`` must hold all groups.
    """
    room, plan, parts, cuts = list(room), [], {}, 0
    heap = [(-n, 1, 1, count, None) for n, count in sizes.items()]  # the rest of a cut group has 0 in second place
    heapify(heap)
    while heap:
        minus, _, at, count, part = heappop(heap)
        n, k = -minus, 1
        fits = [(r, s) for s, r in enumerate(room) if r >= n]
        if fits:
            s = min(fits)[1]
            k = min(count, room[s] // n)
            room[s] -= k * n
            if part:
                parts[part].append((n, s))
            else:
                plan.append((n, at, at + k - 1, s, None))
        else:
            s, part, cuts = room.index(max(room)), part or (n, at), cuts + 1
            parts.setdefault(part, []).append((room[s], s))
            heappush(heap, (room[s] - n, 0, 0, 1, part))
            room[s] = 0
        if count > k:
            heappush(heap, (-n, 1, at + k, count - k, None))
    for (n, at), of in parts.items():
        ends = accumulate(rows for rows, _ in of)
        plan.append((n, at, at, None, [(end, s) for end, (_, s) in zip(ends, of, strict=True)]))
    return plan, cuts


PLAN = "size long, first long, last long, goal long, pieces array<struct<upto: long, shard: long>>"


def settle(cells: DataFrame, quota: list[int]) -> DataFrame:
    """Cells (g1, g2, home, n, shard) with the final ``shard``, or ``pieces`` of the group where it is cut.

    Afterwards no shard has more linked rows than its quota.
    """
    groups = checkpointed(cells.groupBy("g1", "g2").agg(
        F.sum("n").alias("size"), F.when(F.min("shard") == F.max("shard"), F.min("shard")).alias("own")))
    counts = [tuple(r) for r in groups.groupBy("size", "own").count().collect()]
    room, split, every = list(quota), Counter(), Counter()
    for size, own, count in counts:
        every[size] += count
        if own is None:
            split[size] += count
        else:
            room[own] -= size * count
    plan, cuts = pack(split, room) if min(room) >= 0 else ([], None)
    if cuts != 0:
        anew, fewest = pack(every, quota)
        if cuts is None or fewest < cuts:
            plan, groups = anew, groups.withColumn("own", F.lit(None).cast("long"))
    if not plan:
        return cells.withColumn("pieces", F.lit(None).cast("array<struct<upto: long, shard: long>>"))
    free = groups.filter("own IS NULL").select(
        "g1", "g2", "size", F.xxhash64("g1", "g2").alias("h"), F.lit(1).cast("long").alias("one"))
    free = running_total(free, ["size"], ["h", "g1", "g2"], "one", "at", bucket_bits(sum(every.values())))
    steps = F.broadcast(cells.sparkSession.createDataFrame(plan, PLAN))
    placed = free.join(steps, "size").filter("at BETWEEN first AND last").select("g1", "g2", "goal", "pieces")
    return checkpointed(cells.join(placed, ["g1", "g2"], "left").select(
        "g1", "g2", "home", "n", F.when(F.col("pieces").isNull(), F.coalesce("goal", "shard")).alias("shard"), "pieces"))


def shards(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Row counts of shards differ by one at most; slots count from 0 without gaps. A null text counts as an
    empty one (size 1, crc 0) and is equal to it. A null doc_id is an id like any other; repeated rows are
    documents of their own and linked. A group above a shard's quota fills whole shards, and its rest is packed
    like a group; a smaller one is cut only where no shard has room for it.
    """
    text = F.coalesce("text", F.lit(""))
    # Places come from id, text and number among equal rows: rows of one id, or one row again and again, spread too.
    rows = checkpointed(numbered(docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("b"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text).alias("g2"))).withColumn(
        "h", F.xxhash64("doc_id", "g1", "at", F.lit("home"))).withColumns({"home": F.pmod("h", F.lit(n_shards)), "h": F.xxhash64("h")}))
    quota = quotas(rows.count(), n_shards)
    first = rows.groupBy("g1", "g2", "home").agg(F.count("*").alias("n"))
    linked = first.withColumn("all", F.sum("n").over(Window.partitionBy("g1", "g2"))).filter("all > 1").drop("all")
    cells = settle(propagate(linked, quota, rounds), quota)
    bits = bucket_bits(sum(quota))
    placed = rows.join(cells, ["g1", "g2", "home"], "left").select(
        "g1", "g2", "doc_id", "b", "text_crc32", F.when(F.col("pieces").isNull(), F.coalesce("shard", "home")).alias("shard"),
        F.col("n").isNull().cast("long").alias("lone"),
        F.when(F.col("n") <= WHOLE_ROWS, F.xxhash64("g1", "g2")).otherwise(F.col("h")).alias("place"), "h",
        F.lit(1).cast("long").alias("one"), "pieces")
    if not cells.filter("pieces IS NOT NULL").isEmpty():
        placed = checkpointed(placed)
        cut = running_total(placed.filter("pieces IS NOT NULL"), ["g1", "g2"], ["h", "doc_id"], "one", "at", bits)
        cut = cut.withColumn("shard", F.filter("pieces", lambda x: F.col("at") <= x["upto"])[0]["shard"])
        placed = placed.filter("pieces IS NULL").unionByName(cut.select(*placed.columns))
    ranked = checkpointed(running_total(
        placed.drop("g1", "g2", "pieces"), ["shard", "lone"], ["place", "h", "doc_id"], "one", "rank", bits))
    counts = {(r.shard, r.lone): r.n for r in ranked.groupBy("shard", "lone").agg(F.count("*").alias("n")).collect()}
    grouped = [counts.get((s, 0), 0) for s in range(n_shards)]
    full = [grouped[s] + counts.get((s, 1), 0) for s in range(n_shards)]
    over = [max(0, f - q) for f, q in zip(full, quota, strict=True)]
    gaps = [max(0, q - f) for f, q in zip(full, quota, strict=True)]
    over_from, gap_from = [0, *accumulate(over)], [0, *accumulate(gaps)]
    slot = F.col("rank") - 1 + F.when(F.col("lone") == 1, _pick(grouped, F.col("shard"))).otherwise(0)
    spare = slot - _pick(quota, F.col("shard")) + _pick(over_from[:-1], F.col("shard"))
    goal = sum((spare >= g).cast("long") for g in gap_from[1:])
    return ranked.withColumn("slot", slot).withColumn(
        "goal", F.when(slot >= _pick(quota, F.col("shard")), goal)).select(
        "doc_id", (F.col("b") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"),
        F.coalesce("goal", "shard").cast("int").alias("shard"),
        F.when(F.col("goal").isNull(), F.col("slot")).otherwise(
            spare - _pick(gap_from[:-1], F.col("goal")) + _pick(full, F.col("goal"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
