"""Sharding by balanced label propagation: linked documents move to their neighbours' shard under quotas.

Documents of equal text are linked. Every document begins in a shard that its id decides. In the first rounds each group of links takes as its label the shard that
has most of it, and room for most of the rest; its documents move there in the order of the groups' size, as long as the quota holds all of
them, and the others wait. What no shard can hold whole is dealt out in parts. Then placed documents move on: in each round the parts of a group wish to
go to the shard where most of it lies, unless the group fills that shard already. How many rows may go from each shard to each other is decided
on the table of wishes by pair of shards: along cycles of wishes, which leave all sizes as they are, and along chains of wishes that end in a shard with room. Where
neither is left, rows are swapped with whole groups of the shard that they wish to go to, which are as well off in the other. Rows
only ever join a part of their group that is as large as theirs or larger, so that the links cut never rise; rounds end when nothing moves in three orders of
equal parts. Law `rows`: the quotas differ by one at most, and documents without links, which cut no edge anywhere, fill what is left
exactly. The rounds work on counts by group and shard, never on a group's documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, cut, running


def _rooms(spark, quotas: list[int], placed: DataFrame) -> list[int]:
    used = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).where("shard is not null").collect()}  # a row for each shard
    return [q - used.get(s, 0) for s, q in enumerate(quotas)]


def _admit(wishes: DataFrame, rooms: list[int], chunks: int) -> DataFrame:
    """wishes(g, shard, n) with `taken`: all of it or nothing, larger wishes first, as the room allows. A wish beyond every shard's room is taken in part."""
    room = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in rooms]), F.col("shard") + 1)
    sized = wishes.withColumn("_level", -F.floor(F.log2(F.col("n").cast("double")))).withColumn("_chunk", F.pmod(F.xxhash64("g"), F.lit(chunks)))
    ranked = running(sized, ["shard"], ["_level", "_chunk"], [F.col("g")], F.col("n"), "_ahead")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), room - F.col("_ahead")))
    return ranked.withColumn("taken", F.when((part == F.col("n")) | (F.col("n") > max(rooms)), part).otherwise(F.lit(0).cast("long"))).drop("_level", "_chunk", "_ahead")


def _flows(wants: dict[tuple[int, int], int], rooms: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may go from shard to shard at once: at most as many as want to, and no shard takes in more than goes out and it has room for.

    wants and rooms have an entry for each pair of shards and each shard. Chains of wishes are followed until they close or reach a shard with room.
    """
    left, free, out = dict(wants), list(rooms), {}

    def chain(start: int) -> list[int] | None:
        """The shortest chain from a shard that ends in it or in one with room."""
        came, todo = {start: None}, [start]
        for here in todo:
            for (a, b), n in left.items():
                if a != here or n <= 0:
                    continue
                if b == start or free[b] > 0 and b not in came:
                    path = [b, here]
                    while path[-1] != start:
                        path.append(came[path[-1]])
                    return path[::-1]
                if b not in came:
                    came[b] = here
                    todo.append(b)
        return None

    for start in range(len(rooms)):
        while path := chain(start):
            steps = list(zip(path, path[1:]))
            n = min(left[x] for x in steps)
            if path[-1] != start:
                n = min(n, free[path[-1]])
                free[path[-1]] -= n
                free[start] += n
            for x in steps:
                left[x] -= n
                out[x] = out.get(x, 0) + n
    return out


def _wishes(placed: DataFrame, quotas: list[int], chunks: int, turn: int) -> DataFrame:
    """g, src, shard, n, level, chunk: parts of groups and the shard that they wish to go to, where the largest part lies that doesn't fill its shard (equal ones: as the turn decides)."""
    quota = F.array(*[F.lit(int(q)).cast("long") for q in quotas])
    parts = placed.groupBy("g").agg(F.collect_list(F.struct("shard", "n")).alias("at")).where("size(at) > 1")  # at most one entry for each shard
    open_ = F.filter("at", lambda x: x["n"] < F.element_at(quota, x["shard"] + 1))
    home = F.array_max(F.transform(open_, lambda x: F.struct(x["n"].alias("n"), F.xxhash64("g", x["shard"], F.lit(turn)).alias("tie"), x["shard"].alias("shard"))))
    wishes = parts.select("g", home.alias("home"), F.explode(open_).alias("p")).where("p.shard <> home.shard")
    level = -F.floor(F.log2(F.col("home.n").cast("double")))
    return wishes.select("g", F.col("p.shard").alias("src"), F.col("home.shard").alias("shard"), F.col("p.n").alias("n"), level.alias("level"), F.pmod(F.xxhash64("g"), F.lit(chunks)).alias("chunk"))


def _after(turns: Rounds, placed: DataFrame, moves: DataFrame) -> DataFrame:
    """placed after moves (g, src, shard, n) of n rows each."""
    both = F.explode(F.array(F.struct(F.col("src").alias("shard"), (-F.col("n")).alias("n")), F.struct("shard", "n")))
    return turns.put(placed.unionByName(moves.select("g", both.alias("c")).select("g", "c.shard", "c.n")).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def _moved(turns: Rounds, placed: DataFrame, wishes: DataFrame, quotas: list[int]) -> DataFrame | None:
    """placed (g, shard, n) after the moves that `_flows` allows; None if there are none."""
    wants = {(r.src, r.shard): r.n for r in wishes.groupBy("src", "shard").agg(F.sum("n").alias("n")).collect()}  # a row for each pair of shards
    flows = _flows(wants, _rooms(placed.sparkSession, quotas, placed))
    if not flows:
        return None
    size = len(quotas)
    most = F.array(*[F.lit(int(flows.get((a, b), 0))).cast("long") for a in range(size) for b in range(size)])
    ranked = running(wishes, ["src", "shard"], ["level", "chunk"], [F.col("g")], F.col("n"), "ahead")
    taken = F.least(F.col("n"), F.element_at(most, F.col("src") * size + F.col("shard") + 1) - F.col("ahead"))
    return _after(turns, placed, ranked.withColumn("n", taken).where("n > 0"))


def _swapped(turns: Rounds, placed: DataFrame, wishes: DataFrame, chunks: int, less: int) -> DataFrame | None:
    """placed after swaps of rows that wish to go to a shard with whole groups of that shard, which cut nothing on either side; None if there are none.

    A part gives all its rows but `less` for a group of as many; the k-th part that seeks a size in a shard meets the k-th group of the size.
    """
    seeking = wishes.withColumn("n", F.col("n") - less).where("n >= 2").drop("level")
    if seeking.isEmpty():
        return None
    seeking = running(seeking, ["shard", "n"], ["chunk"], [F.col("g"), F.col("src")], F.lit(1), "k")
    whole = placed.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), F.max("shard").alias("shard"), F.max("n").alias("n")).where("parts = 1").select(F.col("g").alias("other"), "shard", "n", F.pmod(F.xxhash64("g"), F.lit(chunks)).alias("chunk"))
    whole = running(whole.join(F.broadcast(seeking.select("shard", "n").distinct()), ["shard", "n"]), ["shard", "n"], ["chunk"], [F.col("other")], F.lit(1), "k").drop("chunk")  # a row for each shard and size of a part
    pairs = cut(seeking.join(whole, ["shard", "n", "k"]).select("g", "other", "src", "shard", "n"))
    if pairs.isEmpty():
        return None
    back = pairs.select(F.col("other").alias("g"), F.col("shard").alias("src"), F.col("src").alias("shard"), "n")
    return _after(turns, placed, pairs.drop("other").unionByName(back))


def propagated(placed: DataFrame, quotas: list[int], moves: int = 40, chunks: int = 64) -> DataFrame:
    """placed (g, shard, n), within the quotas, after at most `moves` rounds of label propagation. No round cuts more links than the one before, and none breaks a quota."""
    turns, wished = Rounds(placed.sparkSession), Rounds(placed.sparkSession)
    still = 0
    for turn in range(moves):
        wishes = wished.put(_wishes(placed, quotas, chunks, turn))
        after = _moved(turns, placed, wishes, quotas) or _swapped(turns, placed, wishes, chunks, still)
        placed, still = (placed, still + 1) if after is None else (after, 0)
        if still == 3 or after is None and wishes.isEmpty():
            break
    return placed


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int = 8, chunk_rows: int = 256, moves: int = 40) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`).

    Counts of rows by shard differ by one at most. size is the text's UTF-8 bytes and 8; slots number a shard's rows
    without gaps in an order that the ids decide. Null texts equal each other, and differ from empty ones; text_crc32
    of null is 0. Rows of a null id and repeated rows are documents like others. An empty table gives an empty table.
    Of docs only the id and the text are read, once. Rows are numbered in chunks of `chunk_rows` rows, or of more where chunks would
    outnumber four times the root of the rows, so that neither a chunk nor the table of their sums grows with the rows. `rounds` bounds the rounds in
    which groups are placed, `moves` those in which placed documents move on.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    light = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("g"), F.monotonically_increasing_id().alias("row"),
    )
    light = cut(light)
    total = light.count()
    chunks = max(64, min(total // chunk_rows, 4 * math.isqrt(total)))
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    light = light.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(chunks)))
    first = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(shards)).cast("int")

    counts = light.groupBy("g", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = cut(counts.groupBy("g").agg(F.sum("n").alias("total"), F.collect_list(F.struct("shard", "n")).alias("at")).where("total > 1"))  # at most one entry for each shard
    # Round 0: each group moves to the shard that most of it begins in, if that has room for it.
    most = F.array_max(F.transform("at", lambda x: F.struct(x["n"].alias("n"), F.xxhash64("g", x["shard"]).alias("tie"), x["shard"].alias("shard"))))
    kept = _admit(groups.select("g", most["shard"].alias("shard"), F.col("total").alias("n")), quotas, chunks)
    turns, joined = Rounds(spark), Rounds(spark)
    placed = turns.put(kept.select("g", "shard", F.col("taken").alias("n")).where("n > 0"))
    for _ in range(rounds):
        rooms = _rooms(spark, quotas, placed)
        have = placed.groupBy("g").agg(F.sum("n").alias("have"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by"))
        waiting = groups.join(have, "g", "left").withColumn("n", F.col("total") - F.coalesce("have", F.lit(0))).where("n > 0")
        options = F.array(*[
            F.struct((F.coalesce(F.try_element_at("by", F.lit(s)), F.lit(0)) + F.least(F.col("n"), F.lit(r))).alias("score"), F.xxhash64("g", F.lit(s)).alias("tie"), F.lit(s).alias("shard"))
            for s, r in enumerate(rooms) if r > 0
        ])
        if max(rooms) <= 0:
            break
        wishes = waiting.withColumn("shard", F.array_max(options)["shard"]).select("g", "shard", "n")
        moved = joined.put(_admit(wishes, rooms, chunks).where("taken > 0").select("g", "shard", F.col("taken").alias("n")))
        if moved.isEmpty():
            break
        placed = turns.put(placed.unionByName(moved).groupBy("g", "shard").agg(F.sum("n").alias("n")))

    # What still waits, group by group, and then the documents without links fill the rooms in the order of the shards.
    rooms = _rooms(spark, quotas, placed)
    ends = [sum(rooms[: s + 1]) for s in range(shards)]
    begins = [0, *ends[:-1]]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    have = placed.groupBy("g").agg(F.sum("n").alias("have"))
    rest = groups.join(have, "g", "left").withColumn("n", F.col("total") - F.coalesce("have", F.lit(0))).where("n > 0").select("g", "n", F.lit(0).alias("all"), F.pmod(F.xxhash64("g"), F.lit(chunks)).alias("chunk"))
    rest = cut(running(rest, ["all"], ["chunk"], [F.col("g")], F.col("n"), "ahead"))
    waiting = rest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    overlap = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), (F.least(F.col("ahead") + F.col("n"), F.element_at(longs(ends), s + 1)) - F.greatest(F.col("ahead"), F.element_at(longs(begins), s + 1))).alias("n")))
    filled = rest.select("g", F.explode(overlap).alias("x")).select("g", "x.shard", "x.n").where("n > 0")
    ranges = turns.put(placed.unionByName(filled).groupBy("g", "shard").agg(F.sum("n").alias("n")))
    ranges = propagated(ranges, quotas, moves, chunks)
    ranges = ranges.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("at"))
    upto = F.transform(F.sequence(F.lit(1), F.size("at")), lambda i: F.aggregate(F.slice("at", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    ranges = ranges.select("g", F.col("at.shard").alias("shards"), upto.alias("upto"))

    known = light.join(ranges, "g", "left")
    linked = running(known.where("upto is not null"), ["g"], ["chunk"], [F.col("doc_id"), F.col("row")], F.lit(1), "place")
    linked = linked.withColumn("shard", F.element_at("shards", F.size(F.filter("upto", lambda x: x <= F.col("place"))) + 1))
    single = running(known.where("upto is null").withColumn("all", F.lit(0)), ["all"], ["chunk"], [F.col("doc_id"), F.col("row")], F.lit(1), "place")
    single = single.withColumn("shard", F.size(F.filter(longs(ends), lambda x: x <= F.col("place") + waiting)))
    columns = ["doc_id", "size", "text_crc32", "row", "chunk", "shard"]
    out = cut(linked.select(*columns).unionByName(single.select(*columns)))
    out = running(out, ["shard"], ["chunk"], [F.col("doc_id"), F.col("row")], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """What a sharding cuts: links (pairs of rows of equal size and text_crc32) and how many of them lie in two shards. One row; 0 of 0 for an empty table."""
    counts = sharded.groupBy("size", "text_crc32", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    groups = counts.groupBy("size", "text_crc32").agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    return groups.agg(F.coalesce(F.sum("links"), F.lit(0.0)).cast("long").alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0.0)).cast("long").alias("cut"))
