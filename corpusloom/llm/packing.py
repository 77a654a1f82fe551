"""Filling containers of fixed capacity with items of varying length.

The plan is made from the histogram of lengths alone, at most one entry per length up to the capacity: lengths from long
to short, each into the open containers with the least room that suffices (best fit), as many of a length as a container
takes, then into new ones. Containers filled alike are one entry of the plan, a range of numbers. Then the items take
the planned slots: an item's rank within its length names its slot. Ranks come from counts per length and salt, so that
one length may hold any share of the items.

Cases: an item longer than the capacity is cut into full containers and a rest, which is an item; null or zero sizes
take no room and come out with a null container; negative sizes count as zero; repeated ids are items of their own;
no items give no rows. A capacity below 1 is refused.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.session import materialize

#: The histogram and the plan are held by the driver, with a few entries per length.
MAX_CAPACITY = 1 << 20
#: Parts at least into which each length is cut to rank its items, and items of one length in a part at most, on the mean.
SALTS, RANKED = 64, 200_000
#: Slots up to which the plan is broadcast, and ranks that one key of the join holds beyond.
SLOTS, STRETCH = 100_000, 1 << 16

PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("size", "first", "until", "container", "each", "offset")])


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (size, first rank, end of ranks, first container, items in each, offset of the first), and the number of containers."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted: amounts of room of open containers
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: ranges (first container, number)
    made = 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, number))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first = capacity, made
                number = -(-left // (capacity // size))
                made += number
            each = room // size
            full = min(number, left // each)
            if full:
                slots.append((size, rank, rank + full * each, first, each, capacity - room))
                put(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # fewer than fill one container
                slots.append((size, rank, rank + left, first + full, left, capacity - room))
                put(room - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, number - full)
    return slots, made


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens", salts: int | None = None) -> DataFrame:
    """Rows (key, part, start, tokens, container, offset): which stretch of which item lies where in which container.

    salts: parts of each length; by default as many as the commonest length needs. items is read twice (histogram, assignment), so it should be a table, not an expensive plan.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"a capacity has to lie between 1 and {MAX_CAPACITY}")
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    whole = F.floor(F.col("n") / capacity).cast("bigint")
    parts = sized.filter("n > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("n") / capacity).cast("bigint") - 1))))
    parts = parts.select("k", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part") * capacity).alias("size"))
    counts = {r["size"]: r["n"] for r in _histogram(sized, whole, capacity).collect()}  # at most `capacity` rows
    slots, made = plan_slots(counts, capacity)
    salts = salts or max(SALTS, -(-max(counts.values(), default=0) // RANKED))
    salt = F.pmod(F.xxhash64("k", "part"), F.lit(salts)).cast("int")
    salted = parts.withColumn("salt", salt)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count("*").alias("m")).select("size", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("k", "part")) - 1)
    ranked = ranked.join(offsets, ["size", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    plan = spark.createDataFrame(slots, PLAN)
    at = F.col("rank") - F.col("first")
    inside = (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    if len(slots) <= SLOTS:  # at most a few per length
        placed = ranked.join(F.broadcast(plan), inside)
    else:  # by stretches of ranks, so that a common length is many keys
        cut = lambda c: F.floor(c / STRETCH)
        plan = plan.withColumn("stretch", F.explode(F.sequence(cut(F.col("first")), cut(F.col("until") - 1))))
        inside = (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
        placed = ranked.join(plan, inside & (cut(F.col("rank")) == F.col("stretch")))
    placed = placed.select(F.col("k").alias(key), "part", "start", ranked["size"].alias("tokens"), (F.col("container") + F.floor(at / F.col("each"))).cast("bigint").alias("container"), (F.col("offset") + F.pmod(at, F.col("each")) * ranked["size"]).cast("bigint").alias("offset"))
    nothing = F.lit(None).cast("bigint")
    empty = sized.filter("n = 0").select(F.col("k").alias(key), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("tokens"), nothing.alias("container"), nothing.alias("offset"))
    return placed.unionByName(empty)


def _histogram(sized: DataFrame, whole, capacity: int) -> DataFrame:
    """Lengths of all parts and their numbers, from one pass over the sizes."""
    by = sized.filter("n > 0").groupBy("n").agg(F.count("*").alias("m"))
    full = by.select(F.lit(capacity).cast("bigint").alias("size"), (whole * F.col("m")).alias("c"))
    rest = by.select(F.pmod(F.col("n"), F.lit(capacity).cast("bigint")).alias("size"), F.col("m").alias("c"))
    return full.unionByName(rest).filter("size > 0 and c > 0").groupBy("size").agg(F.sum("c").alias("n"))


def pack_all(documents: DataFrame, containers: DataFrame, path: str) -> DataFrame:
    """The documents packed once for each container_id, sized in tokens of the vocabulary at path."""
    from corpusloom.llm.tokens import encode

    runs = containers.select("container_id", "tokens").filter("tokens is not null").orderBy("container_id").limit(65).collect()
    if len(runs) > 64:
        raise ValueError("more than 64 capacities")
    sizes = materialize(encode(documents, path=path, counts=True), "sizes")
    out = None
    for c in runs:
        one = pack(sizes, c["tokens"]).select(F.lit(c["container_id"]).alias("container_id"), F.lit(c["tokens"]).alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = pack(sizes.limit(0), 1).select(F.lit(0).alias("container_id"), F.lit(0).alias("capacity"), "*")
    return out
