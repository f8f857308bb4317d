"""Sharding by balanced label propagation: documents with equal texts move to a common shard, shard sizes stay even.

Law: `rows`, counts at most one apart. Linked documents (groups of equal texts) start dealt out evenly. Each round joins
every group's counts per shard with the group's strongest shard and moves members there, gainful moves first, as far as
quotas allow: what enters a shard may fill its room and what leaves it, so full shards exchange members. Groups that are
apart in the end are packed whole, large ones first; fewer groups than there are shards stay cut. Groups larger than a quota
fill one shard after another. Documents without links have no neighbours and fill what is left. Propagation works on (group, shard) counts, a few rows a group
whatever its size; quotas are dealt by sums of buckets, so no shard's candidates meet in one task.

Built-in functions only. Defined cases: a null text is an empty one; repeated rows are rows of their own; a null doc_id is
carried; fewer rows than shards leave shards empty; an empty table gives an empty table; ties go by a hash of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.operators.held import held

SHARDS = 8
#: Propagation ends when no wish is met, or less than this part of them: packing brings together what is still apart.
LEAST_SHARE = 64
#: Buckets that share a shard's quota for moves of one gain.
SALTS = 64

#: Times the wishes of a round are weighed against the room, at most.
SWEEPS = 100

_IN_PARTITION = (1 << 33) - 1
_GROUP = ("text_hash", "text_crc32", "size")


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` as a struct `row`, with size, CRC-32 and hash of the text."""
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row")).select(
        "row",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
    )


def _with_place(df: DataFrame, name: str) -> DataFrame:
    """`df` written with `at`, a distinct number: the writing task's partition and the row's place in it."""
    return held(df.withColumn("at", F.monotonically_increasing_id()), name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with `number`, gapless from 0 in the order of the partitions. One row a partition is summed in one task."""
    placed = _with_place(df, name)
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held(sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "offsets")
    number = F.col("offset") + F.col("at").bitwiseAND(F.lit(_IN_PARTITION))
    return placed.withColumn("part", part).join(offsets, "part").withColumn("number", number).drop("part", "offset", "at")


def _totals(counts: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def granted(wishes: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much of each wish (from, to) can be met at once: what enters a shard may fill its room and what leaves it."""
    out, sweep = dict(wishes), 0
    while True:
        settled, sweep = True, sweep + 1
        for shard in range(len(room)):
            enters = sum(n for (_, to), n in out.items() if to == shard)
            excess = enters - sum(n for (source, _), n in out.items() if source == shard) - room[shard]
            if excess > 0:
                settled = False
                if sweep > SWEEPS:
                    # Wishes in a circle can shrink by little each time; a shard still too full then takes nobody.
                    excess = enters
                # Every wish is cut by its share of the excess, rounded up, until the excess is gone.
                left = excess
                for pair, n in sorted(out.items(), key=lambda x: -x[1]):
                    if pair[1] == shard:
                        cut = min(n, left, -(-excess * n // enters))
                        out[pair] = n - cut
                        left -= cut
        if settled:
            return out


def propagate(counts: DataFrame, quotas: list[int]) -> DataFrame:
    """Balanced label propagation over (`group`, `shard`, `n`), the members of each group in each shard.

    Every move makes the sum of squared counts larger, so the rounds come to an end; `settle` takes what they leave apart.
    """
    shards = len(quotas)
    barred: set[int] = set()
    while True:
        room = [quota - used for quota, used in zip(quotas, _totals(counts, shards), strict=True)]
        # Equal shards are told apart by a hash of the group, so that wishes go both ways and can be exchanged.
        strength = F.struct(F.col("n"), F.xxhash64("group", "shard").alias("turn"), F.col("shard"))
        goal = counts.filter(~F.col("shard").isin(*barred) if barred else F.lit(True)).groupBy("group").agg(F.max(strength).alias("goal"))
        moves = (
            counts.join(goal.select("group", F.col("goal.n").alias("there"), F.col("goal.shard").alias("to")), "group")
            .filter((F.col("shard") != F.col("to")) & (F.col("n") <= F.col("there")))
            .withColumn("gain", F.length(F.bin("there")))
            .withColumn("salt", F.pmod(F.xxhash64("group"), F.lit(SALTS)))
        )
        moves = held(moves, "moves")
        # At most one row for each pair of shards comes back.
        wishes = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        grants = granted(wishes, room)
        moving = sum(grants.values())
        if moving * LEAST_SHARE < sum(wishes.values()) and moving:
            return counts
        full = {to for _, to in wishes} - {to for (_, to), n in grants.items() if n}
        # Groups that a shard has refused wish for their next strongest one; once members have moved, older refusals are void.
        barred = full if moving else barred | full
        if not moving:
            if not full:
                return counts
            continue
        grant = F.get(F.array(*[F.lit(grants.get((i, j), 0)).cast("long") for i in range(shards) for j in range(shards)]), F.col("shard") * shards + F.col("to"))
        by_gain = Window.partitionBy("shard", "to").orderBy(F.col("gain").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1)
        shares = (
            moves.groupBy("shard", "to", "gain", "salt")
            .agg(F.sum("n").alias("wish"))
            .withColumn("share", grant - F.coalesce(F.sum("wish").over(by_gain), F.lit(0)))
            .filter("share > 0")
            .select("shard", "to", "gain", "salt", "share")
        )
        in_bucket = Window.partitionBy("shard", "to", "gain", "salt").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(in_bucket), F.lit(0))
        moved = F.greatest(F.lit(0), F.least(F.col("n"), F.col("share") - before))
        accepted = moves.join(shares, ["shard", "to", "gain", "salt"]).withColumn("moved", moved).filter("moved > 0")
        # A move takes members from one shard of the group and brings them to another.
        steps = accepted.select(
            "group",
            F.explode(
                F.array(
                    F.struct(F.col("shard").alias("shard"), (-F.col("moved")).alias("n")),
                    F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")),
                )
            ).alias("step"),
        ).select("group", "step.shard", "step.n")
        changed = counts.unionByName(steps).groupBy("group", "shard").agg(F.sum("n").alias("n"))
        counts = held(changed.filter("n > 0"), "labels")


def pack(sizes: dict[int, int], room: list[int]) -> tuple[dict[int, list[tuple[int, list[tuple[int, int]]]]], int]:
    """Shards for groups, large ones first, each into the shard with most room; and how many groups had to be cut.

    `sizes` counts the groups of each size. The plan has for each size runs of (groups, [(shard, members of each)]). A group that
    fits nowhere fills the shards with most room; each such group closes a shard, so fewer groups are cut than there are shards,
    as long as the room holds all members.
    """
    room, plan, cuts = list(room), {}, 0
    for size in sorted(sizes, reverse=True):
        left, whole, cut = sizes[size], [0] * len(room), []
        while left:
            shard = max(range(len(room)), key=lambda s: room[s])
            fit = min(left, room[shard] // size)
            if fit:
                # Many equal groups are dealt out some at a time.
                fit = max(1, fit // (2 * len(room)))
                whole[shard] += fit
                room[shard] -= fit * size
                left -= fit
                continue
            parts, members = [], size
            while members:
                shard = max(range(len(room)), key=lambda s: room[s])
                taken = min(members, room[shard])
                parts.append((shard, taken))
                room[shard] -= taken
                members -= taken
            cut.append((1, parts))
            left -= 1
        cuts += len(cut)
        plan[size] = [(n, [(shard, size)]) for shard, n in enumerate(whole) if n] + cut
    return plan, cuts


def settle(counts: DataFrame, quotas: list[int]) -> DataFrame:
    """Bring together the groups that `counts` still has in several shards: they are packed into the room that the others leave.

    If that cuts groups and a packing of all groups cuts fewer, that one is taken. Only the number of groups of each size
    comes to the driver, which is at most the root of twice the rows.
    """
    shards, spark = len(quotas), counts.sparkSession
    groups = held(counts.groupBy("group").agg(F.sum("n").alias("size"), (F.count("*") > 1).alias("apart")), "groups")
    every: dict[int, int] = {}
    apart: dict[int, int] = {}
    for r in groups.groupBy("size", "apart").agg(F.count("*").alias("groups")).collect():
        every[r["size"]] = every.get(r["size"], 0) + r["groups"]
        if r["apart"]:
            apart[r["size"]] = r["groups"]
    if not apart:
        return counts
    stay = held(counts.join(groups.filter("NOT apart").select("group"), "group").select("group", "shard", "n"), "together")
    plan, cuts = pack(apart, [quota - used for quota, used in zip(quotas, _totals(stay, shards), strict=True)])
    sizes, chosen = apart, groups.filter("apart")
    if cuts:
        other, fewer = pack(every, quotas)
        if fewer < cuts:
            plan, sizes, chosen, stay = other, every, groups, None
    rows, first = [], 0
    for size in sorted(plan):
        end, runs = first, []
        for n, parts in plan[size]:
            end += n
            runs.append((end, parts))
        rows.append((size, runs))
        first += sizes[size]
    table = spark.createDataFrame(rows, "size long, runs array<struct<end:long,parts:array<struct<shard:int,n:long>>>>")
    numbered = _numbered(chosen.select("group", "size").orderBy("size", "group"), "packed")
    run = F.get(F.filter("runs", lambda x: F.col("number") < x["end"]), F.lit(0))
    packed = numbered.join(table, "size").select("group", F.explode(run["parts"]).alias("part")).select("group", "part.shard", "part.n")
    return held(packed if stay is None else stay.unionByName(packed), "settled")


def assign_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`rows` (of `prepared`, any further columns) with `shard` and `slot`, gapless from 0 within each shard."""
    rows = _with_place(rows, "rows").withColumnRenamed("at", "id")
    narrow = rows.select("id", *_GROUP)
    groups = narrow.groupBy(*_GROUP).agg(F.count("*").alias("members"), F.min("id").alias("group")).filter("members > 1")
    links = held(narrow.join(groups.select(*_GROUP, "group"), list(_GROUP), "left").select("id", "group"), "grouped")
    # Sorted by group the members are neighbours; the sort also cuts a hot group over many tasks.
    linked = _numbered(links.filter("group IS NOT NULL").orderBy("group", "id"), "linked")
    linked = held(linked, "members")
    starts = linked.groupBy("group").agg(F.min("number").alias("start"))
    total = rows.count()
    quotas = [(total - s + shards - 1) // shards for s in range(shards)]
    dealt = linked.groupBy("group", F.pmod("number", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    labels = settle(propagate(held(dealt, "labels"), quotas), quotas)
    # Members of a group take its shards in order, each as many as the shard has been granted.
    used = F.transform(
        F.array_sort(F.collect_list(F.struct("shard", "n"))), lambda x: F.struct(x["shard"].alias("shard"), x["n"].alias("n"))
    )
    upto = labels.groupBy("group").agg(used.alias("parts"))
    parts = F.col("parts")
    ends = F.transform(
        parts,
        lambda x, i: F.struct(
            x["shard"].alias("shard"),
            F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("end"),
        ),
    )
    placing = starts.join(upto, "group").select("group", "start", ends.alias("ends"))
    rank = F.col("number") - F.col("start")
    placed = (
        linked.join(placing, "group")
        .withColumn("rank", rank)
        .select("id", F.get(F.filter("ends", lambda x: F.col("rank") < x["end"]), F.lit(0))["shard"].alias("shard"))
    )
    # Documents without links fill what the quotas leave.
    room = [quota - used for quota, used in zip(quotas, _totals(labels, shards), strict=True)]
    alone = _numbered(links.filter("group IS NULL").select("id"), "alone")
    shard, end = F.lit(shards - 1), sum(room)
    for s in reversed(range(shards)):
        shard = F.when(F.col("number") < end, F.lit(s)).otherwise(shard)
        end -= room[s]
    filled = alone.select("id", shard.cast("int").alias("shard"))
    decided = _with_place(placed.select("id", F.col("shard").cast("int")).unionByName(filled), "decided")
    part = F.shiftrightunsigned("at", 33)
    counted = decided.withColumn("part", part)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held(
        counted.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")),
        "slots",
    )
    # A task's rows of one shard, not a shard's rows, are what is put in order here.
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at")) - 1
    slots = counted.withColumn("inside", inside).join(offsets, ["shard", "part"])
    return rows.join(slots.select("id", "shard", (F.col("offset") + F.col("inside")).alias("slot")), "id").drop("id")
