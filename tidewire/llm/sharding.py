"""Resharding that moves the fewest bytes: a minimum-cost flow from old shard sizes to new capacities.

1. Each old shard's rows fall into blocks by hash; only the blocks' bytes and counts, whose number is fixed by
   parameters, go to the driver.
2. The flow says how many bytes each old shard keeps or hands to each new one. A byte costs nothing where it stays, 1
   where it moves, more where it moves to another zone. Its network has a node per shard and a hub per zone, so it grows
   with the shards, never with rows.
3. An old shard's blocks, laid end to end, are cut by its transfers. Whole blocks follow from the cuts alone; in the few
   blocks with a cut inside, rows are placed one by one, and those on a cut go last, largest first, where most room is.
4. Shards that give or take something are rewritten, in files of bounded size; the others stay as they are.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, unused


@dataclass(frozen=True)
class ReshardSettings:
    """2**block_bits blocks a shard; a row counts its text's bytes and ``row_bytes``; files hold about ``file_bytes`` of rows.

    ``zones`` has the zone of each shard by its number (all in one where it is empty); a byte that leaves its zone
    costs ``far`` instead of 1.
    """

    block_bits: int = 8
    row_bytes: int = 16
    file_bytes: int = 64 << 20
    zones: tuple[int, ...] = ()
    far: int = 4

    def zone(self, shard: int) -> int:
        return self.zones[shard] if 0 <= shard < len(self.zones) else 0


def equal_capacities(total: int, shards: int) -> list[int]:
    """Whole numbers that differ by 1 at most and add up to ``total``."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


class Flow:
    """A network whose cheapest flow is found along shortest paths, with potentials that keep all costs at 0 or more."""

    def __init__(self):
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: object, sink: object) -> None:
        height = dict.fromkeys(self.out, 0)
        while True:
            far, came, heap, order = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e]:
                        via = d + self.cost[e] + height[x] - height[y]
                        if y not in far or via < far[y]:
                            far[y], came[y], order = via, e, order + 1
                            heapq.heappush(heap, (via, order, y))
            if sink not in far:
                return
            most = max(far.values())
            for x in height:
                height[x] += far.get(x, most)
            path, x = [], sink
            while x != source:
                path.append(came[x])
                x = self.to[came[x] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount

    def sent(self, e: int) -> int:
        return self.room[e ^ 1]


def solve_transfers(sizes: dict[int, int], capacities: list[int], s: ReshardSettings = ReshardSettings()) -> list[tuple[int, int, int]]:
    """(old, new, bytes), by old and new, at least cost: every old byte goes somewhere, every new shard is filled.

    Shard j of the new is old shard j where there is one. The capacities add up to the sizes.
    """
    if sum(sizes.values()) != sum(capacities):
        raise ValueError("capacities must add up to the sizes")
    if not sizes:
        return []
    net, total = Flow(), sum(capacities)
    kept = {i: net.edge(("old", i), ("new", i), total, 0) for i in sizes if 0 <= i < len(capacities)}
    leave = {i: net.edge(("old", i), ("from", s.zone(i)), total, 1) for i in sizes}
    near, far = {}, {}
    for j, c in enumerate(capacities):
        near[j] = net.edge(("from", s.zone(j)), ("new", j), total, 0)
        far[j] = net.edge("between", ("new", j), total, 0)
        net.edge(("new", j), "sink", c, 0)
    across = {z: net.edge(("from", z), "between", total, s.far - 1) for z in {s.zone(i) for i in sizes}}
    for i, n in sizes.items():
        net.edge("source", ("old", i), n, 0)
    net.run("source", "sink")
    moved: dict[tuple[int, int], int] = {(i, i): net.sent(e) for i, e in kept.items() if net.sent(e)}

    def share(givers: list[tuple[int, int]], takers: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Pairs what givers have with what takers lack, in order; what is left of the givers."""
        givers, takers = [list(g) for g in givers if g[1]][::-1], [list(t) for t in takers if t[1]][::-1]
        while givers and takers:
            (i, have), (j, lack) = givers[-1], takers[-1]
            n = min(have, lack)
            moved[i, j] = moved.get((i, j), 0) + n
            givers[-1][1] -= n
            takers[-1][1] -= n
            givers, takers = (x[:-1] if x[-1][1] == 0 else x for x in (givers, takers))
        return [(i, n) for i, n in reversed(givers)]

    left = []
    for z in sorted(across):
        left += share([(i, net.sent(e)) for i, e in sorted(leave.items()) if s.zone(i) == z], [(j, net.sent(e)) for j, e in near.items() if s.zone(j) == z])
    share(left, [(j, net.sent(e)) for j, e in far.items()])
    return sorted((i, j, n) for (i, j), n in moved.items())


@dataclass
class Plan:
    """transfers (old, new, bytes); pieces (old, block, shard, first_slot, file): which rows of a block go where."""

    transfers: list[tuple[int, int, int]]
    spans: DataFrame
    on_cuts: DataFrame
    blocks: DataFrame
    pieces: DataFrame
    untouched: list[int]


class Resharding:
    """Columns of rows that the plan and the rewriting must compute alike."""

    def __init__(self, docs: DataFrame, old: Column, s: ReshardSettings, id_col: str, text_col: str):
        text = F.col(text_col).cast("string")
        self.s = s
        self.names = {n: unused(docs.columns, n) for n in ("old", "block", "order", "size", "crc", "shard", "slot", "file", "first", "start", "cut", "lo", "hi")}
        n = self.names
        size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + s.row_bytes
        crc = F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0).cast("long"))
        order = F.xxhash64(F.col(id_col), crc)
        rows = docs.withColumns({n["old"]: F.coalesce(old.cast("int"), F.lit(-1)), n["size"]: size, n["crc"]: crc, n["order"]: order})
        self.rows = rows.withColumn(n["block"], F.shiftrightunsigned(F.col(n["order"]), 64 - s.block_bits).cast("int"))
        self.sorted_by = [F.col(n["order"]), F.col(id_col), F.col(n["size"]), F.col(n["crc"])]
        self.narrow = self.rows.select(n["old"], n["block"], n["order"], F.col(id_col), n["size"], n["crc"])

    def placed(self, rows: DataFrame, spans: DataFrame) -> DataFrame:
        """Rows of cut blocks with shard, and cut where one lies on the bound of its span: then its shard is open."""
        n = self.names
        inside = W.partitionBy(n["old"], n["block"]).orderBy(*self.sorted_by).rowsBetween(W.unboundedPreceding, 0)
        at_ = rows.withColumn(n["start"], F.col(n["first"]) + F.sum(n["size"]).over(inside) - F.col(n["size"]))
        named = F.broadcast(spans.select(F.col("old").alias("__o"), F.col("lo").alias(n["lo"]), F.col("hi").alias(n["hi"]), F.col("shard").alias("__s")))
        met = at_.join(named, (F.col(n["old"]) == F.col("__o")) & (F.col(n["start"]) >= F.col(n["lo"])) & (F.col(n["start"]) < F.col(n["hi"])))
        whole = F.col(n["start"]) + F.col(n["size"]) <= F.col(n["hi"])
        return met.withColumn(n["shard"], F.when(whole, F.col("__s"))).withColumn(n["cut"], F.when(~whole, F.col(n["hi"]))).drop("__o", "__s", n["lo"], n["hi"])


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table; its rows are bounded by shards times blocks."""
    return F.broadcast(spark.createDataFrame(rows, schema).coalesce(1))


def plan_resharding(work: Resharding, shards: int, scratch: Scratch, capacities: list[int] | None = None) -> Plan:
    s, n, spark = work.s, work.names, work.rows.sparkSession
    narrow = scratch.write(work.narrow, "rows")
    sums = narrow.groupBy(n["old"], n["block"]).agg(F.sum(n["size"]).alias("bytes"), F.count("*").alias("rows"))
    blocks = sorted(tuple(r) for r in sums.collect())
    sizes: dict[int, int] = {}
    for old, _, size, _ in blocks:
        sizes[old] = sizes.get(old, 0) + size
    total = sum(sizes.values())
    capacities = capacities or equal_capacities(total, shards)
    transfers = solve_transfers(sizes, capacities, s)
    # An old shard's line of bytes: what stays first, then what goes, by new shard.
    spans, reach = [], dict.fromkeys(sizes, 0)
    for old, new, size in sorted(transfers, key=lambda t: (t[0], t[0] != t[1], t[1])):
        spans.append((old, reach[old], reach[old] + size, new))
        reach[old] += size
    by_old: dict[int, list[tuple[int, int, int, int]]] = {}
    for span in spans:
        by_old.setdefault(span[0], []).append(span)
    whole, cut, first = [], [], dict.fromkeys(sizes, 0)
    at_span = dict.fromkeys(sizes, 0)
    for old, block, size, rows in blocks:
        lo, own = first[old], by_old[old]
        first[old] += size
        while own[at_span[old]][2] <= lo:
            at_span[old] += 1
        if lo + size <= own[at_span[old]][2]:
            whole.append((old, block, own[at_span[old]][3], size, rows))
        else:
            cut.append((old, block, lo))
    spans_df = _local(spark, spans, "old int, lo long, hi long, shard int")
    cut_df = _local(spark, cut, "old int, block int, first long")
    blocks_df = _local(spark, [(o, b, w, None) for o, b, w, _, _ in whole] + [(o, b, None, f) for o, b, f in cut], "old int, block int, shard int, first long")
    met = narrow.join(cut_df.select(F.col("old").alias(n["old"]), F.col("block").alias(n["block"]), F.col("first").alias(n["first"])), [n["old"], n["block"]])
    placed = scratch.write(work.placed(met, spans_df), "placed")
    # One row at most for each bound between spans.
    on_cut = sorted(tuple(r) for r in placed.filter(F.col(n["cut"]).isNotNull()).select(n["size"], n["old"], n["cut"], n["start"], n["block"]).collect())[::-1]
    room = dict.fromkeys(range(len(capacities)), 0)
    for size, old, _, start, _ in on_cut:
        for _, lo, hi, new in by_old[old]:
            room[new] += max(0, min(hi, start + size) - max(lo, start))
    chosen = []
    for size, old, at_, _, block in on_cut:
        new = max(room, key=lambda j: (room[j], j == old, -j))
        room[new] -= size
        chosen.append((old, at_, new, block, size))
    on_cuts = _local(spark, [c[:3] for c in chosen], "old int, cut long, shard int")
    parts = [(r[0], r[1], r[2], r[3], r[4]) for r in placed.filter(F.col(n["cut"]).isNull()).groupBy(n["old"], n["block"], n["shard"]).agg(F.sum(n["size"]), F.count("*")).collect()]
    sums_of: dict[tuple[int, int, int], list[int]] = {}
    for old, block, new, size, rows in [*whole, *parts, *[(o, b, j, x, 1) for o, _, j, b, x in chosen]]:
        have = sums_of.setdefault((new, old, block), [0, 0])
        have[0] += size
        have[1] += rows
    gives = {i for i, j, _ in transfers if i != j} | {o for o, _, j, _, _ in chosen if o != j}
    takes = {j for i, j, _ in transfers if i != j} | {j for o, _, j, _, _ in chosen if o != j}
    pieces, slots, filled = [], {}, {}
    for (new, old, block), (size, rows) in sorted(sums_of.items(), key=lambda x: (x[0][0], x[0][1] != x[0][0], x[0])):
        pieces.append((old, block, new, slots.get(new, 0), filled.get(new, 0) // s.file_bytes))
        slots[new] = slots.get(new, 0) + rows
        filled[new] = filled.get(new, 0) + size
    return Plan(transfers, spans_df, on_cuts, blocks_df, _local(spark, pieces, "old int, block int, shard int, first_slot long, file long"), sorted(set(sizes) - gives - takes))


def moved_rows(work: Resharding, plan: Plan) -> DataFrame:
    """Rows of all shards that give or take something, with their new shard and slot, dealt out by file."""
    n = work.names
    rows = work.rows.filter(~F.col(n["old"]).isin(plan.untouched)) if plan.untouched else work.rows
    named = plan.blocks.select(F.col("old").alias(n["old"]), F.col("block").alias(n["block"]), F.col("shard").alias(n["shard"]), F.col("first").alias(n["first"]))
    rows = rows.join(F.broadcast(named), [n["old"], n["block"]])
    whole = rows.filter(F.col(n["first"]).isNull()).drop(n["first"])
    cut = work.placed(rows.filter(F.col(n["first"]).isNotNull()).drop(n["shard"]), plan.spans)
    chosen = F.broadcast(plan.on_cuts.select(F.col("old").alias("__o"), F.col("cut").alias("__c"), F.col("shard").alias("__s")))
    cut = cut.join(chosen, (F.col(n["old"]) == F.col("__o")) & (F.col(n["cut"]) == F.col("__c")), "left").withColumn(n["shard"], F.coalesce(n["shard"], "__s"))
    both = whole.unionByName(cut.select(*whole.columns))
    pieces = plan.pieces.select(F.col("old").alias(n["old"]), F.col("block").alias(n["block"]), F.col("shard").alias(n["shard"]), F.col("first_slot").alias(n["first"]), F.col("file").alias(n["file"]))
    both = both.join(F.broadcast(pieces), [n["old"], n["block"], n["shard"]]).repartition(F.col(n["shard"]), F.col(n["file"]))
    inside = W.partitionBy(n["shard"], n["file"], n["old"], n["block"]).orderBy(*work.sorted_by)
    return both.withColumn(n["slot"], F.col(n["first"]) + F.row_number().over(inside) - 1)


@dataclass
class Resharded:
    """Where rewritten shards lie (path/<shard column>=<number>), which old shards were left alone, and what moved."""

    path: str
    shard_col: str
    slot_col: str
    untouched: list[int]
    transfers: list[tuple[int, int, int]]
    schema: object

    def read(self, spark) -> DataFrame:
        """The rewritten shards' rows with shard and slot, from the files."""
        return spark.read.schema(self.schema).parquet(self.path)


def reshard(docs: DataFrame, old: Column, shards: int, path: str, s: ReshardSettings = ReshardSettings(), capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Resharded:
    """Writes ``docs``, which lie in the shards ``old``, to shards 0 to ``shards`` - 1 of equal bytes (or ``capacities``).

    A shard's size differs from its capacity by less than the largest row that lies on a cut. Rows with a null ``old``
    come from no shard and all move. Slots number a shard's rows from 0 without gaps, those that stay first. A shard
    that neither gives nor takes is not written again: it is in ``untouched``, its files and slots stay. All columns are
    written as they are, null texts too; the shard and slot columns get names that none of them has. Rows that are equal
    in everything are told apart by place only, and lie in one block. The result depends on the rows, not on how they
    are dealt out. Without rows only an empty folder is written.
    """
    scratch = Scratch(docs.sparkSession, "resharding")
    work = Resharding(docs, old, s, id_col, text_col)
    plan = plan_resharding(work, shards, scratch, capacities)
    n = work.names
    out = moved_rows(work, plan).select(*docs.columns, n["slot"], n["shard"])
    out.write.partitionBy(n["shard"]).parquet(path)
    scratch.clear()
    return Resharded(path, n["shard"], n["slot"], plan.untouched, plan.transfers, out.schema)
