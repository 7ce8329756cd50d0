"""Operator 10: consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2**32 places. A row goes to the next point clockwise of its
key's hash; where that point's shard is full, it goes on clockwise to the first shard that has room. Under the
law ``rows`` the capacities add up to the number of rows, so counts differ by one at most.

Rows overflow in one order (rank on the arc), so the whole walk needs only the number of rows on each arc: the
driver walks over ``shards * vnodes`` counts, however many rows there are, and gets ranges of ranks for each arc.
Rows then find their range by a join with that table, whose size is bounded by the ring and the number of cells. Rows
of an arc are ranked in cells by a hash of all their columns, one for each ``per_cell`` rows of the arc, so that no
window holds a whole arc, even one of many equal keys.

Null ids and null texts are values like any other (a null text has no bytes); repeated rows are placed one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard) of all virtual nodes."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"shard-{s}-{v}".encode()).digest()[:4], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def walk(points: list[tuple[int, int]], counts: dict[tuple[int, int], int], capacity: list[int]):
    """Ranges (arc, cell, first rank, end rank, shard, first slot): ``counts`` holds rows by (arc, cell).

    Arcs hand what their shard can't take to the next arc, round the ring until nothing is left; each step
    places rows or moves them on, and a full round without a place can't happen while capacities suffice.
    """
    n = len(points)
    waiting: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    for (arc, cell), rows in sorted(counts.items()):
        waiting[arc].append((arc, cell, 0, rows))
    left, slot, out = list(capacity), [0] * len(capacity), []
    while any(waiting):
        for i in range(n):
            shard, moved = points[i][1], []
            for arc, cell, a, b in waiting[i]:
                take = min(b - a, left[shard])
                if take:
                    out.append((arc, cell, a, a + take, shard, slot[shard]))
                    left[shard] -= take
                    slot[shard] += take
                if a + take < b:
                    moved.append((arc, cell, a + take, b))
            waiting[i] = []
            waiting[(i + 1) % n] += moved
    return out


def assign_shards(
    df: DataFrame, key: str, shards: int = 40, vnodes: int = 48, per_cell: int = 500_000, load_factor: float | None = None
) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``load_factor`` c bounds every shard to ceil(c * rows / shards); None sets exact capacities, one apart at
    most. ``df`` must be stable when read again (a table, or a checkpoint); its own ``shard`` and ``slot`` give way.
    """
    spark, points = df.sparkSession, ring(shards, vnodes)
    places = [p for p, _ in points]
    own, names = df.columns, [f"c{i}" for i in range(len(df.columns))]  # none that the columns here can clash with
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(names[own.index(key)]).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    # The arc of a place is the number of points before it: a bounded table of equal cells of the ring, each of
    # which knows its points, keeps this a lookup and a short array scan.
    grain = 1 << 12
    cell_points: list[list[int]] = [[] for _ in range(grain)]
    for p in places:
        cell_points[p // (RING // grain)].append(p)
    before = [bisect.bisect_left(places, c * (RING // grain)) for c in range(grain)]
    lookup = F.broadcast(spark.createDataFrame([(c, before[c], cell_points[c]) for c in range(grain)], "_grain int, _before int, _points array<long>"))
    placed = (
        df.toDF(*names)
        .withColumn("_place", hashed)
        .withColumn("_grain", (F.col("_place") / (RING // grain)).cast("int"))
        .join(lookup, "_grain", "left")
        .withColumn("_arc", (F.col("_before") + F.size(F.filter("_points", lambda p: p < F.col("_place")))) % len(points))
        .drop("_grain", "_before", "_points")
    )
    others = [F.xxhash64(F.col(c).cast("string")) if t.startswith(("array", "map", "struct")) else F.col(c) for c, (_, t) in zip(names, df.dtypes) if t != "void"]
    counts = {(r[0], 0): r[1] for r in placed.groupBy("_arc").count().collect()}  # shards * vnodes at most
    cells = {arc: -(-n // per_cell) for (arc, _), n in counts.items() if n > per_cell}
    if cells:
        many = F.create_map(*[F.lit(x) for kv in cells.items() for x in kv])
        placed = placed.withColumn("_cell", F.pmod(F.xxhash64("_place", *others), F.coalesce(F.element_at(many, F.col("_arc").cast("int")), F.lit(1))).cast("int"))
        split = placed.where(F.col("_arc").isin(list(cells))).groupBy("_arc", "_cell").count().collect()  # one for each per_cell rows
        counts = {k: n for k, n in counts.items() if k[0] not in cells} | {(r[0], r[1]): r[2] for r in split}
    else:
        placed = placed.withColumn("_cell", F.lit(0))
    rows = sum(counts.values())
    if load_factor is None:
        capacity = [rows // shards + (s < rows % shards) for s in range(shards)]
    else:
        capacity = [max(1, -int(-load_factor * rows // shards))] * shards
    ranges: dict[tuple[int, int], list] = {}
    for arc, cell, a, b, shard, slot in walk(points, counts, capacity):
        ranges.setdefault((arc, cell), []).append((a, b, shard, slot))
    plan = F.broadcast(
        spark.createDataFrame([(*k, v) for k, v in ranges.items()], "_arc int, _cell int, _ranges array<struct<a:long,b:long,shard:int,slot:long>>")
    )
    rank = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_place", *others)) - 1
    found = (
        placed.withColumn("_rank", rank)
        .join(plan, ["_arc", "_cell"])
        .withColumn("_r", F.filter("_ranges", lambda r: (r["a"] <= F.col("_rank")) & (F.col("_rank") < r["b"]))[0])
    )
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, own) if c not in ("shard", "slot")], F.col("_r.shard").alias("shard"), (F.col("_r.slot") + F.col("_rank") - F.col("_r.a")).alias("slot"))
