"""k-means: rounds of an assignment against broadcast centres and an aggregation; only centres reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.spool import durable
from ..types import Criteria
from .distance import matrix


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Points (id, p: array of doubles) with label and squared distance to the nearest centre (ties: the first)."""
    held = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    square = lambda c: F.aggregate(F.zip_with("p", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    d = F.transform(held, square)
    return points.withColumn("_d", d).withColumn("d2", F.array_min("_d")).withColumn("label", (F.array_position("_d", F.col("d2")) - 1).cast("int")).drop("_d")


def means(labelled: DataFrame) -> list[tuple[int, int, list[float]]]:
    """(label, count, mean) of each cluster; k rows reach the driver."""
    flat = labelled.select("label", F.posexplode("p").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    rows = flat.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()
    return [(r["label"], r["n"], [x["m"] for x in r["c"]]) for r in rows]


#: Rounds of oversampling, and candidates drawn in each as a multiple of k.
ROUNDS, OVERSAMPLING = 5, 2


def nearest(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Points (id, p) with label and squared distance to the nearest of the centres, which are broadcast."""
    sent = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, best, label = matrix(batch.column("p")), np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows, np.int32)
                for j, c in enumerate(sent.value):
                    d = ((x - c) ** 2).sum(1)
                    closer = d < best
                    best[closer], label[closer] = d[closer], j
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("p"), pa.array(label), pa.array(best)], names=["id", "p", "label", "d2"])

    return points.select("id", "p").mapInArrow(run, "id long, p array<double>, label int, d2 double")


def _uniform(seed: int) -> Column:
    """A number between 0 and 1 for each id."""
    return (F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def candidates(points: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places spread over the points, and how many points are nearest to each.

    Each round draws about ``OVERSAMPLING`` * k points, a point by its squared distance to the places so far, so the
    passes over the points don't grow with k; the places that reach the driver do.
    """
    first = points.orderBy(_uniform(seed), "id").limit(1).select("p").collect()
    chosen, seen = [list(r["p"]) for r in first], {tuple(r["p"]) for r in first}
    for turn in range(ROUNDS + k if first else 0):  # more than ROUNDS only while they are fewer than k
        if turn >= ROUNDS and len(chosen) >= k:
            break
        d = durable(nearest(points, np.array(chosen)).select("id", "p", "d2"))
        total = d.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = d.where(_uniform(seed + 1 + turn) * F.lit(float(total)) < F.col("d2") * F.lit(float(OVERSAMPLING * k))).where("d2 > 0")
        for r in drawn.orderBy("id").select("p").collect():
            if tuple(r["p"]) not in seen:
                seen.add(tuple(r["p"]))
                chosen.append(list(r["p"]))
    weight = np.zeros(len(chosen))
    for r in nearest(points, np.array(chosen)).groupBy("label").count().collect() if chosen else []:
        weight[r["label"]] = r["count"]
    return np.array(chosen), weight


def start_centres(points: DataFrame, k: int, seed: int, spread: bool = True) -> list[list[float]]:
    """k points: spread out, or any k, by hashes of id and seed; fewer where there aren't k different points.

    Spread out: of the weighted ``candidates`` one is drawn by weight, each next by weight times squared distance to
    those drawn.
    """
    if not spread:
        return [list(r["p"]) for r in points.orderBy(_uniform(seed), "id").limit(k).select("p").collect()]
    places, weight = candidates(points, k, seed)
    rng, chosen = np.random.default_rng(seed), []
    near = np.ones(len(places))
    while len(chosen) < min(k, len(places)) and (weight * near).sum() > 0:
        chosen.append(int(rng.choice(len(places), p=weight * near / (weight * near).sum())))
        d = ((places - places[chosen[-1]]) ** 2).sum(1)
        near = d if len(chosen) == 1 else np.minimum(near, d)
    return places[chosen].tolist()


def kmeans(points: DataFrame, k: int, criteria: Criteria = Criteria(10, 1e-4), attempts: int = 1, seed: int = 0, spread: bool = True, initial: DataFrame | None = None) -> tuple[DataFrame, list[list[float]], float]:
    """(labelled points, centres, compactness), the best of some attempts.

    ``initial`` (id, label) starts the first attempt. An empty cluster takes the point of the largest cluster that
    is farthest from its centre.
    """
    points = durable(points.select("id", F.transform("p", lambda v: v.cast("double")).alias("p")))
    best = None
    for attempt in range(max(1, attempts)):
        if initial is not None and attempt == 0:
            found = means(points.join(initial.select("id", "label"), "id"))
            centres = [c for _, _, c in found]
        else:
            centres = start_centres(points, k, seed + 7919 * attempt, spread)
        for _ in range(criteria.max_count):
            labelled = assign(points, centres)
            found = {label: (n, c) for label, n, c in means(labelled)}
            new = [found[j][1] if j in found else None for j in range(len(centres))]
            taken: list[int] = []
            for j in [j for j, c in enumerate(new) if c is None]:
                largest = max(found, key=lambda x: found[x][0])
                far = labelled.where((F.col("label") == largest) & ~F.col("id").isin(taken or [-1])).orderBy(F.desc("d2"), "id").first()
                taken.append(far["id"])
                new[j] = list(far["p"])
            shift = float(np.abs(np.array(new) - np.array(centres)).max())
            centres = new
            if shift <= criteria.epsilon:
                break
        labelled = assign(points, centres)
        compactness = labelled.agg(F.sum("d2")).first()[0]
        if best is None or compactness < best[2]:
            best = labelled, centres, compactness
    return best


def farthest(labelled: DataFrame) -> DataFrame:
    """Of each cluster, the point farthest from its centre (ties: the smallest id)."""
    w = Window.partitionBy("label").orderBy(F.desc("d2"), "id")
    return labelled.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
