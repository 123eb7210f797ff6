"""Points near other points or regions, on the sphere.

Places are balls: a centre and a radius. Coordinates become three-dimensional unit vectors, where "within r km" is
"within a chord of 2 sin(r / 2R)", so neither poles nor the date line are special. There is one plan, whatever the sizes:
space is cut by k-d splits fitted on a bounded sample of points, as deep as the counted points need. Points go to their
cell, balls to every cell they reach into (the halo copies), and each cell joins locally, by a k-d tree over its balls.
Cells that hold more than ``CELL_ROWS`` points all the same are salted: their points are dealt out, their balls copied.
A batch of points descends the tree together, so that Python works on arrays, not on points.

Regions are polygons: points and edges go to strips of longitude, and a plane sweep passes over each strip.

A null or not-a-number coordinate, a latitude beyond 90 degrees, or a null or negative radius is no case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.runtime import cut_lineage

EARTH_KM = 6371.0
#: Places that ``nearest_place`` sends to the tasks at a time (40 bytes each, and their name).
BALLS = 100_000
#: Points that fit the splits, at most about twice as many; a bound on what the driver holds, not on what is joined.
SAMPLE = 50_000
#: Points of a cell that one task takes.
CELL_ROWS = 50_000
#: Levels of the splits: 2^14 cells of CELL_ROWS points are 800 million; cells beyond are salted.
DEEPEST = 14
LEAF = 16


def haversine_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lng_b - lng_a) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable(lat: Column, lng: Column) -> Column:
    return lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) <= 90) & (F.abs(lng) < float("inf"))


def unit_vectors(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def haversine(lat_a: np.ndarray, lng_a: np.ndarray, lat_b: np.ndarray, lng_b: np.ndarray) -> np.ndarray:
    """``haversine_km`` of arrays."""
    a = np.sin(np.radians(lat_b - lat_a) / 2) ** 2 + np.cos(np.radians(lat_a)) * np.cos(np.radians(lat_b)) * np.sin(np.radians(lng_b - lng_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def chord(km: np.ndarray) -> np.ndarray:
    return 2 * np.sin(np.minimum(km / EARTH_KM, np.pi) / 2)


class Splits:
    """A complete k-d tree of ``depth`` levels over a sample: node k splits ``axis[k]`` at ``value[k]``."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.value = np.zeros(2**depth, dtype=int), np.zeros(2**depth)
        parts = {1: sample}
        for k in range(1, 2**depth):
            part = parts.pop(k)
            if len(part):
                self.axis[k] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.value[k] = np.median(part[:, self.axis[k]])
            right = part[:, self.axis[k]] > self.value[k]
            parts[2 * k], parts[2 * k + 1] = part[~right], part[right]

    def cells(self, v: np.ndarray) -> np.ndarray:
        at = np.ones(len(v), dtype=int)
        for _ in range(self.depth):
            at = 2 * at + (v[np.arange(len(v)), self.axis[at]] > self.value[at])
        return at

    def halo(self, v: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, cell) for every cell that a ball reaches into."""
        who, at = np.arange(len(v)), np.ones(len(v), dtype=int)
        for _ in range(self.depth):
            x, split = v[who, self.axis[at]], self.value[at]
            left, right = x - reach[who] <= split, x + reach[who] > split
            who, at = np.concatenate([who[left], who[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
        return who, at


class BallTree:
    """k-d tree over balls; every node knows the box that its balls reach into."""

    def __init__(self, centres: np.ndarray, reach: np.ndarray) -> None:
        self.centres, self.reach = centres, reach
        self.root = self._node(np.arange(len(reach)))

    def _node(self, own: np.ndarray) -> tuple:
        c, r = self.centres[own], self.reach[own, None]
        box = ((c - r).min(axis=0), (c + r).max(axis=0)) if len(own) else (np.full(3, np.inf), np.full(3, -np.inf))
        if len(own) <= LEAF:
            return box, own, None
        axis = np.argmax(c.max(axis=0) - c.min(axis=0))
        order = own[np.argsort(c[:, axis], kind="stable")]
        return box, None, (self._node(order[: len(own) // 2]), self._node(order[len(own) // 2 :]))

    def query(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, ball) for every point within a ball."""
        points, balls, todo = [], [], [(self.root, np.arange(len(v)))]
        while todo:
            (box, own, children), at = todo.pop()
            w = v[at]
            at = at[((w >= box[0] - 1e-12) & (w <= box[1] + 1e-12)).all(axis=1)]
            if not len(at):
                continue
            if children:
                todo += [(child, at) for child in children]
                continue
            gap = ((v[at, None, :] - self.centres[None, own, :]) ** 2).sum(axis=2)
            p, b = np.nonzero(gap <= (self.reach[own] ** 2)[None, :] * (1 + 1e-12))
            points.append(at[p])
            balls.append(own[b])
        none = np.zeros(0, dtype=int)
        return (np.concatenate(points), np.concatenate(balls)) if points else (none, none)

    def nearest(self, v: np.ndarray, lat: np.ndarray, lng: np.ndarray, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, km) nearest to every point: kilometres at six decimals, the smaller ``rank`` among equals. ``places``
        holds latitude and longitude of the centres; branches farther than the best so far are not entered."""
        who, km = np.full(len(v), -1), np.full(len(v), np.inf)

        def gap(node: tuple, at: np.ndarray) -> np.ndarray:
            return np.sqrt((np.maximum(np.maximum(node[0][0] - v[at], v[at] - node[0][1]), 0) ** 2).sum(axis=1))

        def visit(node: tuple, at: np.ndarray) -> None:
            at = at[gap(node, at) <= chord(km[at] + 1e-5) + 1e-9]
            if not len(at):
                return
            _, own, children = node
            if children:
                left = gap(children[0], at) <= gap(children[1], at)
                for child, part in ((children[0], at[left]), (children[1], at[~left]), (children[1], at[left]), (children[0], at[~left])):
                    visit(child, part)
                return
            own = own[np.argsort(rank[own], kind="stable")]
            if not len(own):
                return
            far = np.round(haversine(lat[at, None], lng[at, None], places[None, own, 0], places[None, own, 1]), 6)
            first = far.argmin(axis=1)
            d, b = far[np.arange(len(at)), first], own[first]
            better = (d < km[at]) | (d == km[at]) & (rank[b] < rank[who[at]])
            who[at[better]], km[at[better]] = b[better], d[better]

        visit(self.root, np.arange(len(v)))
        return who, km


def _located(df: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """One row for each key and usable position, rows of one key side by side."""
    ok = df.where(usable(F.col(lat), F.col(lng)) & F.col(key).isNotNull())
    spots = ok.groupBy(F.col(key).alias("id")).agg(F.collect_set(F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng"))).alias("spots"))
    return spots.select("id", F.explode("spots").alias("s")).select("id", "s.lat", "s.lng")


def within_radius(points: DataFrame, places: DataFrame, *, key: str = "id", lat: str = "lat", lng: str = "lng", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, name): every id of ``points`` and place with a distance of at most the place's ``radius_km``, once.

    ``points`` has ``key``, ``lat``, ``lng``; ``places`` has name, lat, lng, radius_km. Other columns do not matter.
    An id with several positions counts wherever one of them lies.
    """
    spots = cut_lineage(_located(points, key, lat, lng))
    good = places.where(usable(F.col("lat"), F.col("lng")) & F.col("name").isNotNull() & (F.col("radius_km") >= 0)).select("name", "lat", "lng", "radius_km").distinct()
    kinds = T.StructType([T.StructField("id", spots.schema["id"].dataType), T.StructField("name", places.schema["name"].dataType)])
    placed, halo = _cells(spots, good, cell_rows)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(unit_vectors(right["lat"].to_numpy(), right["lng"].to_numpy()), chord(right["radius_km"].to_numpy()))
        p, b = tree.query(unit_vectors(left["lat"].to_numpy(), left["lng"].to_numpy()))
        found = pd.DataFrame({"id": left["id"].to_numpy()[p], "name": right["name"].to_numpy()[b]})
        return found.drop_duplicates() if left["id"].duplicated().any() or right["name"].duplicated().any() else found

    met = placed.groupBy("cell", "salt").cogroup(halo.groupBy("cell", "salt")).applyInPandas(meet, kinds)
    # an id may lie in two cells only if it has two positions; a name may have two balls
    return met.distinct()


def _cells(spots: DataFrame, good: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The points with their cell and salt, and the balls copied to every cell and salt that they reach into."""
    total = spots.count()
    depth = min(max((-(-total // cell_rows) - 1).bit_length(), 1), DEEPEST)
    every = max(1, total // SAMPLE)  # one point in so many, by hash: about SAMPLE to twice as many
    sample = spots.where(F.pmod(F.xxhash64("id", "lat", "lng"), F.lit(every)) == 0).select("lat", "lng").toPandas()
    splits = Splits(unit_vectors(sample["lat"].to_numpy(dtype=float), sample["lng"].to_numpy(dtype=float)), depth)

    def cell_of(lat: pd.Series, lng: pd.Series) -> pd.Series:
        return pd.Series(splits.cells(unit_vectors(lat.to_numpy(), lng.to_numpy())))

    celled = spots.withColumn("cell", F.pandas_udf(cell_of, "int")("lat", "lng"))
    rows = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # at most 2^DEEPEST rows
    salts = {c: -(-n // (2 * cell_rows)) for c, n in rows.items()}
    many = {c: n for c, n in salts.items() if n > 1}
    salted = F.create_map(*(F.lit(x) for c, n in many.items() for x in (c, n)))[F.col("cell")] if many else F.lit(1)
    placed = celled.withColumn("salt", F.pmod(F.xxhash64("id", "lat", "lng"), F.coalesce(salted, F.lit(1))).cast("int"))

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            who, at = splits.halo(unit_vectors(pdf["lat"].to_numpy(), pdf["lng"].to_numpy()), chord(pdf["radius_km"].to_numpy()))
            times = np.array([salts.get(c, 0) for c in at], dtype=int)
            salt = np.concatenate([np.arange(n) for n in times]) if len(times) else times
            yield pdf.iloc[np.repeat(who, times)].assign(cell=np.repeat(at, times), salt=salt)

    return placed, good.mapInPandas(copy, T.StructType([*good.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("salt", T.IntegerType())]))


def neighbour_counts(points: DataFrame, km: float, *, key: str = "id", lat: str = "lat", lng: str = "lng", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_near): for every located id how many other ids lie within ``km``.

    Positions that are alike are one point with a count, so that a spot which a third of the rows share costs as much as
    any other; what joins are different positions. An id with several positions counts once for each, and has the
    greatest of its numbers.
    """
    spots = cut_lineage(_located(points, key, lat, lng))
    places = cut_lineage(spots.groupBy("lat", "lng").agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("lat", "lng")))
    balls = places.select(F.col("id").alias("name"), "lat", "lng", F.lit(float(km)).alias("radius_km"))
    placed, halo = _cells(places, balls, cell_rows)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(unit_vectors(left["lat"].to_numpy(), left["lng"].to_numpy()), np.full(len(left), chord(np.array(float(km)))))
        near = np.zeros(len(right), dtype=np.int64)
        for k in range(0, len(right), BATCH):  # so that the pairs of a crowded cell are never held at once
            p, b = tree.query(unit_vectors(right["lat"].to_numpy()[k : k + BATCH], right["lng"].to_numpy()[k : k + BATCH]))
            near[k : k + BATCH] = np.bincount(p, weights=left["n"].to_numpy()[b], minlength=len(near[k : k + BATCH])).astype(np.int64)
        return pd.DataFrame({"at": right["name"].to_numpy(), "near": near})

    met = placed.groupBy("cell", "salt").cogroup(halo.groupBy("cell", "salt")).applyInPandas(meet, "at bigint, near bigint")
    total = met.groupBy("at").agg(F.sum("near").alias("near"))
    counted = spots.select("id", F.xxhash64("lat", "lng").alias("at")).join(total, "at")
    return counted.groupBy("id").agg((F.max("near") - 1).alias("n_near"))


def neighbours_within(points: DataFrame, km: float, *, key: str = "id", lat: str = "lat", lng: str = "lng", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, near): for every id all other ids within ``km``; each pair in both directions."""
    centres = points.select(F.col(key).alias("name"), F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.lit(float(km)).alias("radius_km"))
    return within_radius(points, centres, key=key, lat=lat, lng=lng, cell_rows=cell_rows).where(F.col("id") != F.col("name")).withColumnRenamed("name", "near")


def nearest_place(points: DataFrame, places: DataFrame, *, key: str = "id", lat: str = "lat", lng: str = "lng", balls: int = BALLS) -> DataFrame:
    """(id, name, km): for every id the nearest of all ``places`` (name, lat, lng), at six decimals, by name among equals.

    Places go to the tasks in blocks of ``balls``, so their number is not bounded; the best of an id's positions and blocks
    is an aggregate with map-side combine.
    """
    spots = points.where(usable(F.col(lat), F.col(lng)) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    good = places.where(usable(F.col("lat"), F.col("lng")) & F.col("name").isNotNull()).select("name", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).distinct()
    blocks = -(-good.count() // balls)
    kinds = T.StructType([T.StructField("id", spots.schema["id"].dataType), T.StructField("name", T.StringType()), T.StructField("km", T.DoubleType())])
    found = None
    for k in range(blocks):
        part = good.where(F.pmod(F.xxhash64("name", "lat", "lng"), F.lit(blocks)) == k).orderBy("name").toPandas()
        if not len(part):
            continue
        shared = points.sparkSession.sparkContext.broadcast((part["name"].to_numpy(), part[["lat", "lng"]].to_numpy(dtype=float)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, numbers = shared.value
            tree, rank = BallTree(unit_vectors(numbers[:, 0], numbers[:, 1]), np.zeros(len(names))), np.arange(len(names))
            for pdf in batches:
                a, b = pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
                who, km = tree.nearest(unit_vectors(a, b), a, b, numbers, rank)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "name": names[who], "km": km})

        one = spots.mapInPandas(run, kinds)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return points.sparkSession.createDataFrame([], kinds)
    return found.groupBy("id").agg(F.min(F.struct("km", "name")).alias("m")).select("id", "m.name", "m.km")


def sweep_regions(x: np.ndarray, y: np.ndarray, edges: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) by a plane sweep from west to east.

    ``edges`` (n, 4) holds x, y of both ends, ``owner`` the region of each edge. An edge is active from its west end
    up to, not including, its east end; a point lies in the regions with an odd number of active edges below it. The
    sweep stops where edges begin or end; the points between two stops are held against the active edges together.
    """
    flip = edges[:, 0] > edges[:, 2]
    edges = np.where(flip[:, None], edges[:, [2, 3, 0, 1]], edges)
    steep = edges[:, 0] < edges[:, 2]
    edges, owner = edges[steep], owner[steep]
    none = np.zeros(0, dtype=int)
    if not len(edges) or not len(x):
        return none, none
    stops = np.unique(np.concatenate([edges[:, 0], edges[:, 2]]))
    first, last = np.searchsorted(stops, edges[:, 0]), np.searchsorted(stops, edges[:, 2])
    begin, end = np.argsort(first, kind="stable"), np.argsort(last, kind="stable")
    slab = np.searchsorted(stops, x, side="right") - 1
    order = np.argsort(slab, kind="stable")
    filled, starts = np.unique(slab[order], return_index=True)
    active, i, j = np.zeros(0, dtype=int), 0, 0
    points, regions = [], []
    for k, s in enumerate(filled):
        if s < 0 or s >= len(stops) - 1:
            continue
        upto = np.searchsorted(first[begin], s, side="right")
        active = np.concatenate([active, begin[i:upto]])
        i = max(i, upto)
        active = active[last[active] > s]
        if not len(active):
            continue
        own = order[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(order)]
        a = edges[active]
        kinds, group = np.unique(owner[active], return_inverse=True)
        for at in np.array_split(own, max(1, len(own) * len(active) // BATCH**2)):
            below = a[:, 1] + (a[:, 3] - a[:, 1]) * (x[at, None] - a[:, 0]) / (a[:, 2] - a[:, 0]) <= y[at, None]
            odd = np.zeros((len(at), len(kinds)), dtype=np.int64)
            np.add.at(odd.T, group, below.T.astype(np.int64))
            p, r = np.nonzero(odd % 2)
            points.append(at[p])
            regions.append(kinds[r])
    return (np.concatenate(points), np.concatenate(regions)) if points else (none, none)


#: Points that meet a crowd at a time.
BATCH = 2048
#: Points of a strip that one task takes, and strips at most.
STRIP_ROWS = 100_000
STRIPS = 4096


def regions_containing(points: DataFrame, regions: DataFrame, *, key: str = "id", lat: str = "lat", lng: str = "lng", strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(id, name): every point and polygon that contains it (even-odd rule; a shared border belongs to one side).

    ``regions`` has name and ring, an array of (lat, lng) corners; a ring need not be closed, one of fewer than three
    corners is empty, and one that crosses the date line must be cut there. Points and edges go by strips of longitude, as
    many as the counted points need, each edge to the strips it spans; a strip of one longitude is dealt out by latitude's
    hash, its edges copied.
    """
    kinds = T.StructType([T.StructField("id", points.schema[key].dataType), T.StructField("name", regions.schema["name"].dataType)])
    spots = cut_lineage(_located(points, key, lat, lng))
    ring = F.col("ring")
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = regions.where(F.col("name").isNotNull() & (F.size("ring") >= 3)).select("name", F.explode(F.arrays_zip(ring.alias("a"), after.alias("b"))).alias("e")).select("name", F.col("e.a.lng").alias("x"), F.col("e.a.lat").alias("y"), F.col("e.b.lng").alias("u"), F.col("e.b.lat").alias("v"))

    def swept(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        owner, names = pd.factorize(right["name"])
        p, r = sweep_regions(left["lng"].to_numpy(), left["lat"].to_numpy(), right[["x", "y", "u", "v"]].to_numpy(dtype=float), owner, len(names))
        return pd.DataFrame({"id": left["id"].to_numpy()[p], "name": np.asarray(names, dtype=object)[r]})

    strips = min(-(-spots.count() // strip_rows), STRIPS)
    cuts = sorted(set(spots.approxQuantile("lng", [k / strips for k in range(1, strips)], 0.1 / strips))) if strips > 1 else []

    def strip_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="right"))

    strip = F.pandas_udf(strip_of, "int")
    left = spots.withColumn("strip", strip("lng"))
    rows = {r["strip"]: r["count"] for r in left.groupBy("strip").count().collect()}  # at most STRIPS rows
    many = {c: -(-n // (2 * strip_rows)) for c, n in rows.items() if n > 2 * strip_rows}
    salts = F.coalesce(F.create_map(*(F.lit(x) for c, n in many.items() for x in (c, n)))[F.col("strip")], F.lit(1)) if many else F.lit(1)
    left = left.withColumn("salt", F.pmod(F.xxhash64("id", "lat"), salts).cast("int"))
    ends = edges.withColumn("west", strip(F.least("x", "u"))).withColumn("east", strip(F.greatest("x", "u")))
    right = ends.withColumn("strip", F.explode(F.sequence("west", "east"))).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.groupBy("strip", "salt").cogroup(right.groupBy("strip", "salt")).applyInPandas(swept, kinds).distinct()
