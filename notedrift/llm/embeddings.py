"""Operator 6: embedding near duplicates with randomised-rotation binary codes.

Equal vectors are collapsed first.  Every distinct unit vector is turned by a
fixed random rotation and stored as its signs, one bit each, with a correction factor:
the cosine of the rotated vector and its sign code.  The product of a code with another
rotated vector, divided by the factor, is an unbiased estimate of their cosine over the
random rotations: what the code has beside its own vector points in a random direction.
For a pair at cosine c the error has a deviation of sqrt(1 - c^2) * sqrt(1 - f^2) / (f *
sqrt(d - 1)), so a pair whose estimate is ``CONFIDENCE`` deviations below the threshold
is discarded (a linked pair meets that with a chance of about 1e-9).  In fewer than
``LEAST_DIMENSIONS`` dimensions, where that law is rough, the proven bound is taken: the
angle of a code and a partner is no more than the code's own angle and the link angle
together.  All other pairs are computed again exactly in double precision, so no pair
below the threshold links.

Every vector has one home: the cell of its nearest centre (a bounded sample of the
vectors; every vector is indexed).  Cells whose centres are close are packed into
units of at most ``UNIT`` vectors, and a larger cell is dealt into several units.
A pair is compared in the lower unit of its two homes: a vector visits every lower
unit that may hold a partner.  That is a proven bound, not a number of probes: a
partner x at home with centre c has x.c >= x.c' for every other centre c', so a
vector y within the link angle of x has y.c >= y.c' - sqrt(1 - threshold^2) |c - c'|,
and y is no farther from c than the cell's own radius plus the link angle.  Where
the bounds exclude little (vectors without groups, or one dense group) the work is
that of all pairs.  Visitors of ``VISITS`` units meet a unit in one task, so no task
grows with the data.  A task returns link counts and a spanning forest, never all
its pairs.

Defined results: null or zero vectors and vectors with null or non-finite
components link with nothing; vectors of different lengths do not link; equal
vectors link; ids may repeat or be null; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .skew import join_even

PER_CELL, MOST_CENTRES, UNIT, VISITS = 1_000, 4_096, 2_048, 4
#: Centres of a vector, nearest first, against which the other cells are bounded: each is a proven bound of its own.
WITNESSES = 4
#: Slack of the bounds for rounding.
SLACK = 1e-6
#: Deviations of the estimate that a discarded pair is below the threshold; dimensions from which its law is used.
CONFIDENCE, LEAST_DIMENSIONS = 6.0, 32


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is drawn."""
    q, r = np.linalg.qr(np.random.default_rng(1_000_003 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors (one row of bytes each) and the correction factors."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def signs(packed: np.ndarray, d: int) -> np.ndarray:
    """Codes as rows of +-1."""
    return np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1


def least_estimate(factor: np.ndarray, d: int, threshold: float) -> np.ndarray:
    """The estimate below which a pair of the code is discarded."""
    if d < LEAST_DIMENSIONS:
        angle = np.arccos(np.clip(factor, -1, 1)) + np.arccos(np.clip(threshold, -1, 1))
        return np.cos(np.minimum(angle, np.pi)) / factor - 1e-5
    # the least of c - CONFIDENCE deviations at c over [threshold, 1] is at its lower end for a threshold of 0 or more
    width = np.sqrt(1 - max(threshold, 0.0) ** 2) if threshold > 0 else 1.0
    return threshold - CONFIDENCE * width * np.sqrt(np.maximum(1 - factor ** 2, 0)) / (factor * np.sqrt(d - 1)) - 1e-5


def undecided(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (code row, vector row) that the estimate of their cosine does not rule out; ``code`` as rows of +-1."""
    d = code.shape[1]
    estimate = (code @ turned.T.astype(np.float32)) / (np.sqrt(d) * factor[:, None]).astype(np.float32)
    return np.argwhere(estimate >= least_estimate(factor, d, threshold)[:, None].astype(np.float32))


def _units(frame: pd.DataFrame) -> np.ndarray:
    unit = np.stack(frame["embedding"].to_numpy()).astype(float)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _homes(centres: dict[int, np.ndarray], first: dict[int, int]):
    """Each vector's cell and the cosine to its centre; vectors of a length without centres share the cell ``-length``."""
    def run(frames):
        for frame in frames:
            for d, own in frame.groupby(frame["embedding"].map(len)):
                out = own[["node", "m", "embedding"]].copy()
                out["cell"], out["near"] = -int(d), -1.0
                unit = _units(own)
                code, out["factor"] = codes(unit)
                out["code"] = [c.tobytes() for c in code]
                if d in centres:
                    cell, near = np.empty(len(own), np.int64), np.empty(len(own))
                    for lo in range(0, len(own), 4_096):
                        dots = unit[lo:lo + 4_096] @ centres[d].T
                        cell[lo:lo + 4_096] = dots.argmax(axis=1)
                        near[lo:lo + 4_096] = dots.max(axis=1)
                    out["cell"], out["near"] = cell + first[d], near
                yield out
    return run


def pack_cells(counts: dict[int, int], centres: dict[int, np.ndarray], first: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """(first unit, units) of each cell: close cells share a unit of at most ``most`` vectors, larger cells have several units."""
    place, at = {}, 0
    for cell, n in sorted(counts.items()):
        if cell < 0 or n > most:
            place[cell] = (at, -(-n // most))
            at += place[cell][1]
    for d, vectors in centres.items():
        small = np.array([first[d] + i in counts and first[d] + i not in place for i in range(len(vectors))])
        while small.any():
            seed = int(np.argmax(small))
            held = 0
            for i in np.argsort(-(vectors @ vectors[seed]), kind="stable").tolist():
                if small[i]:
                    if held and held + counts[first[d] + i] > most:
                        break
                    held += counts[first[d] + i]
                    small[i] = False
                    place[first[d] + i] = (at, 1)
            at += 1
    return place


def _gaps(vectors: np.ndarray, used: np.ndarray, sine: float) -> np.ndarray:
    """Sine times the distance of every centre (row) to the used ones, in single precision and no smaller than it is."""
    out = np.empty((len(vectors), len(used)), np.float32)
    for lo in range(0, len(vectors), 512):
        dots = np.clip(vectors[lo:lo + 512] @ vectors[used].T, -1, 1)
        out[lo:lo + 512] = sine * np.sqrt(2 - 2 * dots + 1e-14) + 1e-6
    return out


def _visits(centres: dict[int, np.ndarray], first: dict[int, int], place: dict[int, tuple[int, int]], radius: dict[int, float], threshold: float):
    """Each vector's own unit and all lower units that may hold a partner of it."""
    # sine of the link angle; at a threshold of 0 or less nothing is excluded
    sine = np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else 1.0
    angle = np.arccos(np.clip(threshold, -1, 1))

    def run(frames):
        gaps: dict[int, np.ndarray] = {}  # once a task
        for frame in frames:
            for (d, _), own in frame.groupby([frame["embedding"].map(len), frame["cell"] < 0]):
                cells = own["cell"].to_numpy()
                node = own["node"].to_numpy()
                start, parts = (np.array([place[c][k] for c in cells.tolist()], np.int64) for k in (0, 1))
                # a hash of the node deals a cell's vectors to its units
                unit_of = start + ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                visits = [np.arange(s, u) for s, u in zip(start.tolist(), unit_of.tolist())]
                if d in centres:
                    vectors = centres[d]
                    used = np.array([i for i in range(len(vectors)) if first[d] + i in place], np.int64)
                    begin, size = (np.array([place[first[d] + i][k] for i in used.tolist()], np.int64) for k in (0, 1))
                    reach = np.cos(np.minimum(np.pi, np.arccos(np.clip([radius[first[d] + i] for i in used.tolist()], -1, 1)) + angle))
                    if d not in gaps:
                        gaps[d] = _gaps(vectors, used, sine)
                    unit = _units(own)
                    witnesses = min(WITNESSES, len(vectors))
                    for lo in range(0, len(own), 1_024):
                        dots = unit[lo:lo + 1_024] @ vectors.T
                        inside = dots[:, used]
                        open_ = inside >= reach - SLACK
                        near = np.argpartition(-dots, witnesses - 1, axis=1)[:, :witnesses]
                        for w in near.T:
                            open_ &= inside >= dots[np.arange(len(dots)), w][:, None] - gaps[d][w] - SLACK
                        for i, row in enumerate(open_, lo):
                            lower = np.flatnonzero(row & (begin < unit_of[i]))
                            many = lower[size[lower] > 1]
                            several = [np.arange(begin[j], min(begin[j] + size[j], unit_of[i])) for j in many.tolist()]
                            visits[i] = np.unique(np.concatenate([visits[i], begin[lower], *several]))
                out = own[["node", "m", "embedding", "code", "factor"]].copy()
                out["unit"] = unit_of
                out["visits"] = visits
                yield out
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row reachable from each row over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, step: int = 2_048):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        unit_no, chunk = key
        frame = frame.sort_values("node", kind="stable")
        unit = _units(frame)
        d = unit.shape[1]
        code = signs(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), d)
        factor, turned = frame["factor"].to_numpy(), unit @ rotation(d)
        home = frame["home"].to_numpy()
        m = frame["m"].to_numpy().astype(float)
        left, right = np.flatnonzero(home), np.flatnonzero(~home)
        links, root = np.zeros(len(frame)), np.arange(len(frame))

        def compare(x: np.ndarray, y: np.ndarray, same: bool) -> None:
            nonlocal root
            got = undecided(code[x], factor[x], turned[y], threshold)
            a, b = x[got[:, 0]], y[got[:, 1]]
            if same:
                a, b = a[a < b], b[a < b]
            for lo in range(0, len(a), 100_000):  # exact recomputation of the undecided pairs
                p, q = a[lo:lo + 100_000], b[lo:lo + 100_000]
                near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[near], q[near]
                if len(p):
                    links[:] += np.bincount(p, m[q], len(frame)) + np.bincount(q, m[p], len(frame))
                    # only links between different trees change the forest
                    new = root[p] != root[q]
                    if new.any():
                        every = np.arange(len(frame))
                        root = _roots(len(frame), np.concatenate([every, p[new]]), np.concatenate([root, q[new]]))

        pieces = lambda x: [x[lo:lo + step] for lo in range(0, len(x), step)]
        if chunk == unit_no // VISITS:  # pairs inside the unit, once
            for i, x in enumerate(pieces(left)):
                for j, y in enumerate(pieces(left)[i:]):
                    compare(x, y, j == 0)
        for x in pieces(left):
            for y in pieces(right):
                compare(x, y, False)
        on = np.flatnonzero(links > 0)
        node = frame["node"].to_numpy()
        return pd.DataFrame({"node": node[on], "links": links[on].astype(np.int64), "root": node[root[on]]})
    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept): one row a vector."""
    own = materialize(rows.select(F.col(id_col).alias("key"), F.col(vector_col).alias("embedding")), "op6-vectors")
    kind = dict(own.dtypes)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = own.where(usable)
    distinct = good.groupBy("embedding").agg(F.count("*").alias("m"), F.min("key").alias("least"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "op6-distinct")
    n = distinct.count()
    size = int(min(MOST_CENTRES, max(1, n // PER_CELL)))
    sample = distinct.orderBy(F.xxhash64("embedding")).select("embedding").limit(size).collect()  # at most MOST_CENTRES
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    centres, first, at = {}, {}, 0
    for d, found in by_length.items():
        vectors = np.array(found, float)
        centres[d], first[d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), at
        at += len(found)

    shape = f"node long, m long, embedding {kind['embedding']}, code binary, factor double"
    homes = materialize(distinct.select("node", "m", "embedding").mapInPandas(_homes(centres, first), f"{shape}, cell long, near double"), "op6-homes")
    # one row a cell: at most MOST_CENTRES and one for each vector length
    cells = homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("radius")).collect()
    place = pack_cells({r["cell"]: r["n"] for r in cells}, centres, first, UNIT)
    visits = _visits(centres, first, place, {r["cell"]: r["radius"] for r in cells}, threshold)
    placed = materialize(homes.mapInPandas(visits, f"{shape}, unit long, visits array<long>"), "op6-units")
    chunk = F.floor(F.col("unit") / VISITS).alias("chunk")
    guests = placed.select(F.explode("visits").alias("at"), chunk, "node", "m", "embedding", "code", "factor", F.lit(False).alias("home"))
    met = guests.select("at", "chunk").distinct()
    inside = placed.select(F.col("unit").alias("at"), chunk).distinct()
    hosts = placed.select(F.col("unit").alias("at"), "node", "m", "embedding", "code", "factor", F.lit(True).alias("home")).join(met.union(inside).distinct(), "at")
    found = guests.unionByName(hosts).groupBy("at", "chunk").applyInPandas(_compare(threshold), "node long, links long, root long")
    found = materialize(found, "op6-links")

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found, "node", "root", "op6")
    named = (distinct.drop("embedding").join(counted, "node", "left").join(reached, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    table = materialize(distinct.select("node", "embedding", "m").join(named, "node").select("embedding", "m", "n_links", "component_id"), "op6-groups")
    linked = join_even(own.where(usable), table, "embedding", "m", n).select("key", "n_links", "component_id")
    alone = own.where(~usable).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(id_col), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
