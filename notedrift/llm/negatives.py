"""Operator 13: hard-negative mining with angular triangle filtering.

Components become integers, so every score (inner product) is exact.  A row stores
its norm and its angles to a few reference directions (a bounded sample of the rows).
By the triangle inequality the angle of two rows lies between the largest difference
and the smallest sum of their angles to one reference; the cosines of those ends,
multiplied by the norms and widened beyond any rounding, bound their score.

Rows have a unit: their nearest reference and a ring of the angle to it.  Units of many
rows are dealt into parts.  An anchor visits the units whose bounds overlap a window of
scores it wants; inside a part rows lie by angle in segments, each with the interval
of its angles to every reference and of its norms, and only the segments whose bounds
overlap a window of the anchor (and may beat its best rows so far) get integer scoring.

Three rounds: an anchor's own unit gives a lower limit for its positives, the units that
may reach that limit give the positives, and their scores give the windows of the
negatives.  Where angles exclude little (rows without groups) the work is that of all
anchors against all rows, in blocks of bounded size; a block returns no more than the
best rows of each window.

Defined results: rows with a null id, label or vector, with a null or non-finite
component or a norm of 2**28 or more after scaling (scores might not fit 64 bits) take
no part; rows of different lengths have no score; a zero vector scores zero; rows may
repeat: each is a row of its own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Reference directions, rings of a unit's angle, rows of a part, anchors of a block, rows of a segment.
REFERENCES, RINGS, PART, BLOCK, SEGMENT = 32, 64, 16_384, 16_384, 64
MOST_NORM = float(1 << 28)
#: Angles are stored as 16-bit fractions of pi; the slack covers their rounding and that of arccos and cos.
STEP = np.pi / 65_535
SLACK = STEP + 1e-6
FAR = 1 << 62
#: Scored rows a block holds before it keeps the best of each window.
HELD = 1 << 20


def _vectors(column: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the column, scaled and floored vectors) by vector length; rows without a usable vector are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    values = np.where(nulls, np.nan, values)
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[there]).tolist():
        at = np.flatnonzero(there & (sizes == d))
        with np.errstate(over="ignore", invalid="ignore"):
            rows = np.floor(values[first[at][:, None] + np.arange(d)] * scale)
            norm = np.sqrt((rows * rows).sum(axis=1))
            good = np.isfinite(rows).all(axis=1) & (norm < MOST_NORM)
        yield d, at[good], rows[good]


def _store(references: dict[int, np.ndarray], first: dict[int, int], scale: float):
    """Integer vectors with their norms, angles and units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, rows in _vectors(batch.column("vector"), scale):
                if not len(at):
                    continue
                norm = np.sqrt((rows * rows).sum(axis=1))
                angles = np.zeros((len(at), 0), "<u2")
                unit = np.full(len(at), d << 32, np.int64)
                if d in references:
                    cosine = rows @ references[d].T / np.where(norm > 0, norm, 1)[:, None]
                    angle = np.arccos(np.clip(cosine, -1, 1))
                    near = angle.argmin(axis=1)
                    ring = np.minimum(RINGS - 1, (angle[np.arange(len(at)), near] * (RINGS / np.pi)).astype(np.int64))
                    unit += ((first[d] + near + 1) << 8) + ring
                    angles = np.rint(angle / STEP).astype("<u2")
                small = np.abs(rows).max(axis=1, initial=0) < 1 << 15
                vectors = [row.astype("<i2" if s else "<i4").tobytes() for row, s in zip(rows, small.tolist())]
                keep = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(keep) for c in ("id", "label", "anchor")), pa.array(np.full(len(at), d, np.int32)), pa.array(unit), pa.array(norm),
                     pa.array(vectors, pa.binary()), pa.array([a.tobytes() for a in angles], pa.binary())],
                    names=["id", "label", "anchor", "d", "unit", "norm", "vector", "angles"])
    return run


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    """Stored vectors as exact floats."""
    out = np.empty((len(column), d))
    size = column.map(len).to_numpy()
    for kind in ("<i2", "<i4"):
        own = np.flatnonzero(size == d * np.dtype(kind).itemsize)
        if len(own) and d:
            out[own] = np.frombuffer(b"".join(column.iloc[own]), kind).reshape(len(own), d)
    return out


def _angles(column: pd.Series) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column), "<u2").reshape(n, -1) * STEP if n else np.zeros((0, 0))


def score_bounds(low: np.ndarray, high: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the integer scores of rows at an angle in [low, high] of a row of ``norm``, their norms in [least, most].

    Widened by SLACK in the angle, a relative 1e-9 and one whole, so no rounding makes them too narrow.
    """
    over = np.cos(np.clip(low - SLACK, 0, np.pi))
    under = np.cos(np.clip(high + SLACK, 0, np.pi))
    wide = norm * most * 1e-9 + 1
    return (np.where(under >= 0, norm * least * under, norm * most * under) - wide,
            np.where(over >= 0, norm * most * over, norm * least * over) + wide)


def scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``largest``: bound of the product of their norms."""
    if largest < 2.0**53:  # no partial sum is larger than the product of the norms
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _block(k: int, same: bool):
    """Best ``k`` rows of each window of each anchor in one part: (anchor, window, score, id, node)."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"anchor": np.empty(0, np.int64), "window": np.empty(0, np.int32), "score": np.empty(0, np.int64), "id": np.empty(0, np.int64), "node": np.empty(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        d = int(right["d"].iloc[0])
        own_angle = _angles(right["angles"])
        nearest = own_angle.min(axis=1) if own_angle.shape[1] else np.zeros(len(right))
        order = np.argsort(nearest, kind="stable")
        right, own_angle = right.iloc[order], own_angle[order]
        a, x = _matrix(left["vector"], d), _matrix(right["vector"], d)
        a_norm, x_norm = left["norm"].to_numpy(), right["norm"].to_numpy()
        cuts = np.arange(0, len(right), SEGMENT)
        least, most = np.minimum.reduceat(x_norm, cuts), np.maximum.reduceat(x_norm, cuts)
        low, high = np.zeros((len(left), len(cuts))), np.full((len(left), len(cuts)), np.pi)
        a_angle = _angles(left["angles"])
        for j in range(own_angle.shape[1]):
            near, far = np.minimum.reduceat(own_angle[:, j], cuts), np.maximum.reduceat(own_angle[:, j], cuts)
            at = a_angle[:, j, None]
            np.maximum(low, np.maximum(at - far, near - at), out=low)
            total = at + far
            np.minimum(high, np.minimum(total, np.pi), out=high)
            np.minimum(high, np.where(at + near > np.pi, 2 * np.pi - at - near, np.pi), out=high)
        under, over = score_bounds(low, high, a_norm[:, None], least, most)
        lows, highs = np.stack(left["lows"].to_numpy()), np.stack(left["highs"].to_numpy())  # anchors x windows
        windows = lows.shape[1]
        best = np.full((len(left), windows), -FAR)  # k-th best so far
        overlaps = np.zeros(over.shape, bool)
        for w in range(windows):
            overlaps |= (lows[:, w] <= highs[:, w])[:, None] & (over >= lows[:, w, None]) & (under <= highs[:, w, None])
        a_label, x_label = left["label"].to_numpy(), right["label"].to_numpy()
        a_node, x_node, x_id = left["node"].to_numpy(), right["node"].to_numpy(), right["id"].to_numpy()
        largest = float(a_norm.max() * x_norm.max())
        held, n_held = [np.empty((0, 4), np.int64)], 0

        def keep_best() -> None:
            nonlocal held, n_held
            rows = np.concatenate(held)
            rows = rows[np.lexsort((x_node[rows[:, 3]], rows[:, 2], -rows[:, 1], rows[:, 0]))]
            group = rows[:, 0]
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(rows) else np.empty(0, np.int64)
            rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
            last = rows[rank == k - 1]
            best.reshape(-1)[last[:, 0]] = last[:, 1]
            held, n_held = [rows[rank < k]], 0

        for s in np.argsort(-over.max(axis=0), kind="stable").tolist():
            # a window that has k rows takes none below its last; equal ones may have a smaller id
            some = np.flatnonzero(overlaps[:, s] & (over[:, s] >= best.min(axis=1)))
            if not len(some):
                continue
            lo, hi = cuts[s], min(cuts[s] + SEGMENT, len(right))
            got = scores(a[some], x[lo:hi], largest)
            fits = (a_label[some][:, None] == x_label[lo:hi]) == same
            if same:
                fits &= a_node[some][:, None] != x_node[lo:hi]
            for w in range(windows):
                least_score = np.maximum(lows[some, w], best[some, w])
                i, j = np.nonzero(fits & (got >= least_score[:, None]) & (got <= highs[some, w, None]))
                if len(i):
                    held.append(np.stack([some[i] * windows + w, got[i, j], x_id[lo + j], lo + j], axis=1))
                    n_held += len(i)
            if n_held > HELD:
                keep_best()
        keep_best()
        rows = held[0]
        if not len(rows):
            return empty
        return pd.DataFrame({"anchor": a_node[rows[:, 0] // windows], "window": (rows[:, 0] % windows).astype(np.int32), "score": rows[:, 1], "id": rows[:, 2], "node": x_node[rows[:, 3]]})
    return run


def _visits(references: dict[int, np.ndarray], first: dict[int, int], units: pd.DataFrame):
    """The units whose bounds overlap a window of the anchor; for lengths without references the unit of that length."""
    number = units["unit"].to_numpy(np.int64)
    cell, ring = ((number >> 8) & 0xFFFFFF) - 1, number & 0xFF
    near, far = ring * (np.pi / RINGS), (ring + 1) * (np.pi / RINGS)
    near, far = near - SLACK, np.where(ring == RINGS - 1, np.pi, far) + SLACK
    least, most = units["least"].to_numpy(), units["most"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, own in frame.groupby("d"):
                own = own.copy()
                if d not in references:
                    own["visits"] = [[int(d) << 32]] * len(own)
                    yield own
                    continue
                mine = np.flatnonzero((number >> 32) == d)
                at = _angles(own["angles"])[:, cell[mine] - first[d]]
                low = np.maximum(0, np.maximum(at - far[mine], near[mine] - at))
                high = np.minimum(np.pi, at + far[mine])
                under, over = score_bounds(low, high, own["norm"].to_numpy()[:, None], least[mine], most[mine])
                lows, highs = np.stack(own["lows"].to_numpy()), np.stack(own["highs"].to_numpy())
                open_ = np.zeros(over.shape, bool)
                for w in range(lows.shape[1]):
                    open_ |= (lows[:, w] <= highs[:, w])[:, None] & (over >= lows[:, w, None]) & (under <= highs[:, w, None])
                own["visits"] = [number[mine[row]] for row in open_]
                yield own
    return run


def _fresh(frame: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so both sides of a meeting may come from one table."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id", "node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: which rows are anchors.  An anchor's positives are its best ``positives`` other rows of
    its label; for each, the best ``negatives`` rows of other labels whose score is ``low`` to ``high``
    percent of the positive's.  Ties go to the smaller id.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                      F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: F.floor(x * scale) != 0)
    sample = own.where(finite).select("vector").distinct().orderBy(F.xxhash64("vector")).limit(REFERENCES).collect()  # at most REFERENCES rows
    by_length: dict[int, list] = {}
    for d, _, vectors in _vectors(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())), scale):
        if len(vectors):
            by_length[d] = vectors
    references, first, at = {}, {}, 0
    for d, vectors in by_length.items():
        references[d], first[d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), at
        at += len(vectors)

    shape = "id long, label long, anchor boolean, d int, unit long, norm double, vector binary, angles binary"
    stored = materialize(own.mapInArrow(_store(references, first, scale), shape).withColumn("node", F.monotonically_increasing_id()), "op13-rows")
    units = materialize(stored.groupBy("unit").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"))
                        .withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "op13-units")
    # units with a reference: at most REFERENCES * RINGS rows
    known = units.where(F.shiftright("unit", 8).bitwiseAND(0xFFFFFF) > 0).select("unit", "least", "most").toPandas()
    visits = _visits(references, first, known)
    placed = stored.join(units.select("unit", "parts"), "unit").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).drop("parts", "anchor")
    queries = _fresh(stored.where("anchor").drop("anchor", "id"))
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int"))

    def meet(wanted: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """Best ``k`` rows of each window; ``wanted``: anchors with ``unit`` as their visits."""
        visiting = wanted.join(units.select("unit", "parts"), "unit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = _fresh(visiting.select("unit", "part", "block").distinct())
        hosts = placed.join(met, ["unit", "part"])
        keys = ["unit", "part", "block"]
        found = visiting.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(_block(k, same), "anchor long, window int, score long, id long, node long")
        return materialize(_best(found, k), name)

    def calling(wanted: DataFrame) -> DataFrame:
        """Anchors with windows, a row for each unit they visit."""
        parts = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
        return wanted.mapInPandas(visits, parts + ", visits array<long>").withColumn("unit", F.explode("visits")).drop("visits")

    every = lambda low_, high_: [F.array(low_).alias("lows"), F.array(F.lit(high_)).alias("highs")]
    plain = ["node", "label", "d", "norm", "vector", "angles", "block"]
    # the own unit gives a lower limit of the last positive
    home = meet(queries.select(*plain, "unit", *every(F.lit(-FAR), FAR)), positives, True, "op13-home")
    limit = home.where(F.col("rank") == positives).select(F.col("anchor").alias("node"), F.col("score").alias("limit"))
    wanted = queries.join(limit, "node", "left").select(*plain, *every(F.coalesce("limit", F.lit(-FAR)), FAR))
    found = meet(calling(wanted), positives, True, "op13-positives")
    positive = found.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 * score is between low * positive and high * positive: whole numbers rounded inwards; a missing positive wants nothing
    span = positive.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("of"))  # at most `positives` entries
    numbers = F.sequence(F.lit(0), F.lit(positives - 1))
    hundredth = lambda x: F.floor((x - F.pmod(x, F.lit(100))).cast("decimal(20,0)") / F.lit(100)).cast("long")
    lows = F.transform(numbers, lambda w: F.coalesce(-hundredth(F.element_at("of", w) * -low), F.lit(FAR)))
    highs = F.transform(numbers, lambda w: F.coalesce(hundredth(F.element_at("of", w) * high), F.lit(-FAR)))
    wanted = queries.join(span.select(F.col("anchor").alias("node"), lows.alias("lows"), highs.alias("highs")), "node").select(*plain, "lows", "highs")
    found = meet(calling(wanted), negatives, False, "op13-negatives")
    return (found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["anchor", "window"])
            .join(stored.where("anchor").select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
