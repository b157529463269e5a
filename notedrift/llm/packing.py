"""Operator 7: best-fit packing by a configuration linear program.

Every piece of a document is at most ``capacity`` tokens long, so all that the
packing has to know is the histogram of piece lengths (``capacity`` counts,
whatever the corpus size).  On it the configuration program is solved: amounts of
configurations (multisets of lengths that fit one sequence), as few as possible, that
cover the pieces.  Its rows are the numbers of pieces of a length or more, because a
place of a sequence also takes a shorter piece; that is the same program, with prices
that never fall with the length.  The price of a row is its multiplicative weight over
its full demand; a round finds the configuration of highest price by a knapsack dynamic
program, takes a step of it, and lowers the weights of the rows by how much of their
demand the step covers.  Prices divided by the price of that configuration are feasible
duals, so every round also gives a lower bound of the sequences; the rounds end once the
program is within ``GAP`` of the best bound.

The fractional solution is rounded down, then up where pieces are left; where a length
has run out, a shorter piece takes its place.  A sequence is kept only if its pieces are
worth a whole one at the best dual prices (within ``SLACK``).  Best fit places the rest
of the rounding, first into the room left in those sequences; its share is logged.

The corpus itself is never collected: each piece gets its rank among the pieces
of its length (rank in its task at reading, plus the counts of earlier tasks),
and the rank decides the configuration, the sequence and the place in it.

Defined results: a null text is the empty text (one piece: the end token);
repeated or null ids are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textops import text_slices
from .vocab import vocabulary

CAPACITY = 1024
#: Factor of the weights' fall, most rounds, relative gap of program and bound at which it ends, rounds between checks.
ETA, ROUNDS, GAP, CHECKED = 1.0, 1_500, 0.003, 50
#: Share of the price of a whole sequence that a rounded sequence may lack.
SLACK = 0.002

log = logging.getLogger(__name__)


@dataclass
class Program:
    """Amounts of configurations that cover all pieces, the best feasible dual prices by length, and their bound."""

    amounts: list[tuple[tuple[int, ...], float]]
    prices: np.ndarray
    bound: float


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[list[int], float]:
    """The multiset of lengths (places in ``lengths``, ascending) of highest price that fits, and the price."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        n = usable[room]
        best[room] = best[room - 1]
        if n:
            got = best[room - lengths[:n]] + prices[:n]
            k = got.argmax()
            if got[k] > best[room]:
                best[room], choice[room] = got[k], k
    room, taken = capacity, []
    while room > 0:
        k = int(choice[room])
        if k >= 0:
            taken.append(k)
            room -= int(lengths[k])
        else:
            room -= 1
    return taken, float(best[capacity])


def step_prices(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Feasible duals that need no program: lengths over capacity - x cost one, those under x nothing, others their size; the best x."""
    sizes = np.arange(capacity + 1)
    found = []
    for x in range(capacity // 2 + 1):
        prices = np.where(sizes > capacity - x, 1.0, np.where(sizes < x, 0.0, sizes / capacity))
        found.append((float((counts * prices).sum()), x, prices))
    bound, _, prices = max(found, key=lambda f: f[:2])
    return prices, bound


def program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Program:
    """Solve the configuration program by multiplicative weights."""
    prices, bound = step_prices(counts, capacity)
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return Program([], prices, 0.0)
    demand = np.cumsum(counts[lengths][::-1].astype(float))[::-1]  # pieces of this length or more
    covered = np.zeros(len(lengths))  # share of the demand
    amounts: dict[tuple[int, ...], float] = {}
    total = 0.0
    for done in range(1, rounds + 1):
        weight = np.exp(-ETA * (covered - covered.min()))
        price = np.cumsum(weight / demand)
        taken, most = knapsack(lengths, price, capacity)
        if weight.sum() / most > bound:
            bound = float(weight.sum() / most)
            prices = np.zeros(capacity + 1)
            prices[lengths] = price / most
        share = np.cumsum(np.bincount(taken, minlength=len(lengths))[::-1])[::-1] / demand
        step = 1 / float(share.max())
        covered += step * share
        total += step
        config = tuple(int(lengths[k]) for k in sorted(taken, reverse=True))
        amounts[config] = amounts.get(config, 0.0) + step
        if done % CHECKED == 0 and covered.min() > 0 and total / covered.min() <= bound * (1 + GAP):
            break
    if covered.min() <= 0:  # too few rounds for every row: what is left bare gets sequences of one piece
        bare = lengths[covered <= 0]
        scale = max(1.0, float(covered.max()))
        return Program([*((c, n / scale) for c, n in amounts.items()), *(((int(x),), float(counts[x])) for x in bare)], prices, bound)
    scale = float(covered.min())
    log.info("packing: program of %.1f sequences, bound %.1f, %d configurations", total / scale, bound, len(amounts))
    return Program([(c, n / scale) for c, n in amounts.items()], prices, bound)


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """The amounts of `program`."""
    return program(counts, capacity, rounds).amounts


def rounded(solution: list[tuple[tuple[int, ...], float]], counts: np.ndarray, capacity: int,
            prices: np.ndarray | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences of each configuration that use every piece exactly once.

    ``prices``: feasible duals; a sequence of the solution is kept if its pieces are worth 1 - SLACK at them.
    """
    prices = step_prices(counts, capacity)[0] if prices is None else prices
    left = counts.astype(np.int64).copy()
    plan: dict[tuple[int, ...], int] = {}

    def take(config: tuple[int, ...], n: int) -> None:
        """Up to ``n`` sequences; a length that has run out gives its place to the next shorter one."""
        while n > 0:
            used: dict[int, int] = {}
            for length in config:
                while length > 0 and left[length] <= used.get(length, 0):
                    length -= 1
                if length:
                    used[length] = used.get(length, 0) + 1
            if sum(prices[x] * k for x, k in used.items()) < 1 - SLACK:
                return
            copies = min(n, min(int(left[x]) // k for x, k in used.items()))
            for x, k in used.items():
                left[x] -= copies * k
            key = tuple(x for x, k in sorted(used.items(), reverse=True) for _ in range(k))
            plan[key] = plan.get(key, 0) + copies
            n -= copies

    for config, amount in sorted(solution, key=lambda x: -x[1]):
        take(config, int(amount + 1e-9))
    for config, amount in sorted(solution, key=lambda x: -(x[1] % 1)):
        take(config, 1)
    mass = float((counts * np.arange(capacity + 1)).sum())
    log.info("packing: %d of %d pieces, %.3g of the tokens, are placed by best fit", left.sum(), counts.sum(), (left * np.arange(capacity + 1)).sum() / max(mass, 1))
    return list(best_fit(left, capacity, plan).items())


def packed(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The rounded program."""
    solved = program(counts, capacity)
    return rounded(solved.amounts, counts, capacity, solved.prices)


def best_fit(counts: np.ndarray, capacity: int, opened: dict[tuple[int, ...], int] | None = None) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing in runs of equal lengths, as if placed piece by piece into the ``opened`` sequences and new ones."""
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # open sequences by room left
    for config, n in (opened or {}).items():
        rooms[capacity - sum(config)][config] = n
    for length in np.flatnonzero(counts)[::-1].tolist():
        k = int(counts[length])
        while k:
            fit = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            own, n = rooms[fit].popitem() if fit is not None else ((), k)
            room = fit if fit is not None else capacity
            copies = min(k, room // length)  # a sequence is filled before the next, for its room is then the least
            used = min(n, k // copies)
            if own and n > used:
                rooms[room][own] = n - used
            filled, left = own + (length,) * copies, room - copies * length
            rooms[left][filled] = rooms[left].get(filled, 0) + used
            k -= used * copies
    return {own: n for r in rooms for own, n in r.items()}


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, the runs of ranks: first rank, copies a sequence, first sequence, offset of the first copy."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, n in plan:
        lengths, copies = np.unique(config, return_counts=True)
        place = 0
        for length, c in zip(lengths.tolist(), copies.tolist()):
            runs.setdefault(length, []).append((used.get(length, 0), c, sequence, place))
            used[length] = used.get(length, 0) + n * c
            place += length * c
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*found)) for length, found in runs.items()}


def _pieces(path: str, pattern: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column("key")
            for lo, hi, texts in text_slices(batch.column("text")):
                ids, bounds = vocab.encode(texts)
                size = np.diff(bounds) + 1
                n = (size + capacity - 1) // capacity
                doc = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                crc = np.empty(len(doc), np.int64)
                at = 0
                for d in range(hi - lo):
                    own = np.append(ids[bounds[d]:bounds[d + 1]], np.int32(end_id)).astype("<u4")
                    for _ in range(n[d]):
                        crc[at] = zlib.crc32(own[start[at]:start[at] + length[at]].tobytes())
                        at += 1
                # rank among the task's pieces of the same length
                order = np.argsort(length, kind="stable")
                sorted_lengths = length[order]
                run_start = np.flatnonzero(np.append(True, sorted_lengths[1:] != sorted_lengths[:-1])) if len(order) else order
                inside = np.arange(len(order)) - np.repeat(run_start, np.diff(np.append(run_start, len(order))))
                rank = np.empty(len(order), np.int64)
                rank[order] = inside + seen[sorted_lengths]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + lo)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank, pa.int64())],
                    names=["key", "piece", "start", "length", "ids_crc32", "part", "rank"])
    return run


def _placer(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence = np.empty(len(rank), np.int64)
            offset = np.empty(len(rank), np.int64)
            for l in np.unique(length).tolist():
                own = np.flatnonzero(length == l)
                first, copies, base, place = table[l]
                k = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[k]
                sequence[own] = base[k] + inside // copies[k]
                offset[own] = place[k] + inside % copies[k] * l
            keep = ["key", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, vocab_path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    own = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["key"]
    shape = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(own.mapInArrow(_pieces(vocab_path, pattern, end_id, capacity), f"{shape}, part int, rank long"), "op7-pieces")
    # one row for each task and length; a length's rows are as many as tasks
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "op7-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    table = slots(packed(histogram, capacity))
    ranked = (pieces.join(counts.select("part", "length", "before"), ["part", "length"])
              .select("key", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")))
    return ranked.mapInArrow(_placer(table), f"{shape}, sequence_id long, offset long").withColumnRenamed("key", id_col)
