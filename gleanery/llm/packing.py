"""Packing documents into sequences by linear grouping, then best fit.

1. Tokenise whole texts; cut what is longer than a sequence into full pieces and a rest.
   A full piece is a sequence of its own.
2. Count pieces per length: at most `capacity` rows, whatever the corpus. Everything
   after this is decided on these counts.
3. Large lengths are put in order and dealt into groups of equal cardinality; in a group
   every length is rounded up to the largest of it. A linear programme over the few
   group sizes, by column generation, finds configurations (how many of each size one
   sequence holds); whole multiples of them are opened.
4. Actual documents take the places of their group, so space is left over; then the
   documents without a place, large before small, go by best fit: to the opened sequence
   with the least room that holds them, else to a new one.
5. The plan is a list of runs: documents number a..b of a length, in an order of their own,
   go to sequences s, s+1, ... at a fixed offset. Each piece is numbered within its
   length (in slices, as one length may hold a third of all pieces) and reads its place
   from its run. The runs are at most a few per length and configuration, so their table
   is broadcast: its size is bounded by the capacity, not by the corpus.

Defined results: null text is empty and still carries its end id; rows that share an id
are packed as separate documents; equal lengths are numbered by a hash of id and piece;
an empty table gives an empty packing; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import numbered
from .common import stored
from .tokens import default_path, encode

CAPACITY, END_ID, GROUPS = 4096, 1, 12


# --- pieces ---------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", kept: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit integers.

    `kept`: bounds of a worker's store of tokens, see `tokens`; they affect speed and memory only.
    """
    path = tokenizer or default_path()

    def cut(batches):
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small batches out: ids take more room than text
                part = batch.slice(at, 256)
                rows = [[], [], [], [], []]
                for k, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), path, kept)):
                    ids = np.frombuffer(raw + end, "<u2").astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        for column, value in zip(rows, (k, n, start, len(piece), piece.tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()),
                     pa.array(rows[4], pa.binary())], names=["doc_id", "piece", "start", "length", "ids"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(cut, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids BINARY")


# --- the plan, on counts per length ---------------------------------------------------


def _best_configuration(prices: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes with the highest total price that fits one sequence.

    Layer k of the table holds the best price of k sizes at most, for every room.
    """
    layers, choices = [np.zeros(capacity + 1)], []
    while True:
        best, choice = layers[-1].copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            value = layers[-1][: capacity + 1 - s] + prices[i]
            better = value > best[s:] + 1e-12
            best[s:][better], choice[s:][better] = value[better], i
        if (choice < 0).all():
            break
        layers.append(best)
        choices.append(choice)
    counts, room = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[room] >= 0:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(layers[-1][capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """[(how many of each size, how many sequences)]: column generation, rounded down.

    Starts from configurations of one size each. The prices of the sizes at the current basis
    find the configuration that saves most; it replaces the one that runs out first. The
    demand that rounding leaves open is packed later by best fit.
    """
    n = len(sizes)
    if not n:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(40 * n):
        prices = np.linalg.solve(basis.T, np.ones(n))
        best, column = _best_configuration(np.maximum(prices, 0.0), sizes, capacity)
        if best <= 1 + 1e-7:
            break
        used, move = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, np.maximum(used, 0.0) / np.where(move > 1e-9, move, 1.0), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    used = np.linalg.solve(basis, need)
    return [([int(round(x)) for x in basis[:, j]], int(np.floor(max(0.0, used[j]) + 1e-9))) for j in range(n)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, n, sequence, offset): piece first+k of the length stands in sequence+k at offset.

    `large`: lengths above it are grouped, by default a quarter of the capacity.
    """
    large = capacity // 4 if large is None else large
    left, taken, runs = dict(counts), defaultdict(int), []
    nextseq = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], n, sequence, offset))
        taken[length] += n
        left[length] -= n

    if left.get(capacity):
        take(capacity, left[capacity], 0, 0)
        nextseq = counts[capacity]
    big = sorted((s for s in left if large < s < capacity and left[s]), reverse=True)
    share = -(-sum(left[s] for s in big) // groups) if big else 1
    # lengths, longest first, dealt into groups of equal cardinality: a length may reach over several groups
    members: list[list[list[int]]] = [[]]
    room = share
    for s in big:
        n = left[s]
        while n:
            if not room:
                members.append([])
                room = share
            k = min(n, room)
            members[-1].append([s, k])
            n, room = n - k, room - k
    members = [m for m in members if m]
    sizes: list[int] = [m[0][0] for m in members]
    merged: dict[int, int] = defaultdict(int)  # groups rounded up to the same size count as one
    for m, s in zip(members, sizes):
        merged[s] += sum(k for _, k in m)
    distinct = sorted(merged, reverse=True)
    queues = {s: [e for m, z in zip(members, sizes) if z == s for e in m] for s in distinct}
    # blocks of sequences with equal room: room -> [(sequence, how many, filled)]
    opened: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def leave(room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in opened or not opened[room]:
                insort(rooms, room)
            opened[room].append((sequence, n))

    for config, n in configurations(distinct, [merged[s] for s in distinct], capacity):
        if not n or not any(config):
            continue
        blocks = [(nextseq, n, 0)]
        nextseq += n
        for s, k in zip(distinct, config):
            for _ in range(k):
                after, queue = [], queues[s]
                for sequence, width, filled in blocks:
                    while width:
                        if not queue:
                            after.append((sequence, width, filled))
                            break
                        length, have = queue[-1]
                        m = min(width, have)
                        take(length, m, sequence, filled)
                        after.append((sequence, m, filled + length))
                        sequence, width = sequence + m, width - m
                        queue[-1][1] -= m
                        if not queue[-1][1]:
                            queue.pop()
                blocks = after
        for sequence, width, filled in blocks:
            leave(capacity - filled, sequence, width)
    # best fit, longest first: the least room that holds the length; several to one sequence at a time
    for length in sorted((s for s in left if left[s]), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(left[length], per)
                fits = per
                if not full:
                    full, fits = 1, rest
                sequence, nextseq, room = nextseq, nextseq + full, capacity
            else:
                room = rooms[at]
                sequence, full = opened[room].pop()
                if not opened[room]:
                    rooms.pop(at)
                fits = min(room // length, max(1, left[length] // full))
                if full * fits > left[length]:
                    leave(room, sequence + left[length], full - left[length])
                    full = left[length]
            for k in range(fits):
                take(length, full, sequence, capacity - room + k * length)
            leave(room - fits * length, sequence, full)
    return runs


# --- on Spark -------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """`cut` (doc_id, piece, length, ...) with sequence_id and offset. Reads `cut` twice: store it first."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity, groups)
    hashed = cut.withColumn("_order", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece")))
    ranked = numbered(hashed, ["length"], ["_order", "doc_id", "piece"], F.substring("_order", 1, 3), "_number")
    columns = ["_length", "_first", "_n", "_sequence", "_offset"]
    table = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in runs], pa.int64()) for i, c in enumerate(columns)}))
    number = F.col("_number") - 1
    inside = (F.col("length") == F.col("_length")) & (number >= F.col("_first")) & (number < F.col("_first") + F.col("_n"))
    return (
        ranked.join(F.broadcast(table), inside)
        .withColumn("sequence_id", F.col("_sequence") + number - F.col("_first"))
        .withColumn("offset", F.col("_offset"))
        .drop("_number", "_order", *columns)
    )


def sequences(packed: DataFrame, cut: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of every sequence, from pieces that carry `ids`.

    A sequence holds `capacity` ids at most, so its group is small.
    """
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", ids.alias("ids")).withColumn("length", F.expr("octet_length(ids) div 4"))
