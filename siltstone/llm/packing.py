"""Filling containers of a fixed capacity with items, planned on the histogram of their lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.staging import stage

_RANK_BITS = 44  # room for the rank below the length in one sortable number


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts. Lengths are 1..capacity.

    Returns (rows, number of containers). A row (length, first rank, first container, per container, used) says: from this
    rank on, items of this length go into the containers from `first container` on, `per container` into each, behind
    `used` filled places. Containers with the same contents are runs of numbers, so the plan's size depends on the
    capacity, not on the number of items: every step ends a length or a run.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first container, how many)
    frees: list[int] = []
    total = 0

    def add(free: int, first: int, many: int) -> None:
        if many and free:
            if free not in runs:
                runs[free] = []
                insort(frees, free)
            runs[free].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, many = runs[free].pop()
                if not runs[free]:
                    del runs[free]
                    frees.pop(at)
            else:
                free, first = capacity, total
                many = -(-left // (capacity // length))
                total += many
            each = free // length  # a container once begun is the fullest one until nothing more fits
            whole = min(many, left // each)
            rest = min(left - whole * each, each) if whole < many else 0
            rows.append((length, rank, first, each, capacity - free))
            add(free - each * length, first, whole)
            if rest:
                add(free - rest * length, first + whole, 1)
            add(free, first + whole + (rest > 0), many - whole - (rest > 0))
            rank += whole * each + rest
            left -= whole * each + rest
    return rows, total


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int = 4096, rank_group: int = 1_000_000) -> DataFrame:
    """Rows (id, size, piece, n_pieces, piece_size, container, start): every item has its place, none overlaps another.

    Items above the capacity are cut into pieces of the capacity and a rest; no other item is cut. An item of size 0, a
    negative or a null size needs no place: container and start are null. Repeated rows are separate items. Other columns
    are not carried. An empty table gives an empty table.

    The driver gets the histogram (at most `capacity` rows) and sends the plan. The rank of an item within its length is
    exact; lengths with more than `rank_group` items are split by a hash of the id, so one length may hold any share.
    """
    spark = df.sparkSession
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))
    items = stage(df.select(F.col(f"`{id_col}`").alias("id"), size.alias("size")), "sizes")
    n = F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1)).cast("int")
    pieces = items.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("piece_size", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("long") * capacity).cast("int"))

    histogram = {r[0]: r[1] for r in pieces.where("piece_size > 0").groupBy("piece_size").count().collect()}
    rows, _ = best_fit_plan(histogram, capacity)
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)

    parts = np.ones(capacity + 1, np.int64)
    for length, many in histogram.items():
        parts[length] = -(-many // rank_group)
    if parts.max() > 1:
        of_length = F.get(F.array(*[F.lit(int(x)) for x in parts]), F.col("piece_size"))
        group = F.pmod(F.xxhash64("id", "piece"), of_length).cast("int")
    else:
        group = F.lit(0)
    ranked = pieces.withColumn("grp", group).withColumn("rank", F.row_number().over(Window.partitionBy("piece_size", "grp").orderBy("id", "piece")).cast("long"))
    if parts.max() > 1:
        before = Window.partitionBy("piece_size").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        sums = pieces.withColumn("grp", group).groupBy("piece_size", "grp").count()
        sums = sums.select("piece_size", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
        ranked = ranked.join(sums, ["piece_size", "grp"]).withColumn("rank", F.col("rank") + F.col("before"))

    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("size", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("n_pieces", T.IntegerType())]
        + [T.StructField("piece_size", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("start", T.IntegerType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p[:, 0] << _RANK_BITS) | p[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            none = length == 0
            if len(keys):
                row = p[np.maximum(np.searchsorted(keys, (length << _RANK_BITS) | (rank - 1), "right") - 1, 0)]
                done = rank - 1 - row[:, 1]
                container, start = row[:, 2] + done // row[:, 3], row[:, 4] + done % row[:, 3] * length
            else:
                container = start = np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(container, mask=none), pa.array(start.astype(np.int32), mask=none)], schema.fieldNames())

    return ranked.select("id", "size", "piece", "n_pieces", "piece_size", "rank").mapInArrow(place, schema)
