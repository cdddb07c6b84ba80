"""Average hashes of frames, and which frames need an analysis of their own.

A frame's pixels are an array of grey values (8 times 8 for a hash of 64 bits). Of an
asset's frames, in time order, one of a hash that was analysed before takes that
result, one alike to the last analysed takes that one's; all others are analysed.
Frames pass through a task in order with the hashes analysed so far as the only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def average_hash(pixels: Column) -> Column:
    """64 bits of 64 grey values, the first the highest: set where a value is not below the mean; null for other arrays."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + p) / F.size(pixels)
    bits = lambda m: F.aggregate(pixels, F.lit(0).cast("bigint"), lambda s, p: F.shiftleft(s, 1).bitwiseOR(F.when(p >= m, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
    return F.when(F.size(pixels) == 64, F.transform(F.array(mean), bits)[0])


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean difference of two pictures' grey values, as a share of 255; 1 for pictures of different sizes or none."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a) / 255).otherwise(1.0)


def submission_frames(frames: DataFrame, most: float = 0.0) -> DataFrame:
    """asset_id, frame_id, source_frame, reason, distance of every frame (asset_id, frame_id, pts_ms, hash).

    reason: analysed, exact_frame_hash or similar_previous_frame (a share of bits of ``most`` or less differ from the last analysed
    frame that has a hash). A frame without a hash is analysed.
    """
    kind = dict(frames.dtypes)
    rows = frames.select("asset_id", "frame_id", "pts_ms", F.col("hash").cast("bigint").alias("hash")).repartition(F.col("asset_id")).sortWithinPartitions("asset_id", "pts_ms", "frame_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset, seen, last, chosen = object(), {}, None, None
        for b in batches:
            out = []
            for a, f, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if a != asset:
                    asset, seen, last, chosen = a, {}, None, None
                apart = None if h is None or last is None else ((h ^ last) & (1 << 64) - 1).bit_count() / 64
                if h is not None and h in seen:
                    out.append((seen[h], "exact_frame_hash", None))
                elif apart is not None and apart <= most:
                    out.append((chosen, "similar_previous_frame", apart))
                else:
                    chosen = f
                    if h is not None:
                        seen[h] = f
                        last = h
                    out.append((f, "analysed", None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[0] for o in out], b.schema.field(1).type), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], names=["asset_id", "frame_id", "source_frame", "reason", "distance"])

    return rows.mapInArrow(kernel, f"asset_id {kind['asset_id']}, frame_id {kind['frame_id']}, source_frame {kind['frame_id']}, reason string, distance double")
