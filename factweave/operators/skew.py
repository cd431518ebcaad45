"""Per-key results over keys of which a few hold most rows.

Rows are range-partitioned on (keys, secondary order) with Spark's sampled quantiles, so a heavy key is cut
into as many partitions as its rows need. Every partition then holds at most two keys that may continue in a
neighbour: its first and its last. Keys inside are final at once; the states of the two edge keys, at most
two a partition whatever the data, are stitched by their running row offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from factweave.session import cut

PID = "__pid"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_split(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned on keys and secondary order; adds the partition number as ``__pid``."""
    n = _partitions(df, partitions)
    return df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn(PID, F.spark_partition_id())


def _borders(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """Where a run of equal keys begins in a sorted batch, and the batch's length."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in names:
        codes, _ = pd.factorize(pdf[k])
        change[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(change), len(pdf))


def key_counts(df: DataFrame, keys: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """Rows of every key combination as ``n``; a null key is a key, an empty table gives no rows.

    Only the keys and an eight-byte hash of ``order`` are shuffled. A partition counts its sorted runs; its inner keys are final there and
    then, and only the states of its first and last key are exchanged and added up.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    narrow = df.select(*[F.col(k).cast("string").alias(a) for k, a in zip(keys, ks)], F.xxhash64(order).alias("__ord"))
    split = narrow.repartitionByRange(_partitions(df, partitions), *ks, "__ord").select(*ks).sortWithinPartitions(*ks)
    names = [*ks, "n", "edge"]

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list] = []
        held: list | None = None
        first = True
        for pdf in batches:
            if not len(pdf):
                continue
            at = _borders(pdf, ks)
            cols = [pdf[k].to_numpy(dtype=object)[at[:-1]] for k in ks]
            for *key, n in zip(*cols, np.diff(at).tolist()):
                if held is not None and held[:-2] == key:
                    held[-2] += n
                    continue
                if held is not None:
                    out.append(held)
                held, first = [*key, n, first], False
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held is not None:
            held[-1] = True
            yield pd.DataFrame([*out, held], columns=names)

    state = T.StructType([*[T.StructField(k, T.StringType()) for k in ks], T.StructField("n", T.LongType()), T.StructField("edge", T.BooleanType())])
    parts = cut(split.mapInPandas(states, state), costly=True)
    stitched = parts.where("edge").groupBy(*ks).agg(F.sum("n").alias("n"))
    out = parts.where("NOT edge").select(*ks, "n").unionByName(stitched)
    return out.select(*[F.col(a).cast(df.schema[k].dataType).alias(k) for k, a in zip(keys, ks)], "n")


def heavy_keys(df: DataFrame, keys: list[str], order: str, share: float = 0.05, partitions: int | None = None) -> DataFrame:
    """Key combinations holding at least ``share`` of all rows, with ``n``."""
    counts = cut(key_counts(df, keys, order, partitions))
    total = counts.select(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    return counts.where(F.col("n") / total >= F.lit(share))


def key_profile(df: DataFrame, keys: list[str], value: str, ts: str, row_id: str, partitions: int | None = None) -> DataFrame:
    """For every key: ``n`` rows, ``n_values`` non-null values, exact ``median_value``, ``latest_id``.

    The median of an even number of values is the mean of the middle two; without values it is null.
    ``latest_id`` is the row id with the greatest (ts, id), nulls of ts first. Null keys are keys, repeated
    rows count as they stand, extra columns are left out, an empty table gives no rows.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    narrow = df.select(
        *[F.col(k).cast("string").alias(a) for k, a in zip(keys, ks)],
        F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("__v"),
        F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62))).alias("__ts"),
        F.col(row_id).cast("string").alias("__id"),
    )
    split = cut(range_split(narrow, ks, ["__v", "__id"], partitions).sortWithinPartitions(*ks, "__v", "__id"))
    fields = [T.StructField(k, T.StringType()) for k in ks]
    state = T.StructType(
        [T.StructField(PID, T.IntegerType()), *fields, T.StructField("n", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("median_value", T.DoubleType()), T.StructField("__ts", T.LongType()), T.StructField("latest_id", T.StringType())]
    )
    names = [f.name for f in state.fields]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(key, pid, pieces of values, rows, best) of every run of one key, across batches."""
        key, held = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            cols, at = [pdf[k].to_numpy(dtype=object) for k in ks], _borders(pdf, ks)
            v, ts_, ids, pid = pdf["__v"].to_numpy(dtype=float), pdf["__ts"].to_numpy(), pdf["__id"].to_numpy(dtype=object), int(pdf[PID].iloc[0])
            for s, e in zip(at[:-1], at[1:]):
                k = tuple(c[s] for c in cols)
                vals = v[s:e][~np.isnan(v[s:e])]
                top = ts_[s:e].max()
                best = (int(top), max(("" if i is None else i) for i in ids[s:e][ts_[s:e] == top]))
                if held is not None and k == key:
                    held[1].append(vals)
                    held[2] += e - s
                    held[3] = max(held[3], best)
                else:
                    if held is not None:
                        yield key, held
                    key, held = k, [pid, [vals], int(e - s), best]
        if held is not None:
            yield key, held

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, first = [], None, True
        for key, (pid, pieces, n, best) in runs(batches):
            if last is not None:
                out.append(last)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            vals = np.concatenate(pieces)
            mid = float((vals[(len(vals) - 1) // 2] + vals[len(vals) // 2]) / 2) if len(vals) else None
            last, first = [pid, *key, n, len(vals), first, mid, best[0], best[1]], False
        if last is not None:
            last[names.index("edge")] = True
            out.append(last)
        if out:
            yield pd.DataFrame(out, columns=names)

    parts = cut(split.mapInPandas(states, state), costly=True)
    edge = parts.where("edge")
    by_key = W.partitionBy(*ks)
    placed = (
        edge.withColumn("before", F.coalesce(F.sum("n_values").over(by_key.orderBy(PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("all_values", F.sum("n_values").over(by_key))
        .withColumn("rank", F.explode(F.array(F.expr("(all_values - 1) div 2"), F.expr("all_values div 2"))))
        .where("all_values > 0 AND rank >= before AND rank < before + n_values")
        .select(PID, *ks, (F.col("rank") - F.col("before")).alias("at"))
    )
    bound = 4 * _partitions(df, partitions)
    wanted = placed.limit(bound + 1).collect()
    assert len(wanted) <= bound, "more stitched ranks than two a partition edge"
    by_pid: dict[int, list[tuple]] = {}
    for r in wanted:
        by_pid.setdefault(r[PID], []).append((tuple(r[k] for k in ks), r["at"]))
    picked_schema = T.StructType([*fields, T.StructField("v", T.DoubleType())])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, (pid, pieces, _, _) in runs(batches):
            asked = [a for k, a in by_pid.get(pid, []) if k == key]
            if asked:
                vals = np.concatenate(pieces)
                out += [[*key, float(vals[a])] for a in asked]
        if out:
            yield pd.DataFrame(out, columns=[*ks, "v"])

    mids = split.where(F.col(PID).isin(sorted(by_pid) or [-1])).mapInPandas(pick, picked_schema).groupBy(*ks).agg(F.avg("v").alias("mid"))
    whole = edge.groupBy(*ks).agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.max(F.struct("__ts", "latest_id")).alias("best"))
    stitched = whole.alias("w").join(mids.alias("m"), [F.col(f"w.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ks], "left").select(*[F.col(f"w.{k}").alias(k) for k in ks], "n", "n_values", F.col("mid").alias("median_value"), F.col("best.latest_id").alias("latest_id"))
    inner = parts.where("NOT edge").select(*ks, "n", "n_values", "median_value", "latest_id")
    return inner.unionByName(stitched).select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], "n", "n_values", "median_value", "latest_id")
