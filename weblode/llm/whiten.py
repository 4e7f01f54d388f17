"""Embedding whitening: covariance by polarisation from exact integer squares, eigenvectors, projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblode.llm.ship import ship

#: Steps of the integer grid in one unit, and the shift that keeps its values positive.
GRID = 1024
SHIFT = 100_000
#: Entries from this magnitude on are no embedding's; their squares would leave 64 bits.
MOST = float(1 << 19)
#: Rows worked on at once.
ROWS = 4096


def _vectors(batches: Iterator[pa.RecordBatch], dims: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with a usable vector as (rows, lengths, flat integer entries); with ``dims``, only vectors of that length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column("vector")
            lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore"):
                fine = np.abs(flat) < MOST
            ends = np.cumsum(lengths)
            bad = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(~fine, out=bad[1:])
            good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            if dims is not None:
                good &= lengths == dims
            if good.any():
                x = np.floor(flat[np.repeat(good, lengths)] * GRID).astype(np.int64) + SHIFT
                yield part.filter(pa.array(good)), lengths[good], x


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and vector length: rows and sums of the entries."""
    total: dict[int, list] = {}
    for _, lengths, x in _vectors(batches):
        for d in np.unique(lengths):
            rows = x[np.repeat(lengths == d, lengths)].reshape(-1, d)
            got = total.setdefault(int(d), [0, np.zeros(d, np.int64)])
            got[0] += len(rows)
            got[1] += rows.sum(0)
    yield pa.record_batch(
        [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
         pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], names=["dims", "n", "sums"])


def _squares(dims: int, centre: np.ndarray):
    """Per task, for every dimension and every sum of two: the sum of its squares, in two parts of 32 bits each.

    Row i holds dimension i against the dimensions from i on; the first entry is the dimension itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = [np.zeros(dims - i, np.int64) for i in range(dims)]
        low = [np.zeros(dims - i, np.int64) for i in range(dims)]
        for _, _, x in _vectors(batches, dims):
            y = np.ascontiguousarray((x.reshape(-1, dims) - centre).T)
            for i in range(dims):
                pair = y[i:] + y[i]
                pair[0] = y[i]
                pair *= pair
                high[i] += (pair >> 32).sum(1)
                low[i] += (pair & 0xFFFFFFFF).sum(1)
        yield pa.record_batch(
            [pa.array(np.arange(dims, dtype=np.int32)), pa.array([h.tolist() for h in high], pa.list_(pa.int64())),
             pa.array([v.tolist() for v in low], pa.list_(pa.int64()))], names=["i", "high", "low"])
    return run


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: rows, exact sums, unit components by falling eigenvalue, and the share each explains."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _prepared(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.select(F.col(column).cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """Learn a whitening from every usable vector of ``vectors``.

    Entries become integers, ``floor(1024 * c) + 100000``. Every entry is centred by the whole part of its dimension's mean
    before it is multiplied; the rest of the mean, ``r/n`` with ``0 <= r < n``, is taken off exactly, since the squares of
    ``n*x - S`` sum to ``n * (n * sum(y*y) - r*r)``. So variances of all dimensions and of all sums of two dimensions are ratios of
    exact integers, and polarisation, ``(var(a+b) - var(a) - var(b)) / 2``, gives every covariance, rounded once.

    Two scans. Tasks send one row of sums for each vector length, then ``dims`` rows of squares; Spark adds them, and the driver gets
    ``dims * (dims + 1) / 2`` numbers whatever the input.

    Vectors that are null, empty, or hold null, non-finite or huge entries (2**19 and more) are left out. Where lengths differ,
    the most frequent one counts (the longest of equals) and other vectors are left out. No vectors give a whitening without
    components; so do vectors that are all alike.
    """
    ship(vectors.sparkSession)
    rows = _prepared(vectors, column)
    parts = rows.mapInArrow(_sums, "dims int, n long, sums array<long>")
    sized = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sized is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    dims, n = sized["dims"], sized["n"]
    per_dim = parts.filter(F.col("dims") == dims).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    sums = [r["s"] for r in per_dim.orderBy("i").collect()]
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    got = rows.mapInArrow(_squares(dims, np.array(centre, np.int64)), "i int, high array<long>, low array<long>")
    added = (got.select("i", F.posexplode(F.arrays_zip("high", "low")).alias("k", "part")).groupBy("i", "k")
             .agg(F.sum(F.col("part.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("part.low").cast("decimal(38,0)")).alias("low")))
    square = {(r["i"], r["i"] + r["k"]): (int(r["high"]) << 32) + int(r["low"]) for r in added.toLocalIterator()}
    spread = {}  # n*n times the variance of a dimension (i, i) or of a sum of two (i, j)
    for (i, j), q in square.items():
        r = rest[i] if i == j else rest[i] + rest[j]
        spread[i, j] = n * q - r * r
    cov = np.zeros((dims, dims))
    for (i, j), v in spread.items():
        cov[i, j] = cov[j, i] = v / (n * n) if i == j else (v - spread[i, i] - spread[j, j]) / (2 * n * n)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1]
    values, axes = values[order], axes[:, order].T
    trace = cov.trace()
    real = values > trace * dims * 1e-14
    return Whitening(n, sums, axes[real], values[real], values[real] / trace if trace > 0 else values[real])


def _project(dims: int, model: Whitening, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = model.n
        centre, rest = np.array([s // n for s in model.sums], np.int64), np.array([s % n for s in model.sums], np.int64)
        past = sum(r * r for r in rest.tolist())
        axes = model.components[:k].T / np.sqrt(model.eigenvalues[:k])
        for batch, _, x in _vectors(batches, dims):
            y = x.reshape(-1, dims) - centre
            most = int(np.abs(y).max())
            whole = y if dims * most * max(most, n) < 1 << 62 else y.astype(object)  # beyond 64 bits: whole numbers of any size
            square, along = (whole * whole).sum(1).tolist(), (whole * rest).sum(1).tolist()
            white = (y - rest / n) @ axes
            out = batch.drop_columns(["vector"])
            ends = np.arange(len(y) + 1, dtype=np.int32) * white.shape[1]
            # the squares of n*y - r add up to n*n*sum(y*y) - 2*n*sum(r*y) + sum(r*r)
            out = out.append_column("deviation", pa.array([str(n * (n * q - 2 * a) + past) for q, a in zip(square, along)], pa.string()))
            yield out.append_column("whitened", pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel())))
    return run


def whiten(vectors: DataFrame, model: Whitening, keep: list[str], column: str = "embedding", k: int = 8) -> DataFrame:
    """The columns ``keep`` of every row with a usable vector, ``deviation`` (decimal) and ``whitened``.

    ``deviation`` is the exact sum of ``(n*x - S)**2`` over the dimensions, ``whitened`` the first ``k`` components (fewer where the
    fit has fewer; an empty list where it has none), each of variance one. Vectors the fit left out give no row, and a fit of
    no vectors gives no rows; repeated rows and ties stay. Kept columns may have any name; other columns are ignored.
    """
    ship(vectors.sparkSession)
    kinds = [f"k{i} {vectors.schema[name].dataType.simpleString()}" for i, name in enumerate(keep)]
    rows = vectors.select(*[F.col(name).alias(f"k{i}") for i, name in enumerate(keep)], F.col(column).cast("array<double>").alias("vector"))
    run = _project(len(model.sums), model, k) if model.n else _nothing
    out = rows.mapInArrow(run, ", ".join([*kinds, "deviation string", "whitened array<double>"]))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).toDF(*keep, "deviation", "whitened")


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    return iter(())


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened columns' covariance minus the identity, over all rows (0 without rows)."""
    entries = [F.get("whitened", i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return 0.0
    row = whitened.agg(*[F.covar_pop(entries[i], entries[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs((row[f"c{i}_{j}"] or 0.0) - (i == j)) for i, j in pairs) if row[0] is not None else 0.0
