"""Request limiter: a window per client, opened by its first request after the last one expired.

What a client's requests of one time chunk do is a function from the end of the window that is open before the chunk to the end of
the one open after it. Such a function is a step function with few steps, functions compose, and composition is associative: all chunks
are described independently, a scan over descriptions gives every chunk what is carried into it, and all chunks are judged
independently, however many of the log's requests one client makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from weblode.sources.stages import written

WINDOW_MS = 60_000
MAX_REQUESTS = 30
#: Windows in a chunk, and functions composed at once.
CHUNK_WINDOWS = 16
FAN = 32
NEVER = -(1 << 62)
OUTPUT = "client string, at_ms bigint, request_id bigint, limited boolean, remaining int, reset_ms bigint"
FUNCTION = "client string, block bigint, starts array<bigint>, resets array<bigint>"


def _walker():
    def walk(at, count: int, reset: int, window_ms: int):
        """Counts and resets of sorted request times; one jump per window, not one step per request."""
        import numpy as np

        n = len(at)
        counts, resets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        i = 0
        while i < n:
            if at[i] > reset:
                reset, count = int(at[i]) + window_ms, 0
            end = int(np.searchsorted(at, reset, side="right"))
            counts[i:end] = count + np.arange(1, end - i + 1)
            resets[i:end] = reset
            count, i = count + end - i, end
        return counts, resets, count, reset

    return walk


def _tools():
    """The functions that run in tasks, made here so that executors need no package of ours. They take all groups of a batch at once:
    most clients make a request or two in a chunk, and a step in Python for each would cost more than the rest of the job."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def edges(batch, keys):
        """Where a row's key differs from that of the row before."""
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k)
            change[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(change)

    def key_at(batch, keys, i):
        return tuple(batch.column(k)[i].as_py() for k in keys)

    def pieces(batches, keys):
        """(columns, bounds) of whole groups of a sorted partition; a group may span batches and is put together once."""
        def whole(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            batch = table.to_batches(max_chunksize=table.num_rows)[0]
            return batch, np.concatenate([[0], edges(batch, keys), [batch.num_rows]]).astype("int64")

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and key_at(held[-1], keys, held[-1].num_rows - 1) != key_at(batch, keys, 0):
                yield whole(held)
                held = []
            change = edges(batch, keys)
            if len(change):
                yield whole([*held, batch.slice(0, int(change[-1]))])
                held = []
            held.append(batch.slice(int(change[-1])) if len(change) else batch)
        if held:
            yield whole(held)

    def numbers(batch, name):
        return batch.column(name).to_numpy(zero_copy_only=False).astype("int64")

    def grouped(bounds):
        return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def seeker(at, group):
        """Finds the first position of a group whose time is later than the one given; the group's end without one."""
        values, rank = np.unique(at, return_inverse=True)
        wide = len(values) + 1
        places = group * wide + rank
        return lambda groups, times: np.searchsorted(places, groups * wide + np.searchsorted(values, times, "right"), "left")

    def close(starts, ends, bounds, horizon):
        """The step function of each group of sorted steps, of which ``ends`` tells where a window that ends before ``starts`` is led by that
        step alone: a window carried in that ends before ``starts[i]`` but not before the one before it leads to ``resets[i]``; one that
        ends after all of them is carried on. Only steps that a window ending before ``horizon`` can meet are kept, and none that end
        where the next one ends."""
        group = grouped(bounds)
        after, stop, resets = seeker(starts, group)(group, ends), bounds[1:][group], ends.copy()
        more = after < stop
        while more.any():  # pointer doubling: each round doubles the windows passed
            resets[more] = resets[after[more]]
            ahead = after.copy()
            ahead[more] = after[after[more]]
            after, more = ahead, ahead < stop
        met = np.empty(len(starts), bool)
        met[1:] = starts[:-1] < horizon[group[1:]]
        met[bounds[:-1]] = True
        starts, resets, group = starts[met], resets[met], group[met]
        keep = np.append((resets[1:] != resets[:-1]) | (group[1:] != group[:-1]), True)
        return starts[keep], resets[keep], np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=len(bounds) - 1))])

    def functions(clients, blocks, starts, resets, bounds):
        offsets = pa.array(bounds, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(steps, pa.int64())) for steps in (starts, resets)]
        return pa.RecordBatch.from_arrays([clients, pa.array(blocks, pa.int64()), *lists], names=["client", "block", "starts", "resets"])

    def steps(batch):
        """Starts, resets and bounds of the functions of a batch."""
        starts, resets = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "resets"))
        sizes = pc.list_value_length(batch.column("starts")).to_numpy(zero_copy_only=False)
        return starts, resets, np.concatenate([[0], np.cumsum(sizes)]).astype("int64")

    return pieces, numbers, grouped, seeker, close, functions, steps, edges, key_at


def _describer(window_ms: int, chunk_ms: int):
    pieces, numbers, _, _, close, functions, *_ = _tools()

    def run(batches):
        for batch, bounds in pieces(batches, ["client", "chunk"]):
            at, heads = numbers(batch, "at_ms"), bounds[:-1]
            chunks = numbers(batch, "chunk")[heads]
            yield functions(batch.column("client").take(heads), chunks, *close(at, at + window_ms, bounds, chunks * chunk_ms + window_ms))

    return run


def _functions(ticks: DataFrame, window_ms: int, chunk_ms: int) -> DataFrame:
    """One function for each (client, chunk), from the distinct times of its requests."""
    rows = ticks.select("client", "chunk", "at_ms").repartition("client", "chunk").sortWithinPartitions("client", "chunk", "at_ms")
    return rows.mapInArrow(_describer(window_ms, chunk_ms), FUNCTION)


def _composed(functions: DataFrame, window_ms: int, block_ms: int) -> DataFrame:
    """Functions of ``FAN`` neighbouring blocks composed to one: their steps follow one another, as requests do."""
    pieces, numbers, _, _, close, made, steps, *_ = _tools()
    wide = block_ms * FAN

    def run(batches):
        for batch, bounds in pieces(batches, ["client", "upper"]):
            starts, resets, places = steps(batch)
            heads = bounds[:-1]
            upper = numbers(batch, "upper")[heads]
            yield made(batch.column("client").take(heads), upper, *close(starts, resets, places[bounds], upper * wide + window_ms))

    rows = functions.withColumn("upper", F.floor(F.col("block") / FAN))
    return rows.repartition("client", "upper").sortWithinPartitions("client", "upper", "block").mapInArrow(run, FUNCTION)


def _carried(functions: DataFrame, above: DataFrame) -> DataFrame:
    """(client, block, carried): what each block is handed, given what its group of blocks is handed."""
    pieces, numbers, grouped, seeker, _, _, steps, *_ = _tools()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, bounds in pieces(batches, ["client", "upper"]):
            starts, resets, places = steps(batch)
            inner, handed = places[bounds], numbers(batch, "carried")
            find = seeker(starts, grouped(inner))
            groups, reset = np.arange(len(bounds) - 1), handed[bounds[:-1]]
            taken = np.full(len(starts), -1)
            while len(groups):  # a round takes each group on by a block at least
                at = find(groups, reset)
                on = at < inner[1:][groups]
                groups, at = groups[on], at[on]
                taken[at] = at
                reset = resets[at]
            latest = np.concatenate([[-1], np.maximum.accumulate(taken)])[places[:-1]]  # the last step taken before each block
            own = latest >= inner[:-1][grouped(bounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("client"), batch.column("block"), pa.array(np.where(own, resets[latest], handed), pa.int64())], names=["client", "block", "carried"])

    rows = functions.withColumn("upper", F.floor(F.col("block") / FAN)).join(above, ["client", "upper"])
    return rows.repartition("client", "upper").sortWithinPartitions("client", "upper", "block").mapInArrow(
        run, "client string, block bigint, carried bigint")


def _scan(ticks: DataFrame, window_ms: int, chunk_ms: int) -> DataFrame:
    """(client, chunk, carried): the end of the window open before each chunk. Up by composing blocks, down by following them.

    No group of either sweep has more than ``FAN`` rows, so a busy client's chunks are scanned by many tasks.
    """
    levels = [written(_functions(ticks, window_ms, chunk_ms), "limiter")]
    span, block_ms = ticks.agg(F.min("chunk"), F.max("chunk")).first(), chunk_ms
    low, high = span if span[0] is not None else (0, 0)
    while low // FAN != high // FAN:
        levels.append(written(_composed(levels[-1], window_ms, block_ms), "limiter"))
        low, high, block_ms = low // FAN, high // FAN, block_ms * FAN
    carried = levels[-1].select("client").distinct().select("client", F.lit(low // FAN).cast("bigint").alias("upper"), F.lit(NEVER).alias("carried"))
    for level in reversed(levels):
        carried = written(_carried(level, carried), "limiter").withColumnRenamed("block", "upper")
    return carried.withColumnRenamed("upper", "chunk")


def _tails(ticks: DataFrame, carried: DataFrame, window_ms: int) -> DataFrame:
    """(client, chunk, before): requests of the open window that were made in the chunk before."""
    pieces, numbers, grouped, seeker, *_ = _tools()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, bounds in pieces(batches, ["client", "chunk"]):
            at, heads = numbers(batch, "at_ms"), bounds[:-1]
            find, stop = seeker(at, grouped(bounds)), bounds[1:]
            groups = np.arange(len(heads))
            opened = find(groups, numbers(batch, "carried")[heads])
            groups = groups[opened < stop]
            while len(groups):
                after = find(groups, at[opened[groups]] + window_ms)
                on = after < stop[groups]
                groups = groups[on]
                opened[groups] = after[on]
            upto = np.concatenate([[0], np.cumsum(numbers(batch, "requests"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("client").take(heads), pa.array(numbers(batch, "chunk")[heads] + 1, pa.int64()), pa.array(upto[stop] - upto[opened], pa.int64())],
                names=["client", "chunk", "before"])

    rows = ticks.join(carried, ["client", "chunk"]).repartition("client", "chunk").sortWithinPartitions("client", "chunk", "at_ms")
    return rows.mapInArrow(run, "client string, chunk bigint, before bigint")


def rate_limit(log: DataFrame, window_ms: int = WINDOW_MS, limit: int = MAX_REQUESTS, chunk_ms: int | None = None) -> DataFrame:
    """Verdict on every request of log(client, at_ms, request_id).

    ``chunk_ms`` is the length of the time chunks in which a client's requests are judged, at least a window; a chunk's distinct times
    are held at once, its requests are streamed. Requests without a client are those of the client ``unknown``; requests without a
    time are not judged.
    """
    chunk_ms = chunk_ms or CHUNK_WINDOWS * window_ms
    if chunk_ms < window_ms:
        raise ValueError("chunk_ms is a window at least")
    rows = log.filter("at_ms IS NOT NULL").select(
        F.coalesce("client", F.lit("unknown")).alias("client"), "at_ms", "request_id", F.floor(F.col("at_ms") / chunk_ms).alias("chunk"))
    ticks = written(rows.groupBy("client", "chunk", "at_ms").agg(F.count("*").alias("requests")), "limiter")
    carried = _scan(ticks, window_ms, chunk_ms)
    known = written(carried.join(_tails(ticks, carried, window_ms), ["client", "chunk"], "left").fillna(0, ["before"]), "limiter")
    placed = rows.join(known, ["client", "chunk"]).repartition("client", "chunk").sortWithinPartitions("client", "chunk", "at_ms", "request_id")
    return placed.mapInArrow(_judge(window_ms, limit), OUTPUT)


def _judge(window_ms: int, limit: int):
    _, numbers, grouped, seeker, *_, edges, key_at = _tools()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        keys, last, state = ["client", "chunk"], None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bounds = np.concatenate([[0], edges(batch, keys), [n]]).astype("int64")
            heads, stop, at = bounds[:-1], bounds[1:], numbers(batch, "at_ms")
            count, reset = numbers(batch, "before")[heads], numbers(batch, "carried")[heads]
            if key_at(batch, keys, 0) == last:  # a chunk's requests go on from the batch before
                count[0], reset[0] = state
            # each group begins in the window it is handed; every other window begins with the request that opens it
            begins, before, resets = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
            begins[heads], before[heads], resets[heads] = True, count, reset
            find, groups = seeker(at, grouped(bounds)), np.arange(len(heads))
            while len(groups):
                opens = find(groups, reset)
                on = opens < stop[groups]
                groups, opens = groups[on], opens[on]
                reset = at[opens] + window_ms
                begins[opens], before[opens], resets[opens] = True, 0, reset
            opened = np.flatnonzero(begins)
            mine = opened[np.cumsum(begins) - 1]
            counts, resets = before[mine] + np.arange(n) - mine + 1, resets[mine]
            last, state = key_at(batch, keys, n - 1), (int(counts[-1]), int(resets[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("client"), batch.column("at_ms"), batch.column("request_id"), pa.array(counts > limit),
                 pa.array(np.maximum(0, limit - counts), pa.int32()), pa.array(resets, pa.int64())],
                names=["client", "at_ms", "request_id", "limited", "remaining", "reset_ms"])

    return run


def rate_limit_stream(log: DataFrame, window_ms: int = WINDOW_MS, limit: int = MAX_REQUESTS, late: str = "1 minute") -> DataFrame:
    """The same verdicts on a stream, one (count, reset) state per client, kept until its window is over.

    Rows of a micro-batch are judged by time; of those only times and ids are held. The watermark follows the requests' own times,
    ``late`` behind the newest; a timer at the end of a client's window removes its state once the watermark is past it, so the
    state is that of the open windows alone, and a stream that has ended stays ended.
    """
    session = log.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = log.filter("at_ms IS NOT NULL").select(F.coalesce("client", F.lit("unknown")).alias("client"), "at_ms", "request_id", F.timestamp_millis("at_ms").alias("at"))
    return rows.withWatermark("at", late).groupBy("client").transformWithStateInPandas(
        statefulProcessor=_bucket_processor(window_ms, limit)(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _bucket_processor(window_ms: int, limit: int):
    walk = _walker()

    class Buckets(StatefulProcessor):
        """One client's open window."""

        def init(self, handle) -> None:
            self.handle = handle
            self.bucket = handle.getValueState("bucket", "count bigint, reset_ms bigint")

        def handleInputRows(self, key, rows, timerValues):
            import numpy as np
            import pandas as pd

            parts = [(pdf["at_ms"].to_numpy(), pdf["request_id"].to_numpy()) for pdf in rows]
            at, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.lexsort((ids, at))
            at, ids = at[order], ids[order]
            count, reset = self.bucket.get() if self.bucket.exists() else (0, -(1 << 62))
            counts, resets, count, reset = walk(at, int(count), int(reset), window_ms)
            self.bucket.update((int(count), int(reset)))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(reset) + 1)
            yield pd.DataFrame({
                "client": [key[0]] * len(at), "at_ms": at, "request_id": ids, "limited": counts > limit,
                "remaining": np.maximum(0, limit - counts).astype("int32"), "reset_ms": resets})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.bucket.exists() and self.bucket.get()[1] < expiredTimerInfo.getExpiryTimeInMs():
                self.bucket.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Buckets
