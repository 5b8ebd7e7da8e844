"""Frame sequences ``(seq_id, t, vec)``: similarity, segment borders, pooling and stream alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def adjacent_similarity(frames: DataFrame, seq: str = "seq_id", t: str = "t", vec: str = "vec") -> DataFrame:
    """Adds sim: cosine with the frame before, rounded to 6 places; null for the first frame, 0 where a norm is 0.

    The norm of a frame is computed once and travels with it to the next one.
    """
    own = frames.withColumn("__own", F.struct(F.col(vec).alias("v"), dot(F.col(vec), F.col(vec)).alias("n")))
    own = own.withColumn("__before", F.lag("__own").over(Window.partitionBy(seq).orderBy(t)))
    norm = F.sqrt(F.col("__own.n") * F.col("__before.n"))
    sim = F.coalesce(dot(F.col(vec), F.col("__before.v")) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))
    return own.withColumn("sim", F.when(F.col("__before").isNotNull(), F.round(sim, 6))).drop("__own", "__before")


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def threshold_segments(frames: DataFrame, threshold: float, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Adds segment: a new one begins at the first frame and wherever sim <= threshold."""
    fresh = _flag(F.col("sim").isNull() | (F.col("sim") <= threshold))
    return frames.withColumn("segment", (F.sum(fresh).over(Window.partitionBy(seq).orderBy(t)) - 1).cast("int"))


def topk_segments(frames: DataFrame, target: float, base: float, seq: str = "seq_id", t: str = "t", max_run: int | None = None) -> DataFrame:
    """Adds segment for a target rate: the n - 1 least similar transitions are borders, n = max(1, round(L * target / base)).

    Ties fall to the earlier frame.  ``max_run`` cuts segments longer than that.
    """
    per = Window.partitionBy(seq)
    ordered = per.orderBy(t)
    wanted = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(per) * F.lit(target / base)).cast("int"))
    rank = F.row_number().over(per.orderBy(F.col("sim").asc_nulls_last(), t))
    fresh = F.col("sim").isNull() | (rank <= wanted - 1)
    frames = frames.withColumn("__new", _flag(fresh))
    if max_run is None:
        return frames.withColumn("segment", (F.sum("__new").over(ordered) - 1).cast("int")).drop("__new")
    return split_runs(frames, "__new", max_run, seq, t).drop("__new")


def split_runs(frames: DataFrame, new: str, max_run: int, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Adds segment: runs that begin where ``new`` is 1 are cut every ``max_run`` frames."""
    ordered = Window.partitionBy(seq).orderBy(t)
    placed = frames.withColumn("__p", F.row_number().over(ordered) - 1)
    placed = placed.withColumn("__start", F.max(F.when(F.col(new) == 1, F.col("__p")).otherwise(0)).over(ordered))
    fresh = _flag((F.col("__p") - F.col("__start")) % max_run == 0)
    return placed.withColumn("segment", (F.sum(fresh).over(ordered) - 1).cast("int")).drop("__p", "__start")


def uniform_segments(frames: DataFrame, target: float, base: float, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Adds segment = min(floor(p * n / L), n - 1) for position p of L frames."""
    per = Window.partitionBy(seq)
    length = F.count(F.lit(1)).over(per)
    n = F.greatest(F.lit(1), F.bround(length * F.lit(target / base)).cast("int"))
    place = F.row_number().over(per.orderBy(t)) - 1
    return frames.withColumn("segment", F.least(F.floor(place * n / length), n - 1).cast("int"))


def segment_frames(frames: DataFrame, value: float, base: float, uniform: bool = False) -> DataFrame:
    """Mode rule: a value over 1 is a target rate (by similarity or uniform), else a similarity threshold."""
    if value > 1:
        return uniform_segments(frames, value, base) if uniform else topk_segments(adjacent_similarity(frames), value, base)
    return threshold_segments(adjacent_similarity(frames), value)


def segment_sums(frames: DataFrame, seq: str = "seq_id", vec: str = "vec") -> DataFrame:
    """``(seq, segment, sums, frames)``: sum of the vectors of every segment.

    Arrow batches are summed where they are, one row for each segment in them, so no frame is ever spread over its
    dimensions; what is left of a segment are the few batches it lies in.
    """
    kind = frames.schema[seq].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.filter(batch.column(2).is_valid())
            if not held.num_rows:
                continue
            codes = pc.fill_null(held.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            segment = held.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            _, first, group, number = np.unique(codes * (segment.max() + 1) + segment, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(group, kind="stable")
            vectors = held.column(2)
            widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            if (widths == widths[0]).all():
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(widths), -1)
                sums = np.add.reduceat(np.nan_to_num(flat[order]), np.cumsum(number) - number, axis=0)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            else:
                made = pa.array([_uneven(vectors.take(pa.array(rows))) for rows in np.split(order, np.cumsum(number)[:-1])], pa.list_(pa.float64()))
            rows = pa.array(first)
            yield pa.RecordBatch.from_arrays([held.column(0).take(rows), held.column(1).take(rows), made, pa.array(number, pa.int64())], names=[seq, "segment", "sums", "frames"])

    parts = frames.select(seq, F.col("segment").cast("int").alias("segment"), F.col(vec).cast("array<double>").alias("__v"))
    parts = parts.mapInArrow(run, f"`{seq}` {kind}, segment int, sums array<double>, frames bigint")
    added = F.aggregate(F.collect_list("sums"), F.array().cast("array<double>"), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    return parts.groupBy(seq, "segment").agg(added.alias("sums"), F.sum("frames").alias("frames"))


def _uneven(vectors: pa.Array) -> np.ndarray:
    """Sum of vectors of different widths: missing dimensions count nothing."""
    some = [np.array(v, np.float64) for v in vectors.to_pylist()]
    out = np.zeros(max(map(len, some)))
    for v in some:
        out[: len(v)] += np.nan_to_num(v)
    return out


def pool_segments(frames: DataFrame, seq: str = "seq_id", vec: str = "vec") -> DataFrame:
    """``(seq, segment, dim, mean, frames)``: mean of every dimension of every segment."""
    made = segment_sums(frames, seq, vec)
    return made.select(seq, "segment", F.posexplode("sums").alias("dim", "x"), "frames").select(seq, "segment", "dim", (F.col("x") / F.col("frames")).alias("mean"), "frames")


def pooled_vectors(frames: DataFrame, seq: str = "seq_id", vec: str = "vec") -> DataFrame:
    """``(seq, segment, vec)``: pooled vectors."""
    return segment_sums(frames, seq, vec).select(seq, "segment", F.transform("sums", lambda x: x / F.col("frames")).alias(vec))


def segment_sizes(frames: DataFrame, seq: str = "seq_id") -> DataFrame:
    return frames.groupBy(seq, "segment").agg(F.count(F.lit(1)).alias("size"))


def achieved_rate(frames: DataFrame, base: float, seq: str = "seq_id") -> DataFrame:
    """One row: mean over sequences of segments / max(frames, 1) * base; the base rate if there are none."""
    each = frames.groupBy(seq).agg((F.max("segment") + 1).alias("n"), F.count(F.lit(1)).alias("frames"))
    rate = F.avg(F.col("n") / F.greatest(F.col("frames"), F.lit(1)) * base)
    return each.agg(F.coalesce(rate, F.lit(float(base))).alias("rate"))


def query_positions(frames: DataFrame, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Places of frames and of one query behind each segment in the joint sequence: ``(seq, kind, item, place)``."""
    ordered = Window.partitionBy(seq).orderBy(t)
    places = frames.withColumn("__p", F.row_number().over(ordered) - 1)
    items = places.select(seq, F.lit("frame").alias("kind"), F.col("__p").alias("item"), (F.col("__p") + F.col("segment")).alias("place"))
    last = places.groupBy(seq, "segment").agg(F.max("__p").alias("__last"))
    queries = last.select(seq, F.lit("query").alias("kind"), F.col("segment").alias("item"), (F.col("__last") + F.col("segment") + 1).alias("place"))
    return items.unionByName(queries)


def delayed_pairs(items: DataFrame, seq: str, order: str, value: str, valid: Column) -> DataFrame:
    """Item n gets the value of step n + 1; pairs whose value is invalid leave, and so does the tail."""
    later = F.lead(value).over(Window.partitionBy(seq).orderBy(order))
    return items.withColumn("paired", later).where(F.col("paired").isNotNull() & valid)


def splice_before(tokens: Column, insert: Column, marker: Column) -> Column:
    """``tokens`` with ``insert`` before the first ``marker``; null without a marker."""
    at = F.array_position(tokens, marker).cast("int")
    return F.when(at > 0, F.concat(F.slice(tokens, F.lit(1), at - 1), insert, F.slice(tokens, at, F.size(tokens))))


def interleave(a: Column, b: Column) -> Column:
    """a0, b0, a1, b1, ... up to the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))


def even_odd(tokens: Column) -> tuple[Column, Column]:
    """Streams at even and at odd places; an odd tail is dropped."""
    whole = F.slice(tokens, F.lit(1), (F.floor(F.size(tokens) / 2) * 2).cast("int"))
    return F.filter(whole, lambda x, i: i % 2 == 0), F.filter(whole, lambda x, i: i % 2 == 1)


def align_streams(text: Column, speech: Column, delay: int, delay_token: Column, end: Column, pad: Column) -> Column:
    """Struct(text, speech, padded): delay tokens before and an end token behind the speech, the shorter side padded."""
    late = F.concat(F.array_repeat(delay_token, delay), speech, F.array(end))
    gap = F.size(late) - F.size(text)
    return F.struct(
        F.concat(text, F.array_repeat(pad, F.greatest(F.lit(0), gap))).alias("text"),
        F.concat(late, F.array_repeat(pad, F.greatest(F.lit(0), -gap))).alias("speech"),
        F.abs(gap).alias("padded"),
    )


def history(turns: DataFrame, conversation: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """Adds history: the texts of earlier turns of the conversation, in order."""
    earlier = F.collect_list(text).over(Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("history", F.concat_ws(separator, earlier))


def history_of(messages: Column, separator: str = "\n") -> Column:
    """For a message array: an array with the joined contents before each message, without any shuffle."""
    contents = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.transform(messages, lambda m, i: F.concat_ws(separator, F.slice(contents, F.lit(1), i)))


def shifted(labels: Column, ignore: int = -100) -> Column:
    """Labels of the next position; the last position has none and gets ``ignore``."""
    return F.when(F.size(labels) > 0, F.concat(F.slice(labels, 2, F.size(labels)), F.array(F.lit(ignore)))).otherwise(labels)


def target_spans(packed: DataFrame, offset: str = "offset", length: str = "length") -> DataFrame:
    """Adds first_target and targets: which of the shifted losses of its batch a packed sample owns.

    Loss t of a batch is that of token t + 1, so it belongs to the sample of that token: the first sample of a batch owns
    one loss less than it has tokens, and every other one begins with the loss of the token before it.
    """
    begins = F.col(offset) == 0
    return packed.withColumn("first_target", F.greatest(F.col(offset) - 1, F.lit(0))).withColumn("targets", F.greatest(F.col(length) - F.when(begins, 1).otherwise(0), F.lit(0)))
