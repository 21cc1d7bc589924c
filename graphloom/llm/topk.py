"""Exact top-k by integer inner product.

Vectors are dealt into blocks by descending length. A query leaves a block alone when its length times the block's
greatest length can't reach its k-th best score so far (Cauchy-Schwarz). Within a block, vectors and query are rotated to
the axes of greatest spread (from an SVD); the partial sum over the first axes plus the product of what is left of both
lengths bounds a score from above, and only those who can still enter the best k get an exact inner product. Rotation and
bounds decide what is computed, never a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, materialised, partitions_for, shared_folder, tuned
from graphloom.llm.files import at, write_whole

#: Vectors of a block, at most, and at least where there are so many; queries of a block.
MOST_ROWS, LEAST_ROWS, QUERY_ROWS = 1 << 15, 1 << 11, 1 << 10
#: Vectors from which the rotation is fitted: those with the least hashes of their ids.
SAMPLE = 10_000
#: Share of the axes that a partial sum covers, and rows of one step within a block.
LEADING, STEP = 0.5, 4096


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while every partial sum fits in 53 bits, else in 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if bound >= 2.0**63:
        raise OverflowError("scores need more than 64 bits")
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if bound < 2.0**53 else q @ x.T


def best_of(q_ids, q, x_ids, x, tau, k: int, axes: np.ndarray | None = None, step: int = STEP) -> dict[int, list[tuple[int, int]]]:
    """The k best (score, vec_id) of each query, by its row number, among rows x that may reach tau; x is sorted by descending length."""
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(v, ((0, 0), (0, d - v.shape[1]))) for v in (q, x))
    axes = np.eye(d) if axes is None or len(axes) != d else axes
    lead = max(1, int(LEADING * d)) if d else 0
    qf, tau, held = q.astype(np.float64), tau.astype(np.float64).copy(), {}
    q_norm = np.sqrt((qf**2).sum(axis=1))
    q_lead = qf @ axes[:, :lead]
    q_rest = np.sqrt(np.maximum(0, q_norm**2 - (q_lead**2).sum(axis=1)))
    for start in range(0, len(x), step):
        part, ids = x[start : start + step], x_ids[start : start + step]
        pf = part.astype(np.float64)
        norm = np.sqrt((pf**2).sum(axis=1))
        slack = 1.0 + 1e-9 * q_norm * norm.max(initial=0)
        live = np.flatnonzero(q_norm * norm.max(initial=0) + slack >= tau)
        if not len(live):
            continue
        p_lead = pf @ axes[:, :lead]
        p_rest = np.sqrt(np.maximum(0, norm**2 - (p_lead**2).sum(axis=1)))
        above = q_lead[live] @ p_lead.T + np.outer(q_rest[live], p_rest) + slack[live, None]
        may = (above >= tau[live, None]) & (q_ids[live, None] != ids)
        columns = np.flatnonzero(may.any(axis=0))
        if not len(columns):
            continue
        exact = _scores(q[live], part[columns])
        may = may[:, columns]
        for row, query in enumerate(live.tolist()):
            at_ = np.flatnonzero(may[row] & (exact[row] >= tau[query]))
            if not len(at_):
                continue
            if len(at_) > k:  # all that reach the k-th greatest score, ties included
                least = np.partition(exact[row, at_], len(at_) - k)[len(at_) - k]
                at_ = at_[exact[row, at_] >= least]
            found = held.get(query, []) + list(zip(exact[row, at_].tolist(), ids[columns[at_]].tolist(), strict=True))
            held[query] = found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
            if len(found) == k:
                tau[query] = max(tau[query], found[-1][0])
    return held


def _read(path: str) -> tuple[np.ndarray, np.ndarray]:
    system, inner = at(path)
    with system.open_input_file(inner) as file:
        head = np.frombuffer(file.read(16), "<i8")
        ids = np.frombuffer(file.read(8 * head[0]), "<i8")
        return ids, np.frombuffer(file.read(), "<i8").reshape(head[0], head[1])


def _blocks(df: DataFrame, folder: str) -> DataFrame:
    """One file for each partition of df (vec_id, v, norm): its rows in order, shorter vectors filled up with zeros."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            rows += [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        if not ids:
            return
        d = max(map(len, rows))
        v = np.zeros((len(rows), d), "<i8")
        for k, r in enumerate(rows):
            v[k, : len(r)] = r
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}.bin"
        write_whole(path, context.taskAttemptId(), [np.array(v.shape, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), v.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([path]), pa.array([float((v.astype(np.float64) ** 2).sum(axis=1).max() ** 0.5)])], names=["block", "path", "longest"])

    return materialised(df.select("vec_id", "v").mapInArrow(write, "block int, path string, longest double"), "topk-blocks")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest inner product with each query row, but for the query's own id.

    Components become floor(scale * x). Ties go to the smaller id; fewer than k rows where there are fewer. Rows with a
    null id, a null vector, or a null or non-finite component take no part; shorter vectors count as filled up with zeros;
    rows that repeat id and vector count once, and rows of the query's id with another vector are the query's own too. Scores that might exceed 64 bits are an error. Queries may be any share of
    the rows: they are dealt into blocks too, and block meets block by path, with no rows shuffled to be compared.
    """
    spark = tuned(vectors.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    x = F.col(vector_column)
    sound = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    made = vectors.filter(sound).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), is_query.alias("asks")).dropDuplicates(["vec_id", "v"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    made = materialised(made.withColumn("norm", norm), "topk-vectors")
    n, asking = made.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0)).alias("q")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not asking:
        return spark.createDataFrame([], schema)
    rows = min(MOST_ROWS, max(LEAST_ROWS, n // (2 * partitions_for(made))))
    by_norm = [F.desc("norm"), F.xxhash64("vec_id")]
    blocks = _blocks(made.repartitionByRange(-(-n // rows), *by_norm).sortWithinPartitions(*by_norm), shared_folder(spark, "topk-rows"))
    asked = _blocks(made.filter("asks").repartition(-(-asking // QUERY_ROWS), F.xxhash64("vec_id")).sortWithinPartitions("vec_id"), shared_folder(spark, "topk-queries"))
    axes = _axes(made)

    def searched(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        for q_block, q_path, x_path, taus in zip(*(columns[c].to_pylist() for c in ("q_block", "q_path", "x_path", "taus")), strict=True):
            kept = {p: kept.get(p) or _read(p) for p in (q_path, x_path)}
            (q_ids, q), (x_ids, x_rows) = kept[q_path], kept[x_path]
            tau = np.frombuffer(taus, "<f8") if taus else np.full(len(q_ids), -np.inf)
            found = best_of(q_ids, q, x_ids, x_rows, tau, k, axes)
            flat = [(q_block, row, int(q_ids[row]), i, s) for row, best in found.items() for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["q_block", "row", "query_id", "vec_id", "score"])

    kind = "q_block int, row int, query_id long, vec_id long, score long"
    names = ("q_block", "q_path", "x_path", "taus")
    queries = asked.select(F.col("block").alias("q_block"), F.col("path").alias("q_path"))
    # The longest vectors first: their k-th best score is where every other block starts from.
    first = blocks.agg(F.min_by("path", F.struct(-F.col("longest"), F.col("block"))).alias("p")).first()["p"]
    seeds = materialised(arrow_rows(queries.withColumn("x_path", F.lit(first)).withColumn("taus", F.lit(None).cast("binary")).repartition(partitions_for(queries), "q_block"), [F.col(c) for c in names], searched, kind), "topk-seeds")
    taus = _thresholds(seeds, asked, k)
    # By number, so that no list of blocks is held anywhere; a pair whose lengths can't reach the least threshold of its queries is left out before a file is read.
    most = blocks.agg(F.max("block").alias("m")).first()["m"]
    others = blocks.filter(F.col("path") != first).select("block", F.col("path").alias("x_path"), "longest")
    pairs = asked.select(F.col("block").alias("q_block"), F.col("path").alias("q_path"), F.col("longest").alias("q_longest")).join(taus, "q_block")
    pairs = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(most)))).join(others, "block")
    bound = F.col("q_longest") * F.col("longest")
    pairs = pairs.filter(bound * (1 + 1e-9) + 1 >= F.col("least"))
    rest = arrow_rows(pairs.repartition(2 * partitions_for(pairs), "x_path", "q_block").sortWithinPartitions("x_path"), [F.col(c) for c in names], searched, kind)
    ranked = F.row_number().over(Window.partitionBy("q_block", "row").orderBy(F.desc("score"), "vec_id"))
    return seeds.union(rest).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _axes(made: DataFrame) -> np.ndarray:
    """Left singular vectors of a bounded sample, the axes of greatest spread first."""
    sample = [r["v"] for r in made.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    d = max(map(len, sample), default=0)
    filled = np.zeros((len(sample), d))
    for k, v in enumerate(sample):
        filled[k, : len(v)] = v
    return np.linalg.svd(filled.T @ filled)[0] if d else np.eye(0)


def _thresholds(seeds: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q_block, taus, least: for each query of a block, in order, its k-th best score among the seeds, or minus infinity; and the least of these."""
    kth = seeds.groupBy("q_block", "row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("tau"))
    packed = kth.groupBy("q_block").agg(F.collect_list(F.struct("row", "tau")).alias("of"))

    def make(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        out, least = [], []
        for path, of in zip(columns["path"].to_pylist(), columns["of"].to_pylist(), strict=True):
            tau = np.full(len(_read(path)[0]), -np.inf)
            for x in of or []:
                if x["tau"] is not None:
                    tau[x["row"]] = x["tau"]
            out.append(tau.astype("<f8").tobytes())
            least.append(float(tau.min(initial=np.inf)))
        yield pa.RecordBatch.from_arrays([columns["q_block"], pa.array(out, pa.binary()), pa.array(least, pa.float64())], names=["q_block", "taus", "least"])

    joined = asked.select(F.col("block").alias("q_block"), "path").join(packed, "q_block", "left")
    return arrow_rows(joined, [F.col(c) for c in ("q_block", "path", "of")], make, "q_block int, taus binary, least double")
