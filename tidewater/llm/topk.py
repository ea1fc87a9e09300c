"""Operator 2: exact top-k inner products by a pivot-distance index.

With M the largest squared norm, every vector x gets one more component
sqrt(M - |x|^2); then |q - x|^2 = |q|^2 + M - 2 q.x for a query q (whose own added
component is 0), so the highest products are the nearest vectors and the triangle
inequality holds. Each distinct vector is keyed by its nearest pivot and by the
annulus of its distance from it. A first round searches one block of each query's
home annulus and gives a threshold; a second visits every other block whose annulus
can hold something as near. Annuli know the range of their distances from every
pivot, not only their own, and all of these bound. Within a block, annuli are cut
finer in the same way and expanded outwards while a bound allows. Scores are exact
whole numbers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, stash

#: Rows from which pivots are chosen, pivots at most, annuli of a pivot, rows of a block and of a step in it, queries of a task.
SAMPLE, PIVOTS, ANNULI, BLOCK, STEP, QUERIES = 2048, 256, 4, 8192, 256, 8192
SLACK = 1e-6
#: Pivots where the sample says that bounds save next to nothing: its queries' share of products beyond which few are taken.
FEW, NEAR_ALL = 8, 0.9
BLOCK_KEY = ["pivot", "annulus", "part"]


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, or null if one is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products; through doubles where these hold them exactly."""
    bound = float(np.abs(q).max(initial=1)) * float(np.abs(x).max(initial=1)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots from the sample."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def share_left(sample: np.ndarray, pivots: np.ndarray, m: float, k: int, asked: int = 64) -> float:
    """The share of products that steps of the sample, in the order of an index, leave to some of its own queries.

    Thresholds are those that the queries reach within the sample. Only the speed of a search
    depends on this number.
    """
    far = distances(sample, pivots)
    order = np.lexsort((far.min(1), far.argmin(1)))
    far, rows = far[order], sample[order]
    starts = np.arange(0, len(rows), max(1, len(rows) // 64))
    queries = np.c_[rows[:: max(1, len(rows) // asked), :-1], np.zeros(len(rows[:: max(1, len(rows) // asked)]))]
    scores = queries @ rows.T
    need = np.partition(scores, -min(k + 1, len(rows)), 1)[:, -min(k + 1, len(rows))]
    limit = np.sqrt(np.maximum(0, (queries**2).sum(1) + m - 2 * need))
    gap = bounds(distances(queries, pivots), np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts))
    return float((gap <= limit[:, None] * (1 + SLACK) + SLACK).mean())


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors from all pivots."""
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T))


def bounds(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least distance that each row of ``d`` (distances from pivots) allows from each box (``lo`` to ``hi`` by pivot)."""
    out = np.zeros((len(d), len(lo)))
    for j in range(len(lo)):
        out[:, j] = np.maximum(0, np.maximum(lo[j] - d, d - hi[j])).max(1)
    return out


def _search(q: pd.DataFrame, x: pd.DataFrame, most: int, m: float, pivots: np.ndarray) -> tuple[list[tuple], int]:
    """The best ids of one block for each query, as (qid, score, ids), and how many products were taken."""
    vectors, dist = _matrix(x["v"]), x["dist"].to_numpy(float)
    order = np.lexsort((x["uid"].to_numpy(), dist))
    vectors = vectors[order]
    ids, uid = x["ids"].to_numpy()[order], x["uid"].to_numpy()[order]
    queries, need = _matrix(q["v"]), q["need"].to_numpy(float)
    norm = (queries.astype(float) ** 2).sum(1)
    lifted = np.c_[vectors.astype(float), np.sqrt(np.maximum(0, m - (vectors.astype(float) ** 2).sum(1)))]
    far = distances(lifted, pivots)
    starts = np.arange(0, len(vectors), STEP)
    gap = bounds(
        distances(np.c_[queries.astype(float), np.zeros(len(queries))], pivots), np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)
    )
    best_s = np.full((len(queries), most), -np.iinfo(np.int64).max)
    best_i = np.full((len(queries), most), -1)
    limit, taken = np.sqrt(np.maximum(0, norm + m - 2 * need)), 0
    for c in np.argsort(gap.min(0), kind="stable"):
        act = np.flatnonzero(gap[:, c] <= limit * (1 + SLACK) + SLACK)
        if not act.size:
            continue
        lo, hi = int(starts[c]), min(int(starts[c]) + STEP, len(vectors))
        taken += len(act) * (hi - lo)
        s = np.concatenate([best_s[act], _exact(queries[act], vectors[lo:hi])], 1)
        i = np.concatenate([best_i[act], np.broadcast_to(np.arange(lo, hi), (len(act), hi - lo))], 1)
        u = np.where(i >= 0, uid[i], np.iinfo(np.int64).max)
        top = np.lexsort((u, -s), axis=1)[:, :most]
        best_s[act], best_i[act] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        last = best_s[act, -1].astype(float)
        with np.errstate(invalid="ignore"):
            limit[act] = np.where(best_i[act, -1] >= 0, np.minimum(limit[act], np.sqrt(np.maximum(0, norm[act] + m - 2 * last))), limit[act])
    rows = [
        (qid, int(s), ids[i])
        for qid, ss, ii in zip(q["qid"], best_s, best_i, strict=True)
        for s, i in zip(ss, ii, strict=True)
        if i >= 0
    ]
    return rows, taken


def sent_blocks(index: DataFrame, due: DataFrame) -> DataFrame:
    """The index rows of the blocks that are due (pivot, annulus, part, chunk), once for each such chunk of queries."""
    chunks = due.groupBy(*BLOCK_KEY).agg(F.collect_set("chunk").alias("_chunks"))
    return index.join(chunks, BLOCK_KEY).withColumn("chunk", F.explode("_chunks")).drop("_chunks")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id. Ties go to the smaller id; with fewer
    candidates there are fewer rows. Rows take no part whose id or vector is null
    or whose vector holds a null or non-finite component. Of vectors of different
    lengths, the shorter ones' missing components count as zero. Repeated rows
    count once; one id with several vectors counts as several candidates (and
    queries). An empty table
    gives an empty result. Other columns are left alone. Products are exact while
    they fit 63 bits.

    Equal vectors are one vector with its k + 1 smallest ids, so a third of all
    rows being equal costs no more than one. Pivots come from at most SAMPLE rows;
    everything is indexed, and blocks and query chunks follow counts, so no task
    holds a cell or its queries whole. A block is sent to those chunks of queries that
    reach it. The driver sees pivots and one row for each (pivot, annulus). How much the bounds save depends on the data (see the README).
    """
    spark = vectors.sparkSession
    base = (
        vectors.select(F.col(id_col).alias("id"), quantised(F.col(vec_col)).alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .dropDuplicates(["id", "v"])
    )
    by_id = Window.partitionBy("v").orderBy("id")
    unique = (
        base.withColumn("n", F.row_number().over(by_id))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("uid", F.col("ids")[0])
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    )
    unique, path_u = stash(unique, "topk-vectors")
    stats = unique.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.max("norm").alias("m")).first()
    if not stats.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n, m = stats
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    unique = unique.withColumn("v", padded)
    rows = unique.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v", "norm").collect()
    lift = lambda v, norm: np.c_[v.astype(float), np.sqrt(np.maximum(0, m - norm))]
    sample = lift(np.array([r.v for r in rows], np.int64).reshape(len(rows), dim), np.array([r.norm for r in rows]))
    pivots = choose_pivots(sample, max(1, min(PIVOTS, int(n**0.5 / 8))))
    if len(pivots) > FEW and share_left(sample, pivots, m, k) > NEAR_ALL:
        pivots = pivots[:FEW]
    width = max(1e-9, max(np.sqrt(((sample[:, None] - pivots[None]) ** 2).sum(2)).min(1).max() / ANNULI, 1e-9)) if dim else 1.0

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = distances(lift(_matrix(f["v"]), f["norm"].to_numpy(float)), pivots)
                f["pivot"] = d.argmin(1).astype(np.int32)
                f["dist"] = d.min(1)
                f["annulus"] = np.minimum(f["dist"] // width, ANNULI - 1).astype(np.int32)
                yield f[["v", "ids", "uid", "pivot", "annulus", "dist"]]

    def boxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        for f in frames:
            x = _matrix(f["v"]) if len(f) else np.zeros((0, dim))
            far = distances(lift(x, (x.astype(float) ** 2).sum(1)), pivots)
            for cell, at in f.groupby(["pivot", "annulus"]).indices.items():
                n, lo, hi = held.get(cell, (0, np.inf, -np.inf))
                held[cell] = [n + len(at), np.minimum(lo, far[at].min(0)), np.maximum(hi, far[at].max(0))]
        yield pd.DataFrame([(*c, n, lo, hi) for c, (n, lo, hi) in held.items()], columns=["pivot", "annulus", "n", "lo", "hi"])

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        one = f.iloc[:1].copy()
        one["n"], one["lo"], one["hi"] = [f["n"].sum()], [np.min(np.stack(f["lo"]), 0)], [np.max(np.stack(f["hi"]), 0)]
        return one

    schema = "v array<long>, ids array<long>, uid long, pivot int, annulus int, dist double"
    index, path_i = stash(unique.mapInPandas(keyed, schema), "topk-index")
    box = "pivot int, annulus int, n long, lo array<double>, hi array<double>"
    cells = index.select("v", "pivot", "annulus").mapInPandas(boxed, box).groupBy("pivot", "annulus").applyInPandas(joined, box).collect()
    names = [(c.pivot, c.annulus) for c in cells]
    lows, highs = (np.array([c[k] for c in cells]).reshape(len(cells), len(pivots)) for k in ("lo", "hi"))
    pieces = [-(-c.n // BLOCK) for c in cells]
    split = spark.createDataFrame([(p, a, b) for (p, a), b in zip(names, pieces, strict=True)], "pivot int, annulus int, parts int")
    index = index.join(F.broadcast(split), ["pivot", "annulus"]).withColumn("part", F.expr("cast(pmod(xxhash64(uid), parts) as int)"))

    asked = base.where(F.col("id") % every == 0).withColumn("v", padded)
    queries, path_q = stash(asked.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "topk-queries")
    # Of a block's best, this many leave k behind when the asking id's own vectors go.
    most = k + (asked.groupBy("id").count().agg(F.max("count")).first()[0] or 0)
    chunks = max(1, -(-queries.count() // QUERIES))

    def reached(f: pd.DataFrame, home: bool) -> Iterator[tuple[int, int, np.ndarray]]:
        """The blocks (cell, part) that some query of a batch has to see, with those queries."""
        x = _matrix(f["v"])
        # A query's own added component is 0; home is the cell nearest to it.
        table = bounds(distances(np.c_[x.astype(float), np.zeros(len(x))], pivots), lows, highs)
        limit = np.sqrt(np.maximum(0, (x.astype(float) ** 2).sum(1) + m - 2 * f["need"].to_numpy(float)))
        near = table.argmin(1)
        within = table <= (limit * (1 + SLACK) + SLACK)[:, None]
        for j in np.unique(near) if home else np.flatnonzero(within.any(0)):
            for part in range(1 if home else pieces[j]):
                first = (near == j) & (part == 0)
                sel = np.flatnonzero(first if home else ~first & within[:, j])
                if sel.size:
                    yield int(j), part, sel

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = _matrix(f["v"]).astype(float) if len(f) else np.zeros((0, dim))
            f["home"] = bounds(distances(np.c_[x, np.zeros(len(x))], pivots), lows, highs).argmin(1).astype(np.int32) if len(f) else np.zeros(0, np.int32)
            yield f[["qid", "v", "home"]]

    def visit(frames: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        for f in frames:
            for j, part, sel in reached(f, home) if len(f) else ():
                g = f.iloc[sel][["qid", "v", "need", "chunk"]].copy()
                g["pivot"], g["annulus"], g["part"] = *names[j], part
                yield g

    def wanted(frames: Iterator[pd.DataFrame], home: bool) -> Iterator[pd.DataFrame]:
        """Which chunks of queries reach which blocks, without the queries."""
        for f in frames:
            chunk = f["chunk"].to_numpy()
            rows = [(*names[j], part, int(c)) for j, part, sel in (reached(f, home) if len(f) else ()) for c in np.unique(chunk[sel])]
            yield pd.DataFrame(rows, columns=["pivot", "annulus", "part", "chunk"])

    def searched(asking: DataFrame, home: bool) -> DataFrame:
        key = [*BLOCK_KEY, "chunk"]
        # A block goes to the chunks that reach it and nowhere else.
        due = asking.mapInPandas(lambda fs: wanted(fs, home), "pivot int, annulus int, part int, chunk int")
        sent = sent_blocks(index, due)
        plan = asking.mapInPandas(lambda fs: visit(fs, home), visits)

        def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            out = _search(q, x, most, m, pivots)[0] if len(q) and len(x) else []
            return pd.DataFrame(out, columns=["qid", "score", "ids"])

        return plan.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(run, "qid long, score long, ids array<long>")

    visits = "qid long, v array<long>, need double, chunk int, pivot int, annulus int, part int"
    if chunks > 1:
        # Queries of one home cell share chunks, so that a chunk reaches few blocks.
        queries, _ = stash(queries.mapInPandas(homes, "qid long, v array<long>, home int"), "topk-chunks")
        number, base = {r.home: -(-r["count"] // QUERIES) for r in queries.groupBy("home").count().collect()}, 0
        table = []
        for home, parts in sorted(number.items()):
            table.append((home, base, parts))
            base += parts
        told = spark.createDataFrame(table, "home int, base int, parts int")
        queries = queries.join(F.broadcast(told), "home").withColumn("chunk", F.expr("cast(base + pmod(xxhash64(qid), parts) as int)")).select("qid", "v", "chunk")
    else:
        queries = queries.withColumn("chunk", F.lit(0))
    start = queries.withColumn("need", F.lit(float("-inf"))).repartition(spark.sparkContext.defaultParallelism, "qid")
    first, path_1 = stash(searched(start, True), "topk-home")

    def best(found: DataFrame) -> DataFrame:
        each = found.select("qid", "score", F.explode("ids").alias("vec_id"))
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)

    floor = best(first).where(F.col("r") == most).select("qid", F.col("score").cast("double").alias("known"))
    later = queries.join(floor, "qid", "left").select("qid", "v", "chunk", F.coalesce("known", F.lit(float("-inf"))).alias("need"))
    second, path_2 = stash(searched(later, False), "topk-rest")
    found, path_f = stash(best(first.unionByName(second)).select("qid", "score", "vec_id"), "topk-found")

    own = asked.join(queries.select("v", "qid"), "v").select(F.col("id").alias("query_id"), "qid")
    w = Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")
    out = (
        own.join(found, "qid")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")
    )
    discard(spark, path_u, path_i, path_1, path_2, *([path_q] if chunks > 1 else []))
    return out
