"""Operator 12: near copies among vectors by tiled comparison in the order of principal axes.

Equal vectors are one, with their number. All are turned onto the principal axes of a
sample, which changes no product, so that the leading components carry most of it.
Cells cut the leading axes; two cells whose boxes lie too far apart never meet. The
others meet in tiles of bounded size, one task for each pair of tiles. There, products
are accumulated over the leading components first; the product of what is left is at
most that of the two suffix norms, and a pair is dropped once even that cannot reach the
threshold. Pairs within rounding of it are measured on the vectors as given.

A tile pair sends one row for each linked vector: how many it is linked with, and the
vector that stands for its component within the pair. No pair is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import discard, quoted, release, stash
from tidewater.llm.components import components
from tidewater.llm.vectors import ROWS, packed, ragged, usable

#: Distinct vectors that the axes and cells come from at most, and their bytes; cells, axes that cut them, rows and bytes of a tile.
SAMPLE, SAMPLE_BYTES, CELLS, AXES, TILE, TILE_BYTES = 4096, 32 << 20, 1024, 8, 16384, 8 << 20
#: Rows of a block within a tile, on either side.
MINE, OTHERS = 256, 2048
SLACK = 1e-9


def floats(width: int):
    """A packer of finite vectors, not zero, into their bytes as ``width``-byte floats; -0 counts as 0."""

    def pack(flat: np.ndarray, at: np.ndarray, null: np.ndarray) -> list[bytes | None]:
        ends = np.cumsum(np.r_[0, flat != 0])
        good = usable(flat, at, null) & (ends[at[1:]] > ends[at[:-1]])
        data = (flat + 0.0).astype(f"<f{width}")
        return [data[a:b].tobytes() if g else None for g, a, b in zip(good, at[:-1], at[1:], strict=True)]

    return pack


def matrix(keys: list[bytes], width: int, dim: int) -> np.ndarray:
    """Vectors padded with zeros, each divided by a power of two so that squares neither overflow nor vanish."""
    out = np.zeros((len(keys), dim))
    for i, key in enumerate(keys):
        v = np.frombuffer(key, f"<f{width}")
        out[i, : len(v)] = v
    _, power = np.frexp(np.abs(out).max(1, initial=0))
    return np.ldexp(out, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None]


def axes_of(sample: np.ndarray) -> np.ndarray:
    """Orthogonal directions by falling energy, one a column."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def cut_cells(lead: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A tree of 2 ** depth cells as (axis, value) by node, node i having 2 i + 1 (below the value) and 2 i + 2."""
    nodes, members = [], {0: np.arange(len(lead))}
    for i in range((1 << depth) - 1):
        at = members.pop(i)
        axis = int(np.ptp(lead[at], 0).argmax()) if len(at) else 0
        value = float(np.median(lead[at, axis])) if len(at) else 0.0
        nodes.append((axis, value))
        below = lead[at, axis] < value
        members[2 * i + 1], members[2 * i + 2] = at[below], at[~below]
    return nodes


def cell_of(lead: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    axis, value = np.array([a for a, _ in tree], int), np.array([v for _, v in tree])
    at = np.zeros(len(lead), int)
    for _ in range((len(tree) + 1).bit_length() - 1):
        at = 2 * at + 1 + (lead[np.arange(len(lead)), axis[at]] >= value[at])
    return at - len(tree)


def apart(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """The least squared distance between boxes, each of the first with each of the second."""
    gap = np.maximum(0, np.maximum(lo[:, None] - hi2[None], lo2[None] - hi[:, None]))
    return (gap**2).sum(2)


class Members:
    """Components of a tile pair's vectors, joined many links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            least = np.minimum(ra, rb)
            np.minimum.at(self.root, ra, least)
            np.minimum.at(self.root, rb, least)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class Tile:
    """Vectors along the first axis: as given, turned, and the norms of what follows each cut."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, cuts: list[int], step: int):
        turned = unit(x) @ axes
        self.order = np.argsort(turned[:, 0], kind="stable") if x.shape[1] else np.arange(len(x))
        self.x, self.turned = x[self.order], turned[self.order]
        squares = self.turned**2
        self.rest = {c: np.sqrt(squares[:, c:].sum(1)) for c in cuts}
        self.starts = np.arange(0, len(x), step)
        lead = self.turned[:, :AXES]
        self.lo, self.hi = (f.reduceat(lead, self.starts) for f in (np.minimum, np.maximum))


def block_pairs(a: Tile, i: slice, b: Tile, j: slice, cuts: list[int], least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows of two blocks with a cosine of ``least`` or more, and how many components were multiplied."""
    x, y = a.turned[i], b.turned[j]
    part = x[:, : cuts[0]] @ y[:, : cuts[0]].T
    taken = part.size * cuts[0]
    ii = jj = p = None
    for c, nxt in zip(cuts, [*cuts[1:], None], strict=True):
        if ii is None:
            alive = part >= least - SLACK - a.rest[c][i][:, None] * b.rest[c][j]
            n = int(np.count_nonzero(alive))
            if nxt is not None and 20 * n > part.size:  # most go on: all do, in one product
                part = part + x[:, c:nxt] @ y[:, c:nxt].T
                taken += part.size * (nxt - c)
                continue
            ii, jj = np.nonzero(alive)
            p = part[ii, jj]
        else:
            alive = p >= least - SLACK - a.rest[c][i][ii] * b.rest[c][j][jj]
            ii, jj, p = ii[alive], jj[alive], p[alive]
        if nxt is not None and len(ii):
            p = p + np.einsum("ij,ij->i", x[ii, c:nxt], y[jj, c:nxt])
            taken += len(ii) * (nxt - c)
    ii, jj = ii + i.start, jj + j.start
    close = np.flatnonzero(np.abs(p - least) <= SLACK)
    linked = p > least + SLACK
    for k in range(0, len(close), 4096):
        at = close[k : k + 4096]
        u, v = a.x[ii[at]], b.x[jj[at]]
        linked[at] = (u * v).sum(1) / (np.sqrt((u**2).sum(1)) * np.sqrt((v**2).sum(1))) >= least
    return ii[linked], jj[linked], taken


def compare(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray | None, axes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """For the rows of ``x`` and then of ``y`` (none: ``x`` with itself): the weight of their partners, their component, components multiplied."""
    dim = axes.shape[0]
    cuts = sorted({min(dim, c) for c in (-(-dim // 4), -(-dim // 2), dim)})
    a = Tile(x, axes, cuts, MINE)
    b = a if y is None else Tile(y, axes, cuts, OTHERS)
    own = y is None
    starts = np.arange(0, len(b.x), OTHERS)
    lo, hi = (b.lo, b.hi) if not own else tuple(f.reduceat(a.turned[:, :AXES], starts) for f in (np.minimum, np.maximum))
    near = apart(a.lo, a.hi, lo, hi) <= 2 - 2 * least + SLACK
    wx = wx[a.order]
    wy, shift = (wx, 0) if own else (wy[b.order], len(x))
    links, members, taken = np.zeros(len(x) + (0 if own else len(y))), Members(len(x) + (0 if own else len(y))), 0
    for r, c in zip(*np.nonzero(near), strict=True):
        i = slice(int(a.starts[r]), min(int(a.starts[r]) + MINE, len(x)))
        j = slice(int(starts[c]), min(int(starts[c]) + OTHERS, len(b.x)))
        if own and j.stop <= i.start:
            continue
        ii, jj, n = block_pairs(a, i, b, j, cuts, least)
        taken += n
        if own:
            ii, jj = ii[ii < jj], jj[ii < jj]
        if len(ii):
            links += np.bincount(ii, wy[jj], len(links)) + np.bincount(jj + shift, wx[ii], len(links))
            members.join(ii, jj + shift)
    back = a.order if own else np.r_[a.order, b.order + shift]
    out_links, out_root = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
    out_links[back], out_root[back] = links.astype(np.int64), back[members.root]
    return out_links, out_root, taken


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Link vectors with a cosine of ``least`` (above 0) or more: id, n_links, component_id, kept.

    n_links counts the other rows that a row is linked with, copies included;
    component_id is the smallest id that links reach, the row's own included;
    kept says that it is the row's own. Vectors that are null or zero or hold null
    or non-finite components link with nothing, and neither do empty ones; of
    vectors of different lengths the shorter ones' missing components count as
    zero. A row with a null id takes part; it is never kept, and its component_id
    is the smallest known one or null. Repeated rows are vectors of their own; an
    empty table gives none; other columns are left alone, whatever their names.

    Axes and cells come from at most SAMPLE vectors and change the cost only. The
    driver sees that sample and one row for each of at most CELLS cells. A vector is
    sent once for each tile that its own has to meet; what the boxes do not rule
    out grows with the square of the number of distinct vectors.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType
    width = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8
    rows = packed(vectors, id_col, vec_col, floats(width))
    distinct = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    distinct, path_d = stash(distinct.withColumn("uid", F.monotonically_increasing_id()), "cosine-distinct")
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.length("key")).alias("bytes")).first()
    found, paths = None, [path_d]
    if stats.n:
        found, path_f, more = _compared(distinct, stats.n, stats.bytes // width, width, least)
        discard(spark, *more)
        paths.append(path_f)
    told = distinct.select("key", "uid", "n", "first")
    if found is not None and not found.isEmpty():
        labels, path_l = stash(components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))), "cosine-labels")
        links = found.groupBy("uid").agg(F.sum("links").alias("links"))
        told = told.join(links, "uid", "left").join(labels.withColumnRenamed("v", "uid"), "uid", "left")
        told = told.withColumn("label", F.coalesce("label", "uid"))
        least_id = told.groupBy("label").agg(F.min("first").alias("component_id"))
        told, _ = stash(told.join(least_id, "label").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "cosine-told")
        paths.append(path_l)
    else:
        told, _ = stash(told.select("key", F.col("first").alias("component_id"), (F.col("n") - 1).alias("n_links")), "cosine-told")
    discard(spark, *paths)
    linked = rows.join(told, "key").select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    vec = F.col(quoted(vec_col)).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    alone = vectors.where(~taken).select(F.col(quoted(id_col)).alias("id"))
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _compared(distinct: DataFrame, n: int, dim: int, width: int, least: float) -> tuple[DataFrame, str, list[str]]:
    """uid, links, root for each tile pair and linked vector."""
    spark = distinct.sparkSession
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = [r.key for r in distinct.orderBy(F.xxhash64("key"), "uid").limit(most).select("key").collect()]
    turned = unit(matrix(sample, width, dim))
    axes = axes_of(turned)
    tile = max(MINE, min(TILE, TILE_BYTES // (8 * dim), -(-n // 8)))
    depth = min(CELLS, max(1, -(-n // tile))).bit_length() - 1
    lead_n, tree = min(AXES, dim), cut_cells((turned @ axes)[:, :AXES], depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lead = (unit(matrix(part.column(2).to_pylist(), width, dim)) @ axes)[:, :AXES]
                cell = cell_of(lead, tree) if tree else np.zeros(len(lead), int)
                arrays = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(list(lead), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "n", "key", "cell", "lead"])

    placed = distinct.select("uid", "n", "key").mapInArrow(place, "uid long, n long, key binary, cell int, lead array<double>")
    placed, path = stash(placed, "cosine-placed")
    box = [f(F.col("lead")[i]).alias(f"{name}{i}") for i in range(lead_n) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), *box).collect()
    lo, hi = (np.array([[c[f"{s}{i}"] for i in range(lead_n)] for c in cells]) for s in ("lo", "hi"))
    parts = [-(-c.n // tile) for c in cells]
    meet = apart(lo, hi, lo, hi) <= 2 - 2 * least + SLACK
    pairs = [(cells[i].cell, cells[j].cell, parts[i], parts[j]) for i, j in zip(*np.nonzero(meet), strict=True) if i <= j]
    table = spark.createDataFrame(pairs, "a int, b int, pa int, pb int")
    split = spark.createDataFrame([(c.cell, p) for c, p in zip(cells, parts, strict=True)], "cell int, parts int")
    # At most CELLS and CELLS * (CELLS + 1) / 2 rows of a few numbers.
    mine = placed.drop("lead").join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    left = mine.join(F.broadcast(table), F.col("cell") == F.col("a")).withColumn("i", F.col("part"))
    left = left.withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("pb") - 1)))
    right = mine.join(F.broadcast(table), F.col("cell") == F.col("b")).withColumn("j", F.col("part"))
    last = F.when(F.col("a") == F.col("b"), F.col("j") - 1).otherwise(F.col("pa") - 1)
    right = right.where(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    columns = ["a", "i", "b", "j", "uid", "n", "key"]
    sent = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))

    def search(group: pa.Table) -> pa.Table:
        release()
        side = group.column("side").to_numpy()
        uid, weight, keys = group.column("uid").to_numpy(), group.column("n").to_numpy().astype(float), group.column("key").to_pylist()
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = group.column("a")[0] == group.column("b")[0] and group.column("i")[0] == group.column("j")[0]
        out = [np.zeros(0, np.int64)] * 3
        if len(own) and (one or len(other)):
            x = matrix([keys[i] for i in own], width, dim)
            y = None if one else matrix([keys[i] for i in other], width, dim)
            links, root, _ = compare(x, y, weight[own], None if one else weight[other], axes, least)
            uid = uid[own] if one else uid[np.r_[own, other]]
            at = np.flatnonzero(links)
            out = [uid[at], links[at], uid[root[at]]]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["uid", "links", "root"])

    total = sum(pa_ * pb if a != b else pa_ * (pa_ + 1) // 2 for a, b, pa_, pb in pairs)
    key = ["a", "i", "b", "j"]
    dealt = sent.repartition(min(4096, max(1, 2 * total)), *key).groupBy(*key)
    found, path_f = stash(dealt.applyInArrow(search, "uid long, links long, root long"), "cosine-found")
    return found, path_f, [path]
