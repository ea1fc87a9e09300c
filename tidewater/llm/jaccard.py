"""Operator 6: the Jaccard self-join of word-shingle sets, by T-occurrence search.

Equal sets are one vertex. Two sets with Jaccard similarity of t or more share at
least T shingles, and some of these are among each one's first |x| - ceil(t |x|) + 1
in any global order. The order here puts shingles that many documents hold (a fixed
bitmap of them, from a count over all documents) behind the rest, so those first
ones are mostly rare and their inverted lists short.

Short lists travel to the sets that they name, and each set's lists are searched as
DivideSkip does it: most of them are merged through a heap, the longest only probed by
binary search, and a partner stays if it occurs in T lists, T being what the overlap
must have within the first shingles. Long lists hold groups of near copies. A group's
members are first verified against one of them, its pivot; only members that no link
connects with the pivot by then are searched for in the whole group, in blocks, again
with DivideSkip (where a counting merge of the short lists stands in for the heap) and
leaving out what is connected already. Every pair that is left is verified on whole
sets, which are made anew from the texts where they are wanted and sent once to each
star of sets that asks for them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import discard, fresh, mix64, quoted, release, stash, text_chunks
from tidewater.llm.components import components
from tidewater.llm.shingles import set_id, shingle_sets

#: log2 of the bits of the map of frequent shingles (8 MB), and of those of the map of wanted sets at most (32 MB).
HOT_BITS, WANTED_BITS = 26, 28
#: Lists with more entries are long; a shingle in more documents is frequent (in yet more, if too many are).
LONG = 32
#: Parts of a frequent shingle's list.
SALTS = 64
#: Members of a group that are verified against one copy of its pivot, or searched with few unlinked ones; else those of a block and of its other side.
STAR, BLOCK, REST = 256, 4096, 1024


def needed(nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with 100 * overlap >= percent * union."""
    return -(-percent * (nx + ny) // (100 + percent))


def kept(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles come first: n - ceil(percent n / 100) + 1."""
    return n + percent * n // -100 + 1


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked; the smaller is probed in the larger."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release()
    for part in text_chunks(batch):
        text = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        yield part, list(shingle_sets([t or b"" for t in text], size))


class _Seen:
    """Identities of sets met in this task, for leaving out copies early (a saving only, so bounded)."""

    def __init__(self, limit: int = 200_000):
        self.ids, self.limit = set(), limit

    def new(self, i: bytes) -> bool:
        if i in self.ids:
            return False
        if len(self.ids) < self.limit:
            self.ids.add(i)
        return True


def frequent_map(docs: DataFrame, size: int) -> np.ndarray:
    """A bitmap, by the top bits of a shingle, of shingles in more than LONG documents.

    Tasks send sorted 32-bit prefixes of their shingles, packed by range; each
    range is counted in one task and comes back as its piece of the bitmap. Where
    so many are frequent that the map would fill up, only the most frequent are
    marked: LONG is doubled until an eighth of the map is enough.
    """
    parts = max(8, 1 << (docs.rdd.getNumPartitions() - 1).bit_length())
    bits_log, long = HOT_BITS, LONG
    parts = min(parts, 1 << 16, (1 << bits_log) // 8)

    def pack(values: list[np.ndarray]) -> pa.RecordBatch:
        v, n = np.unique(np.concatenate(values), return_counts=True)
        cut = np.searchsorted(v, np.arange(1, parts, dtype=np.uint64) * np.uint64(2**32 // parts))
        cut = [0, *cut.tolist(), len(v)]
        planes, more = [], []
        for a, b in zip(cut, cut[1:], strict=False):
            step = np.diff(v[a:b], prepend=np.uint32(0)).astype("<u4")  # byte planes of steps compress well
            planes.append(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())
            several = np.flatnonzero(n[a:b] > 1)
            more.append(np.c_[several, n[a:b][several]].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(planes), pa.array(more)], ["part", "steps", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, _Seen()
        for batch in batches:
            for _, sets in _sets(batch, size):
                for s in sets:
                    if len(s) and seen.new(set_id(s)):
                        held.append((s >> np.uint64(32)).astype(np.uint32))
                        total += len(s)
                if total > 4_000_000:
                    yield pack(held)
                    held, total = [], 0
        if held:
            yield pack(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = [], []
        for steps, more in zip(rows["steps"], rows["more"], strict=True):
            v = np.cumsum(np.frombuffer(steps, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)
            n = np.ones(len(v), np.uint32)
            m = np.frombuffer(more, "<u4").reshape(-1, 2)
            n[m[:, 0]] = m[:, 1]
            values.append(v)
            counts.append(n)
        v, n = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
        total = np.add.reduceat(n, start) if len(start) else n
        hot, n = v[start][total > long], total[total > long]
        level = np.bincount(np.log2(n // long).astype(int), minlength=1)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "hot": [hot.tobytes()], "n": [np.minimum(n, 2**32 - 1).astype(np.uint32).tobytes()], "levels": [level]})

    packed = docs.select("text").mapInArrow(count, "part int, steps binary, more binary")
    counted = packed.groupBy("part").applyInPandas(merge, "part int, hot binary, n binary, levels array<long>")
    counted, path = stash(counted, "frequent")
    levels = counted.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    above = 0
    while sum(r.n for r in levels if r.level >= above) > 1 << (bits_log - 3):
        above += 1
    width = (1 << bits_log) // parts

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, hot, n in zip(f["part"], f["hot"], f["n"], strict=True):
                often = np.frombuffer(n, np.uint32) > (long << above)
                bits = np.zeros(width, np.uint8)
                bits[(np.frombuffer(hot, np.uint32)[often] >> np.uint32(32 - bits_log)).astype(np.int64) % width] = 1
                yield pd.DataFrame({"part": [part], "bits": [np.packbits(bits).tobytes()]})

    pieces = counted.select("part", "hot", "n").mapInPandas(mark, "part int, bits binary").collect()
    discard(docs.sparkSession, path)
    out = np.zeros((1 << bits_log) // 8, np.uint8)
    for r in pieces:
        out[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def first_shingles(s: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that come first in the global order, and how many of them, at the end, are frequent."""
    at = s >> np.uint64(64 - (int(len(hot) * 8).bit_length() - 1))
    often = (hot[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
    k = int(kept(len(s), percent))
    rare = int(len(s) - often.sum())
    if rare >= k:
        return s[often == 0][:k], 0
    return np.concatenate([s[often == 0], s[often == 1][: k - rare]]), k - rare


def entries(docs: DataFrame, hot: np.ndarray, percent: int, size: int) -> DataFrame:
    """The inverted lists' entries: shingle, salt, sid (the set's identity), weight.

    A frequent shingle's list comes in SALTS parts (salt 1 and up; others have
    salt 0). ``weight`` is the set's size and, above 32 bits, how many of its
    first shingles are frequent.
    """
    shared, salts = docs.sparkSession.sparkContext.broadcast(hot), SALTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = _Seen(), shared.value
        for batch in batches:
            for _, sets in _sets(batch, size):
                token, salt, sid, k, weight = [], [], [], [], []
                for s in sets:
                    if len(s) and seen.new(i := set_id(s)):
                        first, h = first_shingles(s, bits, percent)
                        token.append(first)
                        salt.append(np.r_[np.zeros(len(first) - h, np.int32), np.full(h, 1 + i[0] % salts, np.int32)])
                        sid.append(i)
                        k.append(len(first))
                        weight.append((h << 32) + len(s))
                if token:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(token).view(np.int64)),
                            pa.array(np.concatenate(salt)),
                            pa.array(sid, pa.binary()).take(pa.array(np.repeat(np.arange(len(sid)), k))),
                            pa.array(np.repeat(np.array(weight, np.int64), k)),
                        ],
                        ["shingle", "salt", "sid", "weight"],
                    )

    return docs.select("text").mapInArrow(run, "shingle long, salt int, sid binary, weight long")


def least_occurrences(nx: int, ny: int, percent: int) -> int:
    """How many lists of first shingles two sets of these sizes share at least, if they are similar."""
    return -(-percent * (nx + ny) // (100 + percent)) - (-(-percent * max(nx, ny) // 100) - 1)


def t_occurrence(lists: list[list[bytes]], least: dict[bytes, int]) -> list[bytes]:
    """The members that occur in as many of the sorted lists as ``least`` asks of them.

    The longest lists, fewer than any member needs, are not merged but probed.
    """
    lists = sorted(lists, key=len)
    t = min(least.values())
    skip = min(t - 1, len(lists) - 1, int(t / (0.01 * np.log2(2 + len(lists[-1])) + 1)))
    short, long_ = lists[: len(lists) - skip], lists[len(lists) - skip :]
    out = []
    for y, run in groupby(heapq.merge(*short)):
        n, need = sum(1 for _ in run), least[y]
        for k, probed in enumerate(long_):
            if n + len(long_) - k < need:
                break
            i = bisect_left(probed, y)
            n += i < len(probed) and probed[i] == y
        if n >= need:
            out.append(y)
    return out


def short_list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share enough short lists; ``lists`` has shingle, m (sorted sid and n of its sets)."""
    later = F.expr(
        "transform(sequence(0, size(m) - 2), i -> struct(m[i].sid as x, m[i].n as nx, filter(slice(m, i + 2, size(m)), "
        f"y -> 100L * least(y.n, m[i].n) >= {percent}L * greatest(y.n, m[i].n)) as ys))"
    )
    sent = lists.select(F.explode(later).alias("p")).select("p.x", "p.nx", F.col("p.ys.sid").alias("ys"), F.col("p.ys.n").alias("ny"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, size, held, least = None, 0, [], {}

        def found() -> list[tuple[bytes, bytes]]:
            return [(last, y) for y in t_occurrence(held, least)] if held else []

        for batch in batches:
            out = []
            for x, nx, ys, ny in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != last:
                    out += found()
                    last, size, held, least = x, nx, [], {}
                held.append(ys)
                for y, n in zip(ys, ny, strict=True):
                    if y not in least:
                        least[y] = least_occurrences(size, n, percent)
            yield _links(out)
        yield _links(found())

    ordered = sent.where(F.size("ys") > 0).repartition("x").sortWithinPartitions("x")
    return ordered.mapInArrow(run, "a binary, b binary")


def _links(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["a", "b"])


def divide_skip(sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the members of a group: a spanning set of them, not all.

    With two sides (0 and 1), only pairs between them are looked at. ``known``
    numbers what is connected already.
    """
    sizes = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, ends = member[order], np.cumsum(np.bincount(code, minlength=len(values)))
    starts = ends - np.diff(np.r_[0, ends])
    length = ends - starts
    at, parent = np.cumsum(np.r_[0, sizes]), np.arange(len(sets))
    two, links = bool(side.any()), []
    if known is not None:
        _, first, place = np.unique(known, return_index=True, return_inverse=True)
        parent = first[place]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    label = parent.copy()  # a root for each member, renewed after links
    for x in np.argsort(-sizes, kind="stable"):
        codes = code[at[x] : at[x + 1]]
        codes = codes[length[codes] > 1]
        t = -(-percent * int(sizes[x]) // 100)  # any partner shares as many
        if len(codes) < t:
            continue
        codes = codes[np.argsort(length[codes], kind="stable")]
        skip = min(t - 1, int(t / (0.01 * np.log2(2 + length[codes[-1]]) + 1)))  # long lists to be probed
        short, long_ = codes[: len(codes) - skip], codes[len(codes) - skip :]
        ids, n = np.unique(np.concatenate([posting[starts[c] : ends[c]] for c in short]), return_counts=True)
        fit = (n >= t - skip) & (label[ids] != label[x]) & (100 * np.minimum(sizes[ids], sizes[x]) >= percent * np.maximum(sizes[ids], sizes[x]))
        if two:
            fit &= side[ids] != side[x]
        ids, n = ids[fit], n[fit].copy()
        least = needed(sizes[ids], sizes[x], percent)
        for k, c in enumerate(long_):
            if not len(ids):
                break
            inside = posting[starts[c] : ends[c]]
            where = np.minimum(np.searchsorted(inside, ids), len(inside) - 1)
            n += inside[where] == ids
            able = n + (len(long_) - k - 1) >= least
            ids, n, least = ids[able], n[able], least[able]
        for y in ids[n >= least].tolist():
            a, b = root(int(x)), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(x), y))
        if len(ids):
            label = np.array([root(i) for i in range(len(sets))]) if links else label
    return links


def _stars(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Who is to be verified against whom, as stars: head, salt, sid, member (false for the head's own row)."""
    members = groups.where(F.col("sid") != F.col("pivot")).select(F.col("pivot").alias("head"), "salt", "sid")
    members = members.union(pairs.select("a", F.lit(-1), "b"))
    heads = members.select("head", "salt").distinct()
    return members.withColumn("member", F.lit(True)).union(heads.select("head", "salt", F.col("head").alias("sid"), F.lit(False)))


def _verify(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links a, b between heads of stars and their members whose whole sets are similar. A star has a bounded number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out = []
                for head, salt, sid, member, items in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True):
                    s = np.frombuffer(items, np.uint64)
                    if not member:
                        now, own = (head, salt), s
                    elif now == (head, salt) and similar(own, s, percent):
                        out.append((head, sid))
                yield _links(out)

    sent = stars.join(sets, "sid").select("head", "salt", "sid", "member", "items")
    return sent.repartition("head", "salt").sortWithinPartitions("head", "salt", "member").mapInArrow(run, "a binary, b binary")


def _with_pivots(groups: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``groups`` (pivot, sid, salt) joined with what ``table`` knows of pivots by ``key``; a copy for each salt, so no pivot is hot."""
    copies = groups.select("pivot", "salt").distinct().join(table.withColumnRenamed(key, "pivot"), "pivot")
    return groups.join(copies, ["pivot", "salt"])


def _with_rest(groups: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` renewed by links between members that nothing connects with their pivot yet and all others of their groups.

    Both sides are cut into blocks, and by size: similar sets are in the same
    band of sizes or in neighbouring ones. ``fetch`` makes the whole sets.
    """
    spark = groups.sparkSession
    named = groups.join(labels.select(F.col("v").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    heads = groups.select(F.col("pivot").alias("sid")).distinct().join(labels.select(F.col("v").alias("sid"), "label"), "sid", "left")
    heads = heads.select("sid", F.coalesce("label", "sid").alias("head"))
    named, path = stash(_with_pivots(named, heads, "sid").withColumn("apart", F.col("label") != F.col("head")), "named")
    sizes = named.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if("apart").alias("rest")).where(F.col("rest") > 0)
    block = F.when(F.col("rest") <= STAR, min(STAR, BLOCK)).otherwise(BLOCK)
    sizes = sizes.select("pivot", F.ceil(F.col("n") / block).cast("int").alias("bn"), F.ceil(F.col("rest") / REST).cast("int").alias("br"))
    sizes, path_s = stash(sizes, "rest")
    if sizes.isEmpty():
        discard(spark, path, path_s)
        return labels
    band = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    mine = _with_pivots(named, sizes, "pivot").withColumn("band", band).withColumn("h", F.xxhash64("sid"))
    place: dict[str, Column] = {"i": F.pmod("h", "br").cast("int"), "j": F.pmod("h", "bn").cast("int")}
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = mine.select("pivot", "sid", "label", "band", place["j"].alias("j"), spread("br").alias("i"), F.lit(1).alias("side"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    rest = mine.where("apart").select("pivot", "sid", "label", near.alias("band"), place["i"].alias("i"), "bn")
    rest = rest.select("pivot", "sid", "label", "band", spread("bn").alias("j"), "i", F.lit(0).alias("side"))
    full = others.unionByName(rest).join(fetch(mine.select("sid"), mine.count()), "sid")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        if side.min() == side.max():
            return pd.DataFrame([], columns=["a", "b"])
        items, sid = [np.frombuffer(b, np.uint64) for b in rows["items"]], rows["sid"].to_numpy()
        links = divide_skip(items, side, percent, pd.factorize(rows["label"])[0])
        return pd.DataFrame([(sid[a], sid[b]) for a, b in links], columns=["a", "b"])

    links, path_l = stash(full.groupBy("pivot", "band", "i", "j").applyInPandas(search, "a binary, b binary"), "rest-links")
    labels = components(labels.select(F.col("v").alias("a"), F.col("label").alias("b")).union(links)) if not links.isEmpty() else labels
    discard(spark, path, path_s, path_l)
    return labels


def near_duplicates(documents: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """Connect documents whose shingle sets overlap by ``percent`` of their union or more.

    Returns doc_id, n_shingles (the set's size) and component_id, the smallest
    doc_id that links reach, itself included. Texts are lower-cased in A-Z and cut
    at ASCII white space; a set holds the distinct ``size``-word shingles, or with
    fewer words the whole sequence. A null or empty text has an empty set and is
    its own component. A null doc_id takes part and reports its component's
    smallest known doc_id, or null. Repeated rows are returned again; an empty
    table gives none; other columns are left alone, whatever their names. Shingles
    are told apart by 64-bit fingerprints, sets by 128-bit ones.

    No pair of a group of copies is listed: equal sets are one vertex, and long
    lists yield spanning links. The driver holds two bitmaps of bounded size.
    """
    spark = documents.sparkSession
    named, _ = set_classes(documents.select("doc_id", "text"), percent, size)
    # Written apart, so that the join reads plain exchanges, whose hot partitions Spark splits.
    first, _ = stash(named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("first")), "first")
    return named.join(first, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id")
    )


def one_of_each(documents: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """The rows of ``documents`` but one only of each component, as :func:`near_duplicates` links them.

    The row with the smallest known doc_id stays, or one without if all are null;
    of rows with an equal doc_id one stays. Rows are told apart as rows, not by
    doc_id: it may be null, repeated, or stand on unrelated texts. Rows without
    words belong to no component and all stay. Columns pass as they are.
    """
    spark, row = documents.sparkSession, fresh(documents, "row")
    rows = _numbered(documents, row)
    named, path = set_classes(rows.select("doc_id", row, "text"), percent, size)
    named = named.where(F.col("class").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", row)
    first = named.groupBy("class").agg(F.min(order).alias("first")).select(F.col("first").getField(row).alias(row))
    extra, _ = stash(named.select(row).join(first, row, "left_anti"), "extra")
    discard(spark, path)
    return rows.join(extra, row, "left_anti").select(*[F.col(quoted(c)) for c in documents.columns])


def _numbered(documents: DataFrame, row: str) -> DataFrame:
    """``documents`` with a lasting identity of each row: its file and place in it where they come from Parquet files as they are, else a written number."""
    try:
        where = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return documents.withColumn(row, where)
    except AnalysisException:  # not from such files
        return stash(documents.withColumn(row, F.monotonically_increasing_id()), "rows")[0]


def set_classes(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, str]:
    """The columns of ``docs`` but text, n_shingles, and class (equal for the rows of one component, null without words), and the table's path."""
    spark, own = docs.sparkSession, [c for c in docs.columns if c != "text"]
    hot = frequent_map(docs, size)

    # A frequent shingle's list is spread over SALTS tasks, so none holds it whole.
    lists = entries(docs, hot, percent, size).repartition("shingle", "salt").dropDuplicates(["shingle", "salt", "sid"])
    part = Window.partitionBy("shingle", "salt")
    top = F.max(F.struct("weight", "sid"))
    lists = lists.withColumn("entries", F.count("*").over(part)).where((F.col("entries") > 1) | (F.col("salt") > 0))
    pivot = F.when((F.col("salt") == 0) & (F.col("entries") > LONG), top.over(part).getField("sid"))
    lists, path_l = stash(lists.withColumn("pivot", pivot), "lists")
    plain = lists.where(F.col("salt") == 0).drop("salt")
    salted = lists.where(F.col("salt") > 0).select("shingle", "salt", "sid", "weight")
    parts = salted.groupBy("shingle", "salt").agg(F.count("*").alias("n"), top.alias("t"))
    whole = parts.groupBy("shingle").agg(F.sum("n").alias("entries"), F.max("t").alias("top")).where(F.col("entries") > 1)
    copies = parts.select("shingle", "salt").join(whole, "shingle")
    salted = salted.join(copies, ["shingle", "salt"])
    salted = salted.select("shingle", "sid", "weight", "entries", F.when(F.col("entries") > LONG, F.col("top.sid")).alias("pivot"))
    lists, path_a = stash(plain.select(*salted.columns).union(salted), "all-lists")
    discard(spark, path_l)

    # Short lists: at most LONG entries each, so what is sent is bounded by the entries.
    size_of = F.col("weight").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    member = F.struct("sid", size_of.alias("n"))
    short = lists.where(F.col("pivot").isNull()).groupBy("shingle").agg(F.sort_array(F.collect_list(member)).alias("m"))
    pairs, path_p = stash(short_list_pairs(short, percent), "pairs")
    groups = lists.where(F.col("pivot").isNotNull()).groupBy("pivot", "sid").agg(F.max(size_of).alias("n"), F.max("entries").alias("entries"))
    salt = F.pmod(F.xxhash64("sid"), F.ceil(F.col("entries") / STAR)).cast("int")
    groups, path_g = stash(groups.select("pivot", "sid", "n", salt.alias("salt")), "groups")
    discard(spark, path_a)

    # Whole sets are made only where wanted; a bitmap sized by their number says which may be.
    def fetch(sids: DataFrame, count: int) -> DataFrame:
        return _items(docs, _bitmap(sids, count), size).groupBy("sid").agg(F.first("items").alias("items"))

    stars, path_s = stash(_stars(pairs, groups), "stars")
    discard(spark, path_p)
    links, path_k = stash(_verify(stars, fetch(stars.select("sid"), stars.count()), percent), "links")
    labels = _with_rest(groups, fetch, components(links), percent)
    discard(spark, path_g, path_s, path_k)

    table, path_t = stash(_described(docs, size), "described")
    named = table.join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("class", F.coalesce("label", "sid"))
    named, path = stash(named.select(*own, "n_shingles", "class"), "classes")
    discard(spark, path_t)
    return named, path


def _bit(sid: np.ndarray, bits: int) -> np.ndarray:
    """Places in a map of 2 ** ``bits`` bits, from the first halves of identities."""
    return (mix64(sid) >> np.uint64(64 - bits)).astype(np.int64)


def _halves(sids: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join((i or bytes(16))[:8] for i in sids), np.uint64)


def _bitmap(sids: DataFrame, count: int) -> np.ndarray:
    """A map of hashed identities, with 16 bits for each (and at most 2 ** WANTED_BITS): no wanted one is missing, some others may be in it."""
    width = min(WANTED_BITS, max(16, int(16 * count).bit_length()))
    size = (1 << width) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = _bit(_halves(batch.column(0).to_pylist()), width)
            np.bitwise_or.at(bits, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        for k in range(256):
            piece = bits[k * size // 256 : (k + 1) * size // 256]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()])], ["k", "bits"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"k": rows["k"].iloc[:1], "bits": [out.tobytes()]})

    pieces = sids.mapInArrow(run, "k int, bits binary").groupBy("k").applyInPandas(merge, "k int, bits binary").collect()
    out = np.zeros(size, np.uint8)
    for r in pieces:
        out[r.k * size // 256 : (r.k + 1) * size // 256] = np.frombuffer(r.bits, np.uint8)
    return out


def _items(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """sid and items of the sets that may be wanted, most of them once for each task."""
    shared, width = docs.sparkSession.sparkContext.broadcast(wanted), int(len(wanted) * 8).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, _Seen()
        for batch in batches:
            for _, sets in _sets(batch, size):
                sets = [s for s in sets if len(s)]
                sid = [set_id(s) for s in sets]
                at = _bit(_halves(sid), width)
                hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                kept = [k for k, h in enumerate(hit) if h and seen.new(sid[k])]
                yield pa.RecordBatch.from_arrays([pa.array([sid[k] for k in kept], pa.binary()), pa.array([sets[k].tobytes() for k in kept], pa.binary())], ["sid", "items"])

    return docs.select("text").mapInArrow(run, "sid binary, items binary")


def _described(docs: DataFrame, size: int) -> DataFrame:
    """The columns but text, n_shingles and sid (null without words)."""
    own = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                columns = [part.column(part.schema.get_field_index(c)) for c in own]
                sid = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in sets], pa.int64()), sid], [*own, "n_shingles", "sid"])

    schema = T.StructType(docs.select(*own).schema.fields)
    return docs.mapInArrow(run, schema.add("n_shingles", "long").add("sid", "binary"))
