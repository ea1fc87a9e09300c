"""Operator 4: benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits of any script, lower-cased; a letter of a script
that is written without spaces is a word. An overlap is an aligned window of W words
(W = 16, or the document's or item's length if shorter) with at most W // 8
substituted words, or 8 words in a row that are the same. The window is cut into four
blocks; two substitutions leave at least two blocks whole, so hashing every pair of
blocks, that is three fixed masks that ignore the positions between, misses no
overlap. Hashes of all benchmark windows and of all document windows are joined, and
each hit is verified along its diagonal. Items under 8 words match as a whole, word
for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import appended, fresh, quoted, stash, texts_of
from tidewater.llm.wordhash import runs, stretches

#: Words of a window; words of the shortest item that tolerates a substitution, and of a verbatim run that counts.
WINDOW, BRIEF = 16, 8
#: Benchmark words that go to the tasks at once; larger benchmarks go in several such parts.
PART_WORDS = 1_000_000
#: Scripts written without spaces (fixed values: code point ranges).
UNSPACED = [
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
]


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """For each code point: 0 between words, 1 in a word, 2 a word of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[:0x20000] = [c.isalnum() or category(c)[0] == "M" for c in map(chr, range(0x20000))]
    for a, b in UNSPACED:
        kinds[a : b + 1] = 2 * (kinds[a : b + 1] > 0) if b < 0x20000 else 2
    return kinds


def fold_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of texts, and where each text's start (one more entry ends the last)."""
    folded = [t.lower() if t.isascii() else normalize("NFKC", t).lower() for t in texts]
    codes = np.frombuffer(("\n".join(folded) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = letter_kinds()[codes]
    before = np.r_[np.uint8(0), kind[:-1]]
    cut = (kind != before) | (kind == 2)  # something begins or ends in front of this place
    start = np.flatnonzero(cut & (kind > 0))
    end = np.flatnonzero(cut & (before > 0))
    limits = np.cumsum([0, *(len(t) + 1 for t in folded)])
    return stretches(codes, start, end), np.searchsorted(start, limits)


def substitutions(window: int) -> int:
    """Substituted words that a window tolerates: 2 of 16, 1 of 8 to 15."""
    return window // 8


def masks(block: int) -> list[list[int]]:
    """The positions that each mask keeps, for blocks of ``block`` words."""
    return [[*range(block), *range(gap, gap + block)] for gap in (block, 2 * block, 3 * block)]


class Seeds:
    """The hashes of items under one mask, sorted, with a quick map by their top bits."""

    def __init__(self, kept: list[int], items: list[tuple[int, np.ndarray]]):
        self.kept = kept
        h = [runs(w, kept) for _, w in items]
        item = np.repeat(np.array([k for k, _ in items], np.int32), [len(x) for x in h])
        offset = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.offset = flat[order], item[order], offset[order]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(flat >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, word within it, item, word within that) wherever the mask's words agree."""
        h = runs(words, self.kept)
        place = np.flatnonzero(self.quick[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.hashes, h[place], side=s) for s in ("left", "right"))
        text = np.searchsorted(at, place, side="right") - 1
        good = (hi > lo) & (place + self.kept[-1] < at[text + 1])
        for p, t, a, b in zip(place[good].tolist(), text[good].tolist(), lo[good].tolist(), hi[good].tolist(), strict=True):
            start = int(at[t])
            for item, offset in zip(self.item[a:b].tolist(), self.offset[a:b].tolist(), strict=True):
                yield t, p - start, item, offset


class Benchmark:
    """Items as word fingerprints, and their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        words, at = fold_words([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, int))
        self.items = [(items[k][0], words[a:b]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        numbered = [(k, w) for k, (_, w) in enumerate(self.items)]
        long = [(k, w) for k, w in numbered if len(w) >= BRIEF]
        blocks: dict[int, list] = {}
        for k, w in long:
            blocks.setdefault(min(WINDOW, len(w)) // 4, []).append((k, w))
        self.seeds = [Seeds(m, mine) for block, mine in sorted(blocks.items()) for m in masks(block)]
        #: For documents shorter than a window: windows as short as they.
        self.brief = [Seeds(m, long) for m in masks(BRIEF // 4)] if long else []
        lengths = sorted({len(w) for _, w in numbered if len(w) < BRIEF})
        self.whole = [Seeds(list(range(n)), [(k, w) for k, w in numbered if len(w) == n]) for n in lengths]

    def overlaps(self, words: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text, (item id, first word, words) of verified overlaps, one for each item."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(at) - 1)]
        for seeds in self.whole:
            for t, p, item, _ in seeds.hits(words, at):
                found[t].setdefault(item, (p, len(seeds.kept)))
        sizes = np.diff(at)
        short = np.flatnonzero((sizes >= BRIEF) & (sizes < WINDOW))
        few = np.concatenate([words[at[t] : at[t + 1]] for t in short]) if len(short) else words[:0]
        for tables, mine, place, number in (
            (self.seeds, words, at, np.arange(len(sizes))),
            (self.brief, few, np.r_[0, np.cumsum(sizes[short])], short),
        ):
            tried: set[tuple[int, int, int]] = set()
            for seeds in tables if len(mine) else ():
                for t, p, item, offset in seeds.hits(mine, place):
                    key = (t, item, p - offset)
                    if key not in tried and item not in found[number[t]]:
                        tried.add(key)
                        if span := verify(mine[place[t] : place[t + 1]], self.items[item][1], key[2]):
                            found[number[t]][item] = span
        return [sorted((self.items[k][0], *span) for k, span in f.items()) for f in found]


def verify(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int] | None:
    """The stretch of ``doc`` that overlaps ``item`` laid at ``shift``: (first word, words), or None.

    It joins all windows on this diagonal that tolerate their substitutions, and all verbatim runs.
    """
    a, b = max(0, shift), min(len(doc), shift + len(item))
    same = doc[a:b] == item[a - shift : b - shift]
    total, spans = np.r_[0, np.cumsum(same)], []
    window = min(WINDOW, len(item), len(doc))
    for size, least in ((window, window - substitutions(window)), (BRIEF, BRIEF)):
        if b - a >= size >= BRIEF:
            good = np.flatnonzero(total[size:] - total[:-size] >= least)
            spans += [(int(good[0]), int(good[-1]) + size)] if len(good) else []
    if not spans:
        return None
    first, last = min(s for s, _ in spans), max(e for _, e in spans)
    return a + first, last - first


def contamination(documents: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Find benchmark overlaps in every whole text: doc_id, text_hash, contaminated, items.

    ``text_hash`` is xxhash64 of the text; ``items`` lists (item_id, first word,
    words) in order, one for each item. Items of 8 and more words overlap as the
    module says; a shorter one must occur whole and unchanged; one without words,
    or with a null text or id, takes no part. Documents under 8 words can only
    hold such short items. A null text counts as empty and is clean; a null doc_id
    stays null; repeated rows are judged alike; an empty table on either side
    gives a defined result (no rows, or all clean); other columns are left alone,
    whatever their names.

    The benchmark goes to the tasks in parts of about ``part_words`` words (a
    longer single item is a part of its own), counted as above: one such part is
    the usual case. A larger benchmark takes as many passes, one after the other:
    each writes the documents that it finds and gives its part back, so neither the
    driver nor a task ever holds more than one.
    """
    narrow = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    parts = _parts(benchmark, part_words)
    if len(parts) == 1:
        out = _scan(narrow, _items(parts[0]))[0]
    else:
        rows = []
        for part in parts:
            hit, shared = _scan(narrow, _items(part))
            rows.append(stash(hit.where(F.size("items") > 0).select("doc_id", "text_hash", "items").distinct(), "overlaps")[0])
            shared.destroy()
        found = rows[0]
        for more in rows[1:]:
            found = found.union(more)
        found = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
        found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "items")
        out = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        out = out.withColumn("items", F.coalesce("items", F.array().cast(found.schema["items"].dataType)))
    return out.select("doc_id", "text_hash", (F.size("items") > 0).alias("contaminated"), "items")


def uncontaminated(documents: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``documents`` whose texts overlap no benchmark item, with their columns; see :func:`contamination`."""
    names, column = documents.columns, fresh(documents, "overlaps")
    parts = _parts(benchmark, part_words)
    for part in parts:
        scanned, shared = _scan(documents, _items(part), column)
        documents = scanned.where(F.size(column) == 0).select(*[F.col(quoted(c)) for c in names])
        if len(parts) > 1:
            documents, _ = stash(documents, "uncontaminated")
            shared.destroy()
    return documents


def _parts(benchmark: DataFrame, part_words: int) -> list[DataFrame]:
    """The benchmark's items in parts of about ``part_words`` words, by hash."""
    bench = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(fold_words([t])[0]) for t in texts_of(batch)], pa.int64())], ["n"])

    words = bench.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words // part_words))
    return [bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _items(part: DataFrame) -> list[tuple[int, str]]:
    return [(r.item_id, r.text) for r in part.collect()]


def _scan(documents: DataFrame, items: list[tuple[int, str]], column: str = "items"):
    """``documents`` with the overlaps with one part of the benchmark, and what was broadcast for it."""
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "words")])
    shared = documents.sparkSession.sparkContext.broadcast(Benchmark(items))

    def find(part: pa.RecordBatch) -> list:
        bench = shared.value
        if not bench.items:
            return [[[]] * part.num_rows]
        found = bench.overlaps(*fold_words(texts_of(part)))
        return [[[{"item_id": i, "start": s, "words": n} for i, s, n in f] for f in found]]

    return appended(documents, [(column, arrow, T.ArrayType(span))], find), shared
