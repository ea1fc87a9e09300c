"""Operator 11: phrase collocations from position bitmaps of words.

Texts are handled in shards of a bounded size. A shard numbers its words' positions,
with an empty one behind each piece, and keeps for every frequent word the bitmap of
its positions, compressed by density: bits for a dense word, sorted positions for
another; ``owner`` says at once which word's bitmap has the bit of a position. A phrase
grows by shifting its bitmap of last positions by one, taking AND with the words'
bitmaps, and counting bits; phrases are extended depth first, and no piece's end is
crossed, since nobody has the bit there. Counts are summed over shards.

A phrase can only be frequent if its parts are. So three rounds over the texts follow
that of single words: pairs, triples, longer phrases, each with the maps of what the
round before found (bounded bitmaps of fingerprints, which may let too much pass but
never too little). Pairs and triples are first counted by short fingerprints, packed;
only those that can reach the least count are counted exactly, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, mix64, release, stash, text_chunks
from tidewater.llm.sketches import Packer, bitmap, frequent, in_map, map_width
from tidewater.llm.wordhash import stretches

#: Words of a phrase at most; bytes of text hashed at once, words of a shard, positions extended at once, fingerprints and counted phrases held before they are sent.
MOST, CHUNK, SHARD, BATCH, HELD, ROWS = 5, 1 << 19, 1 << 19, 1 << 18, 1_000_000, 250_000
#: A word at more than one of so many positions has its bitmap as bits.
DENSE = 32
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that end a piece, and all bytes between words.
MARK = np.zeros(256, bool)
MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = MARK.copy()
BETWEEN[[0x20, 0x09]] = True
LANE = np.uint64(0xD6E8FEB86659FD93)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list[str]]]:
    """Texts and their languages (as places in a list) of about CHUNK bytes; a longer text is cut behind marks, where it has some."""
    texts, langs, held = [], [], 0
    release()
    for batch in batches:
        for rows in text_chunks(batch, CHUNK):
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in _cut(text or b""):
                    texts.append(part)
                    langs.append(lang)
                    held += len(part) + 1
                    if held > CHUNK:
                        yield texts, *_coded(langs)
                        texts, langs, held = [], [], 0
    if texts:
        yield texts, *_coded(langs)


def _coded(langs: list[str]) -> tuple[np.ndarray, list[str]]:
    code = pc.dictionary_encode(pa.array(langs, pa.string()))
    return code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        ends = np.flatnonzero(MARK[np.frombuffer(text, np.uint8, CHUNK, at)])
        if not len(ends):  # no mark in all of this: go on to the next one
            more = np.flatnonzero(MARK[np.frombuffer(text, np.uint8, offset=at)])
            if not len(more):
                break
            ends = more[:1]
        yield text[at : at + int(ends[-1]) + 1]
        at += int(ends[-1]) + 1
    yield text[at:]


def words_of(texts: list[bytes], code: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, where words start and end, their fingerprints (by language), the piece of each, and the place of its language."""
    buf = FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    out = BETWEEN[buf]
    before = np.r_[True, out[:-1]]
    start, end = np.flatnonzero(before & ~out), np.flatnonzero(~before & out)
    piece = np.cumsum(MARK[buf], dtype=np.int32)[start]
    limits = np.cumsum([len(t) + 1 for t in texts])
    lang = code[np.searchsorted(limits, start, side="right")]
    own = stretches(np.frombuffer("".join(n + "\n" for n in names).encode(), np.uint8), *_spans(names))
    return buf, start, end, mix64(stretches(buf, start, end) + own[lang] * LANE), piece, lang


def _spans(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = [len(n.encode()) for n in names]
    end = np.cumsum([s + 1 for s in size]) - 1
    return end - size, end


def shards(batches: Iterator[pa.RecordBatch], maps: list[np.ndarray]) -> Iterator[Shard]:
    """Shards of about SHARD words."""
    h, pieces, held, base = [], [], 0, 0
    for texts, code, names in chunks(batches):
        _, _, _, words, piece, _ = words_of(texts, code, names)
        h.append(words)
        pieces.append(piece.astype(np.int64) + base)
        held, base = held + len(words), base + (int(piece[-1]) if len(piece) else 0) + 1
        if held > SHARD:
            yield Shard(np.concatenate(h), np.concatenate(pieces), maps)
            h, pieces, held = [], [], 0
    if held:
        yield Shard(np.concatenate(h), np.concatenate(pieces), maps)


class Shard:
    """The position bitmaps of a shard's words that may be frequent, and which phrases that end at a position may be."""

    def __init__(self, h: np.ndarray, piece: np.ndarray, maps: list[np.ndarray]):
        pos = np.arange(len(h)) + np.cumsum(np.r_[0, piece[1:] != piece[:-1]]) if len(h) else np.zeros(0, int)
        self.size = int(pos[-1]) + 2 if len(h) else 1
        keep = in_map(maps[0], h)
        h, pos = h[keep], pos[keep]
        self.words, code = np.unique(h, return_inverse=True)
        self.owner = np.full(self.size, -1, np.int32)
        self.owner[pos] = code
        order = np.argsort(code, kind="stable")
        self.positions, counts = pos[order], np.bincount(code, minlength=len(self.words))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.dense = np.flatnonzero(counts > self.size // DENSE)
        self.bits = {int(c): self._bits(self.positions[self.starts[c] : self.ends[c]]) for c in self.dense}
        light = np.ones(len(self.words), bool)
        light[self.dense] = False
        self.light = self.positions[light[code[order]]]
        # The fingerprint of the phrase of d words that ends at a position, and whether it may be frequent.
        last, ok = np.zeros(self.size, np.uint64), self.owner >= 0
        last[pos] = h
        self.prints, self.may = [last], [ok]
        for d, m in enumerate(maps[1:], 2):
            self.deeper(d)
            self.may[-1] &= in_map(m, self.prints[-1])

    def _bits(self, positions: np.ndarray) -> np.ndarray:
        flags = np.zeros(-(-self.size // 64) * 64, bool)
        flags[positions] = True
        return np.packbits(flags, bitorder="little").view("<u8")

    def deeper(self, d: int) -> None:
        """Fingerprints of ``d`` words, where the phrase without its last word and that without its first may both be frequent."""
        prints, may = np.zeros(self.size, np.uint64), np.zeros(self.size, bool)
        may[1:] = self.may[-1][:-1] & self.may[-1][1:]
        prints[1:] = mix64(self.prints[-1][:-1] * LANE + self.prints[0][1:])
        self.prints.append(prints)
        self.may.append(may)

    def phrases(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases of 2 to ``most`` words whose parts may be frequent, as their words, counts and a last position; each once."""
        yield from self._deeper(*self._from_dense(), most)
        light = np.setdiff1d(np.arange(len(self.words)), self.dense)
        ends = np.cumsum((self.ends - self.starts)[light])
        edge = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BATCH, len(self.light), BATCH)), len(light)])
        for a, b in zip(edge, edge[1:], strict=False):
            size = np.diff(ends[a:b], prepend=ends[a - 1] if a else 0)
            at = slice(int(ends[a - 1]) if a else 0, int(ends[b - 1]))
            yield from self._deeper(self.light[at], np.repeat(np.arange(b - a), size), light[a:b, None], most)

    def _from_dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that begin with a dense word: bitmaps shifted as bits."""
        last, node, words = [], [], []
        for c, bits in self.bits.items():
            moved = bits << np.uint64(1)
            moved[1:] |= bits[:-1] >> np.uint64(63)
            for d, other in self.bits.items():
                both = moved & other
                n = int(np.bitwise_count(both).sum())
                if n:
                    last.append(np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little")))
                    node.append(np.full(n, len(words)))
                    words.append((c, d))
            hit = self.light[(moved[self.light >> 6] >> (self.light & 63).astype(np.uint64)) & np.uint64(1) == 1]
            if len(hit):  # the sparse words' positions are in order of the words
                code = self.owner[hit]
                first = np.r_[True, code[1:] != code[:-1]]
                last.append(hit)
                node.append(len(words) + np.cumsum(first) - 1)
                words += [(c, int(d)) for d in code[first]]
        if not words:
            return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 2), int)
        return np.concatenate(last), np.concatenate(node), np.array(words)

    def _deeper(self, last: np.ndarray, node: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Grow phrases that a batch of bitmaps (their last positions, by node) stands for."""
        depth = words.shape[1]
        if depth > 1 and len(words):
            at = np.searchsorted(node, np.arange(len(words)))
            yield words, np.bincount(node, minlength=len(words)), last[at]
        if depth == most or not len(words):
            return
        k = min(depth, len(self.may)) - 1  # the longest known parts: what ends here, and what ends at the next position
        go = self.may[k][last] & self.may[k][last + 1] & (self.owner[last + 1] >= 0)
        last, node = last[go] + 1, node[go]
        key = node * np.int64(len(self.words)) + self.owner[last]
        order = np.argsort(key, kind="stable")
        key, last = key[order], last[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        new = key[first]
        grown = np.c_[words[new // max(1, len(self.words))], new % max(1, len(self.words))]
        yield from self._deeper(last, np.cumsum(first) - 1, grown, most)


def _counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, h, n: all words of all texts."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray, list[bytes], list[str]]]) -> pa.RecordBatch:
        every = np.concatenate([h for h, _, _, _ in parts])
        h, first, place = np.unique(every, return_index=True, return_inverse=True)
        n = np.bincount(place, np.concatenate([n for _, n, _, _ in parts])).astype(np.int64)
        words, langs = ([x for p in parts for x in p[k]] for k in (2, 3))
        at = pa.array(first)
        arrays = [pa.array(langs, pa.string()).take(at), pa.array(words, pa.binary()).cast(pa.string()).take(at), pa.array(h.view(np.int64)), pa.array(n)]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "word", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts, code, names in chunks(batches):
            buf, start, end, h, _, lang = words_of(texts, code, names)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            data = buf.tobytes()
            words = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            held.append((h, n, words, [names[k] for k in lang[first].tolist()]))
            size += len(h)
            if size > SHARD // 4:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    found = docs.mapInArrow(run, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Counted:
    """Exact counts of phrases by their words (zeros behind them), held until there are ROWS of them."""

    def __init__(self, parts: int):
        self.parts, self.words, self.counts, self.held = parts, [], [], 0

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        full = np.zeros((len(words), MOST), np.uint64)
        full[:, : words.shape[1]] = words
        self.words.append(full)
        self.counts.append(counts.astype(np.int64))
        self.held += len(words)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        words, counts = np.concatenate(self.words), np.concatenate(self.counts)
        order = np.lexsort(words.T[::-1])
        words, counts = words[order], counts[order]
        start = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(1)]) if len(words) else np.zeros(0, int)
        words, counts = words[start], np.add.reduceat(counts, start) if len(start) else counts
        self.words, self.counts, self.held = [words], [counts], len(words)
        return words, counts

    def packs(self) -> tuple[list[int], list[bytes], list[bytes]]:
        words, counts = self.merged()
        part = (mix64(words @ np.array([3, 5, 7, 11, 13], np.uint64)) % np.uint64(self.parts)).astype(int)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(self.parts + 1))
        at = [k for k in range(self.parts) if cut[k] < cut[k + 1]]
        rows = [order[cut[k] : cut[k + 1]] for k in at]
        self.words, self.counts, self.held = [], [], 0
        return at, [words[r].astype("<u8").tobytes() for r in rows], [counts[r].astype("<i8").tobytes() for r in rows]


def _round(docs: DataFrame, maps: list[np.ndarray], exact: range, sketch: int, parts: int, bits: int) -> DataFrame:
    """Packed counts by part: of the phrases of ``sketch`` words by fingerprint (steps, more), of those of the lengths ``exact`` by words (words, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    most = max([*exact, sketch])

    def sent(packs: tuple[list, list, list], first: int) -> pa.RecordBatch:
        columns = [pa.nulls(len(packs[0]), pa.binary())] * 4
        columns[first : first + 2] = [pa.array(p, pa.binary()) for p in packs[1:]]
        return pa.RecordBatch.from_arrays([pa.array(packs[0], pa.int32()), *columns], ["part", "steps", "more", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, packer, counted = shared.value, Packer(parts, bits), Counted(parts)
        for shard in shards(batches, maps):
            if sketch:
                shard.deeper(sketch)
                shard.may.pop()  # not known yet
            for words, n, last in shard.phrases(most):
                depth = words.shape[1]
                if depth == sketch:
                    packer.add(shard.prints[depth - 1][last], n)
                if depth in exact:
                    go = shard.may[depth - 1][last] if depth <= len(shard.may) else np.ones(len(last), bool)
                    counted.add(shard.words[words[go]], n[go])
            if packer.held > HELD:
                yield sent(packer.packs(), 0)
            if counted.held > ROWS and len(counted.merged()[0]) > ROWS // 2:
                yield sent(counted.packs(), 2)
        if packer.held:
            yield sent(packer.packs(), 0)
        if counted.held:
            yield sent(counted.packs(), 2)

    return docs.mapInArrow(run, "part int, steps binary, more binary, words binary, n binary")


def _summed(packs: DataFrame, least: int) -> DataFrame:
    """w and a: the phrases of which packs (part, words, n) count ``least`` or more."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        counted = Counted(1)
        for words, n in zip(rows["words"], rows["n"], strict=True):
            counted.add(np.frombuffer(words, "<u8").reshape(-1, MOST), np.frombuffer(n, "<i8"))
        words, n = counted.merged()
        often = n >= least
        return pd.DataFrame({"w": pd.Series([[x for x in r if x] for r in words[often].view(np.int64).tolist()], dtype=object), "a": n[often]})

    return packs.select("part", "words", "n").groupBy("part").applyInPandas(merge, "w array<long>, a long")


def _frequent_phrases(docs: DataFrame, words: DataFrame, total: int, least: int) -> tuple[DataFrame, list[str]]:
    """w (the words' fingerprints) and a, for phrases of two words and more that occur ``least`` times or more."""
    spark = docs.sparkSession
    width, bits = map_width(total, least), min(56, max(32, total.bit_length() + 5))
    parts = min(1 << 12, max(8, 1 << (docs.rdd.getNumPartitions() - 1).bit_length()))
    maps, tables, paths = [bitmap(words.select("h"), width)], [], []
    for exact, sketch in ((range(0), 2), (range(2, 3), 3), (range(3, MOST + 1), 0)):
        found, path = stash(_round(docs, maps, exact, sketch, parts, bits), "phrases")
        if sketch:
            hot, path_h = stash(frequent(found.where(F.col("steps").isNotNull()), bits, parts, least), "frequent")
            maps.append(bitmap(hot, width))
            discard(spark, path_h)
        if exact:
            table, path_t = stash(_summed(found.where(F.col("words").isNotNull()), least), "frequent-phrases")
            tables.append(table)
            paths.append(path_t)
        discard(spark, path)
    return tables[0].union(tables[1]), paths


def collocations(documents: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by how much more often they occur than their parts would suggest.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs. All counts are by language (null:
    ``und``): n of all words, f of all a phrase's occurrences within pieces,
    overlapping ones too. A phrase of 2 to 5 words with a = f >= ``least``, cut
    behind its first k words, scores floor(1000 a n / (f(first) f(rest))); its
    lowest score counts, of equal ones that of the smallest k. A phrase is dropped
    if a longer one of at most 5 words holds it and occurs as often, whether that
    one is dropped or not. Returns lang, rank (from 1), phrase, a, l, r, n, score,
    by falling score, then falling a, then the phrase's bytes.

    A null or empty text has no words; repeated rows count each time; an empty
    table gives none; other columns are left alone, whatever their names. Words
    are told apart by 64-bit fingerprints inside a phrase. Counts below 10^15 give
    exact scores. A language with few phrases returns fewer than ``top``.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    vocabulary, path_v = stash(_counted_words(docs), "vocabulary")
    sizes, path_n = stash(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "lang-sizes")
    words, path_w = stash(vocabulary.where(F.col("n") >= least).select("lang", "word", "h", F.col("n").alias("f")), "frequent-words")
    discard(spark, path_v)
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    found, paths = _frequent_phrases(docs, words, total, least)
    out, _ = stash(_ranked(found, words, sizes, top), "collocations")
    discard(spark, path_n, path_w, *paths)
    return out


def _ranked(found: DataFrame, words: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    size = F.size("w")
    counts = found.union(words.select(F.array("h"), "f"))
    # A longer phrase holds a shorter one as often only if the one with one word more, between them, occurs as often.
    longer = found.where(size > 2).select(F.explode(F.array(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size - 1))).alias("w"), "a")
    kept = found.join(longer.distinct(), ["w", "a"], "left_anti")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("u"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("v"))
    cuts = cuts.join(counts.select(F.col("w").alias("u"), F.col("a").alias("l")), "u")
    cuts = cuts.join(counts.select(F.col("w").alias("v"), F.col("a").alias("r")), "v")

    spelled = kept.select("w", F.posexplode("w").alias("i", "h")).join(words.select("h", "lang", "word"), "h")
    spelled = spelled.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("s"), F.first("lang").alias("lang"))
    spelled = spelled.select("w", "lang", F.concat_ws(" ", F.col("s.word")).alias("phrase")).join(sizes, "lang")

    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.join(spelled, "w").select("w", "lang", "phrase", "a", "k", "l", "r", "n", (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).alias("above"), (exact("l") * exact("r")).alias("below"))
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("w", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
