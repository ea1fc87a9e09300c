"""Operator 9: SentencePiece encoding and decoding by a weighted transducer.

Three machines are compiled from a model file: the normaliser (space marks and
dummy prefix), the pieces (a trie whose leaves write ids) and byte fallback (an
arc for each unknown character that writes its bytes). Each input is composed
with them, and the shortest path in the tropical semiring (min, +) is the
encoding. For a unigram model an arc weighs minus its piece's score. For a BPE
model an arc weighs 0 if its piece may follow the one before it, that is if
merging both pieces' characters by rank gives just these two, and infinity (the
semiring's zero) if not; exactly one finite path is left, and it is BPE's result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import per_worker, text_chunks, texts_of
from tidewater.llm.pieces import SPACE, Vocabulary, WordCache

#: Ids are kept as unsigned 32-bit integers.
WIDTH = "I"
#: Words kept at most, and pairs of neighbours.
WORDS, FOLLOWS = 500_000, 500_000


class Transducer:
    """Normaliser, pieces and byte fallback of one model, ready for composition."""

    def __init__(self, model: bytes):
        self.v = v = Vocabulary(model)
        self.trie: dict = {}
        for s, i in v.ids.items():
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            node[""] = i
        self.rank = {s: -v.scores[i] for s, i in v.ids.items()}
        self.follows: dict[int, bool] = {}  # by both pieces in one number
        self.unknown_weight = 10 - min(v.scores[i] for i in v.ids.values())
        self.surface = [
            "" if i in v.control else s.replace(SPACE, " ") for i, s in enumerate(v.strings)
        ]
        self.byte_of = {i: b for b, i in v.bytes.items()}

    def merged(self, text: str) -> list[str]:
        """The pieces that rank-ordered merging leaves of a short string."""
        parts = list(text)
        while len(parts) > 1:
            best, at = math.inf, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1], math.inf)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand behind ``left`` (-1: a word's start, -2: an unknown character)."""
        got = self.follows.get((left + 2 << 32) + right)
        if got is None:
            if len(self.follows) > FOLLOWS:
                self.follows.clear()
            a, b = self.v.strings[left] if left >= 0 else "", self.v.strings[right]
            got = self.merged(a + b) == ([a, b] if a else [b])
            self.follows[(left + 2 << 32) + right] = got
        return got

    def fallback(self, char: str) -> list[int]:
        """Output of an unknown character's arc."""
        return [self.v.bytes[b] for b in char.encode()] if self.v.byte_fallback else [self.v.unk]

    def shortest(self, word: str) -> bytes:
        """Ids on the shortest path through the composition with one normalised word."""
        n, bpe, trie, follows = len(word), self.v.kind == 2, self.trie, self.follows
        cost, back = [0.0] + [math.inf] * n, [(-1, -1)] * (n + 1)
        for i in range(n):
            here = cost[i]
            if here == math.inf:
                continue
            last = back[i][1]
            before = last + 2 << 32
            node, j, single = trie, i, False
            while j < n:
                node = node.get(word[j])
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is None:
                    continue
                single |= j == i + 1
                if bpe:
                    if cost[j] == math.inf:
                        ok = follows.get(before + piece)
                        if ok is None:
                            ok = self.may_follow(last, piece)
                        if ok:
                            cost[j], back[j] = 0.0, (i, piece)
                elif here - self.v.scores[piece] < cost[j]:
                    cost[j], back[j] = here - self.v.scores[piece], (i, piece)
            if not single:
                w = here if bpe else here + self.unknown_weight
                if w < cost[i + 1]:
                    cost[i + 1], back[i + 1] = w, (i, -2)
        path, j = [], n
        while j:
            i, piece = back[j]
            path += [piece] if piece >= 0 else self.fallback(word[i])[::-1]
            j = i
        return array(WIDTH, path[::-1]).tobytes()

    def all(self, words: list[str]) -> list[bytes]:
        return list(map(self.shortest, words))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces are read as UTF-8, the dummy prefix goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            out = bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                out += self.surface[i].encode() if b is None else bytes((b,))
            text = out.decode(errors="replace")
        return text[1:] if self.v.prefix and text[:1] == " " else text


@per_worker
def compiled(model: bytes) -> tuple[Transducer, WordCache]:
    """The transducer and its cache of words; a worker compiles it once."""
    t = Transducer(model)
    return t, WordCache(t.v, t.all, limit=WORDS)


def encode_decode(documents: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), round_trip (decoding gives the normalised text back) and,
    as asked for, ids (array<long>) and decoded. A null text counts as empty and
    gives no ids; a null doc_id stays null; repeated rows give repeated results;
    an empty table gives none; other columns are left alone, whatever their
    names. Narrow: no shuffle, memory bounded by the batch.
    """
    model = Path(model_path).read_bytes()
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean"
    schema += ", ids array<long>" * keep_ids + ", decoded string" * keep_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, cache = compiled(model)
        for batch in batches:
            for part in text_chunks(batch):
                texts = texts_of(part)
                flat = [b"".join(x) for x in cache.of(texts)]
                rows = [memoryview(b).cast(WIDTH).tolist() for b in flat]
                back = [machine.decode(r) for r in rows]
                want = [machine.decode([]) if not t else machine.v.normalise(t).replace(SPACE, " ") for t in texts]
                cut = machine.v.prefix
                columns = [
                    part.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(b) for b in flat], pa.int64()),
                    pa.array([b == (w[1:] if cut and w[:1] == " " else w) for b, w in zip(back, want, strict=True)]),
                ]
                columns += [pa.array(rows, pa.list_(pa.int64()))] * keep_ids + [pa.array(back, pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
