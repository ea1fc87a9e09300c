"""Operator 8: token ids as flat binary files with 64-bit document offsets.

A table becomes a folder of shards in ascending doc_id order. Shard k has
``ids-k.bin`` (unsigned integers, little endian, 16 bits wide where the
vocabulary allows and else 32), ``offsets-k.bin`` (64-bit: where each document
starts within the shard, and the end) and ``docs-k.bin`` (64-bit doc_ids). Shard
bases are prefix sums over the shards' totals, so that documents have global
starts without a pass through one task. Readers map the files into memory.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.common import per_worker, text_chunks, texts_of, trimmed

#: doc_id of a row without one, in the files.
NO_ID = -(2**63)
#: A single space between other white space, with which it may form one token.
INSIDE_RUN = re.compile(r" \s(?<=\s \s)")


class ByteEncoder:
    """Ids of texts by the tokenizers library, kept by space-led word.

    A byte-level pre-tokenizer cuts before every single space unless white space
    of any kind stands on both its sides, so such words encode alone as in their
    text. Texts with such a space, runs of spaces or special strings go to the
    library whole, and so does every text if the file's settings are others.
    """

    def __init__(self, spec: str, limit: int = 1_000_000):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        self.by_word = (
            self.library.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex
        )
        self.limit = limit
        self.rest: dict[str, bytes] = {}
        vocabulary = sorted((i, t) for t, i in self.library.get_vocab().items())
        self.leads = np.zeros(vocabulary[-1][0] + 1, bool)
        self.leads[[i for i, t in vocabulary if t[:1] == "\u0120"]] = True  # how byte-level vocabularies write a space

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with its leading space; many words go as one text, cut where ids begin with the space.

        A word that begins with other white space starts a text, so that nothing runs into it.
        """
        joined, n = [], 0
        for w in words:
            if n % 256 == 0 or w[0].isspace():
                joined.append([])
                n = 0
            joined[-1].append(" " + w)
            n += 1
        joined = ["".join(j) for j in joined]
        ids = np.concatenate([np.array(e.ids, self.width) for e in self.library.encode_batch(joined, add_special_tokens=False)])
        at, flat, size = np.flatnonzero(self.leads[ids]).tolist(), ids.tobytes(), self.width.itemsize
        cuts = zip(at, [*at[1:], len(ids)], strict=True)
        return [flat[a * size : b * size] for a, b in cuts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of the width."""
        self.rest = trimmed(self.rest, self.limit)
        rest, simple = self.rest, self.by_word
        parts = [
            t.split(" ")
            if simple and "  " not in t and t[:1] != " " and t[-1:] != " " and not INSIDE_RUN.search(t) and not any(s in t for s in self.special)
            else None
            for t in texts
        ]
        words = [p[1:] if p else [] for p in parts]
        missing = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in rest]
        if missing:
            rest.update(zip(missing, self._encode_words(missing), strict=True))
        # First words, and texts that are not plain, as they stand.
        heads = self._encode([p[0] if p else t for p, t in zip(parts, texts, strict=True)])
        return [h + b"".join(map(rest.__getitem__, w)) if w else h for h, w in zip(heads, words, strict=True)]


@per_worker
def encoder(spec: str) -> ByteEncoder:
    """The encoder of a worker, for all its tasks; a task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteEncoder(spec)


@dataclass(frozen=True)
class Shard:
    """One shard: its number, its files' common name, counts and base."""

    number: int
    stem: str
    documents: int
    ids: int
    base: int


@dataclass(frozen=True)
class TokenFiles:
    """A written folder and its manifest (one small entry for each shard)."""

    folder: str
    width: int
    shards: tuple[Shard, ...]


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write shards below ``folder``.

    ``folder`` must be one that all executors and readers share. Documents are
    ranged and sorted by doc_id, ties by a hash of the text; a null doc_id comes first and is
    read back as null; a null text counts as empty (the end id alone); repeated
    rows are written again; an empty table gives no shards. Columns besides
    doc_id (whole numbers) and text are left alone, whatever their names.

    Tasks write under names of their own attempt, and only what the successful
    attempt reports enters the manifest, so a repeated task does no harm.
    """
    spec = Path(tokenizer_path).read_text()
    width = encoder(spec).width
    run_id = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task = encoder(spec), TaskContext.get()
        number, stem = task.partitionId(), f"{run_id}-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, root = pafs.FileSystem.from_uri(folder)
        end, doc_ids, ends, out, total = np.array([end_id], e.width).tobytes(), [], [], None, 0
        for batch in batches:
            for part in text_chunks(batch, 2 << 20):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/ids-{stem}.bin")
                flat = [b + end for b in e.encode(texts_of(part))]
                out.write(b"".join(flat))
                sizes = np.fromiter(map(len, flat), np.int64, len(flat)) // e.width.itemsize
                ends.append(total + np.cumsum(sizes))
                total = int(ends[-1][-1])
                doc_ids.append(part.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if out is not None:
            out.close()
            for name, values in (("offsets", np.concatenate([[0], *ends])), ("docs", np.concatenate(doc_ids))):
                with fs.open_output_stream(f"{root}/{name}-{stem}.bin") as f:
                    f.write(values.astype("<i8").tobytes())
            row = [[number], [stem], [sum(map(len, doc_ids))], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["number", "stem", "documents", "ids"])

    # A hash of the text lets the ranges split an id (or null) of very many rows.
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ranged = keyed.select("doc_id", "text")
    rows = sorted(ranged.mapInArrow(run, "number long, stem string, documents long, ids long").collect())
    bases = accumulate((r.ids for r in rows), initial=0)
    shards = tuple(Shard(r.number, r.stem, r.documents, r.ids, b) for r, b in zip(rows, bases, strict=False))
    return TokenFiles(folder, width.itemsize, shards)


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory if it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """Documents as the files hold them: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before; ids_crc32 is that of the
    ids as little-endian unsigned 32-bit integers, end id included.
    """
    folder, width = files.folder, files.width
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for frame in frames:
            for stem, base in zip(frame["stem"], frame["base"], strict=True):
                ids = _mapped(fs, f"{root}/ids-{stem}.bin", f"<u{width}")
                at = _mapped(fs, f"{root}/offsets-{stem}.bin", "<i8")
                doc = _mapped(fs, f"{root}/docs-{stem}.bin", "<i8")
                for a in range(0, len(doc), 2000):
                    b = min(a + 2000, len(doc))
                    rows = [ids[at[i] : at[i + 1]].astype("<u4") for i in range(a, b)]
                    out = pd.DataFrame({
                        "doc_id": pd.array(doc[a:b], "Int64"),
                        "start": base + at[a:b],
                        "n_tokens": at[a + 1 : b + 1] - at[a:b],
                        "ids_crc32": [zlib.crc32(r.tobytes()) for r in rows],
                    })
                    out.loc[out["doc_id"] == NO_ID, "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = [r.astype(np.int64) for r in rows]
                    yield out

    manifest = [(s.stem, s.base) for s in files.shards]
    table = spark.createDataFrame(manifest, "stem string, base long")
    return table.repartition(max(1, len(manifest)), "stem").mapInPandas(run, schema)
