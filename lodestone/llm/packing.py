"""Best-fit packing of tokenized documents into sequences, bulk-synchronously.

1. Texts become token ids and pieces of at most ``capacity`` tokens; only ids' checksums, places and lengths are kept.
2. Pieces are range-sorted by length, longest first (ties by id and piece, so equal lengths spread over partitions).
3. Supersteps match pieces with gaps. The sorted pieces and the sorted gaps are held as runs of equal length, at most
   ``capacity`` of each whatever the count of pieces. A superstep takes the next run of pieces; its sweep finds the successor
   among the gap runs (the smallest gap that is large enough), and as many pieces as that run has gaps are matched by rank, the
   r-th piece with the r-th gap, which resolves conflicts; gaps are updated, and the rest of the run goes on to the next
   successor, or opens new sequences when no gap is left. This is best-fit decreasing, exactly.
4. The plan's rows say "pieces of global rank [a, b) go to sequences from s on, at offset o"; a row's rank is that of its range
   partition's first row plus its number in the partition's file, so every piece finds its place by a binary search, in one narrow pass.

The plan's size depends on the capacity and on how lengths fall, not on the count of pieces.

Defined cases: a null or empty text is one piece of one token (the end id); rows with the same id are packed each for itself.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Pre-tokens that a worker remembers, of texts in Latin-1; and chunks between white space of other texts.
REMEMBERED, REMEMBERED_CHUNKS = 600_000, 100_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's for the whole text.

    In a text of Latin-1 only, the normalizer does nothing but lower letters and take white space together, so one regular
    expression over the lowered text gives the pre-tokens; the tokenizer's model takes those it has not met lately. Pre-tokens
    never cross white space, so a text with other characters is cut there: its chunks of Latin-1 are encoded likewise, any other
    chunk, and one that may hold an added token, goes through the whole tokenizer."""

    letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
    #: The pre-tokenizer's pattern, with the letters (lowered), numbers and white space of Latin-1; the commonest come first, as
    #: only marks and contractions can begin alike.
    pattern = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^\t-\r \x85\xa0{letters}{digits}]+")

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.by_run = C.Recent(self.of_run, REMEMBERED)
        self.by_chunk = C.Recent(self.of_chunk, REMEMBERED_CHUNKS)

    def of_run(self, run: str) -> bytes:
        mapped = run if run.isascii() and run.isprintable() else self.to_bytes(run)[0][0]
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        if (data := self.of_latin(chunk)) is None:
            return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return data

    def of_latin(self, text: str) -> bytes | None:
        """None for a text that has other characters or an added token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if any(t in text for t in self.added):
            return None
        return b"".join(map(self.by_run.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if (data := self.of_latin(text)) is None:
            return b"".join(map(self.by_chunk.__getitem__, text.replace("\n", " ").split(" ")))
        return data


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    end = np.asarray([END_ID], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        out: list[tuple] = []
        encode = encoder(tokenizer_file).encode
        for doc_id, text in zip(ids, batch.column(1), strict=True):
            data = encode(text.as_py() or "") + end
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return C.map_text(docs, step, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (first rank, first sequence, offset) by rank, and the number of sequences.

    counts: length: pieces. Ranks go by length, longest first. Within a row, rank a + i goes to sequence s + i."""
    gaps: dict[int, deque] = {}  # gap: runs [first sequence, count]
    rows: list[tuple[int, int, int]] = []
    rank = opened = 0
    free = np.zeros(capacity + 1, np.int64)  # gap: sequences
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = np.flatnonzero(free[length:])
            if len(fit):
                gap = int(fit[0]) + length
                run = gaps[gap][0]
                n = min(left, run[1])
                first, run[0], run[1] = run[0], run[0] + n, run[1] - n
                if not run[1]:
                    gaps[gap].popleft()
                free[gap] -= n
            else:  # as many new sequences as these pieces fill; their gaps are successors at once
                gap, n = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + n
            rows.append((rank, first, capacity - gap))
            rank, left = rank + n, left - n
            if rest := gap - length:
                to = gaps.setdefault(rest, deque())
                if to and to[-1][0] + to[-1][1] == first:
                    to[-1][1] += n
                else:
                    to.append([first, n])
                free[rest] += n
    return np.asarray(rows, np.int64).reshape(-1, 3), opened


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, tables: C.Tables | None = None) -> DataFrame:
    """A row for each piece with its sequence and offset."""
    tables = tables or C.Tables(docs.sparkSession)
    cut = tables.keep(pieces(docs, tokenizer_file, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(counts, capacity)
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = cut.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranked = tables.keep(ranked, "ranked")
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each range partition
    first, total = np.zeros(max(sizes, default=0) + 1, np.int64), 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    shared = docs.sparkSession.sparkContext.broadcast((rows, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, first = shared.value
        for b in batches:
            rank = first[b.column(5).to_numpy()] + b.column(6).to_numpy()
            row = np.searchsorted(rows[:, 0], rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rows[row, 1] + rank - rows[row, 0]), pa.array(rows[row, 2])], names=[x.split()[0] for x in PLACED.split(", ")])

    # each range partition is one file, and Parquet numbers its rows, however a reader splits it
    return ranked.select("*", F.col("_metadata.row_index").alias("row")).mapInArrow(place, PLACED)
