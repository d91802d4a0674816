"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by size (powers of four of their count of distinct word shingles). For a partition of items of at
most u shingles, documents are cut into windows of u consecutive shingles, so that a short item is never compared with a long
document as a whole, where MinHash would see nothing. A window and an item of a partition are each signed by one-permutation
MinHash with 4 u bins: the least hash of each bin. They are candidates if a bin agrees. A shingle of an item survives in a
window's signature with a chance of about 0.8 whatever the document's length, so of an item whose containment is 0.8 all but a
few in 100,000 are candidates; items of at most eight shingles have windows of one shingle, and are all found.
Each candidate is verified: the share of the item's distinct shingles that the whole document has.

A window without any shingle of an item's signature cannot agree with it, so only other windows are signed.
Items are broadcast up to ``most_broadcast`` shingles; more are searched in blocks of that size, a pass over the documents each.

Words are lower-cased in A-Z, without marks around them. Defined cases: a text of fewer than k words is one shingle; a text
without words holds nothing, and an item without words is found nowhere; ids that repeat are rows of their own (one row, if the items take several blocks); a null item id
is reported as -1; items that tie are all listed, in order of their ids; texts of any length are read whole; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

SCHEMA = "doc_id long, item_ids array<long>, containment double"
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}|*#$%&<>")] = True


def word_shingles(off: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle in order of place (shorter rows' single ones last)."""
    start, end, row = C.words(off, raw)
    start, end, row = C.bare(raw, _MARKS, start, end, row)
    return C.shingles(C.Prefix(raw, lower=True)(start, end), row, len(off) - 1, k)


def _bins(u: int) -> int:
    return 4 * u


class Items:
    """Distinct shingles of each item, and the signatures by size partition."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, h: np.ndarray):
        self.ids, self.h = ids, h  # h: by item, ascending
        self.cut = np.searchsorted(row, np.arange(len(ids) + 1))
        size = np.diff(self.cut)
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []  # u, signature's hashes in order, their items
        u = 8
        while len(size) and u // 4 < size.max():
            mine = (size > (u // 4 if u > 8 else 0)) & (size <= u)
            at = np.flatnonzero(mine[row])
            sign = at[least_of_bins(row[at], h[at], _bins(u))] if u > 8 else at
            order = np.argsort(h[sign], kind="stable")
            if len(order):
                self.parts.append((u, h[sign][order], row[sign][order]))
            u *= 4
        self.filter = np.zeros(1 << 20, bool)
        for _, s, _ in self.parts:
            self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, item: int) -> np.ndarray:
        return self.h[self.cut[item] : self.cut[item + 1]]


def least_of_bins(group: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """Places of the least hash of each (group, bin). The bin is taken from the hash's low bits, mixed."""
    b = C.mix(h + np.uint64(bins)) % np.uint64(bins)
    order = np.lexsort((h, b, group))
    g, b = group[order], b[order]
    return order[np.concatenate([[True], (g[1:] != g[:-1]) | (b[1:] != b[:-1])])] if len(order) else order


def candidates(items: Items, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct (row, item) whose signatures agree in a bin."""
    out = [np.empty((0, 2), np.int64)]
    maybe = np.flatnonzero(items.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(maybe):
        return out[0]
    first = np.searchsorted(row, np.arange(row.max() + 2)) if (np.diff(row) >= 0).all() else None
    place = np.arange(len(h)) - first[row] if first is not None else None
    for u, sign, item in items.parts:
        at = maybe[np.isin(h[maybe], sign)]
        if not len(at):
            continue
        if u > 8:
            if place is None:
                raise ValueError("shingles must be in order of rows")
            window = row * ((1 << 40) // u) + place // u  # a number for each row's window
            mine = np.flatnonzero(np.isin(window, window[at]))
            least = mine[least_of_bins(window[mine], h[mine], _bins(u))]
            at = least[np.isin(h[least], sign)]
        low, high = np.searchsorted(sign, h[at], "left"), np.searchsorted(sign, h[at], "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.stack([np.repeat(row[at], n), item[which]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _found(batch: pa.RecordBatch, items: Items, k: int, threshold: float) -> pa.RecordBatch:
    """(doc_id, item_ids, containment) of a batch of (doc_id, text)."""
    h, row = word_shingles(*C.offsets_of(batch.column(1)), k)
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    found: list[list[int]] = [[] for _ in range(batch.num_rows)]
    best = np.zeros(batch.num_rows)
    cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
    own_row, own = -1, np.empty(0, np.uint64)
    for r, i in candidates(items, h, row).tolist():
        if r != own_row:
            own_row, own = r, np.unique(h[cut[r] : cut[r + 1]])
        q = items.of(i)
        n = int(np.isin(q, own, assume_unique=True).sum())
        best[r] = max(best[r], n / len(q))
        if n >= threshold * len(q) - 1e-9:
            found[r].append(int(items.ids[i]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(x) for x in found], pa.list_(pa.int64())), pa.array(best)], names=["doc_id", "item_ids", "containment"])



def _search(docs: DataFrame, items: Items, k: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    return C.map_text(docs, lambda batch: _found(batch, shared.value, k, threshold), SCHEMA)


def collect_items(benchmark: DataFrame, k: int) -> Items:
    """At most as many shingles as the caller has checked."""

    def run(batches):
        for b in C.slices(batches):
            h, row = C.unique_in_rows(*word_shingles(*C.offsets_of(b.column(1)), k))
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], names=["item_id", "h"])

    got = benchmark.mapInArrow(run, "item_id long, h array<long>").toPandas().sort_values("item_id", kind="stable")
    own = [np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in got["h"]]
    return Items(got["item_id"].fillna(-1).to_numpy(np.int64), np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own) if own else np.empty(0, np.uint64))


def _blocks(benchmark: DataFrame, k: int, most_broadcast: int) -> list[DataFrame]:
    """The items in blocks of about ``most_broadcast`` shingles."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    bytes_of_text = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(bytes_of_text) // (2 * most_broadcast)))  # a shingle takes two bytes of text at least
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.filter(block == b) for b in range(blocks)] if blocks > 1 else [items]


def find(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, most_broadcast: int = 4_000_000, tables: C.Tables | None = None) -> DataFrame:
    """(doc_id, item_ids, containment, contaminated) of every document; item_ids: items contained to ``threshold`` at least;
    containment: the highest of its candidates. Of several blocks of items, one at a time is in the driver's memory: its pass is
    written before the next is read."""
    blocks = _blocks(benchmark, k, most_broadcast)
    if len(blocks) == 1:
        out = _search(docs, collect_items(blocks[0], k), k, threshold)
    else:
        tables = tables or C.Tables(docs.sparkSession)
        found = [tables.keep(_search(docs, collect_items(items, k), k, threshold), "found") for items in blocks]
        out = reduce(DataFrame.unionByName, found).groupBy("doc_id").agg(F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.max("containment").alias("containment"))
        out = out.withColumn("item_ids", F.sort_array("item_ids"))
    return out.withColumn("contaminated", F.size("item_ids") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, most_broadcast: int = 4_000_000) -> DataFrame:
    """The documents, in their columns, that hold no item: a narrow pass for each block of items, nothing is joined."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    for block in _blocks(benchmark, k, most_broadcast):
        shared = docs.sparkSession.sparkContext.broadcast(collect_items(block, k))

        def run(batches, shared=shared):
            for b in C.slices(batches):
                own = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at)], names=["doc_id", "text"])
                yield b.filter(pa.compute.equal(pa.compute.list_value_length(_found(own, shared.value, k, threshold).column(1)), 0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
