"""Removal of repeated byte strings, by run-length indexes over the strings that may repeat.

A string of W = 400 bytes that starts at two places makes both of its occurrences removable. Exactly the bytes under such
strings are found, in any number of machines:

1. Every window of W bytes has one anchor, the least hash among the 32-byte strings in it (leftmost on ties). Equal windows
   have equal anchors at equal offsets, so windows only need comparing inside a group of equal anchors. The windows of one
   anchor are neighbours; the bytes under them are its piece. Pieces are known by hash until their bytes are needed.
2. Groups of one occurrence are dropped. In a group whose pieces are all equal every window repeats. These counts are aggregated
   before they are shuffled, so a passage in a third of all rows is a few rows.
3. The different pieces of the other groups, one copy of each with its count, get a run-length index, many groups in one:
   the Burrows-Wheeler transform by prefix doubling, its runs, and samples at run ends, where alone longest common prefixes
   are taken. Streaming the pieces through it gives their matching statistics: a place whose row is not at a run's end matches
   one byte less than the place before it. Places that match W bytes or more elsewhere are marked.
4. A group of more than ``most`` different pieces (the ends of a passage that very many documents hold, which differ as the texts
   around do) is not collected: its windows are dealt by offset into blocks of 48, then 6, then 1, and grouped anew by the bytes
   that a block's windows share; each step drops what is unique and settles what is equal.
5. Marks go back to the documents, whose other bytes are hashed.

Hashes have 64 bits; a wrong equality among n pieces has a chance of about n^2 / 2^65.

Defined cases: a null or empty text has no bytes and keeps none; texts under W bytes lose nothing; equal rows are copies of
each other; rows with the same id are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C

WINDOW, GRAM, MOST = 400, 32, 2000
BLOCKS = (48, 6, 1)
#: Bytes of pieces in one run-length index.
INDEX_BYTES = 1 << 20
PIECES = "doc_id long, name long, place long, a_lo int, a_hi int, key long, sub long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of v[s : s + w] for every s, by minima from and to block ends."""
    n = len(v)
    if n < w:
        return v[:0]
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(off: np.ndarray, raw: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, key, sub) of every anchor, places in the buffer."""
    n = len(raw)
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if n < window:
        return none
    at = C.Prefix(raw)
    start = np.arange(n - gram + 1)
    h = at(start, start + gram)
    bits = np.uint64(max(28, n.bit_length()))  # of a place; 28 do for a slice, a text of its own may need more
    v = (h >> bits << bits) | start.astype(np.uint64)
    least = sliding_min(v, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    good = np.arange(len(least)) + window <= off[1:][row]
    s = np.flatnonzero(good)
    if not len(s):
        return none
    a, r = least[s].astype(np.int64), row[s]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]]) - 1
    lo, hi, a, r = s[first], s[last], a[first], r[first]
    sub = C.mix(at(lo, hi + window) + (a - lo).astype(np.uint64) * C._MULT[3])
    return r, a, lo, hi, C.mix(h[a]), sub


def pieces(docs: DataFrame) -> DataFrame:
    """Every anchor's piece: offsets a_lo .. a_hi of the anchor in its windows, and the hashes."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        off, raw = C.offsets_of(batch.column(1))
        r, a, lo, hi, key, sub = anchors(off, raw)
        who = pa.array(r)
        columns = [batch.column(0).take(who), batch.column(2).take(who), pa.array(a - off[r]), pa.array((a - hi).astype(np.int32)), pa.array((a - lo).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(sub.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return C.map_text(docs, step, PIECES, _name().alias("name"))


def _name() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


# --- the run-length index --------------------------------------------------------------------------------------------------


#: Bytes that the first ranks compare.
_FIRST = 5


class RunIndex:
    """Run-length index of strings, each with an end: a byte at ``ends``, different from all other bytes, the last one too."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        n = self.n = len(text)
        ends = np.asarray(ends, np.int64)
        end_no = np.searchsorted(ends, np.arange(n))
        left = (ends[end_no] if n else ends) - np.arange(n)  # bytes before the end
        pad = np.concatenate([text, np.zeros(_FIRST, np.uint8)]).astype(np.uint64)
        word = np.zeros(n, np.uint64)
        for j in range(_FIRST):
            word = (word << np.uint64(8)) | np.where(left >= j, pad[j : j + n], np.uint64(0))
        order, rank = _ranked(word)
        own = np.where(left < _FIRST, end_no + 1, 0)  # a place is told from all others once an end lies within its reach
        order, rank = _ranked(rank.astype(np.uint64) * np.uint64(n + 2) + own.astype(np.uint64))
        self.text, span = text, _FIRST
        self.levels = [(span, rank)]
        while rank.max(initial=0) < n - 1:
            after = np.zeros(n, np.uint64)
            after[: max(0, n - span)] = rank[span:] + 1
            order, rank = _ranked(rank.astype(np.uint64) * np.uint64(n + 2) + after)
            span *= 2
            self.levels.append((span, rank))
        self.is_end = np.zeros(n + 1, bool)
        self.is_end[ends] = True
        self.order = order  # the suffix array, to ``span`` bytes
        # the transform; ends differ from each other
        last = np.where(self.is_end[order - 1] if n else order, 256 + end_no[order - 1] if n else order, text[order - 1] if n else order).astype(np.int32)
        head = np.concatenate([[True], last[1:] != last[:-1]]) if n else np.empty(0, bool)
        tail = np.concatenate([head[1:], [True]]) if n else head
        #: The run-compressed transform, and the samples of places at run ends.
        self.run_byte, self.run_start = last[head], np.flatnonzero(head)
        self.head_place, self.tail_place = order[head], order[tail]
        before = order[np.maximum(np.flatnonzero(head) - 1, 0)]
        behind = order[np.minimum(np.flatnonzero(tail) + 1, n - 1)]
        self.head_match = np.where(np.flatnonzero(head) > 0, self.common(self.head_place, before), 0)
        self.tail_match = np.where(np.flatnonzero(tail) < n - 1, self.common(self.tail_place, behind), 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes, by descending powers of two."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for span, rank in reversed(self.levels):
            inside = np.maximum(a, b) + span <= self.n
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            a, b, out = a + same * span, b + same * span, out + same * span
        for _ in range(8):
            inside = np.maximum(a, b) < self.n
            same = np.zeros(len(a), bool)
            same[inside] = (self.text[a[inside]] == self.text[b[inside]]) & ~self.is_end[a[inside]] & ~self.is_end[b[inside]]
            a, b, out = a + same, b + same, out + same
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every place the longest match elsewhere, streamed in text order from the samples at run ends.

        Inside a run the neighbour in suffix order is preceded by the same byte, so its match is one longer at the place
        before; hence a place that is no sample has the last sample's match less the distance to it."""
        out = np.zeros(self.n, np.int64)
        for place, match in ((self.head_place, self.head_match), (self.tail_place, self.tail_match)):
            reach = np.zeros(self.n, np.int64)
            reach[place] = place + match + 1
            is_sample = np.zeros(self.n, bool)
            is_sample[place] = True
            latest = np.maximum.accumulate(np.where(is_sample, np.arange(self.n), -1))
            out = np.maximum(out, np.where(latest >= 0, reach[latest] - 1 - np.arange(self.n), 0))
        return out


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the rank of each among the different ones. Keys are under 2**42, or under (n + 2)**2."""
    n = len(key)
    if n < 1 << 21:  # sorting key and place as one number is several times faster than sorting places
        both = (key << np.uint64(21)) | np.arange(n, dtype=np.uint64)
        both.sort()
        order, ordered = (both & np.uint64((1 << 21) - 1)).astype(np.int64), both >> np.uint64(21)
    else:
        order = np.argsort(key)
        ordered = key[order]
    rank = np.empty(n, np.int32)
    if n:
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return order, rank


def repeated_starts(strings: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each of some different strings, whether the window at each start occurs at another place of any of them."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    found = RunIndex(text, np.cumsum([len(s) + 1 for s in strings]) - 1).matching_statistics() >= window
    out, at = [], 0
    for s in strings:
        out.append(found[at : at + max(0, len(s) - window + 1)])
        at += len(s) + 1
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


# --- the distributed steps -------------------------------------------------------------------------------------------------


def _counted(p: DataFrame) -> DataFrame:
    """(key, times, kinds): occurrences and different pieces of every group that has more than one occurrence."""
    one = p.groupBy("key", "sub").agg(F.sum("m").alias("m"))
    return one.groupBy("key").agg(F.sum("m").alias("times"), F.count("*").alias("kinds")).filter("times > 1")


def _with_bytes(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Pieces with their bytes, from the document of their first occurrence."""
    by_doc = reps.groupBy("name", "who").agg(F.collect_list(F.struct("place", "a_lo", "a_hi", "key", "sub", "m")).alias("p"))  # a document's own
    text = C.id_and_text(docs).select(_name().alias("name"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("who"), "text")
    met = by_doc.join(text, ["name", "who"]).select("text", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, rows = (b.column(0)[i].as_py() or "").encode("utf-8", "surrogatepass"), b.column(1)[i].as_py()
                data = [raw[r["place"] - r["a_hi"] : r["place"] - r["a_lo"] + WINDOW] for r in rows]
                cols = [pa.array([r[c] for r in rows], t) for c, t in (("key", pa.int64()), ("sub", pa.int64()), ("a_lo", pa.int32()), ("a_hi", pa.int32()), ("m", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(data, pa.binary())], names=["key", "sub", "a_lo", "a_hi", "m", "data"])

    return met.mapInArrow(run, "key long, sub long, a_lo int, a_hi int, m long, data binary")


def _indexed(cold: DataFrame, partitions: int) -> DataFrame:
    """(key, sub, x_lo, x_hi): offsets of windows that repeat, by run-length indexes over whole groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seen: dict[tuple[int, int], tuple] = {}
        for r in rows:
            seen.setdefault((r[0], r[1]), r)
        own = list(seen.values())
        out = []
        for (key, sub, _, a_hi, m, data), flags in zip(own, repeated_starts([r[5] for r in own]), strict=True):
            if m > 1:
                flags = np.ones(len(data) - WINDOW + 1, bool)
            out += [(key, sub, a_hi - b, a_hi - a) for a, b in _spans(flags)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "sub", "x_lo", "x_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if size > INDEX_BYTES and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield solve(held)

    ordered = cold.select("key", "sub", "a_lo", "a_hi", "m", "data").repartition(partitions, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, sub long, x_lo int, x_hi int")


def _dealt(hot: DataFrame, block: int) -> DataFrame:
    """The pieces of hot groups by blocks of offsets, keyed by what a block's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for root_key, root_sub, key, a_lo, a_hi, m, data in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                at = C.Prefix(np.frombuffer(data, np.uint8))
                for j in range(a_lo // block, a_hi // block + 1):
                    lo, hi = max(a_lo, j * block), min(a_hi, j * block + block - 1)
                    a, z = np.asarray([a_hi - j * block, a_hi - hi]), np.asarray([a_hi - j * block - block + 1 + WINDOW, a_hi - lo + WINDOW])
                    core, whole = at(a, z)
                    tag = np.asarray([core, whole, core], np.uint64) + np.asarray([j, lo * 1024 + hi, key & 0xFFFFFFFF], np.uint64) * C._MULT[4:7]
                    mixed = C.mix(tag).view(np.int64)
                    out.append((root_key, root_sub, int(mixed[0] ^ mixed[2]), int(mixed[1]), lo, hi, m, data[a_hi - hi : a_hi - lo + WINDOW]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["root_key", "root_sub", "key", "sub", "a_lo", "a_hi", "m", "data"])

    return hot.select("root_key", "root_sub", "key", "a_lo", "a_hi", "m", "data").mapInArrow(run, "root_key long, root_sub long, key long, sub long, a_lo int, a_hi int, m long, data binary")


def repeats(docs: DataFrame, tables: C.Tables, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Every piece, and (key, sub, x_lo, x_hi): offsets in them of windows that repeat."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = tables.keep(pieces(docs), "pieces")
    who = F.coalesce("doc_id", F.lit(-(1 << 62)))
    one = every.groupBy("key", "sub").agg(F.count("*").alias("m"), F.min(F.struct("name", who.alias("who"), "place", "a_lo", "a_hi")).alias("at"))
    one = tables.keep(one.select("key", "sub", "m", "at.*"), "kinds")
    groups = tables.keep(_counted(one), "groups")
    several = one.join(groups, "key")
    found = [several.filter("kinds = 1").select("key", "sub", F.col("a_lo").alias("x_lo"), F.col("a_hi").alias("x_hi"))]
    strings = tables.keep(_with_bytes(several.filter("kinds > 1"), docs).join(groups, "key"), "strings")
    found.append(tables.keep(_indexed(strings.filter(F.col("kinds") <= most), partitions), "indexed"))
    hot = strings.filter(F.col("kinds") > most).withColumns({"root_key": F.col("key"), "root_sub": F.col("sub")})
    for block in BLOCKS:
        if hot.isEmpty():
            break
        dealt = tables.keep(_dealt(hot, block), "dealt")
        met = dealt.join(_counted(dealt), "key")
        root = [F.col("root_key").alias("key"), F.col("root_sub").alias("sub")]
        found.append(met.filter("kinds = 1").select(*root, F.col("a_lo").alias("x_lo"), F.col("a_hi").alias("x_hi")))
        cold = met.filter((F.col("kinds") > 1) & (F.col("kinds") <= most))
        kinds = cold.groupBy("key", "sub").agg(F.first("a_lo").alias("a_lo"), F.first("a_hi").alias("a_hi"), F.sum("m").alias("m"), F.first("data").alias("data"))
        found.append(tables.keep(cold.select("root_key", "root_sub", "key", "sub").join(_indexed(kinds, partitions), ["key", "sub"]).select(*root, "x_lo", "x_hi"), "indexed"))
        hot = met.filter(F.col("kinds") > most).select("root_key", "root_sub", "key", "a_lo", "a_hi", "m", "data")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return every, out


def dedup(docs: DataFrame, most: int = MOST, tables: C.Tables | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document; spans: (start, end) byte runs removed."""
    tables = tables or C.Tables(docs.sparkSession)
    every, found = repeats(docs, tables, most)
    marks = every.join(found, ["key", "sub"]).select("name", (F.col("place") - F.col("x_hi")).alias("s"), (F.col("place") - F.col("x_lo") + WINDOW).alias("e"))
    marks = tables.keep(marks.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("marks")), "marks")  # a text's own
    named = C.id_and_text(docs).withColumn("name", _name()).join(marks, "name", "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            out = []
            for i in range(b.num_rows):
                raw, spans = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"), []
                for m in b.column(2)[i].as_py() or ():
                    if spans and m["s"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m["e"])
                    else:
                        spans.append([m["s"], m["e"]])
                h, at = hashlib.sha256(), 0
                for s, e in spans:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                out.append((b.column(0)[i].as_py(), len(raw), sum(e - s for s, e in spans), len(spans), h.hexdigest(), [{"s": s, "e": e} for s, e in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*(x.split()[0] for x in RESULT.split(", ")), "spans"])

    return named.mapInArrow(run, RESULT + ", spans array<struct<s: long, e: long>>")
