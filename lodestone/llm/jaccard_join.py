"""Similarity join of documents by the Jaccard index of their word shingles, through parity sketches.

1. Every document gets its count of distinct shingles and a 64-bit name of its shingle set; equal sets are one from there on.
2. Size bands: a pair of sizes a <= b with Jaccard t or more has b <= a / t and a symmetric difference of at most
   K = (1 - t) / t * high, if a is at most ``high``, its band's end. A set takes part in the bands of all sizes it may be paired
   with as the larger one. In a band its shingles are dealt by hash to K + 1 + E blocks of a wide parity sketch, in which a shingle
   flips one of 2^64 bits of its block; a block is held as the XOR of its set bits' 64-bit codes, so blocks agree by content and
   not by chance. Unequal blocks bound the symmetric difference from below, so a pair within K differences has E + 1 equal blocks.
   If either set has at most E empty blocks, one of these is not empty, and the two meet in it. A set with more empty blocks is
   sketched again by other hashes (first without frequent shingles, whose blocks bring unlike sets together, then with them), and
   the other set of the pair takes part in every attempt up to its own first good one, so the pair meets in the first attempt
   that is good for either. Only what is never good shows its empty blocks too, in the last attempt. No pair is lost.
3. Sets that share a block (band, attempt, place, content) meet at the least of them, their hub: an aggregation and a join.
4. A hub's group is contracted, in blocks of bounded size. First each block, with the hub, is searched for partners by short
   sketches, of a few bits for each difference allowed. Members that are not linked to the hub then, and only these, are compared
   with the members of other blocks. So a group of m copies costs m, however large it is.
5. Groups of partners are contracted likewise with their texts, verifying exactly whatever is not linked through others already.
   Both steps emit spanning forests, never all pairs.
6. Components of the forest give the classes.

Names are 64-bit hashes of sets and shingles; among n different sets two agree with a chance of n^2 / 2^65.

Defined cases: a null text or one without words has no shingles and is linked with nothing (its component is its own id); fewer
words than k are one shingle; equal texts are linked at any size; rows with the same id are one node of the links, and each
reports its own size; a row without an id is linked as any other, but its id is no component's: the least id among its
partners is, or null; a pair at exactly the threshold is linked; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm.components import components

#: Attempts without and with frequent shingles.
RARE_TRIES, TRIES = 2, 5
#: Empty blocks that an attempt bears, as a share of the differences allowed.
SPARE = 0.12
#: Documents whose shingles are counted to tell frequent ones.
FREQUENCY_SAMPLE = 4_000
#: Ratio of a size band's ends.
BAND = 1.3
#: Sets and words that a block of a group holds at most (one set at least).
BLOCK_SETS, BLOCK_WORDS = 1024, 400_000
#: Names that a task remembers, so that copies emit their words once in a task.
REMEMBERED = 200_000


def bands(t: Fraction, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, K) of each size band up to ``longest``."""
    low, out = 1, []
    while low <= longest:
        high = max(low, int(low * BAND))
        out.append((low, high, int((1 - t) / t * high)))
        low = high + 1
    low, high, k = (np.asarray(x, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return low, high, k


def _shingled(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, row) by row, and by row the size and the set's name."""
    off, raw = C.offsets_of(batch.column(batch.schema.get_field_index("text")))
    start, end, row = C.words(off, raw)
    h, row = C.unique_in_rows(*C.shingles(C.Prefix(raw, lower=True)(start, end), row, len(off) - 1, k))
    n = np.bincount(row, minlength=len(off) - 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(h), dtype=np.uint64)])
    cut = np.concatenate([[0], np.cumsum(n)])
    name = C.mix((total[cut[1:]] - total[cut[:-1]]) + n.astype(np.uint64) * C._ODD).view(np.int64)
    return h, row, n, name


def sketch(h: np.ndarray, row: np.ndarray, rows: int, k: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, first place of each row's k + 1 words)."""
    first = np.concatenate([[0], np.cumsum(k + 1)])
    x = C.mix(h + np.uint64(0x1234567 * (attempt + 1)))
    place = ((x >> np.uint64(32)) * (k[row] + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + first[row]
    out = np.zeros(first[-1], np.uint64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (x & np.uint64(63)))
    return out, first[:rows]


def _blocks(h: np.ndarray, row: np.ndarray, rows: int, n: np.ndarray, attempt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, first place, blocks not empty) of each row's n blocks; an empty block's content is 0."""
    first = np.concatenate([[0], np.cumsum(n)])
    x = C.mix(h + np.uint64(0x1234567 * (attempt + 1)))
    place = ((x >> np.uint64(32)) * n[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + first[row]
    out = np.zeros(first[-1], np.uint64)
    order = np.argsort(place, kind="stable")
    at = place[order]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    if len(head):
        out[at[head]] = np.bitwise_xor.reduceat(C.mix(x[order] ^ C._ODD), head)
    full = np.zeros(first[-1], bool)
    full[at[head]] = True
    return out, first[:rows], full


def _keys(h: np.ndarray, row: np.ndarray, n: np.ndarray, t: Fraction, rare: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of the blocks of every row in every band that it takes part in; n are the sizes of the whole sets, and ``rare``
    marks the shingles that the first attempts take."""
    if not len(n) or not n.max():
        return
    low, high, k = bands(t, int(n.max()))
    own = np.searchsorted(high, n)
    for back in range(len(high)):
        band = own - back
        # as the larger of a pair whose smaller one is in that band
        reach = (n > 0) & (band >= 0)
        if back:
            reach &= n * t.numerator <= high[np.maximum(band, 0)] * t.denominator
            if not reach.any():
                break
        rows = np.flatnonzero(reach & (k[np.maximum(band, 0)] > 0))
        for attempt in range(TRIES):
            if not len(rows):
                break
            new = np.full(len(n), -1)
            new[rows] = np.arange(len(rows))
            mine = new[row] >= 0
            if attempt < RARE_TRIES:
                mine &= rare
            kk = k[band[rows]]
            spare = np.maximum(1, np.ceil(SPARE * kk)).astype(np.int64)
            blocks = kk + 1 + spare
            content, first, full = _blocks(h[mine], new[row[mine]], len(rows), blocks, attempt)
            of = np.repeat(np.arange(len(rows)), blocks)
            place = np.arange(len(content)) - first[of]
            key = C.mix(content * C._MULT[0] + (place * 64 + attempt).astype(np.uint64) * C._MULT[1] + band[rows[of]].astype(np.uint64) * C._MULT[2])
            bad = np.bincount(of[~full], minlength=len(rows)) > spare
            keep = full | bad[of] if attempt == TRIES - 1 else full
            yield key[keep].view(np.int64), rows[of[keep]]
            rows = rows[bad]


def _short_bits(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Bits of a set's short sketch: a power of two, about eight for each difference allowed; it folds to half by XOR."""
    most = (t.denominator - t.numerator) * 2 * n // (t.denominator + t.numerator)
    return 64 << np.ceil(np.log2(np.maximum(most * 8, 64) / 64)).astype(np.int64)


def digests(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(doc_id, n_shingles, name, short sketch, hash of the text) of every document."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row, n, name = _shingled(batch, k)
        bits = _short_bits(n, t)
        first = np.concatenate([[0], np.cumsum(bits // 64)])
        flat = np.zeros(first[-1], np.uint64)
        x = C.mix(h ^ C._ODD).view(np.int64) & (bits[row] - 1)
        np.bitwise_xor.at(flat, first[row] + (x >> 6), np.uint64(1) << (x & 63).astype(np.uint64))
        short = [flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(name), pa.array(short, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "name", "short", "of_text"])

    return C.map_text(docs, step, "doc_id long, n_shingles long, name long, short binary, of_text long", _of_text().alias("of_text"))


def _of_text() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x


def partners(n: np.ndarray, short: list[bytes], t: Fraction, side: np.ndarray) -> np.ndarray:
    """A spanning forest (pairs of places) of the pairs whose sizes and short sketches allow the index t; with two sides, of
    those across."""
    words = np.asarray([len(x) // 8 for x in short])
    forest, out = _Forest(), []
    num, den = t.numerator, t.denominator
    two = bool(side.any() and not side.all())
    by = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    own = {w: np.frombuffer(b"".join(short[i] for i in at), np.uint64).reshape(len(at), w) for w, at in by.items()}
    for w, at in by.items():
        sides = [(at, own[w])]
        if 2 * w in by:
            sides.append((by[2 * w], own[2 * w][:, :w] ^ own[2 * w][:, w:]))
        for x, i in zip(own[w], at.tolist(), strict=True):
            for js, y in sides:
                ok = np.minimum(n[i], n[js]) * den >= np.maximum(n[i], n[js]) * num
                if js is at:
                    ok &= js > i
                if two:
                    ok &= side[js] != side[i]
                near = np.flatnonzero(ok)
                if len(near):
                    apart = np.bitwise_count(y[near] ^ x).sum(axis=1, dtype=np.int64)
                    for j in js[near[apart * (den + num) <= (den - num) * (n[i] + n[js[near]])]].tolist():
                        a, b = forest.root(i), forest.root(j)
                        if a != b:
                            forest[a] = b
                            out.append((i, j))
    return np.asarray(out, np.int64).reshape(-1, 2)


def frequent_shingles(docs: DataFrame, k: int, sample: int = FREQUENCY_SAMPLE, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles of at least ``least`` of ``sample`` documents, in order. Whichever they are, the join's result is the same."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_shingled(batch, k)[0].view(np.int64))], names=["h"])

    found = C.map_text(C.id_and_text(docs).join(F.broadcast(ids.distinct()), "doc_id"), step, "h long")
    rows = found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "h").limit(most).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def sketch_words(docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """(key, name) of every block of every set's sketches, once in a task. Whichever shingles are frequent, no pair is lost: a set's
    difference from another is no larger without them."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in C.slices(batches, limit=1 << 20):
            h, row, n, name = _shingled(batch, k)
            if len(seen) > REMEMBERED:
                seen.clear()
            fresh = np.zeros(len(n), bool)
            for i, x in enumerate(name.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            mine = fresh[row]
            h, row = h[mine], row[mine]
            often = frequent.value
            rare = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] != h if len(often) else np.ones(len(h), bool)
            for key, at in _keys(h, row, np.where(fresh, n, 0), t, rare):
                for a in range(0, len(key), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 200_000]), pa.array(name[at[a : a + 200_000]])], names=["key", "name"])

    return C.id_and_text(docs).mapInArrow(run, "key long, name long")


def linked(texts: pa.RecordBatch, names: np.ndarray, side: np.ndarray, k: int, t: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows; with two sides (0 and 1), of those across."""
    h, row, n, _ = _shingled(texts, k)
    m = len(n)
    cut = np.searchsorted(row, np.arange(m + 1))
    width = np.full(m, int((1 - t) / t * max(1, int(n.max()))))  # one width, so that sketches compare
    words, _ = sketch(h, row, m, width, TRIES)
    words = words.reshape(m, -1)
    num, den = t.numerator, t.denominator
    two = bool(side.any() and not side.all())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(m), np.arange(m))
    found: list[np.ndarray] = []
    for i in left.tolist():
        js = right if two else right[i + 1 :]
        small, large = np.minimum(n[i], n[js]), np.maximum(n[i], n[js])
        js = js[(small * den >= large * num) & (n[js] > 0)] if n[i] else js[:0]
        if len(js):
            most = (den - num) * (n[i] + n[js]) // (den + num)
            for a in range(0, len(js), 256):
                part = js[a : a + 256]
                apart = np.bitwise_count(words[part] ^ words[i]).sum(axis=1, dtype=np.int64)
                good = apart <= most[a : a + 256]
                if good.any():
                    found.append(np.stack([apart[good], np.full(good.sum(), i), part[good]], axis=1))
        if len(found) > 4096:
            found = [np.concatenate(found)]
    if not found:
        return []
    pairs = np.concatenate(found)
    forest, out = _Forest(), []
    for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        a, b = forest.root(i), forest.root(j)
        if a == b:
            continue
        both = len(np.intersect1d(h[cut[i] : cut[i + 1]], h[cut[j] : cut[j + 1]], assume_unique=True))
        if both * den >= num * (n[i] + n[j] - both):
            forest[a] = b
            out.append((int(names[i]), int(names[j])))
    return out


def _contracted(group: DataFrame, blocks: Column, load, solve, tables: C.Tables) -> DataFrame:
    """(u, v): links of groups (g, name, ...), a forest that has the components of all of a group's links.

    Each block of a group and its hub are one cell, in which all links are found; then the members that are not linked to the hub
    are compared with the members of all blocks. ``load`` adds what ``solve`` reads to rows (g, i, j, side, name)."""
    parts = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = ["g", "i", "j"]
    columns = [*cells, "side", "name"]

    def solved(rows: DataFrame) -> DataFrame:
        return tables.keep(_by_cell(load(rows).repartition(parts, *cells).sortWithinPartitions(*cells), solve, "u long, v long"), "links")

    sizes = group.groupBy("g").agg(blocks.alias("m"), F.min("name").alias("hub"))
    dealt = group.join(sizes, "g").select("g", "name", "m", "hub", F.pmod(F.xxhash64("name"), F.col("m")).alias("block"))
    dealt = tables.keep(dealt, "dealt")
    each = dealt.select("g", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "name")
    hubs = dealt.filter("m > 1 and name = hub").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"), "name")
    links = solved(each.unionByName(hubs.select("g", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "name")))
    large = dealt.filter("m > 1")
    if large.isEmpty():
        tables.drop(dealt)
        return links
    found = components(links, tables)
    of = large.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("class", F.coalesce("component", "name"))
    home = of.filter("name = hub").select("g", F.col("class").alias("home"))
    left = tables.keep(of.join(home, "g").filter("class <> home").select("g", "name"), "left")
    many = left.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("n"))
    one = left.join(many, "g").join(sizes.select("g", "m"), "g").select("g", F.pmod(F.xxhash64("name"), F.col("n")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"), F.lit(0).alias("side"), "name")
    other = large.join(many, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "name")
    return links.unionByName(solved(one.select(columns).unionByName(other.select(columns))))


def links(docs: DataFrame, digest: DataFrame, k: int, t: Fraction, tables: C.Tables) -> DataFrame:
    """(u, v): names of sets, a forest of links that has the components of all links between different sets."""
    words = tables.keep(sketch_words(docs, k, t), "words")
    first = words.groupBy("key").agg(F.min("name").alias("hub"), F.max("name").alias("last")).filter("hub <> last").select("key", "hub")
    first = tables.keep(first, "shared")
    tables.tidy()
    met = tables.keep(words.join(first.hint("shuffle_hash"), "key").filter("name <> hub").select("name", "hub").distinct(), "met")
    tables.drop(words, first)
    sets = digest.filter("n_shingles > 0").groupBy("name").agg(F.first("n_shingles").alias("n"), F.first("short").alias("short"), F.min("of_text").alias("of_text"))
    group = met.select(F.col("hub").alias("g"), "name").unionByName(met.select(F.col("hub").alias("g"), F.col("hub").alias("name")).distinct())
    sets = tables.keep(sets.join(group.select("name").distinct(), "name", "left_semi"), "sets")
    # with short sketches: who has a partner at all
    near = _contracted(group, F.ceil(F.count("*") / BLOCK_SETS), lambda rows: rows.join(sets.select("name", "n", "short"), "name").select("g", "i", "j", "side", "name", "n", "short"), _near(t), tables)
    # sets that may be linked are in one component of these
    alive = components(near, tables).select(F.col("node").alias("name"), F.col("component").alias("g"))
    alive = tables.keep(alive.join(sets.select("name", "n", "of_text"), "name"), "alive")
    tables.drop(met, sets)
    # with their texts, each found by its hash
    text = C.id_and_text(docs).select(_of_text().alias("of_text"), "text").join(alive.select("of_text").distinct(), "of_text", "left_semi").dropDuplicates(["of_text"])
    text = tables.keep(alive.select("name", "of_text").join(text, "of_text").select("name", "text"), "texts")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_WORDS))
    out = _contracted(alive, blocks, lambda rows: rows.join(text, "name").select("g", "i", "j", "side", "name", "text"), _verified(k, t), tables)
    tables.drop(alive, text)
    return out


def _near(t: Fraction):
    def solve(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()]), axis=1, return_index=True)[1]
        name, side = b.column(4).to_numpy()[at], b.column(3).to_numpy()[at]
        short = b.column(6)
        out = name[partners(b.column(5).to_numpy()[at], [short[int(i)].as_py() for i in at], t, side)]
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

    return solve


def _verified(k: int, t: Fraction):
    def solve(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.take(pa.array(np.unique(np.stack([b.column(3).to_numpy(), b.column(4).to_numpy()]), axis=1, return_index=True)[1]))
        out = linked(b, b.column(4).to_numpy(), b.column(3).to_numpy(), k, t)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    return solve


def _by_cell(ordered: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` on the rows of each cell (hub, i, j), read from partitions in that order; a cell's size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return solve(b)

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if held and tuple(key[a]) != last:
                    yield done()
                last = tuple(key[a])
                held.append(b.slice(a, z - a))
        if held:
            yield done()

    return ordered.mapInArrow(run, schema)


def join(docs: DataFrame, k: int = 4, threshold: float | Fraction = Fraction(85, 100), tables: C.Tables | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    t = Fraction(threshold).limit_denominator(10_000)
    tables = tables or C.Tables(docs.sparkSession)
    digest = tables.keep(digests(docs, k, t), "digests")
    # rows of one id are one node
    ids = digest.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("name").alias("u"), F.max("name").alias("v")).filter("u <> v")
    same = digest.filter("n_shingles > 0").join(ids.select("doc_id", "u"), "doc_id").select("u", F.col("name").alias("v"))
    found = components(links(docs, digest, k, t, tables).unionByName(same), tables).withColumnRenamed("node", "name")
    # equal sets share a name, so ids are aggregated by name first and by class then, before any is shuffled
    by_name = digest.filter("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("least")).join(found, "name", "left").withColumn("class", F.coalesce("component", "name"))
    by_name = tables.keep(by_name.select("name", "class", "least"), "names")
    least = by_name.groupBy("class").agg(F.min("least").alias("component_id"))
    of = tables.keep(by_name.join(least, "class").select("name", "component_id"), "classes")
    empty = digest.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return digest.filter("n_shingles > 0").join(of, "name").select("doc_id", "n_shingles", "component_id").unionByName(empty)
