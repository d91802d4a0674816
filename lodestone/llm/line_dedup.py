"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. Texts are split at newlines. A line of white space only is never compared and always stays; all others take part, whatever
   their length. A line's name is a 64-bit hash of it, so equal lines are one from there on.
2. Signature. What is verified are the sets of all character shingles (``k`` = 5) of two lines. Signed are, of a line of many
   words, the strings of nine characters at word beginnings (a content-defined sample, in which lines of one language share far
   less by chance than in short shingles), and of a line of few words or none all its shingles. Lines of 12 to 17 words are
   signed both ways, so that no pair falls between the two. The hashes are dealt to ten bins by their value; the three least of a
   bin make its band key. Two lines at a Jaccard index of 0.8 by scattered edits share a key with a chance of about 0.98
   (word beginnings) or 0.999 (all shingles).
3. Lines of a band meet its hub, the most frequent of them (an edited copy is rarer than what it was copied from): an aggregation
   and a join, linear in the lines however many share a band.
4. Each pair is verified: the exact Jaccard index of the sets of all shingles. A pair that already differs too much in the shingles
   at word beginnings cannot reach it, and is dropped before all shingles are taken; that loses nothing.
5. Refinement: where lines of a band are still in several components, they meet again under keys of that band and each later one,
   two bands that agree, with a hub of their own; then of three; and so on until no key has lines of several components or all
   ten bands agree. Lines that share a passage but are not similar fall apart at once, so no group is ever compared pair by pair.
6. Components of verified pairs, by alternating stars. The line at the least (doc_id, line_no) of a component stays.

Defined cases: a null text has no lines; an empty one has one line, which stays; a line shorter than k is one shingle; rows with
the same doc_id and line number share one fate; a null doc_id comes first; of equal lines the one of the least (doc_id, line_no)
stays, and ties there stay together; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of a signature, and hashes in each.
BANDS, ROWS = 10, 3
#: Length of the strings at word beginnings; from FEW of them on they are signed, and up to MANY all shingles are.
LONG, FEW, MANY = 9, 12, 17


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return C.id_and_text(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _takes_part() -> Column:
    return F.col("line").rlike(r"\S")


def _hashed(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.xxhash64(x))


def _shingles(line: Column, k: int) -> Column:
    """The set of all runs of k characters, hashed; a shorter line is one. Runs are cut at each of k starts, which needs no lookahead."""
    runs = [F.regexp_extract_all(F.substring(line, i + 1, 2147483647), F.lit(rf"(?s).{{{k}}}"), F.lit(0)) for i in range(k)]
    return F.array_distinct(_hashed(F.when(F.length(line) < k, F.array(line)).otherwise(F.concat(*runs))))


def _beginnings(line: Column, n: int) -> Column:
    """The strings of n characters at word beginnings."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?:^|\s)(?=(\S.{{{n - 1}}}))"), F.lit(1))


def _keys(hashes: Column, tag: int) -> Column:
    """Band keys, in order of bands; null for a bin without hashes."""
    none = [F.xxhash64(F.lit(tag + b), F.array().cast("array<bigint>")) for b in range(BANDS)]

    def of(h: Column) -> Column:
        def least(b: int) -> Column:
            return F.slice(F.filter(h, lambda x: F.pmod(x, F.lit(BANDS)) == b), 1, ROWS)

        return F.array(*[F.xxhash64(F.lit(tag + b), least(b)) for b in range(BANDS)])

    keys = F.transform(F.array(F.sort_array(F.array_distinct(hashes))), of)  # a lambda's variable is computed once
    return F.transform(F.get(keys, F.lit(0)), lambda x: F.when(~x.isin(*none), x))


def signed(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(name, keys) of every line; name is null for a line that takes no part; keys: one or two arrays of band keys."""
    part = lines(docs).withColumn("name", F.when(_takes_part(), F.xxhash64("line"))).withColumn("words", F.when(F.col("name").isNotNull(), _hashed(_beginnings(F.col("line"), LONG))))
    many = F.when(F.size("words") >= FEW, _keys(F.col("words"), 0))
    every = F.when((F.size("words") >= 0) & (F.size("words") <= MANY), _keys(_shingles(F.col("line"), k), BANDS))
    return part.select("name", F.array_compact(F.array(many, every)).alias("keys"))


def similar(pairs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Of (u, v, a, b) the pairs whose lines a and b have the Jaccard index or more."""

    def once(sets: tuple[Column, Column], test) -> Column:
        """``test`` on the sizes of two sets and of what both have; each set is computed once, as the variable of a lambda."""
        pair = F.array(F.struct(sets[0].alias("x"), sets[1].alias("y")))
        return F.get(F.transform(pair, lambda p: test(F.size(p["x"]) + F.size(p["y"]), F.size(F.array_intersect(p["x"], p["y"])))), F.lit(0))

    a, b = F.col("a"), F.col("b")
    most = lambda line: F.greatest(F.length(line) - (k - 1), F.lit(1))
    # of two sets of n shingles in all, (1 - t) / (1 + t) * n differ at most, and no subset of shingles differs in more
    bound = F.lit((1 - threshold) / (1 + threshold)) * (most(a) + most(b)) + F.lit(1e-9)
    some = tuple(F.array_distinct(_hashed(_beginnings(x, k))) for x in (a, b))
    rough = once(some, lambda n, both: n - 2 * both <= bound)
    exact = once((_shingles(a, k), _shingles(b, k)), lambda n, both: both >= F.lit(threshold) * (n - both) - F.lit(1e-9))
    return pairs.filter(rough & exact).select("u", "v")


def _bands(distinct: DataFrame) -> DataFrame:
    """(name, place, key), dealt by key; what takes all of its columns reads the same shuffle."""
    return distinct.select("name", "place", F.explode(F.flatten("keys")).alias("key")).filter("key is not null").repartition("key")


def _shared(band: DataFrame, *apart: str) -> DataFrame:
    """(key, hub) of the keys under which a column of ``apart`` has several values: the place of the first of them."""
    ends = [x for c in apart for x in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_z"))]
    return band.groupBy("key").agg(F.min("place").alias("hub"), *ends).filter(" AND ".join(f"{c}_a <> {c}_z" for c in apart)).select("key", "hub")


def _met(band: DataFrame, shared: DataFrame) -> DataFrame:
    """Of (key, name, place, ...) the rows of shared keys, with their hubs. These keys are few, so they are the side to build."""
    return band.join(shared.hint("shuffle_hash"), "key")


def _pairs(met: DataFrame) -> DataFrame:
    """(u, v): names and their hubs' names, unless both are of one class already."""
    hub = met.filter("place = hub").select("key", F.col("name").alias("v"), F.col("class").alias("w"))
    apart = met.filter("place <> hub").select("key", F.col("name").alias("u"), "class").join(hub, "key").filter("class <> w")
    return apart.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _several(rows: DataFrame) -> DataFrame:
    """The keys under which lines of several classes are."""
    return rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key")


def classes(docs: DataFrame, distinct: DataFrame, k: int, threshold: float, tables: C.Tables) -> DataFrame:
    """(node, component) of the names that are linked; distinct: (name, place, keys)."""
    band = _bands(distinct)
    met = tables.keep(_met(band, _shared(band, "name")).withColumn("class", F.col("name")), "met")
    tables.tidy()
    tried = tables.keep(_pairs(met), "pairs")
    wanted = tried.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    texts = lines(docs).filter(_takes_part()).select(F.xxhash64("line").alias("name"), "line").join(wanted, "name", "left_semi").dropDuplicates(["name"])
    texts = tables.keep(texts, "texts")  # all names that any later round pairs have met a hub in the first
    tables.tidy()

    def verified(pairs: DataFrame) -> tuple[DataFrame, dict]:
        both = pairs.join(texts.select(F.col("name").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("name").alias("v"), F.col("line").alias("b")), "v")
        return tables.observed(similar(both, k, threshold), "similar")

    found = components(verified(tried)[0], tables)
    sets = None
    for depth in range(2, BANDS + 1):
        of = met.drop("class").join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("class", F.coalesce("component", "name"))
        rest = of.join(_several(of), "key", "left_semi").drop("hub", "component")
        if sets is None:  # band keys of the names that are left
            sets = tables.keep(distinct.select("name", F.col("keys").alias("all")).join(rest.select("name").distinct().hint("shuffle_hash"), "name", "left_semi"), "sets")
        rest = rest.join(sets, "name")
        if depth == 2:  # a key's side (one of the two ways of signing) and its band
            rest = rest.withColumn("side", F.when(F.array_contains(F.get("all", F.lit(0)), F.col("key")), 0).otherwise(1)).withColumn("last", F.array_position(F.get("all", F.col("side")), F.col("key")).cast("int"))
        later = F.transform(F.get("all", F.col("side")), lambda x, i: F.when(i >= F.col("last"), F.struct(F.xxhash64("key", x).alias("key"), (i + 1).cast("int").alias("last"), x.alias("x"))))
        finer = rest.select("name", "place", "class", "side", F.explode(later).alias("to")).filter("to.x is not null").select("name", "place", "class", "side", F.col("to.key").alias("key"), F.col("to.last").alias("last"))
        finer = tables.keep(finer, "finer")
        before = met
        met, about = tables.observed(_met(finer, _shared(finer, "place", "class")), "met")
        tables.drop(finer, before)
        if not about["n"]:
            break
        fresh, about = tables.observed(_pairs(met).join(tried, ["u", "v"], "left_anti"), "fresh")
        if not about["n"]:
            continue
        tried = tried.unionByName(fresh)
        linked, about = verified(fresh)
        if about["n"]:  # known components are stars already
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(linked), tables)
    tables.drop(texts)
    return found


def judged(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, tables: C.Tables | None = None) -> DataFrame:
    """(doc_id, line_no, kept, keeper_doc_id, keeper_line_no) of every line."""
    tables = tables or C.Tables(docs.sparkSession)
    # the most frequent comes first, then the least name; among the few names of a key the places tell them apart
    rarity = F.lit(63) - F.floor(F.log2(F.col("n").cast("double"))).cast("long")
    place = F.shiftleft(rarity, 57) + F.shiftrightunsigned(F.col("name"), 7)
    distinct = signed(docs, k).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    distinct = tables.keep(distinct.select("name", "n", place.alias("place"), "keys"), "distinct")
    tables.tidy()
    found = classes(docs, distinct, k, threshold, tables).withColumnRenamed("node", "name")
    # names of several lines, equal or similar; all other lines are on their own
    shared = distinct.filter("n > 1").select("name").join(found, "name", "full").select("name", F.coalesce("component", "name").alias("class"))
    shared = tables.keep(shared, "shared")
    tables.drop(distinct)
    every = lines(docs).select("doc_id", "line_no", F.when(_takes_part(), F.xxhash64("line")).alias("name"))
    placed = tables.keep(every.join(shared.hint("shuffle_hash"), "name", "left").select("doc_id", "line_no", "class"), "placed")
    together = placed.filter("class is not null")
    keeper = together.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("keeper"))
    columns = ["doc_id", "line_no", "kept", "keeper_doc_id", "keeper_line_no"]
    alone = placed.filter("class is null").select("doc_id", "line_no", F.lit(True).alias("kept"), F.col("doc_id").alias("keeper_doc_id"), F.col("line_no").alias("keeper_line_no"))
    kept = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.line_no") == F.col("line_no"))
    judged_ = together.join(keeper, "class").select("doc_id", "line_no", kept.alias("kept"), F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"))
    return alone.unionByName(judged_).select(columns)


def dedup(docs: DataFrame, tables: C.Tables | None = None, **rules) -> DataFrame:
    """The documents without their removed lines, in their columns. A document of which only white space is left is dropped;
    one that loses no line stays as it is. ``n_chars`` follows the text, if there is such a column."""
    tables = tables or C.Tables(docs.sparkSession)
    own, cut, fates, whole = C.unused(docs, "doc", "text", "fate", "whole")
    fate = judged(docs, tables=tables, **rules).groupBy("doc_id", "line_no").agg(F.bool_or("kept").alias("kept"))
    flags = fate.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kept"))).alias(fates), F.bool_and("kept").alias(whole))  # a document's own lines
    flags = flags.filter(~F.col(whole)).select(F.col("doc_id").alias(own), F.transform(fates, lambda x: x["kept"]).alias(fates))
    text = F.col("text").cast("string")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.coalesce(F.get(fates, i), F.lit(True))), "\n")
    out = docs.join(flags, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").withColumn(cut, F.when(F.col(fates).isNull(), text).otherwise(left))
    out = out.filter(F.col(fates).isNull() | F.col(cut).rlike(r"\S"))
    new = {"text": F.col(cut)} | ({"n_chars": F.when(F.col(fates).isNull(), F.col("n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
