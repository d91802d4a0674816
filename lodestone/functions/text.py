"""Vectors as text: parsing, formatting and small codecs, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def parse_vector(s: Column | str, lenient: bool = False) -> Column:
    """Comma-separated floats. A bad token raises, or is left out if ``lenient``."""
    parts = F.transform(F.split(_col(s), ","), lambda x: F.trim(x))
    if lenient:
        return F.filter(F.transform(parts, lambda x: x.try_cast("float")), lambda x: x.isNotNull())
    return F.transform(parts, lambda x: x.cast("float"))


def parse_vectors(s: Column | str) -> Column:
    """A JSON array of arrays of numbers, strictly; null if it is none."""
    return F.from_json(_col(s), "array<array<float>>")


def fixed(v: Column | str, digits: int, between: str) -> Column:
    """An array's numbers with so many decimals, rounded from their exact binary value, ties to even, as in C and SQL's printf.
    Java's formatter, hence ``format_string``, takes ties up and pads numbers of over 17 digits with zeros. Null numbers are left out."""

    def lines(arrays: pa.Array) -> pa.Array:
        flat, ends, formats, out = arrays.values, arrays.offsets.to_pylist(), {}, []
        whole = None if flat.null_count else flat.to_numpy()
        for valid, a, b in zip(arrays.is_valid().to_pylist(), ends, ends[1:], strict=False):
            row = () if not valid else [x for x in flat[a:b].to_pylist() if x is not None] if whole is None else whole[a:b].tolist()
            if (how := formats.get(len(row))) is None:
                how = formats[len(row)] = between.join([f"%.{digits}f"] * len(row))
            out.append(how % tuple(row) if valid else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(lines, "string")(_col(v).cast("array<double>"))


def format_vector(v: Column | str, most: int) -> Column:
    return fixed(F.slice(_col(v), 1, max(most, 1)) if most else F.array().cast("array<float>"), 4, ", ")


def hex_preview(b: Column | str) -> Column:
    """The first eight bytes in hex."""
    return F.concat(F.lower(F.substring(F.hex(_col(b)), 1, 16)), F.lit("…"))


def url_query(q: Column | str) -> Column:
    """Query string as a map; the last of equal keys wins, escapes are UTF-8."""
    pairs = F.filter(F.split(_col(q), "&"), lambda p: p != "")
    unescape = lambda x: F.try_url_decode(x)
    value = lambda p: F.when(F.contains(p, F.lit("=")), unescape(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit(""))
    keyed = F.transform(pairs, lambda p: F.struct(unescape(F.substring_index(p, "=", 1)).alias("key"), value(p).alias("value")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def json_escape(s: Column | str) -> Column:
    """A string as it stands between the quotes of JSON."""
    return F.regexp_replace(F.to_json(F.array(_col(s))), r'^\["|"\]$', "")
