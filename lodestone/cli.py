"""Command line: create, info, get, search, validate, stats. ``python -m lodestone.cli --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestone.config import Metric
from lodestone.errors import DimensionMismatch, IndexOutOfBounds
from lodestone.operators import lookup, search
from lodestone.operators.quantizer import Quantizer
from lodestone.sources import btcp


def _spark() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _create(a: argparse.Namespace) -> None:
    spark = _spark()
    btcp.write(spark.createDataFrame([], "vec_id long, embedding array<float>"), a.path, Quantizer((0.0,) * a.dims, (1.0,) * a.dims), a.metric)
    print(f"created {a.path} with {a.dims} dims")


def _info(a: argparse.Namespace) -> None:
    m = btcp.open_file(a.path)
    h = m.header
    print(f"version {h.major}.{h.minor}\ndims {h.dims}\nvectors {h.vector_count}\nquantization {h.quant_type.name}\nmetric {h.metric.name}\nfooter {h.footer_offset}\nsize {m.file_size}\nchecksum {m.preview}")


def _get(a: argparse.Namespace) -> None:
    df, m = btcp.read(_spark(), a.path)
    if (row := lookup.get(m.quantizer.dequantize(df), a.id).first()) is None:
        raise IndexOutOfBounds(a.id, m.header.vector_count)
    print(" ".join(map(str, row["codes"])), " ".join(f"{x:.6f}" for x in row["decoded"]), sep="\n")


def _search(a: argparse.Namespace) -> None:
    df, m = btcp.read(_spark(), a.path)
    query = [float(x) for x in a.query.split(",")]
    if len(query) != m.header.dims:
        raise DimensionMismatch(m.header.dims, len(query))
    for i, r in enumerate(search.top_k(m.quantizer.dequantize(df), query, a.k, m.header.metric, "decoded").collect()):
        print(f"{i + 1} id={r['vec_id']} distance={r['distance']:.6f}")


def _validate(a: argparse.Namespace) -> None:
    report = btcp.validate(a.path)
    for k, v in report.items():
        print(k, v)
    if not report["is_valid"]:
        raise ValueError("file is not valid")


def _stats(a: argparse.Namespace) -> None:
    h = btcp.open_file(a.path).header
    print(f"data {h.data_len}\noriginal {4 * h.data_len}\nratio {4.0 if h.data_len else 0.0}")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestone")
    sub = top.add_subparsers(required=True)
    for name, run, *more in (("create", _create, ("--dims", int, 8), ("--metric", Metric.of, "l2")), ("info", _info), ("get", _get, ("id", int, None)), ("search", _search, ("query", str, None), ("-k", int, 5)), ("validate", _validate), ("stats", _stats)):
        p = sub.add_parser(name)
        p.add_argument("path")
        for flag, kind, default in more:
            p.add_argument(flag, type=kind, **({"default": default} if flag[0] == "-" else {}))
        p.set_defaults(run=run)
    a = top.parse_args(argv)
    try:
        a.run(a)
    except (ValueError, OSError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
