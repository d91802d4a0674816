"""The queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common as C


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality_classifier

    return quality_classifier.score(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality_rules

    found = quality_rules.judge(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import suffix_dedup

    return suffix_dedup.dedup(C.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    return toxicity.score(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import packing

    return packing.pack(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import decontaminate

    found = decontaminate.find(C.documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",").alias("items"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    return pii.find(C.documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from lodestone.llm import jaccard_join

    return jaccard_join.join(C.documents(spark, sf_dir), k=4, threshold=Fraction(85, 100))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import token_counts

    return token_counts.token_counts(C.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import line_dedup

    return line_dedup.judged(C.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_toxicity,
        op3_best_fit_packing,
        op4_benchmark_decontamination,
        op5_pii,
        op6_quality_classifier,
        op7_quality_rules,
        op8_jaccard_join,
        op9_token_counts,
        op10_line_dedup,
    )
}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingled_sql(name: str, words: str, k: int, key: str, table: str) -> str:
    """A table (key, s) of the distinct shingles of k words, or of all words if they are fewer."""
    run = f"list_transform(range(1, greatest(len(w) - {k} + 2, 2)), lambda i: array_to_string(w[i:i + {k - 1}], chr(10)))"
    return f"{name} AS (SELECT DISTINCT {key}, unnest({run}) AS s FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)"


_BARE = "list_filter(list_transform(" + _WORDS.format(_LOWER.format("text")) + ", lambda x: trim(x, '.,;:!?\"''()[]{}|*#$%&<>')), lambda x: x <> '')"
#: The other operators are not expressible in SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": (
        f"WITH {_shingled_sql('d', _BARE, 5, 'doc_id', 'documents')}, {_shingled_sql('q', _BARE, 5, 'item_id', 'benchmark')}, n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), "
        "h AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN q USING (s) GROUP BY doc_id, item_id), f AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM h JOIN n USING (item_id) WHERE 10 * c >= 8 * n GROUP BY doc_id) "
        "SELECT doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items FROM documents LEFT JOIN f USING (doc_id)"
    ).replace("doc_id, f.doc_id IS NOT NULL", "documents.doc_id, f.doc_id IS NOT NULL"),
    "op8_jaccard_join": (
        f"WITH RECURSIVE {_shingled_sql('d', _WORDS.format(_LOWER.format('text')), 4, 'doc_id', 'documents')}, n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), "
        "p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2), "
        "l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 85 * (m.n + o.n - c)), "
        "r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), "
        "g AS (SELECT a, min(b) AS g FROM r GROUP BY a) "
        "SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(g.g, t.doc_id)) AS component_id FROM documents t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN g ON g.a = t.doc_id"
    ),
}
