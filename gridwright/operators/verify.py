"""The structural verifier, table scoring and the escalation policies."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, scoring


def with_grids(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds `grids`, a grid for each table block. Blocks stay in their page's row: nothing is shuffled; pages without a
    block don't differ for Python but by an empty list.
    """
    return pages.withColumn("grids", html.grids(html.table_blocks(F.col(text))))


def table_code(grid: Column) -> Column:
    """A table's failure code, or null: errors; no rows, or only empty cells."""
    empty = (grid["n_rows"] == 0) | F.forall(grid["cells"], lambda c: c["text"] == "")
    return F.coalesce(grid["error"], F.when(empty, F.lit(html.DEGENERATE_TABLE)))


def verified(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds verifier_decision, verifier_failure_codes (distinct, first seen first), predicted_table_count,
    html_parse_ok, span_normalization_ok and tables (index, rows, cols, failure_codes).
    """
    out = with_grids(pages, text) if "grids" not in pages.columns else pages
    grids = F.col("grids")
    tables = F.transform(
        grids,
        lambda g, i: F.struct(
            i.alias("index"), g["n_rows"].alias("rows"), g["n_cols"].alias("cols"),
            F.filter(F.array(table_code(g)), lambda c: c.isNotNull()).alias("failure_codes")
        )
    )
    codes = F.when(F.size(grids) == 0, F.array(F.lit(html.NO_TABLE_FOUND))).otherwise(F.array_distinct(F.flatten(F.transform(F.col("tables"), lambda t: t["failure_codes"]))))
    out = out.withColumn("tables", tables).withColumn("verifier_failure_codes", codes).withColumn("predicted_table_count", F.size(grids))
    out = out.withColumn("verifier_decision", F.when(F.size("verifier_failure_codes") == 0, F.lit(html.PASS)).otherwise(F.lit(html.REPARSE)))
    return out.withColumn("html_parse_ok", ~F.array_contains("verifier_failure_codes", html.HTML_PARSE_ERROR)).withColumn(
        "span_normalization_ok",
        ~F.arrays_overlap("verifier_failure_codes", F.array(F.lit(html.SPAN_EXPANSION_FAILED), F.lit(html.RECTANGULAR_INCONSISTENCY)))
    )


def should_reparse() -> Column:
    return F.col("verifier_decision") == html.REPARSE


def random_reparse(page_id: Column, seed: int, probability: float) -> Column:
    """A draw for each page, from a generator seeded by the seed and the page's id, so it doesn't depend on order. No
    draw is made for probabilities of 0 or 1.
    """
    if probability <= 0 or probability >= 1:
        return F.lit(probability >= 1)

    @F.arrow_udf("boolean")
    def draw(ids: pa.Array) -> pa.Array:
        return pa.array([None if p is None else random.Random(f"{seed}:{p}").random() < probability for p in ids.to_pylist()], pa.bool_())

    return draw(page_id)


def scored(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of outputs (page_id, raw_text and any others) against gold (page_id, html).

    Adds precision, recall, cell_f1, text_similarity, gold_cells, pred_cells, pred_parse_error, gold_missing. A
    prediction with a bad table counts as having none and keeps the error; a page without gold scores 0; bad gold fails
    the query. Texts are joined by page_id before they are expanded, both are expanded and compared in one go, and only
    counts come back.
    """
    g = gold.select(F.col("page_id").alias("gold_id"), "html")
    out = outputs.join(g, outputs["page_id"] == g["gold_id"], "left").withColumn("gold_missing", F.col("gold_id").isNull())
    wanted = F.when(~F.col("gold_missing"), html.table_blocks(F.col("html")))
    out = out.withColumn("found", scoring.compared(html.table_blocks(F.col("raw_text")), wanted))
    c = F.col("found")
    bad = F.raise_error(F.concat(F.lit("gold can't be expanded: "), F.col("gold_id"))).cast("struct<precision:double,recall:double,f1:double>")
    out = out.withColumn("s", F.when(c["gold_ok"] == F.lit(False), bad).otherwise(scoring.prf(c["hits"], c["pred_cells"], c["gold_cells"])))
    zero = lambda x: F.when(F.col("gold_missing"), F.lit(0.0)).otherwise(x)
    out = out.withColumns({"precision": zero(F.col("s.precision")), "recall": zero(F.col("s.recall")), "cell_f1": zero(F.col("s.f1")), "text_similarity": zero(scoring.similarity(c))})
    out = out.withColumns({"gold_cells": c["gold_cells"], "pred_cells": c["pred_cells"], "pred_parse_error": F.when(~F.col("gold_missing"), c["error"])})
    return out.drop("s", "found", "gold_id", "html")


def macros(scores: DataFrame, *by: str) -> DataFrame:
    """Means over the pages that have gold (0 if there are none) and counts of pages, with gold, with a parse error."""
    has = F.col("gold_missing") == F.lit(False)
    mean = lambda c: F.coalesce(F.avg(F.when(has, F.col(c))), F.lit(0.0))
    return scores.groupBy(*by).agg(
        mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("cell_f1").alias("macro_cell_f1"),
        mean("text_similarity").alias("macro_text_similarity"), F.count(F.lit(1)).alias("pages_total"), F.count_if(has).alias("pages_with_gold"),
        F.count_if(F.col("pred_parse_error").isNotNull()).alias("pages_with_parse_error")
    )
