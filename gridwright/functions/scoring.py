"""Cell precision, recall and F1, and text similarity, of predicted against gold tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html
from .distance import distance

# How the scorer names a page's first bad table.
ERRORS = {html.HTML_PARSE_ERROR: "html_parse_error", html.SPAN_EXPANSION_FAILED: "span_expansion_failed", html.RECTANGULAR_INCONSISTENCY: "not_rectangular"}


LONG = 1500  # characters of the longer text up to which the built-in edit distance is as fast

COMPARED = "struct<error:string,gold_ok:boolean,pred_cells:long,gold_cells:long,hits:long,pred_text:string,gold_text:string,distance:long,longest:long>"
_COMPARED = pa.struct(
    [
        ("error", pa.string()), ("gold_ok", pa.bool_()), *((c, pa.int64()) for c in ("pred_cells", "gold_cells", "hits")), ("pred_text", pa.string()),
        ("gold_text", pa.string()), ("distance", pa.int64()), ("longest", pa.int64())
    ]
)


def page(blocks: list[str]) -> tuple[str | None, set[tuple[int, int, int, str]], str]:
    """A page's first error, or no_tables; its cells (table, row, column, text) with spans filled and white space
    collapsed, empty ones too; and its text: cells by tabs, rows by newlines, a blank line between tables, stripped at
    the ends. A page in error has neither.
    """
    cells, texts = set(), []
    for i, block in enumerate(blocks):
        try:
            _, columns, found = html.expand(block)
        except html.TableError as e:
            return ERRORS[str(e)], set(), ""
        filled = [" ".join(f.split()) for _, _, _, f in found]
        cells.update((i, r, c, text) for (r, c, _, _), text in zip(found, filled))
        texts.append("\n".join("\t".join(filled[k : k + columns]) for k in range(0, len(filled), max(1, columns))))
    return (None if blocks else "no_tables"), cells, "\n\n".join(texts).strip()


def _compare(pred: pa.Array, gold: pa.Array) -> pa.Array:
    def one(p: list[str] | None, g: list[str] | None) -> dict:
        error, cells, text = page(p or [])
        out = {"error": error, "pred_cells": len(cells), "gold_cells": 0}
        if g is None:
            return out
        bad, golden, want = (error, cells, text) if p == g else page(g)
        longest = max(len(text), len(want))
        out |= {"gold_ok": bad is None, "gold_cells": len(golden), "hits": len(cells & golden), "longest": longest}
        if text == want or not text or not want:
            out["distance"] = longest if text != want else 0
        elif longest > LONG:
            out["distance"] = distance(text, want)
        else:
            out |= {"pred_text": text, "gold_text": want}
        return out

    return pa.array([one(p, g) for p, g in zip(pred.to_pylist(), gold.to_pylist())], _COMPARED)


def compared(pred: Column, gold: Column) -> Column:
    """Of a page's predicted and gold blocks (null: there is no gold), in one Arrow round trip: the prediction's error;
    whether the gold tables are there and good; cells, and how many both have; the texts' edit distance and the longer
    length, or the texts themselves where the built-in distance does. No cell comes back.
    """
    return F.arrow_udf(_compare, COMPARED)(pred, gold)


def prf(hits: Column, n: Column, m: Column) -> Column:
    """precision, recall, f1 of n predicted and m gold cells that share `hits`: all 1 if both are none, all 0 if one is.
    """

    def ladder(x: Column) -> Column:
        return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | (hits == 0), F.lit(0.0)).otherwise(x)

    return F.struct(ladder(F.try_divide(hits, n)).alias("precision"), ladder(F.try_divide(hits, m)).alias("recall"), ladder(F.try_divide(2 * hits, n + m)).alias("f1"))


def similarity(c: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty texts."""
    found = F.coalesce(c["distance"], F.levenshtein(c["pred_text"], c["gold_text"]))
    return F.when(found == 0, F.lit(1.0)).otherwise(1 - F.try_divide(found, c["longest"]))
