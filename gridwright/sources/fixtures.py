"""Deterministic stand-ins over the driver's tables, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.text import token_count
from ..plans import inference

SYSTEMS = (
    # ord, system_id, runner, adaptive, low, high, budget_name, tiles
    (0, "adaptive_2b", "adaptive", True, 4, 10, None, None),
    (1, "fixed_2b_low", "single_pass", False, None, None, "B_low", 4),
    (2, "fixed_2b_matched", "single_pass", False, None, None, "B_fix_2B", 10),
    (3, "random_2b_seed0", "adaptive_random", True, 4, 10, None, None),
    (4, "random_2b_seed1", "adaptive_random", True, 4, 10, None, None),
    (5, "random_2b_seed2", "adaptive_random", True, 4, 10, None, None),
    (6, "fixed_8b_matched", "single_pass", False, None, None, "B_fix_8B", 10),
)
SYSTEM_SCHEMA = "ord int, system_id string, runner string, adaptive boolean, low int, high int, budget_name string, tiles int"
TARGETS = {"B_fix_2B": 9.5, "B_fix_8B": 9.5}
OVERLAP = '<table><tr><td>north</td><td>south</td><td rowspan="2">east</td></tr><tr><td>up</td><td colspan="2">down</td></tr></table>'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, SYSTEM_SCHEMA)


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('page_', lpad(cast(doc_id as string), 7, '0')) as page_id",
        "concat('images/page_', lpad(cast(doc_id as string), 7, '0'), '.png') as image_path",
        "lang as language",
        "doc_id % 3 <> 0 as contains_table",
        "coalesce(lang = 'en', false) and doc_id % 3 <> 0 as is_english_table_page",
        "case when doc_id % 3 <> 0 then cast(n_chars % 40 as int) end as row_count",
        "case when doc_id % 3 <> 0 then cast(n_chars % 9 as int) end as col_count",
        "doc_id % 7 = 0 as has_merged_cells",
        "doc_id % 11 = 0 as has_nested_headers",
    )


PAGE_RECORDS = """page_records as (select 'page_' || lpad(cast(doc_id as varchar), 7, '0') as page_id,
  'images/page_' || lpad(cast(doc_id as varchar), 7, '0') || '.png' as image_path, lang as language,
  doc_id % 3 <> 0 as contains_table, coalesce(lang = 'en', false) and doc_id % 3 <> 0 as is_english_table_page,
  case when doc_id % 3 <> 0 then cast(n_chars % 40 as int) end as row_count,
  case when doc_id % 3 <> 0 then cast(n_chars % 9 as int) end as col_count,
  doc_id % 7 = 0 as has_merged_cells, doc_id % 11 = 0 as has_nested_headers from documents)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id div 7 as page_no", "cast(event_id % 7 as int) as ord", "value", "event_type", "cast(get_json_object(props, '$.k') as long) as k"
    )
    log = e.join(F.broadcast(systems(spark).select("ord", "system_id", "adaptive")), "ord")
    hit = "event_type in ('error', 'purchase')"
    return log.selectExpr(
        "system_id", "cast(page_no as int) as line_no", "concat('page_', lpad(cast(page_no as string), 7, '0')) as page_id",
        f"case when adaptive then {hit} end as reparse_triggered",
        f"case when adaptive then case when {hit} then 'REPARSE' else 'PASS' end end as verifier_decision",
        "case when adaptive then case event_type when 'error' then array('NO_TABLE_FOUND') when 'purchase' then array('DEGENERATE_TABLE') else cast(array() as array<string>) end end as verifier_failure_codes",
        "case when adaptive then case event_type when 'error' then 0 else cast(k % 3 + 1 as int) end end as predicted_table_count",
        "case when adaptive then k end as first_pass_output_tokens",
        f"case when adaptive and {hit} then 2 * k end as reparse_output_tokens",
        "case when not adaptive then k end as output_token_count",
        "case when adaptive then value end as total_runtime_ms", "case when not adaptive then value end as runtime_ms", "'table_parse_v2' as prompt_id",
    )


RUN_LOG = """systems(ord, system_id, adaptive, low, high, budget_name, tiles) as (values
  (0, 'adaptive_2b', true, 4, 10, null, null), (1, 'fixed_2b_low', false, null, null, 'B_low', 4),
  (2, 'fixed_2b_matched', false, null, null, 'B_fix_2B', 10), (3, 'random_2b_seed0', true, 4, 10, null, null),
  (4, 'random_2b_seed1', true, 4, 10, null, null), (5, 'random_2b_seed2', true, 4, 10, null, null),
  (6, 'fixed_8b_matched', false, null, null, 'B_fix_8B', 10)),
run_log as (select s.system_id, s.ord, s.adaptive, s.low, s.high, s.tiles, event_id // 7 as page_no,
  'page_' || lpad(cast(event_id // 7 as varchar), 7, '0') as page_id, value, event_type,
  cast(json_extract_string(props, '$.k') as bigint) as k, s.adaptive and event_type in ('error', 'purchase') as hit
  from events e join systems s on s.ord = e.event_id % 7)"""


def order_html(spark: SparkSession, sf_dir: str, clean: bool = False) -> DataFrame:
    """k, n, page_id, raw_text: a table of an order's lines, damaged by k % 8 unless `clean`."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", "struct(l_linenumber as l, l_partkey as p, l_suppkey as s, cast(l_quantity as bigint) as q, l_returnflag as f) as x")
    # Dealt by a fixed number: what follows is heavy for each row, and small shuffles would be joined into one task.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    rows = rows.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("n", F.size("x"))
    mode = F.lit(7) if clean else F.col("k") % 8

    def line(x, i):
        cells = F.concat(F.lit("<tr><td>"), x["p"].cast("string"), F.lit("</td><td>"), x["q"].cast("string"), F.lit("</td>"))
        short = (mode == 1) & (i == F.col("n") - 1)
        full = F.concat(cells, F.when(short, F.lit("")).otherwise(F.concat(F.lit("<td>"), x["f"], F.lit("</td>"))), F.lit("</tr>"))
        return F.when(mode == 5, F.lit("<tr><td> </td><td></td><td> </td></tr>")).otherwise(full)

    head = F.when(mode == 2, F.lit('<tr><th colspan="2">part qty</th><th>flag</th></tr>')).when(
        mode == 3, F.lit('<tr><th colspan="0">part</th><th>qty</th><th>flag</th></tr>')
    ).when(mode == 5, F.lit("")).otherwise(F.lit("<tr><th>part</th><th>qty</th><th>flag</th></tr>"))
    text = F.concat(
        F.lit("# order "), F.col("k").cast("string"), F.lit(" <table>"), head, F.array_join(F.transform("x", line), ""), F.lit("</table>"),
        F.when(mode == 6, F.lit(" and <table></table>")).otherwise(F.lit(""))
    )
    text = F.when(mode == 0, F.concat(F.lit("# order "), F.col("k").cast("string"))).when(mode == 4, F.lit(OVERLAP)).otherwise(text)
    return rows.select("k", "n", F.concat(F.lit("order_"), F.col("k").cast("string")).alias("page_id"), text.alias("raw_text"))


ORDER_HTML = f"""lines as (select l_orderkey as k, l_linenumber as l, l_partkey as p, l_suppkey as s, cast(l_quantity as bigint) as q,
  l_returnflag as f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), l_returnflag) as r,
  count(*) over (partition by l_orderkey) as n from lineitem),
order_html as (select k, max(n) as n, case when k % 8 = 0 then '# order ' || k when k % 8 = 4 then '{OVERLAP}' else
  '# order ' || k || ' <table>' || case k % 8 when 2 then '<tr><th colspan="2">part qty</th><th>flag</th></tr>' when 3 then '<tr><th colspan="0">part</th><th>qty</th><th>flag</th></tr>' when 5 then '' else '<tr><th>part</th><th>qty</th><th>flag</th></tr>' end
  || string_agg(case when k % 8 = 5 then '<tr><td> </td><td></td><td> </td></tr>' else '<tr><td>' || p || '</td><td>' || q || '</td>' || case when k % 8 = 1 and r = n then '' else '<td>' || f || '</td>' end || '</tr>' end, '' order by r)
  || '</table>' || case when k % 8 = 6 then ' and <table></table>' else '' end end as raw_text from lines group by k)"""


# Markup that doesn't close or nest as it should, by o_orderkey // 32 % 14: A and B stand for two values. With it what comes
# out: rows and columns (0 for an error), and the cells' texts or the error's code.
LENIENT = (
    ("<table><tr><td>A<td>B<tr><td>C<th>D</table>", 2, 2, "A|B|C|D"),
    ("<table><tr><b><td>A</td></b><td>B</td></tr></table>", 1, 2, "A|B"),
    ("<table><tr><i><td>A</td></i><td>B</td></tr></table>", 1, 1, "B"),
    ("<table><tr><td>A<table><tr><td>B</td></tr></table>", 1, 1, "AB"),
    ("<table-x><tr><td>A</td></tr></table>", 0, 0, "HTML_PARSE_ERROR"),
    ("<table>stray<tr>loose<td>A</td>tail</tr><td>B</td></table>", 1, 1, "A"),
    ("<table><tr><td>A</b></p></i> B</td></tr></table>", 1, 1, "A B"),
    ("<table><tr><td>A<thead><tr><th>B</th></tr></thead></table>", 2, 1, "AB|B"),
    ("<table><tr><td>A<div><td>B</td></div></td></tr></table>", 1, 1, "AB"),
    ("<table><tr><td>A</tr><tr><td>B</table>", 2, 1, "A|B"),
    ("<table><tbody><tr><td>A<tbody><tr><td>B</table>", 2, 1, "A|B"),
    ("<table><tr/><tr><td>A</td></tr></table>", 0, 0, "RECTANGULAR_INCONSISTENCY"),
    ("<table><tr><td>A<div><tr><td>B</td></tr></div></td><td>C</td></tr></table>", 0, 0, "RECTANGULAR_INCONSISTENCY"),
    ("<table><caption>no<tr><td>A<br>B</td></table>", 1, 1, "AB"),
)


def lenient_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and raw_text: one of LENIENT with an order's customer and status for A and B."""
    text = F.get(F.array(*(F.lit(x[0]) for x in LENIENT)), (F.col("o_orderkey") / 32).cast("int") % len(LENIENT))
    filled = F.replace(F.replace(text, F.lit("A"), F.concat(F.lit("a"), F.col("o_custkey").cast("string"))), F.lit("B"), F.concat(F.lit("b"), F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), filled.alias("raw_text"))


def _lenient(column: int) -> str:
    shown = [x[column] for x in LENIENT]
    return f"list_extract([{', '.join(repr(x) for x in shown)}], cast(o_orderkey // 32 % {len(LENIENT)} + 1 as int))"


LENIENT_HTML = f"""lenient as (select o_orderkey as k, {_lenient(1)} as n, {_lenient(2)} as m, {_lenient(3)} as told,
  case when {_lenient(1)} = 0 then {_lenient(3)} else replace(replace({_lenient(3)}, 'A', 'a' || o_custkey), 'B', 'b' || o_orderstatus) end as result from orders)"""

def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height and content of the documents' pages: PNG files of one colour each."""

    @F.arrow_udf("binary")
    def image(width: pa.Array, height: pa.Array, grey: pa.Array) -> pa.Array:
        return pa.array([pixels.encode(np.full((h, w, 3), g, np.uint8)) for w, h, g in zip(width.to_pylist(), height.to_pylist(), grey.to_pylist())], pa.binary())

    sizes = table(spark, sf_dir, "documents").selectExpr(
        "concat('page_', lpad(cast(doc_id as string), 7, '0')) as page_id", "cast(8 + doc_id % 23 as int) as width",
        "cast(8 + n_chars % 31 as int) as height", "cast(doc_id % 256 as int) as grey"
    )
    return sizes.select("page_id", "width", "height", image("width", "height", "grey").alias("content"))


PAGE_IMAGES = """page_images as (select 'page_' || lpad(cast(doc_id as varchar), 7, '0') as page_id, cast(8 + doc_id % 23 as int) as w, cast(8 + n_chars % 31 as int) as h, doc_id % 256 as grey from documents),
tilings as (select w, h, cols, (n // cols) as rows from (select w, h, n, cols, row_number() over (partition by w, h order by abs(cols / (n // cols) - w / h), n, cols) as i
  from (select distinct w, h from page_images), range(1, 13) a(n), range(1, 13) b(cols) where n % cols = 0) where i = 1)"""

NOTHING, HOLLOW = "no table here", "<table></table>"  # three words, and one


def uneven(pages: DataFrame, model: inference.Model, budget: inference.Budget, prompt: inference.Prompt) -> DataFrame:
    """An adapter that fails the verifier on known pages: of page numbers n, n % 5 = 0 has no table and n % 5 = 1 an
    empty one; with 8 tiles or more only n % 10 = 0 fails.
    """
    n, rich = F.substring("page_id", 6, 20).cast("long"), budget.max_tiles >= 8
    out = inference.stub(pages, model, budget, prompt)
    nothing = n % (10 if rich else 5) == 0
    text = F.when(nothing, F.lit(NOTHING)).when((n % 5 == 1) & F.lit(not rich), F.lit(HOLLOW)).otherwise(F.col("raw_text"))
    return out.withColumn("raw_text", text).withColumn("output_tokens", token_count(F.col("raw_text"))).withColumn("runtime_ms", F.lit(float(budget.max_tiles)))


inference.register("uneven", uneven)
# Page numbers and what `uneven` makes of them: whether the first pass fails, and the tokens of both passes.
UNEVEN = """uneven as (select page_id, n, n % 5 < 2 as again, case n % 5 when 0 then 3 when 1 then 1 else 9 end as first, case when n % 10 = 0 then 3 else 9 end as second
  from (select page_id, cast(substr(page_id, 6) as bigint) as n from page_records))"""


def annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and entry (VARIANT): the place of the language and the HTML key vary by doc_id."""
    parts = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "concat('imgs/p ', cast(doc_id as string), '.v1.png') as img",
        "concat('<table><tr><td>', cast(n_chars as string), '</td></tr></table>') as h"
    )
    language = "case doc_id % 4 when 0 then concat('\"page_info\":{\"image_path\":\"', img, '\",\"page_attribute\":{\"language\":\"', upper(lang), '\"}}') when 1 then concat('\"page_info\":{\"image_path\":\"', img, '\",\"language\":\"', lang, ' \"}') when 2 then concat('\"image_path\":\"', img, '\",\"page_attribute\":{\"language\":\"', lang, '\"}') else concat('\"image_path\":\"', img, '\",\"x\":[{\"y\":{\"language\":\"', lang, '\"}}]') end"
    key = "element_at(array('html', 'html_str', 'table_html', 'html_seq'), cast(doc_id % 4 as int) + 1)"
    return parts.selectExpr(
        "doc_id",
        f"parse_json(concat('{{', {language}, ',\"layout_dets\":[{{\"category_type\":\"text\"}},{{\"category_type\":\"table\",\"', {key}, '\":\"', h, '\"}}]}}')) as entry"
    )
