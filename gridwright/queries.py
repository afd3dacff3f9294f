"""Queries over the stand-in tables, one for each group of operators, with their SQL.

Where an operator parses HTML, the SQL follows how the tables were made, not the parser.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html
from .functions.text import page_id_from_path, token_count
from .operators import dataset, summary, verify
from .plans import analysis, calibration, experiment, freeze, inference, runners
from .sources import fixtures as fx
from .sources import json_tables, shared, sinks
from .streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

STUB_2B, STUB_8B = inference.Model("stub_2b", "stub"), inference.Model("stub_8b", "stub")
PROMPT = inference.Prompt("table_parse_v2", 2)
RULE = dataset.HardTableRule(20, 6, ("has_merged_cells", "has_nested_headers"))
SETTINGS = calibration.Settings((2, 4, 6), (8, 12, 16), (4, 6, 8, 10), 6.0)
FROZEN = {
    "schema_version": 1, "pinning": {"cost_unit": "max_tiles"},
    "budgets": {
        "B_low": {"name": "B_low", "max_tiles": 4, "model_name": "stub_2b", "adapter_kind": "stub"},
        "B_high": {"name": "B_high", "max_tiles": 10, "model_name": "stub_2b", "adapter_kind": "stub"},
        "B_fix_2B": {"name": "B_fix_2B", "max_tiles": 10, "model_name": "stub_2b", "adapter_kind": "stub"},
        "B_fix_8B": {"name": "B_fix_8B", "max_tiles": 10, "model_name": "stub_8b", "adapter_kind": "stub"}
    },
    "selection": {"adaptive": {"target": 10.0, "measured": 9.5, "low": 4, "high": 10}}
}


def query(sql: str | None = None, *ctes: str):
    """Register a query and its SQL over the given common table expressions."""

    def add(f):
        if f.__name__.startswith("q_"):
            f.__name__ = f.__name__[2:]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            env = spark.sparkContext.environment
            if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
                env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = (f"with {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


P, L, H = fx.PAGE_RECORDS, fx.RUN_LOG, fx.ORDER_HTML
KEPT = "case when hit then 2 * k else k end"


@query(f"""select s.system_id, count(k) as sample_size, round(coalesce(avg(value), 0), 6) as mean_runtime_ms, round(coalesce(quantile_cont(value, 0.95), 0), 6) as p95_runtime_ms,
  round(coalesce(avg({KEPT}), 0), 6) as mean_output_tokens, (case when s.adaptive then count(*) filter (where hit) end)::double as reparse_count,
  case when s.adaptive then round(coalesce(avg(hit::int), 0), 6) end as reparse_rate, round(case when s.adaptive then coalesce(avg(l.low + case when hit then l.high else 0 end), 0) else s.tiles::double end, 6) as cost_tiles
  from systems s left join run_log l using (system_id) group by s.system_id, s.adaptive, s.tiles""", L)  # fmt: skip
def results_table(spark, sf_dir):
    out = summary.summaries(fx.run_log(spark, sf_dir), fx.systems(spark).select("system_id", "adaptive", "low", "high", "tiles"))
    # Nullable whole numbers as doubles, which both engines show alike.
    return rounded(out.drop("adaptive", "low", "high", "tiles").withColumn("reparse_count", F.col("reparse_count").cast("double")))


@query("""select s.system_id, round(m.measured, 6) as measured, t.target, round(m.measured - t.target, 6) as delta, round((m.measured - t.target) / t.target, 6) as relative_delta,
  case when s.adaptive then 'low=' || s.low || ' / high=' || s.high else s.budget_name || '=' || s.tiles end as label
  from systems s join (select system_id, case when any_value(adaptive) then avg(low + case when hit then high else 0 end) else any_value(tiles)::double end as measured from run_log group by 1) m using (system_id)
  left join (values ('B_fix_2B', 9.5::double), ('B_fix_8B', 9.5::double)) t(budget_name, target) on t.budget_name = s.budget_name""", L)  # fmt: skip
def cost_summary(spark, sf_dir):
    out = summary.summaries(fx.run_log(spark, sf_dir), fx.systems(spark).drop("ord", "runner"), p95=False)
    return rounded(summary.cost_summary(out, summary.Targets(fx.TARGETS)))


@query("select system_id, case event_type when 'error' then 'NO_TABLE_FOUND' else 'DEGENERATE_TABLE' end as code, count(*) as n from run_log where hit group by 1, 2", L)
def reparse_histogram(spark, sf_dir):
    return summary.code_histogram(fx.run_log(spark, sf_dir))


@query("select system_id, case when hit then 'REPARSE' else 'PASS' end as decision, count(*) as n from run_log where adaptive group by 1, 2", L)
def decision_histogram(spark, sf_dir):
    return summary.histogram(fx.run_log(spark, sf_dir), F.col("verifier_decision"), "decision")


@query("select system_id, case when event_type = 'error' then 0 else cast(k % 3 + 1 as int) end as tables, count(*) as n from run_log where adaptive group by 1, 2", L)
def table_count_histogram(spark, sf_dir):
    return summary.histogram(fx.run_log(spark, sf_dir), F.col("predicted_table_count"), "tables")


@query("select page_id, language from page_records where is_english_table_page and contains_table", P)
def english_table_pages(spark, sf_dir):
    return dataset.english_table_pages(fx.page_records(spark, sf_dir)).select("page_id", "language")


@query(
    "select page_id, row_count, col_count from page_records where is_english_table_page and (coalesce(row_count, 0) >= 20 or coalesce(col_count, 0) >= 6 or has_merged_cells or has_nested_headers)",
    P
)
def hard_table_pages(spark, sf_dir):
    return dataset.hard_table_pages(dataset.english_table_pages(fx.page_records(spark, sf_dir)), RULE).select("page_id", "row_count", "col_count")


@query("select page_id, image_path from page_records where is_english_table_page order by image_path, page_id limit 20", P)
def top_pages_by_name(spark, sf_dir):
    return dataset.english_table_pages(fx.page_records(spark, sf_dir)).orderBy("image_path", "page_id").limit(20).select("page_id", "image_path")


@query(r"select page_id as id, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_-]', '_', 'g'), ''), 'page') as page_id from pages")
def page_id_from_url(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), page_id_from_path(F.col("url")).alias("page_id"))


@query(r"select k, unnest(range(len(b))) as pos, unnest(b) as block from (select k, regexp_extract_all(raw_text, '(?is)<table\b[^>]*>.*?</table\s*>') as b from order_html)", H)
def table_blocks(spark, sf_dir):
    return fx.order_html(spark, sf_dir).select("k", F.posexplode(html.table_blocks(F.col("raw_text"))).alias("pos", "block")).select("k", F.col("pos").cast("long").alias("pos"), "block")


@query(r"""select k, len(regexp_extract_all(raw_text, '(?i)<tr\b[^>]*>')) as row_count, coalesce(list_max(list_transform(regexp_extract_all(raw_text, '(?is)<tr\b[^>]*>(.*?)</tr\s*>', 1), lambda x: len(regexp_extract_all(x, '(?i)<t[dh]\b[^>]*>')))), 0) as col_count,
  coalesce(list_max(list_transform(regexp_extract_all(raw_text, '(?i)(?:row|col)span="([0-9]+)', 1), lambda x: x::bigint)), 0) > 1 as has_merged_cells,
  coalesce(list_max(list_transform(regexp_extract_all(raw_text, '(?is)<tr\b[^>]*>(.*?)</tr\s*>', 1), lambda x: len(regexp_extract_all(x, '(?i)<th\b[^>]*>')))), 0) > 1 as has_nested_headers from order_html""", H)  # fmt: skip
def table_metadata(spark, sf_dir):
    out = fx.order_html(spark, sf_dir).select("k", html.metadata(F.col("raw_text")).alias("m")).select("k", "m.*")
    return out.withColumns({c: F.col(c).cast("long") for c in ("row_count", "col_count")})


@query(
    r"select k, len(list_filter(regexp_extract_all(raw_text, '(?is)<td\b[^>]*>.*?</td\s*>|<th\b[^>]*>.*?</th\s*>'), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g')) <> '')) as n from order_html",
    H
)
def non_empty_cells(spark, sf_dir):
    return fx.order_html(spark, sf_dir).select("k", html.non_empty_cells(F.col("raw_text")).cast("long").alias("n"))


@query("""select k, case when k % 8 in (2, 7) then 'PASS' else 'REPARSE' end as decision, case k % 8 when 0 then 'NO_TABLE_FOUND' when 1 then 'RECTANGULAR_INCONSISTENCY' when 3 then 'SPAN_EXPANSION_FAILED' when 4 then 'SPAN_EXPANSION_FAILED' when 5 then 'DEGENERATE_TABLE' when 6 then 'DEGENERATE_TABLE' else '' end as codes,
  cast(case k % 8 when 0 then 0 when 6 then 2 else 1 end as bigint) as tables, true as html_parse_ok, k % 8 not in (1, 3, 4) as span_ok from order_html""", H)  # fmt: skip
def verify_pages(spark, sf_dir):
    out = verify.verified(fx.order_html(spark, sf_dir))
    return out.select(
        "k", F.col("verifier_decision").alias("decision"), F.array_join("verifier_failure_codes", ",").alias("codes"),
        F.col("predicted_table_count").cast("long").alias("tables"), "html_parse_ok", F.col("span_normalization_ok").alias("span_ok")
    )


@query("""select k, r, c, case when r = 0 then case when k % 8 in (6, 7) then ['part', 'qty', 'flag'][c + 1] else ['part qty', '', 'flag'][c + 1] end else [p::varchar, q::varchar, f][c + 1] end as text,
  case when r = 0 then case when k % 8 in (6, 7) then ['part', 'qty', 'flag'][c + 1] else ['part qty', 'part qty', 'flag'][c + 1] end else [p::varchar, q::varchar, f][c + 1] end as filled
  from (select k, r, p, q, f from lines where k % 8 in (2, 6, 7) union all select distinct k, 0, null, null, null from lines where k % 8 in (2, 6, 7)), (values (0::bigint), (1), (2)) v(c)
  union all select k, r - 1, c, '', '' from lines, (values (0::bigint), (1), (2)) v(c) where k % 8 = 5""", H)  # fmt: skip
def table_cells(spark, sf_dir):
    """Every page; those whose table is in error have no cells."""
    out = verify.with_grids(fx.order_html(spark, sf_dir))
    return out.select("k", F.explode("grids").alias("g")).select("k", F.inline("g.cells")).select("k", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "text", "filled")


@query("""select k, case when codes = '' then 'PASS' else 'REPARSE' end as decision, codes, tables from (
  select k, cast(case k % 8 when 0 then 0 when 6 then 2 else 1 end + case when k % 3 < 2 then 1 else 0 end as bigint) as tables,
    case when one = '' and k % 8 = 0 and k % 3 = 2 then 'NO_TABLE_FOUND' when one = '' then two when two = '' or one = two then one else one || ',' || two end as codes
  from (select k, case k % 8 when 1 then 'RECTANGULAR_INCONSISTENCY' when 3 then 'SPAN_EXPANSION_FAILED' when 4 then 'SPAN_EXPANSION_FAILED' when 5 then 'DEGENERATE_TABLE' when 6 then 'DEGENERATE_TABLE' else '' end as one,
    case k % 3 when 0 then 'SPAN_EXPANSION_FAILED' when 1 then 'DEGENERATE_TABLE' else '' end as two from order_html))""", H)  # fmt: skip
def verify_several(spark, sf_dir):
    """A second table behind each page's own: codes come once each, in the order of the tables."""
    more = F.when(F.col("k") % 3 == 0, F.lit(fx.OVERLAP)).when(F.col("k") % 3 == 1, F.lit("<table><tr><td> </td></tr></table>")).otherwise(F.lit(""))
    pages = fx.order_html(spark, sf_dir).withColumn("raw_text", F.concat("raw_text", F.lit(" then "), more))
    return verify.verified(pages).select(
        "k", F.col("verifier_decision").alias("decision"), F.array_join("verifier_failure_codes", ",").alias("codes"),
        F.col("predicted_table_count").cast("long").alias("tables")
    )


@query("select k, case when n = 0 then result else '' end as error, n::bigint as n_rows, m::bigint as n_cols, case when n = 0 then '' else result end as cells from lenient", fx.LENIENT_HTML)
def lenient_tables(spark, sf_dir):
    """Unclosed, nested and misnested markup; the last column has the texts in the order of the cells."""
    out = verify.with_grids(fx.lenient_html(spark, sf_dir)).select("k", F.get("grids", F.lit(0)).alias("g"))
    texts = F.array_join(F.transform("g.cells", lambda c: c["text"]), "|")
    return out.select("k", F.coalesce("g.error", F.lit("")).alias("error"), F.col("g.n_rows").cast("long").alias("n_rows"), F.col("g.n_cols").cast("long").alias("n_cols"), texts.alias("cells"))


def _scores(spark, sf_dir):
    """Gold is missing for one page in sixteen."""
    return verify.scored(fx.order_html(spark, sf_dir), fx.order_html(spark, sf_dir, clean=True).where("k % 16 <> 7").select("page_id", F.col("raw_text").alias("html")))


F1 = "case when k % 16 = 7 then 0 else case k % 8 when 2 then (3 * n + 1) / (3 * n + 3) when 6 then 1 when 7 then 1 else 0 end end::double"
FLAT = """flat as (select k, max(n) as n, 'part' || chr(9) || 'qty' || chr(9) || 'flag' || chr(10) || string_agg(p || chr(9) || q || chr(9) || f, chr(10) order by r) as g,
  string_agg(p || chr(9) || q || chr(9) || f, chr(10) order by r) as body from lines group by k)"""
SIM = """case when k % 16 = 7 then 0 else case k % 8 when 2 then 1 - levenshtein('part qty' || chr(9) || 'part qty' || chr(9) || 'flag' || chr(10) || body, g) / greatest(length(g), length(body) + 23)::double when 6 then 1 when 7 then 1 else 0 end end::double"""


@query(f"""select k, round({F1}, 6) as precision, round({F1}, 6) as recall, round({F1}, 6) as cell_f1, round({SIM}, 6) as text_similarity, cast(case when k % 16 = 7 then 0 else 3 * (n + 1) end as bigint) as gold_cells, k % 16 = 7 as gold_missing,
  cast(case when k % 8 in (0, 1, 3, 4) then 0 when k % 8 = 5 then 3 * n else 3 * (n + 1) end as bigint) as pred_cells, case k % 8 when 0 then 'no_tables' when 1 then 'not_rectangular' when 3 then 'span_expansion_failed' when 4 then 'span_expansion_failed' else '' end as error from flat""", H, FLAT)  # fmt: skip
def score_pages(spark, sf_dir):
    return rounded(
        _scores(spark, sf_dir).select(
            "k", "precision", "recall", "cell_f1", "text_similarity", "gold_cells", "gold_missing", "pred_cells",
            F.coalesce("pred_parse_error", F.lit("")).alias("error")
        )
    )


GOLDEN = "filter (where k % 16 <> 7)"


@query(f"""select round(avg({F1}) {GOLDEN}, 6) as macro_precision, round(avg({F1}) {GOLDEN}, 6) as macro_recall, round(avg({F1}) {GOLDEN}, 6) as macro_cell_f1, round(avg({SIM}) {GOLDEN}, 6) as macro_text_similarity,
  count(*) as pages_total, count(*) {GOLDEN} as pages_with_gold, count(*) filter (where k % 8 in (0, 1, 3, 4)) as pages_with_parse_error from flat""", H, FLAT)  # fmt: skip
def score_macro(spark, sf_dir):
    return rounded(verify.macros(_scores(spark, sf_dir)))


@query(f"select page_id, ord, system_id, {KEPT} as output_tokens from run_log", L)
def page_system_matrix(spark, sf_dir):
    log = fx.run_log(spark, sf_dir)
    out = summary.page_matrix(log.select("page_id").distinct(), log, fx.systems(spark))
    return out.select("page_id", F.inline("systems")).select("page_id", "ord", "system_id", "output_tokens")


@query("select distinct system_id, page_id from run_log where page_no % 50 = 0", L)
def leak_check(spark, sf_dir):
    log = fx.run_log(spark, sf_dir)
    return analysis.leaks(log, log.where("line_no % 50 <> 0").select("page_id").distinct())


@query(
    "select f as family from (values ('adaptive_2b'), ('fixed_2b_low'), ('fixed_2b_matched'), ('random_2b'), ('fixed_8b_matched')) t(f) where f not in (select regexp_replace(system_id, '_seed[0-9]+$', '') from run_log where system_id not like 'random%')",
    L
)
def missing_families(spark, sf_dir):
    seen = fx.run_log(spark, sf_dir).where("system_id not like 'random%'").select(F.regexp_replace("system_id", "_seed[0-9]+$", "").alias("family"))
    return spark.createDataFrame([(f,) for f in experiment.FAMILIES], "family string").join(seen, "family", "left_anti")


@query("select page_id from page_records where has_merged_cells intersect select page_id from page_records where has_nested_headers", P)
def split_overlap(spark, sf_dir):
    r = fx.page_records(spark, sf_dir)
    return r.where("has_merged_cells").select("page_id").intersect(r.where("has_nested_headers").select("page_id"))


@query(
    "select page_id, image_path, coalesce(language, '') as language, contains_table, is_english_table_page, coalesce(row_count, -1)::bigint as row_count, coalesce(col_count, -1)::bigint as col_count, has_merged_cells, has_nested_headers from page_records",
    P
)
def json_records(spark, sf_dir):
    """Records written as one JSON array by many tasks, and read back in byte ranges."""
    rows = fx.page_records(spark, sf_dir).withColumn("language", F.coalesce("language", F.lit("")))
    folder = shared.fresh(spark, "records")
    sinks.write_list(rows.select("page_id", F.to_json(F.struct("*")).alias("element")), folder, "element", "page_id")
    out = json_tables.page_records(spark, folder)
    return out.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("row_count", "col_count")})


@query("select page_id, row_number() over (order by page_id) - 1 as place, count(*) over () as n from page_records where is_english_table_page", P)
def manifest_ids(spark, sf_dir):
    """A split manifest written and read back: its ids in order."""
    path = f"{shared.fresh(spark, 'manifests')}/eval_universe.json"
    n = sinks.write_manifest(dataset.english_table_pages(fx.page_records(spark, sf_dir)), path, "eval_universe", {})
    ids = json_tables.split_page_ids(spark, path)
    return ids.select("page_id", F.col("ord").cast("long").alias("place"), F.lit(n).cast("long").alias("n"))


@query("""select count(*) as n, sha256('{' || chr(10) || '  "generated_with_seed": null,' || chr(10) || '  "manifest_kind": "eval_universe",' || chr(10) || '  "page_ids": [' || chr(10) || string_agg('    "' || page_id || '"', ',' || chr(10) order by page_id) || chr(10) || '  ],' || chr(10)
  || '  "pinning": {},' || chr(10) || '  "schema_version": 1' || chr(10) || '}' || chr(10)) as sha256 from page_records where is_english_table_page""", P)  # fmt: skip
def manifest_sha(spark, sf_dir):
    """The hash of a manifest's file, whose bytes are fixed: many tasks write it, and the file's reader takes its hash."""
    path = f"{shared.fresh(spark, 'manifests')}/eval_universe.json"
    n = sinks.write_manifest(dataset.english_table_pages(fx.page_records(spark, sf_dir)), path, "eval_universe", {})
    return spark.createDataFrame([(n, json_tables.sha256(spark, path))], "n long, sha256 string")


def _grid(spark):
    return summary.budget_grid(spark.createDataFrame([(n,) for n in (2, 4, 6)], "low int"), spark.createDataFrame([(n,) for n in (4, 8, 12)], "high int"))


GRID = "grid as (select low, high from (values (2), (4), (6)) a(low) cross join (values (4), (8), (12)) b(high) where high >= low)"
POINTS = "points as (select g.low, g.high, avg(g.low + case when hit then g.high else 0 end) as cost_tiles from run_log, grid g where system_id = 'adaptive_2b' group by 1, 2)"


@query("select low, high from (select distinct l_linenumber::int as low from lineitem), (select distinct cast(l_quantity as int) as high from lineitem) where high >= low")
def budget_grid(spark, sf_dir):
    """Settings that a table holds: line numbers as low budgets, quantities as high ones."""
    lines = fx.table(spark, sf_dir, "lineitem")
    return summary.budget_grid(lines.select(F.col("l_linenumber").cast("int").alias("low")).distinct(), lines.select(F.col("l_quantity").cast("int").alias("high")).distinct())


def _points(spark, sf_dir):
    rate = fx.run_log(spark, sf_dir).where("system_id = 'adaptive_2b'").agg(F.avg(F.col("reparse_triggered").cast("int")).alias("rate"))
    return _grid(spark).join(F.broadcast(rate)).select("low", "high", (F.col("low") + F.col("rate") * F.col("high")).alias("cost_tiles"))


@query("select low, high, 7.0::double as target, round(cost_tiles, 6) as measured from points order by abs(cost_tiles - 7.0), low, high limit 1", L, GRID, POINTS)
def select_pair(spark, sf_dir):
    return rounded(summary.select_pair(_points(spark, sf_dir), 7.0))


@query("""select t as max_tiles, round(target, 6) as target, t::double as measured, abs(t - target) / target <= 0.1 as within_tolerance from (values (4), (6), (8), (10)) v(t), (select cost_tiles as target from points order by abs(cost_tiles - 7.0), low, high limit 1)
  order by abs(t - target) / target > 0.1, abs(t - target), t limit 1""", L, GRID, POINTS)  # fmt: skip
def select_fixed(spark, sf_dir):
    pair = summary.one_row(summary.select_pair(_points(spark, sf_dir), 7.0), "pair")
    points = spark.createDataFrame([(t, float(t)) for t in (4, 6, 8, 10)], "max_tiles int, cost_tiles double")
    return rounded(summary.select_fixed(points, pair.measured, 0.1))


@query("select round((cost_tiles - low) / high, 6) as probability, cost_tiles = low as degenerate from points order by abs(cost_tiles - 7.0), low, high limit 1", L, GRID, POINTS)
def derive_reparse_rate(spark, sf_dir):
    pair = summary.one_row(summary.select_pair(_points(spark, sf_dir), 7.0), "pair")
    p, none = summary.reparse_probability(pair.measured, pair.low, pair.high)
    return spark.createDataFrame([(round(p, 6), none)], "probability double, degenerate boolean")


@query("select o_custkey as key, count(*) as n from orders group by 1 having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return dataset.duplicates(fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("select doc_id, sha256(coalesce(text, '')) as sha256, min(doc_id) over (partition by coalesce(text, '')) as first, count(*) over (partition by coalesce(text, '')) as copies from documents")
def file_hash_equal(spark, sf_dir):
    """Equal contents found by their hashes; the SQL compares the contents. Counts join the rows, so a content that many
    share is a row of counts, not a group of rows.
    """
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return d.join(d.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "sha256").select("doc_id", "sha256", "first", "copies")


@query(r"""with trees as (select case doc_id % 4 when 0 then '{"page_info":{"image_path":"' || img || '","page_attribute":{"language":"' || upper(lang) || '"}}' when 1 then '{"page_info":{"image_path":"' || img || '","language":"' || lang || ' "}'
    when 2 then '{"image_path":"' || img || '","page_attribute":{"language":"' || lang || '"}' else '{"image_path":"' || img || '","x":[{"y":{"language":"' || lang || '"}}]' end
    || ',"layout_dets":[{"category_type":"text"},{"category_type":"table","' || (['html', 'html_str', 'table_html', 'html_seq'])[cast(doc_id % 4 as int) + 1] || '":"<table><tr><td>' || n_chars || '</td></tr></table>"}]}' as j
    from (select *, 'imgs/p ' || doc_id || '.v1.png' as img from documents))
  select regexp_replace(replace(t.fullkey, '"', ''), '\[[0-9]+\]', '[]', 'g') as path, case t.type when 'VARCHAR' then 'STRING' else t.type end as kind, count(*) as n, coalesce(min(case when t.type = 'ARRAY' then json_array_length(t.value)::bigint when t.type = 'OBJECT' then len(json_keys(t.value)) end), -1)::bigint as least_length,
    coalesce(max(case when t.type = 'ARRAY' then json_array_length(t.value)::bigint when t.type = 'OBJECT' then len(json_keys(t.value)) end), -1)::bigint as most_length,
    coalesce(min(case when t.type not in ('ARRAY', 'OBJECT') then case when length(t.value::varchar) > 20 then substr(t.value::varchar, 1, 19) || '…' else t.value::varchar end end), '') as example
  from trees, json_tree(j::json) as t group by 1, 2""")
def tree_shapes(spark, sf_dir):
    """The shapes of all annotation trees."""
    out = dataset.described(fx.annotation_json(spark, sf_dir).select("entry"), 20)
    lengths = {c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("least_length", "most_length")}
    return out.withColumns(lengths | {"example": F.coalesce("example", F.lit(""))})


@query(f"select system_id, page_id, {KEPT} as output_tokens from run_log", L)
def kept_tokens(spark, sf_dir):
    return fx.run_log(spark, sf_dir).select("system_id", "page_id", summary.kept_tokens().alias("output_tokens"))


def _stub_pages(spark, sf_dir):
    return fx.page_records(spark, sf_dir).select("page_id", F.lit(640).alias("width"), F.lit(480).alias("height"))


STUB = r"""'# ' || page_id || chr(10) || chr(10) || '<table>' || chr(10) || '  <tr><th>column_a</th><th>column_b</th></tr>' || chr(10) || '  <tr><td>' || page_id || '</td><td>stub_2b</td></tr>' || chr(10) || '  <tr><td>B_low</td><td>table_parse_v2</td></tr>' || chr(10) || '  <tr><td>image_w</td><td>640</td></tr>' || chr(10) || '  <tr><td>image_h</td><td>480</td></tr>' || chr(10) || '</table>' || chr(10)"""


@query(f"select page_id, {STUB} as raw_text, 9::bigint as output_tokens from page_records", P)
def stub_render(spark, sf_dir):
    return inference.infer(_stub_pages(spark, sf_dir), STUB_2B, inference.Budget("B_low", 4), PROMPT).select("page_id", "raw_text", "output_tokens")


@query(
    r"select doc_id, len(list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '')) as n from documents"
)
def q_token_count(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n"))


@query("select page_id, w as width, h as height, cols::bigint as cols, rows::bigint as rows from page_images join tilings using (w, h)", fx.PAGE_IMAGES)
def tile_choice(spark, sf_dir):
    """The tiles of every page's image by its size."""
    return summary.tile_choice(fx.page_images(spark, sf_dir).select("page_id", "width", "height"), 12)


@query("select page_id, rows::bigint as n_rows, cols::bigint as n_cols, grey::varchar as least, grey::varchar as most from page_images join tilings using (w, h)", fx.PAGE_IMAGES)
def tile_brightness(spark, sf_dir):
    """A model in the workers: images decoded, resampled and cut into tiles, and a table of the tiles' brightness."""
    out = inference.infer(fx.page_images(spark, sf_dir), inference.Model("m", "brightness"), inference.Budget("B", 12), PROMPT)
    g = verify.with_grids(out).select("page_id", F.get("grids", F.lit(0)).alias("g"))
    texts = F.transform("g.cells", lambda c: c["text"])
    return g.select("page_id", F.col("g.n_rows").cast("long").alias("n_rows"), F.col("g.n_cols").cast("long").alias("n_cols"), F.array_min(texts).alias("least"), F.array_max(texts).alias("most"))


@query(f"""select page_id, max_by({KEPT}, page_no * 7 + ord) as output_tokens, max(page_no * 7 + ord) as line_no from run_log group by page_id""", L)
def streamed_last_rows(spark, sf_dir):
    """A log that repeats each page, streamed a few files at a time in no order: the last line of each page counts."""
    log = fx.run_log(spark, sf_dir).join(F.broadcast(fx.systems(spark).select("system_id", "ord")), "system_id")
    rows = log.withColumns({"line_no": F.col("line_no").cast("long") * 7 + F.col("ord"), "system_id": F.lit("all")}).drop("ord")
    place = shared.fresh(spark, "growing")
    rows.repartition(6, F.xxhash64("line_no")).write.partitionBy("system_id").json(f"{place}/log")
    logs.keep_latest(logs.follow(spark, f"{place}/log", 2), f"{place}/latest", f"{place}/state", availableNow=True).awaitTermination()
    return logs.latest(spark, f"{place}/latest").select("page_id", summary.kept_tokens().alias("output_tokens"), "line_no")


@query()
def random_escalation(spark, sf_dir):
    return fx.page_records(spark, sf_dir).select("page_id", verify.random_reparse(F.col("page_id"), 0, 0.55).alias("reparse"))


@query()
def seeded_split(spark, sf_dir):
    return dataset.seeded_split(dataset.english_table_pages(fx.page_records(spark, sf_dir)), 50, None, 1337)


@query("select doc_id, lang as language from documents where lang is not null")
def language_lookup(spark, sf_dir):
    return dataset.with_language(fx.annotation_json(spark, sf_dir)).select("doc_id", "language").where("language is not null")


@query(
    r"""select 'p_' || doc_id || '_v1' as page_id, 'imgs/p ' || doc_id || '.v1.png' as image_filename, 'en' as language, '<table><tr><td>' || n_chars || '</td></tr></table>' as table_html, 1::bigint as row_count, 1::bigint as col_count, false as has_merged_cells, false as has_nested_headers from documents where lang = 'en' order by image_filename limit 100"""
)
def annotated_pages(spark, sf_dir):
    out = dataset.select_annotations(fx.annotation_json(spark, sf_dir).select("entry"), 100, 1)
    return out.withColumns({c: F.col(c).cast("long") for c in ("row_count", "col_count")})


@query("""select page_id, 'eval_universe' as kind, 1::bigint as pages from page_records where is_english_table_page
  union all select page_id, 'hard_subset', 1 from page_records where is_english_table_page and (coalesce(row_count, 0) >= 20 or coalesce(col_count, 0) >= 6 or has_merged_cells or has_nested_headers)
  union all select '', kind, if(kind = 'calibration', 5, count(*) - 5) from page_records, (values ('calibration'), ('held_out_eval')) v(kind) where is_english_table_page group by kind""", P)  # fmt: skip
def frozen_universe(spark, sf_dir):
    """The members of the universe and its hard subset; the seeded splits, which SQL can't draw, by their sizes, over
    members of the universe only.
    """
    out = freeze.universe(fx.page_records(spark, sf_dir), RULE, 5, None, 1337)
    whole = out.where("kind = 'eval_universe'").select("page_id")
    split = out.where("kind not in ('eval_universe', 'hard_subset')").join(whole, "page_id", "left_semi").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("pages"))
    members = out.where("kind in ('eval_universe', 'hard_subset')").select("page_id", "kind", F.lit(1).cast("long").alias("pages"))
    return members.unionAll(split.select(F.lit(""), "kind", "pages"))


@query("select page_id, 'B_low' as budget_name, 9::bigint as output_token_count, 'raw/' || page_id || '.md' as raw_output_path from page_records", P)
def single_pass_run(spark, sf_dir):
    out = runners.single_pass(_stub_pages(spark, sf_dir), STUB_2B, inference.Budget("B_low", 4), PROMPT, "run", "held_out_eval")
    return out.select("page_id", "budget_name", "output_token_count", "raw_output_path")


UNEVEN_2B = inference.Model("stub_2b", "uneven")
LOW_HIGH = inference.Budget("B_low", 4), inference.Budget("B_high", 10)


def _uneven_run(spark, sf_dir):
    return runners.adaptive(_stub_pages(spark, sf_dir), UNEVEN_2B, *LOW_HIGH, PROMPT, "run", "held_out_eval")


@query("""select page_id, again as reparse_triggered, case when again then 'REPARSE' else 'PASS' end as verifier_decision, case n % 5 when 0 then 'NO_TABLE_FOUND' when 1 then 'DEGENERATE_TABLE' else '' end as codes,
  cast(case when n % 5 = 0 then 0 else 1 end as bigint) as tables, first::bigint as first_pass_output_tokens, coalesce(case when again then second end, -1)::bigint as reparse_output_tokens,
  case when again then 14.0 else 4.0 end::double as total_runtime_ms, case when again then 'reparse' else 'first_pass' end as final_output_source from uneven""", P, fx.UNEVEN)  # fmt: skip
def adaptive_run(spark, sf_dir):
    """With an adapter that fails the verifier on known pages."""
    out = _uneven_run(spark, sf_dir)
    return out.select(
        "page_id", "reparse_triggered", "verifier_decision", F.array_join("verifier_failure_codes", ",").alias("codes"),
        F.col("predicted_table_count").cast("long").alias("tables"), "first_pass_output_tokens",
        F.coalesce("reparse_output_tokens", F.lit(-1)).alias("reparse_output_tokens"), "total_runtime_ms", "final_output_source"
    )


HIGH_STUB = STUB.replace("B_low", "B_high")


@query(f"""select 'first_pass' as pass, page_id, 'B_low' as budget_name, first::bigint as tokens, case n % 5 when 0 then '{fx.NOTHING}' when 1 then '{fx.HOLLOW}' else {STUB} end as raw_text from uneven
  union all select 'reparse', page_id, 'B_high', second, case when n % 10 = 0 then '{fx.NOTHING}' else {HIGH_STUB} end from uneven where again
  union all select 'final', page_id, case when again then 'B_high' else 'B_low' end, case when again then second else first end, case when n % 10 = 0 then '{fx.NOTHING}' when again then {HIGH_STUB} else {STUB} end from uneven""", P, fx.UNEVEN)  # fmt: skip
def pass_artifacts(spark, sf_dir):
    """The texts of each pass and of what is kept."""
    parts = runners.artifacts(_uneven_run(spark, sf_dir))
    kept = F.when(F.col("reparse_triggered"), F.struct("budget_high", "reparse_output_tokens")).otherwise(
        F.struct(F.col("budget_low").alias("budget_high"), F.col("first_pass_output_tokens").alias("reparse_output_tokens"))
    )
    final = parts["final"].withColumn("kept", kept).select("page_id", "raw_text", F.col("kept.budget_high").alias("budget_name"), F.col("kept.reparse_output_tokens").alias("output_token_count"))
    rows = [df.select(F.lit(k).alias("pass"), "page_id", "budget_name", F.col("output_token_count").alias("tokens"), "raw_text") for k, df in (parts | {"final": final}).items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query()
def random_run(spark, sf_dir):
    out = runners.adaptive_random(_stub_pages(spark, sf_dir), UNEVEN_2B, *LOW_HIGH, PROMPT, "run", "held_out_eval", 0, 0.55)
    return out.select("page_id", "reparse_triggered", "reparse_output_tokens", "final_output_source", "random_seed", "policy")


SWEEP = """sweep as (select low, high, count(*) as sample_size, avg(case when again then second else first end) as tokens, avg(again::int) as rate, avg(low + case when again then high else 0 end) as cost
  from uneven, (values (2), (4), (6)) a(low), (values (8), (12), (16)) b(high) group by 1, 2)"""


@query("select low, high, sample_size, round(tokens, 6) as mean_output_tokens, round(rate, 6) as reparse_rate, round(cost, 6) as cost_tiles from sweep", P, fx.UNEVEN, SWEEP)
def sweep_adaptive(spark, sf_dir):
    return rounded(calibration.sweep_adaptive(_stub_pages(spark, sf_dir), UNEVEN_2B, PROMPT, SETTINGS))


@query("""select low, high, t as fixed_2b, t as fixed_8b, round(cost, 6) as measured, abs(t - cost) / cost <= 0.1 as within from (select * from sweep order by abs(cost - 6.0), low, high limit 1), (values (4), (6), (8), (10)) v(t)
  order by abs(t - cost) / cost > 0.1, abs(t - cost), t limit 1""", P, fx.UNEVEN, SWEEP)  # fmt: skip
def stub_calibration(spark, sf_dir):
    f = calibration.calibrate(_stub_pages(spark, sf_dir), UNEVEN_2B, inference.Model("stub_8b", "uneven"), PROMPT, SETTINGS)
    s = f["selection"]
    row = (s["adaptive"]["low"], s["adaptive"]["high"], s["fixed_2b"]["max_tiles"], s["fixed_8b"]["max_tiles"], s["adaptive"]["measured"], s["fixed_2b"]["within_tolerance"])
    return rounded(spark.createDataFrame([row], "low int, high int, fixed_2b int, fixed_8b int, measured double, within boolean"))


@query("""select (row_number() over (order by g, seed) - 1)::int as ord, case when g = 3 then f || '_seed' || seed else f end as system_id, f as family, case g when 0 then 'adaptive' when 3 then 'adaptive_random' else 'single_pass' end as runner, seed::double as seed
  from (select g, f, seed from (values (0, 'adaptive_2b'), (1, 'fixed_2b_low'), (2, 'fixed_2b_matched'), (4, 'fixed_8b_matched')) t(g, f), (select null::bigint as seed) union all select distinct 3, 'random_2b', c_nationkey::bigint from customer)""")
def system_specs(spark, sf_dir):
    """The systems of seeds that a table holds."""
    seeds = sorted(r[0] for r in fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int")).distinct().collect())
    return experiment.specs_frame(spark, experiment.specs(seeds)).withColumn("seed", F.col("seed").cast("double"))


def _entries(spark, sf_dir):
    counts = fx.run_log(spark, sf_dir).groupBy("system_id").agg(F.count(F.lit(1)).cast("int").alias("pages_processed"))
    e = fx.systems(spark).join(counts, "system_id").select(
        "ord", "system_id", F.regexp_replace("system_id", "_seed[0-9]+$", "").alias("family"), "runner", F.lit("ok").alias("status"),
        F.lit("out").alias("output_dir"), "pages_processed", F.col("low").alias("budget_low_max_tiles"), F.col("high").alias("budget_high_max_tiles"),
        F.col("tiles").alias("budget_max_tiles"), F.expr("try_cast(nullif(regexp_extract(system_id, 'seed([0-9]+)', 1), '') as int)").alias("seed")
    )
    return e.withColumns({"random_probability": F.lit(None).cast("double"), "notes": F.array().cast("array<string>"), "error": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})


@query(
    f"""select system_id, count(*) as pages_processed, count(*) as sample_size, round(avg(value), 6) as mean_runtime_ms, round(avg({KEPT}), 6) as mean_output_tokens, (case when any_value(adaptive) then count(*) filter (where event_type = 'error') end)::double as no_table, (case when any_value(adaptive) then count(*) filter (where event_type <> 'error' and k % 3 = 0) end)::double as one_table from run_log group by 1""",
    L
)
def system_results(spark, sf_dir):
    out = analysis.results(_entries(spark, sf_dir), fx.run_log(spark, sf_dir))
    return rounded(
        out.select(
            "system_id", F.col("pages_processed").cast("long").alias("pages_processed"), "sample_size", "mean_runtime_ms", "mean_output_tokens",
            F.col("verifier_failure_codes")["NO_TABLE_FOUND"].cast("double").alias("no_table"),
            F.col("predicted_table_count_hist")[1].cast("double").alias("one_table")
        )
    )


@query(f"""select s.system_id, case s.ord when 1 then 'failed' when 6 then 'skipped_stub_8b' else 'ok' end as status, cast(case when s.ord in (1, 6) then 0 else l.n end as bigint) as pages_processed, cast(case when s.ord in (1, 6) then 0 else l.n end as bigint) as sample_size,
  case when s.ord in (1, 6) then 0 else round(l.tok, 6) end::double as mean_output_tokens, case when s.ord in (1, 6) then 0 else round(l.cost, 6) end::double as cost_tiles, case s.ord when 1 then 'broken' when 6 then 'a stub' else '-' end as note, case when s.ord = 0 then 0.5 else -1 end::double as macro_cell_f1
  from systems s join (select system_id, count(*) as n, avg({KEPT}) as tok, case when any_value(adaptive) then avg(low + case when hit then high else 0 end) else any_value(tiles)::double end as cost from run_log group by 1) l using (system_id)""", L)  # fmt: skip
def results_with_failures(spark, sf_dir):
    """One system failed, one was skipped, one has scores."""
    broken, skipped = F.col("ord") == 1, F.col("ord") == 6
    e = _entries(spark, sf_dir).withColumns(
        {
            "status": F.when(broken, F.lit("failed")).when(skipped, F.lit(experiment.SKIPPED)).otherwise(F.lit("ok")),
            "error": F.when(broken, F.lit("broken")), "reason": F.when(skipped, F.lit("a stub"))
        }
    )
    scores = spark.createDataFrame([("adaptive_2b", 0.5)], "system_id string, macro_cell_f1 double")
    out = analysis.results(e, fx.run_log(spark, sf_dir), scores)
    return rounded(
        out.select(
            "system_id", "status", F.col("pages_processed").cast("long").alias("pages_processed"),
            F.col("sample_size").cast("long").alias("sample_size"), "mean_output_tokens", "cost_tiles", F.coalesce("note", F.lit("-")).alias("note"),
            F.coalesce("macro_cell_f1", F.lit(-1.0)).alias("macro_cell_f1")
        )
    )


@query(
    f"""select page_id, max_by({KEPT}, event_id) as output_tokens, count(*) as rows from (select *, page_no * 7 + ord as event_id, case when ord < 4 then 'a' else 'b' end as half from run_log) group by page_id""",
    L
)
def last_row_wins(spark, sf_dir):
    """A log that repeats each page: the matrix shows its last line."""
    log = fx.run_log(spark, sf_dir).join(F.broadcast(fx.systems(spark).select("system_id", "ord")), "system_id")
    one = log.withColumns({"system_id": F.lit("all"), "line_no": F.col("line_no") * 7 + F.col("ord")}).drop("ord")
    counts = one.groupBy("page_id").agg(F.count(F.lit(1)).alias("rows"))
    out = summary.page_matrix(one.select("page_id").distinct(), one, spark.createDataFrame([("all", 0)], "system_id string, ord int"))
    return out.select("page_id", F.inline("systems")).join(counts, "page_id").select("page_id", "output_tokens", "rows")


@query(
    "select system_id, count(*) filter (where hit) as reparse_count, round(avg(hit::int), 6) as reparse_rate, count(*) filter (where not hit) as passed, count(*) filter (where event_type = 'purchase') as degenerate from run_log where adaptive group by 1",
    L
)
def reparse_slices(spark, sf_dir):
    out = analysis.reparse_slices(_entries(spark, sf_dir), fx.run_log(spark, sf_dir))
    return rounded(out.select("system_id", "reparse_count", "reparse_rate", F.col("decision_histogram")["PASS"].alias("passed"), F.col("code_histogram")["DEGENERATE_TABLE"].alias("degenerate")))


@query("select s.system_id, round(4 + 10 * count(*) filter (where hit) / count(*)::double, 6) as cost_tiles from run_log s where adaptive group by 1", L)
def manifest_cost(spark, sf_dir):
    """Cost by the manifest's counts alone, a cross-check of the logs' mean."""
    counts = fx.run_log(spark, sf_dir).where("reparse_triggered is not null").groupBy("system_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("reparse_triggered").alias("again"))
    return rounded(counts.select("system_id", (4 + F.try_divide("again", "pages") * 10).alias("cost_tiles")))


@query("""select * from (values
  (0, 'phase1_splits_disjoint', case when exists (select 1 from run_log where page_id = 'calibration_page') then 'fail' else 'ok' end, 'calibration and held-out pages are disjoint'),
  (1, 'phase6_manifest_sha_matches_held_out', 'ok', 'held-out manifest unchanged'), (2, 'phase6_manifest_sha_matches_frozen', 'ok', 'frozen budgets match'),
  (3, 'phase6_entries_complete', case when (select count(distinct regexp_replace(system_id, '_seed[0-9]+$', '')) from run_log) = 5 and (select count(distinct system_id) from run_log where system_id like 'random_2b_seed%') = 3 then 'ok' else 'fail' end, 'all families and seeds are there'),
  (4, 'phase6_entries_match_disk', 'ok', 'entries match their logs'), (5, 'phase6_log_pages_match_held_out', 'ok', 'logged pages are held out'), (6, 'frozen_artifact_unchanged_by_phase6', 'ok', 'frozen budgets unchanged'),
  (7, 'verifier_decision_codes_known', 'ok', 'codes are known'), (8, 'prompt_id_pinned', 'ok', 'the prompt is pinned'),
  (9, 'random_baseline_seeds_distinct', case when (select count(distinct d) from seqs) > 1 then 'ok' else 'warn' end, (select count(distinct d) || ' different sequences of decisions' from seqs)),
  (10, 'accuracy_status', 'warn', 'not_applicable_stub_adapters')) t(ord, name, status, detail)""", L, "seqs as (select system_id, string_agg(hit::varchar, '' order by page_no) as d from run_log where system_id like 'random%' group by 1)")  # fmt: skip
def audit_report(spark, sf_dir):
    log, pages = fx.run_log(spark, sf_dir), fx.run_log(spark, sf_dir).select("page_id").distinct()
    same = {"held_out_sha256": "a", "frozen_sha256": "b"}
    checks = analysis.audit(
        _entries(spark, sf_dir), log, spark.createDataFrame([("calibration_page",)], "page_id string"), pages,
        same | {"seeds": [0, 1, 2], "prompt_id": "table_parse_v2"}, {"held_out": "a", "frozen": "b"}, FROZEN
    )
    return spark.createDataFrame([(i, c["name"], c["status"], c["detail"]) for i, c in enumerate(checks)], "ord int, name string, status string, detail string")


TAMPERED = """cases(c) as (select unnest(range(9))),
  bad_log as (select c, system_id, ord, adaptive, page_no, case when c = 1 and page_no % 97 = 5 then 'page_elsewhere' else page_id end as page_id, case when c = 2 and k % 50 = 1 then 'other' else 'table_parse_v2' end as prompt_id,
    case when not adaptive then null when c = 3 and hit and k % 40 = 2 then 'ODD' when event_type = 'error' then 'NO_TABLE_FOUND' when event_type = 'purchase' then 'DEGENERATE_TABLE' end as code, case when c = 5 then page_no % 2 = 0 else hit end as hit
    from run_log, cases where not (c = 4 and system_id = 'fixed_2b_low' and page_no % 2 = 0)),
  bad_entries as (select c, system_id, regexp_replace(system_id, '_seed[0-9]+$', '') as family, ord, n from cases, (select system_id, ord, count(*) as n from run_log group by 1, 2) where not (c = 6 and ord = 6)),
  held as (select distinct page_id from run_log), cal as (select c, case when c = 7 then 'page_0000003' else 'calibration_page' end as page_id from cases),
  sent as (select c, 'a' as header, case when c = 8 then 'x' else 'a' end as present from cases),
  fail(c, ord, bad) as (select c, 0, count(*) from cal semi join held using (page_id) group by c
    union all select c, 1, 1 from sent where header <> present union all select c, 3, 1 from bad_entries group by c having count(distinct family) < 5
    union all select c, 4, count(*) from bad_entries e left join (select c, system_id, count(*) as m from bad_log group by 1, 2) using (c, system_id) where n <> coalesce(m, 0) group by c
    union all select c, 5, count(*) from bad_log semi join bad_entries using (c, system_id) anti join held using (page_id) group by c
    union all select c, 7, count(*) from bad_log where code not in ('NO_TABLE_FOUND', 'HTML_PARSE_ERROR', 'SPAN_EXPANSION_FAILED', 'RECTANGULAR_INCONSISTENCY', 'DEGENERATE_TABLE') group by c
    union all select c, 8, count(*) from bad_log semi join bad_entries using (c, system_id) where prompt_id <> 'table_parse_v2' group by c),
  warn(c, ord) as (select c, 9 from (select c, system_id, string_agg(hit::varchar, '' order by page_no) as d from bad_log where system_id like 'random%' group by 1, 2) group by c having count(distinct d) < 2 union all select c, 10 from cases)"""


@query(
    "select c::int as c, o::int as ord, case when exists (select 1 from fail f where f.c = t.c and f.ord = o and bad > 0) then 'fail' when exists (select 1 from warn w where w.c = t.c and w.ord = o) then 'warn' else 'ok' end as status from cases t, (select unnest(range(11)) as o)",
    L, TAMPERED
)
def audit_tampered(spark, sf_dir):
    """The audit over a sound run (0) and eight that were tampered with, each in one place."""
    log, entries = fx.run_log(spark, sf_dir), shared.stored(_entries(spark, sf_dir), "entries")
    held, k = shared.stored(log.select("page_id").distinct(), "held"), F.coalesce("first_pass_output_tokens", "output_token_count")
    odd = (k % 40 == 2) & F.col("reparse_triggered")
    logs = {
        1: log.withColumn("page_id", F.when(F.col("line_no") % 97 == 5, F.lit("page_elsewhere")).otherwise(F.col("page_id"))),
        2: log.withColumn("prompt_id", F.when(k % 50 == 1, F.lit("other")).otherwise(F.col("prompt_id"))),
        3: log.withColumn("verifier_failure_codes", F.when(odd, F.array(F.lit("ODD"))).otherwise(F.col("verifier_failure_codes"))),
        4: log.where("not (system_id = 'fixed_2b_low' and line_no % 2 = 0)"),
        5: log.withColumn("reparse_triggered", F.when(F.col("reparse_triggered").isNotNull(), F.col("line_no") % 2 == 0)),
    }
    header, out = {"held_out_sha256": "a", "frozen_sha256": "b", "seeds": [0, 1, 2], "prompt_id": "table_parse_v2"}, []
    for c in range(9):
        cal = spark.createDataFrame([("page_0000003" if c == 7 else "calibration_page",)], "page_id string")
        checks = analysis.audit(entries.where("ord <> 6") if c == 6 else entries, logs.get(c, log), cal, held, header, {"held_out": "x" if c == 8 else "a", "frozen": "b"}, FROZEN)
        out += [(c, i, x["status"]) for i, x in enumerate(checks)]
    return spark.createDataFrame(out, "c int, ord int, status string")
