"""Dataset, policies, summaries, calibration, experiment, analysis and readers."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import InheritableThread
from pyspark.sql import functions as F

import __spark_entry__
from gridwright import queries as Q
from gridwright.operators import dataset, summary, verify
from gridwright.plans import analysis, calibration, experiment, freeze, inference
from gridwright.sources import json_tables, sinks
from gridwright.streaming import logs

SF = "/root/testdata/sf0.001"


def test_seeded_split_is_the_published_one(spark):
    ids = [f"page_{i:04d}" for i in range(1, 15)]
    pages = spark.createDataFrame([(i,) for i in ids], "page_id string").repartition(5)
    got = {r.page_id: r.split for r in dataset.seeded_split(pages, 5, None, 1337).collect()}
    assert sorted(k for k, v in got.items() if v == "calibration") == [f"page_{i:04d}" for i in (1, 2, 5, 7, 13)]
    assert sum(v == "held_out_eval" for v in got.values()) == 9
    for bad in ((-1, None), (10, 5), (2, -1)):
        with pytest.raises(ValueError):
            dataset.seeded_places(14, *bad, seed=1)
    with pytest.raises(ValueError):
        dataset.seeded_split(pages.union(pages.limit(1)), 5, None, 1)


def test_dense_places(spark):
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as k")
    assert [(r.place, r.k) for r in dataset.dense_places(df, "k").orderBy("place").collect()] == list(enumerate(sorted(str(i) for i in range(1000))))


def test_rules(spark):
    r = spark.createDataFrame(
        [("a", 25, 1, False, False), ("b", None, None, True, False), ("c", 3, 7, False, False), ("d", 3, 3, False, None)],
        "page_id string, row_count int, col_count int, has_merged_cells boolean, has_nested_headers boolean"
    )
    ids = lambda rule: sorted(x.page_id for x in dataset.hard_table_pages(r, rule).collect())
    assert ids(dataset.HardTableRule()) == []
    assert ids(dataset.HardTableRule(20, 6, ("has_merged_cells",))) == ["a", "b", "c"]
    assert dataset.HardTableRule.from_mapping({"min_row_count": "3"}).min_row_count == 3
    with pytest.raises(ValueError):
        dataset.HardTableRule.from_mapping({"require_any_of": ["odd"]})


def test_random_policy(spark):
    pages = spark.range(2000).selectExpr("concat('page_', id) as page_id")
    got = {r.page_id: r.x for r in pages.repartition(7).select("page_id", verify.random_reparse(F.col("page_id"), 0, 0.5).alias("x")).collect()}
    assert got == {p: random.Random(f"0:{p}").random() < 0.5 for p in got} and 800 < sum(got.values()) < 1200
    edge = pages.select(verify.random_reparse(F.col("page_id"), 0, 0).alias("a"), verify.random_reparse(F.col("page_id"), 0, 1).alias("b")).distinct().collect()
    assert [tuple(r) for r in edge] == [(False, True)]


def test_p95_and_costs(spark):
    rows = [("a", i, False, 1, None, float(i)) for i in range(101)] + [("b", 0, True, 5, 7, 3.0), ("b", 1, True, 5, None, 3.0), ("b", 2, None, 5, 9, 3.0)]
    log = spark.createDataFrame(
        rows,
        "system_id string, line_no int, reparse_triggered boolean, first_pass_output_tokens long, reparse_output_tokens long, total_runtime_ms double"
    ).withColumns({"runtime_ms": F.lit(None).cast("double"), "output_token_count": F.lit(None).cast("long")})
    systems = spark.createDataFrame(
        [("a", True, 4, 10, None), ("b", True, 4, 10, None), ("c", False, None, None, 6), ("d", True, 4, 10, None)],
        "system_id string, adaptive boolean, low int, high int, tiles int"
    )
    got = {r.system_id: r for r in summary.summaries(log, systems).collect()}
    assert got["a"].p95_runtime_ms == 95.0 and got["a"].cost_tiles == 4
    assert got["b"].mean_output_tokens == pytest.approx(17 / 3) and got["b"].cost_tiles == pytest.approx(4 + 20 / 3) and got["b"].reparse_count == 2
    assert (got["c"].cost_tiles, got["c"].reparse_rate, got["c"].sample_size) == (6.0, None, 0)
    assert (got["d"].cost_tiles, got["d"].reparse_rate, got["d"].p95_runtime_ms) == (0.0, 0.0, 0.0)


def test_quantiles_are_those_of_all_values(spark):
    rng = random.Random(3)
    groups = {
        "ties": [5.0] * 400 + [7.0] * 21,
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-9, 12) for _ in range(700)],
        "close": [1000 + rng.random() * 1e-6 for _ in range(333)],
        "one": [3.25],
        "two": [-1.0, 4.0],
        "odd": [float("inf"), float("-inf"), 0.0, -0.0, 1.0, None],
        "nan": [1.0] * 3 + [float("nan")] * 30,
        "none": [None, None],
    }
    rows = [(k, v) for k, some in groups.items() for v in some]
    df = spark.createDataFrame(rows, "key string, x double").repartition(6).cache()
    for q in (0.0, 0.31, 0.5, 0.95, 1.0):
        got = {r.key: repr(r["quantile"]) for r in summary.quantiles(df, "key", F.col("x"), q).collect()}
        want = {r.key: repr(r.p) for r in df.groupBy("key").agg(F.percentile("x", F.lit(q)).alias("p")).where("p is not null").collect()}
        assert {k: v.replace("-0.0", "0.0") for k, v in got.items()} == {k: v.replace("-0.0", "0.0") for k, v in want.items()}
    assert summary.quantiles(df.limit(0), "key", F.col("x"), 0.5).count() == 0


def test_selection(spark):
    pairs = lambda *p: spark.createDataFrame(p, "low int, high int, cost_tiles double")
    assert summary.select_pair(pairs((4, 12, 4.0), (4, 8, 4.0), (6, 8, 9.0)), 4.0).head()[:2] == (4, 8)
    with pytest.raises(ValueError):
        summary.one_row(summary.select_pair(spark.createDataFrame([], "low int, high int, cost_tiles double"), 5.0), "pair")
    fixed = lambda *p: spark.createDataFrame([(t, float(t)) for t in p], "max_tiles int, cost_tiles double")
    assert tuple(summary.select_fixed(fixed(4, 6, 8), 6.1, 0.1).head()) == (6, 6.1, 6.0, True)
    assert tuple(summary.select_fixed(fixed(8, 4), 6.0, 0.5).head()) == (4, 6.0, 4.0, True)
    assert tuple(summary.select_fixed(fixed(8, 4), 6.0, 0.05).head()) == (4, 6.0, 4.0, False)
    with pytest.raises(ValueError):
        summary.select_fixed(fixed(4), 0.0, 0.1)
    assert summary.reparse_probability(9.5, 4, 10) == (0.55, False) and summary.reparse_probability(6, 6, 8) == (0.0, True)
    for bad in ((3, 4, 10), (20, 4, 10), (5, 4, 0)):
        with pytest.raises(ValueError):
            summary.reparse_probability(*bad)


def test_last_row_wins_and_empty_pages(spark):
    log = spark.createDataFrame([("s", 0, "p", 1), ("s", 2, "p", 3), ("s", 1, "p", 2)], "system_id string, line_no int, page_id string, output_token_count long").withColumns(
        {
            "reparse_triggered": F.lit(None).cast("boolean"), "reparse_output_tokens": F.lit(None).cast("long"),
            "first_pass_output_tokens": F.lit(None).cast("long"), "total_runtime_ms": F.lit(0.0), "runtime_ms": F.lit(0.0),
            "verifier_decision": F.lit(None).cast("string"), "verifier_failure_codes": F.lit(None).cast("array<string>")
        }
    )
    got = {r.page_id: r.systems for r in summary.page_matrix(spark.createDataFrame([("p",), ("q",)], "page_id string"), log, spark.createDataFrame([("s", 0)], "system_id string, ord int")).collect()}
    assert got["p"][0].output_tokens == 3 and got["q"] == []


def test_calibration_and_experiment(spark, tmp_path):
    pages = spark.createDataFrame([(f"page_{i}", 8, 8) for i in range(5)], "page_id string, width int, height int")
    frozen = calibration.calibrate(pages, Q.STUB_2B, Q.STUB_8B, Q.PROMPT, Q.SETTINGS)
    s = frozen["selection"]
    assert (s["adaptive"]["low"], s["adaptive"]["high"], s["fixed_2b"]["max_tiles"], s["adaptive"]["measured"]) == (6, 8, 6, 6.0)
    calibration.freeze(tmp_path / "f.json", frozen)
    assert json.loads((tmp_path / "f.json").read_text()) == frozen
    with pytest.raises(ValueError):
        calibration.check_frozen(frozen | {"schema_version": 2})

    def write(system, log):
        sinks.write_log(log.drop("raw_text"), str(tmp_path / system))
        return str(tmp_path / system)

    registry = {m.name: m for m in (Q.STUB_2B, Q.STUB_8B)}
    entries = experiment.run_all(pages, frozen, registry, Q.PROMPT, [0, 1], write)
    assert [e["status"] for e in entries] == ["ok"] * 5 + ["skipped_stub_8b"]
    assert entries[0]["pages_processed"] == 5 and entries[0]["reparse_count"] == 0 and entries[3]["notes"]
    bad = experiment.run_all(pages, frozen, {"stub_2b": inference.Model("stub_2b", "other")}, Q.PROMPT, [0], write, families=["adaptive_2b"])
    assert bad[0]["status"] == "failed" and "registered as other" in bad[0]["error"]
    with pytest.raises(ValueError):
        experiment.filtered(experiment.specs([0]), ["none"])
    with pytest.raises(ValueError):
        experiment.specs([])


def test_second_pass_only_where_asked(spark):
    calls = []

    def adapter(pages, model, budget, prompt):
        calls.append((budget.name, pages.count()))
        return inference.stub(pages, model, budget, prompt).withColumn("raw_text", F.when((F.col("page_id") == "bad") & (F.lit(budget.name) == "low"), "prose").otherwise(F.col("raw_text")))

    inference.register("half", adapter)
    from gridwright.plans import runners

    pages = spark.createDataFrame([("good", 8, 8), ("bad", 8, 8)], "page_id string, width int, height int")
    out = {r.page_id: r for r in runners.adaptive(pages, inference.Model("m", "half"), inference.Budget("low", 4), inference.Budget("high", 10), Q.PROMPT, "r", "s").collect()}
    assert calls == [("low", 2), ("high", 1)]
    assert (out["bad"].final_output_source, out["good"].final_output_source, out["good"].reparse_output_tokens) == ("reparse", "first_pass", None)
    with pytest.raises(ValueError):
        inference.infer(pages, inference.Model("m", "none"), inference.Budget("low", 4), Q.PROMPT)


def test_audit_tampering(spark):
    log = Q.fx.run_log(spark, SF).cache()
    pages, entries = log.select("page_id").distinct(), Q._entries(spark, SF)
    header = {"held_out_sha256": "a", "frozen_sha256": "b", "seeds": [0, 1, 2], "prompt_id": "table_parse_v2"}
    cal = spark.createDataFrame([("c",)], "page_id string")

    def run(log=log, entries=entries, cal=cal, held=pages, header=header, shas={"held_out": "a", "frozen": "b"}, **kw):
        return {c["name"]: c["status"] for c in analysis.audit(entries, log, cal, held, header, shas, Q.FROZEN, **kw)}

    good = run()
    assert list(good) == list(analysis.CHECKS) and set(good.values()) == {"ok", "warn"} and good["accuracy_status"] == "warn"
    changed = lambda new: {k for k in good if new[k] != good[k]}
    assert changed(run(cal=pages)) == {"phase1_splits_disjoint"} and run(cal=pages, identical_acknowledged=True)["phase1_splits_disjoint"] == "warn"
    assert changed(run(shas={"held_out": "x", "frozen": "b"})) == {"phase6_manifest_sha_matches_held_out"}
    assert changed(run(shas={"held_out": "a", "frozen": "x"})) == {"phase6_manifest_sha_matches_frozen", "frozen_artifact_unchanged_by_phase6"}
    assert changed(run(header=header | {"seeds": [0, 9]})) == {"phase6_entries_complete"}
    assert changed(run(entries=entries.withColumn("pages_processed", F.lit(1)))) == {"phase6_entries_match_disk"}
    assert changed(run(held=pages.limit(3))) == {"phase6_log_pages_match_held_out"}
    assert changed(run(header=header | {"prompt_id": "other"})) == {"prompt_id_pinned"}
    assert changed(run(log=log.withColumn("verifier_failure_codes", F.array(F.lit("ODD"))))) == {"verifier_decision_codes_known"}
    assert run(log=log.withColumn("reparse_triggered", F.lit(False)))["random_baseline_seeds_distinct"] == "warn"


def test_readers(spark, tmp_path):
    good = {"page_id": "p", "image_path": "i.png", "language": "en", "contains_table": True, "is_english_table_page": True, "more": 1}
    at = lambda name, data: (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data)) and str(tmp_path / name)
    r = json_tables.page_records(spark, at("r.json", [good])).head()
    assert (r.page_id, r.has_merged_cells, r.row_count) == ("p", False, None)
    for bad in ({"a": 1}, [good, good], [{k: v for k, v in good.items() if k != "language"}]):
        with pytest.raises(ValueError):
            json_tables.page_records(spark, at("bad.json", bad))
    ids = json_tables.split_page_ids(spark, at("m.json", {"page_ids": ["b", "a"]}))
    assert [tuple(x) for x in ids.orderBy("ord").collect()] == [(0, "b"), (1, "a")]
    with pytest.raises(ValueError):
        json_tables.split_page_ids(spark, at("m2.json", {"ids": []}))
    log = json_tables.log_rows(spark, {"s": at("l.jsonl", '{"page_id": "x", "odd": 1}\n\n{"page_id": "y"}\n')})
    assert [(x.system_id, x.page_id) for x in log.orderBy("line_no").collect()] == [("s", "x"), ("s", "y")]
    with pytest.raises(ValueError):
        json_tables.log_rows(spark, {"s": at("l2.jsonl", "[1]\n")})
    with pytest.raises(FileNotFoundError):
        json_tables.log_rows(spark, {"s": str(tmp_path / "none.jsonl")})
    assert json_tables.gold(spark, at("g.json", {"p": "<table></table>"})).head().html == "<table></table>"
    with pytest.raises(ValueError):
        json_tables.gold(spark, at("g2.json", {"p": 1}))
    tree = {
        "data": [
            {
                "page_info": {"image_path": "a/b c.x.png", "language": " EN "},
                "layout_dets": [{"category_type": "Table", "html": " ", "html_str": " <table><tr><td>1</td></tr></table> "}]
            },
            {"image_path": "z.png", "layout_dets": [], "deep": {"language": "eng"}}, {"image_path": "y.png"}
        ]
    }
    got = dataset.select_annotations(json_tables.annotations(spark, at("a.json", tree)), 5).collect()
    assert [(x.page_id, x.language, x.table_html, x.row_count) for x in got] == [("b_c_x", "en", "<table><tr><td>1</td></tr></table>", 1)]
    sinks.write_json(tmp_path / "x.json", {"b": 1, "a": 2})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'


def test_values_are_coerced(spark, tmp_path):
    at = lambda data: (tmp_path / "r.json").write_text(json.dumps(data)) and str(tmp_path / "r.json")
    base = {"page_id": 7, "image_path": "i.png", "language": "en", "contains_table": "no", "is_english_table_page": 0}
    r = json_tables.page_records(spark, at([base | {"row_count": " 12 ", "col_count": 3.9, "has_merged_cells": [], "has_nested_headers": 2}])).head()
    assert (r.page_id, r.contains_table, r.is_english_table_page, r.row_count, r.col_count, r.has_merged_cells, r.has_nested_headers) == ("7", True, False, 12, 3, False, True)
    assert json_tables.page_records(spark, at([base | {"row_count": None}])).head().row_count is None
    with pytest.raises(ValueError):
        json_tables.page_records(spark, at([base | {"row_count": "twelve"}]))


def test_lines_of_logs_are_numbered(spark, tmp_path):
    """In the order of files and lines, however they are split; a number that the rows carry counts instead."""
    for part in range(3):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"part-{part}.json").write_text("".join("\n" if i == 3 else json.dumps({"page_id": f"p{part}_{i}", "pad": "x" * 200}) + "\n" for i in range(50)))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"page_id": f"q{i}", "line_no": 100 - i}) + "\n" for i in range(5)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = json_tables.log_rows(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b.jsonl")}).select("system_id", "line_no", "page_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = [("a", part * 50 + i, f"p{part}_{i}") for part in range(3) for i in range(50) if i != 3] + [("b", 100 - i, f"q{i}") for i in range(5)]
    assert sorted(map(tuple, got)) == sorted(want)
    for bad in ("not json", "[1]", "3", '{"page_id": '):
        (tmp_path / "bad.jsonl").write_text('{"page_id": "x"}\n' + bad + "\n")
        with pytest.raises(ValueError, match="line 1"):
            json_tables.log_rows(spark, {"s": str(tmp_path / "bad.jsonl")})
    assert json_tables.log_rows(spark, {}).count() == 0


def test_languages_deep_in_trees(spark):
    nest = lambda v, n: {"language": v} if not n else [nest(v, n - 1)] if n % 2 else {"k": nest(v, n - 1)}
    trees = [
        {"a": {"language": ""}, "b": [{"language": None}, {"c": 1, "language": " Eng "}]}, nest("en", 8), nest("en", 9),
        {"z": {"language": "de"}, "language": "fr"}, {"page_info": {"language": "EN"}, "x": {"language": "no"}}, [], {"language": 0}
    ]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, t string").select("i", F.parse_json("t").alias("entry"))
    out = dataset.with_language(df)
    assert [r.language for r in out.orderBy("i").collect()] == ["eng", "en", None, "fr", "en", None, "0"]


def test_page_files_and_sidecars(spark, tmp_path):
    from gridwright.plans import drivers, runners

    pages = spark.createDataFrame([(f"page_{i:07d}", 8, 8) for i in range(11)], "page_id string, width int, height int")
    out = runners.adaptive(pages, Q.UNEVEN_2B, *Q.LOW_HIGH, Q.PROMPT, "r", "s")
    run = tmp_path / "run"
    assert drivers._write(out, str(run)) == 11
    n = lambda d: sorted(p.stem for p in (run / d).iterdir() if not p.name.startswith("."))
    again = [f"page_{i:07d}" for i in (0, 1, 5, 6, 10)]
    assert n("reparse/raw") == again and len(n("first_pass/raw")) == len(n("final/pages")) == 11
    log = [json.loads(x) for p in sorted((run / "logs").glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["line_no"] for r in log] == list(range(11)) and [r["page_id"] for r in log] == sorted(r["page_id"] for r in log)
    for r in log:
        assert all((run / r[k]).exists() for k in ("first_pass_raw_path", "final_raw_path")) and (r["reparse_raw_path"] is None) == (r["page_id"] not in again)
        assert (run / r["final_raw_path"]).read_text() == (run / (r["reparse_raw_path"] or r["first_pass_raw_path"])).read_text()
    assert (run / "first_pass/raw/page_0000001.md").read_text() == Q.fx.HOLLOW and "column_a" in (run / "final/raw/page_0000001.md").read_text()
    side = json.loads((run / "final/pages/page_0000001.json").read_text())
    assert side["tables"][0]["failure_codes"] == ["DEGENERATE_TABLE"] and side["verifier_decision"] == "REPARSE"
    texts = {r.page_id: r.raw_text for r in drivers.run_outputs(spark, str(run)).collect()}
    assert len(texts) == 11 and texts["page_0000000"] == Q.fx.NOTHING and "B_high" in texts["page_0000001"]
    single = runners.single_pass(pages, Q.STUB_2B, inference.Budget("B_low", 4), Q.PROMPT, "r", "s")
    drivers._write(single, str(tmp_path / "single"))
    assert json_tables.sidecars(spark, str(tmp_path / "single")).where("raw_text like '%column_a%'").count() == 11
    with pytest.raises(FileNotFoundError):
        drivers.run_outputs(spark, str(tmp_path / "none"))
    gold = spark.createDataFrame([(p, t) for p, t in texts.items() if "<table>" in t], "page_id string, html string")
    m = drivers.score_run(spark, drivers.run_outputs(spark, str(run)), gold, str(tmp_path / "scores"))
    shown = (tmp_path / "scores" / "scores.md").read_text()
    assert m["macro_cell_f1"] == 1 and m["pages_with_gold"] == 9 and shown.count("page_00000") == 11


def test_entry_without_the_training_data_package(tmp_path):
    """With the subpackage and the pipeline deleted everything else still imports."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("gridwright", "corpus_pipeline.py", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "gridwright" / "llm", ignore_errors=True)
    say = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for drop in ((), ("corpus_pipeline.py",)):
        for name in drop:
            (tmp_path / name).unlink()
        got = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert got.returncode == 0 and got.stdout.split() == [str(len(Q.QUERIES)), "False"], got.stderr


def test_freeze(spark, tmp_path):
    members = freeze.universe(Q.fx.page_records(spark, SF), Q.RULE, 5, 10, 1337)
    n = freeze.write_manifests(members, str(tmp_path), {}, 1337)
    assert n["calibration"] == 5 and n["held_out_eval"] == 10
    first = (tmp_path / "calibration_split.json").read_bytes()
    freeze.write_manifests(members.repartition(3), str(tmp_path), {}, 1337)
    assert (tmp_path / "calibration_split.json").read_bytes() == first


def test_stream(spark, tmp_path):
    (tmp_path / "in" / "system_id=a").mkdir(parents=True)
    (tmp_path / "in" / "system_id=a" / "1.json").write_text('{"page_id": "p", "reparse_triggered": true, "reparse_output_tokens": 4, "total_runtime_ms": 2.0}\n')
    q = logs.running_results(logs.follow(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from running").collect()] == [("a", 1, 2.0, 4.0, 1.0)]


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "customer orders lineitem events documents pages benchmark".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(Q.ORACLE[name])
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(x) for x in got.columns]
    rows = [tuple(x[i] for i in order) for x in want.fetchall()]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(rows, key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_systems_run_side_by_side(spark, tmp_path):
    """Two systems wait for each other; a third fails, and what it left running is cancelled."""
    import threading
    import time

    pages = spark.createDataFrame([(f"page_{i}", 8, 8) for i in range(5)], "page_id string, width int, height int")
    frozen = calibration.calibrate(pages, Q.STUB_2B, Q.STUB_8B, Q.PROMPT, Q.SETTINGS)
    meet, left, ended = threading.Barrier(2, timeout=120), [], []

    def sleep(rows):
        time.sleep(60)
        return rows

    def linger():
        began = time.time()
        try:
            spark.sparkContext.parallelize([1], 1).mapPartitions(sleep).collect()
        except Exception:  # noqa: BLE001  cancelled
            ended.append(time.time() - began)

    def write(system, log):
        if system == "fixed_2b_low":
            left.append(InheritableThread(target=linger))
            left[0].start()
            time.sleep(2)
            raise OSError("disk full")
        if system in ("adaptive_2b", "fixed_2b_matched"):
            meet.wait()
        sinks.write_log(log.drop("raw_text"), str(tmp_path / system))
        return str(tmp_path / system)

    entries = experiment.run_all(pages, frozen, {m.name: m for m in (Q.STUB_2B, Q.STUB_8B)}, Q.PROMPT, [0], write, at_once=4)
    assert [(e["system_id"], e["status"]) for e in entries] == [
        ("adaptive_2b", "ok"), ("fixed_2b_low", "failed"), ("fixed_2b_matched", "ok"), ("random_2b_seed0", "ok"),
        ("fixed_8b_matched", "skipped_stub_8b")
    ]
    assert "disk full" in entries[1]["error"] and entries[2]["pages_processed"] == 5
    left[0].join(50)
    assert ended and ended[0] < 45 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 80), st.integers(0, 10**6), st.integers(1, 30), st.data())
def test_places_are_traced_back(n, seed, block, data):
    c = data.draw(st.integers(0, n))
    e = data.draw(st.none() | st.integers(0, n - c))
    want = dataset.seeded_places(n, c, e, seed)
    found = dataset.traced(n, range(c + (e or 0)), seed, block)
    got = ["unused" if e is not None else "held_out_eval"] * n
    for k, place in found.items():
        got[place] = "calibration" if k < c else "held_out_eval"
    assert got == want


def test_shapes_of_trees(spark):
    trees = ['{"a": [1, {"b": null}], "c": "xxxxxxxxxxxx"}', '{"a": [], "c": 2.5}', '"s"', None, '{"a": {"b": true}}']
    df = spark.createDataFrame([(t,) for t in trees], "t string").select(F.parse_json("t").alias("entry"))
    got = {(r.path, r.kind): (r.n, r.least_length, r.most_length, r.example) for r in dataset.described(df, 5).collect()}
    assert got == {
        ("$", "OBJECT"): (3, 1, 2, None), ("$", "STRING"): (1, None, None, '"s"'), ("$.a", "ARRAY"): (2, 0, 2, None), ("$.a", "OBJECT"): (1, 1, 1, None), ("$.c", "STRING"): (1, None, None, '"xxx…'), ("$.c", "DECIMAL"): (1, None, None, "2.5"),
        ("$.a[]", "BIGINT"): (1, None, None, "1"), ("$.a[]", "OBJECT"): (1, 1, 1, None), ("$.a[].b", "VOID"): (1, None, None, "null"), ("$.a.b", "BOOLEAN"): (1, None, None, "true"),
    }
    assert dataset.described(df.limit(0)).count() == 0


def test_the_audit_reads_the_log_once(spark, tmp_path):
    Q.fx.run_log(spark, SF).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    held = spark.range(3).selectExpr("concat('page_', id) as page_id")
    plan = analysis.evidence(log, held, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
