"""JSON documents read in byte ranges, and paths of any letters."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridwright import queries as Q
from gridwright.plans import drivers, inference, runners
from gridwright.sources import json_arrays, json_tables, sinks

TEXT = st.text(alphabet=st.sampled_from('a"\\\\ é🎉[]{},:\n\t'), max_size=12)
TREE = st.recursive(st.none() | st.booleans() | st.integers(-9, 99) | TEXT, lambda x: st.lists(x, max_size=4) | st.dictionaries(TEXT, x, max_size=4), max_leaves=12)


def plain_plan(doc, each):
    """What elements() plans, without Spark."""
    ranges, inside, depth, least = [], False, 0, {}
    for at in range(0, doc.size, each):
        r = json_arrays.Range(at, min(at + each, doc.size), inside, depth)
        _, quotes, step, low, step_in, low_in = json_arrays.scan(doc, r)
        least[at] = depth + (low_in if inside else low)
        depth, inside = depth + (step_in if inside else step), inside ^ (quotes % 2 == 1)
        ranges.append(r)
    return ranges, least


@settings(max_examples=250, deadline=None)
@given(st.lists(TREE, max_size=8), st.integers(1, 40), st.integers(3, 60), st.booleans(), st.sampled_from([None, 2]))
def test_elements_of_any_ranges(tmp_path_factory, tree, each, block, ascii_, indent):
    path = tmp_path_factory.getbasetemp() / "any.json"
    path.write_text("\n " + json.dumps(tree, ensure_ascii=ascii_, indent=indent) + " \n", encoding="utf-8")
    doc, was = json_arrays.Document.at(str(path)), json_arrays.BLOCK
    json_arrays.BLOCK = block
    try:
        opening, first = doc.first()
        ranges, least = plain_plan(doc, each)
        found = []
        for r in ranges:
            if r.end <= opening:
                continue
            own = json_arrays.Range(opening, r.end, False, 0, True) if r.start <= opening else r
            found += json_arrays.cut(doc, own, 1, b"]")
            if least[r.start] < 1:
                break
    finally:
        json_arrays.BLOCK = was
    assert first == b"[" and [json.loads(x) for _, x in found] == tree and [at for at, _ in found] == sorted(at for at, _ in found)


def test_lists_objects_and_keys(spark, tmp_path):
    rng = random.Random(4)
    records = [{"page_id": f'p{i} "\\', "n": [i, {"data": [1, "]"]}], "t": rng.choice(["", "\\\\", 'x"]},{', "é" * 50])} for i in range(200)]

    def at(name, data):
        (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
        return str(tmp_path / name)

    def got(*args, **kw):
        return [json.loads(r.element) for r in json_arrays.elements(spark, *args, **kw).orderBy("offset").collect()]

    for size in (700, 1 << 20):
        assert got(at("a.json", records), size=size) == records
        df = json_arrays.elements(spark, str(tmp_path / "a.json"), size=size)
        assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.json").stat().st_size // size)
        wrapped = {"info": {"data": [0]}, "x\\\"data": [3], "data": records, "annotations": [1], "more": [[2]]}
        assert got(at("w.json", wrapped), keys=("data", "annotations"), size=size) == records
        assert got(at("w2.json", {"data": {"a": []}, "annotations": records[:3]}), keys=("data", "annotations"), size=size) == records[:3]
        members = json_arrays.elements(spark, at("o.json", {r["page_id"]: r["t"] for r in records}), kinds="{", size=size).collect()
        assert {k: v for r in members for k, v in json.loads("{" + r.element + "}").items()} == {r["page_id"]: r["t"] for r in records}
    assert got(at("e.json", " [ \n] ")) == []
    for bad in ("", "{}", "[1", "[1]]", '["a]', "[1}", "[1,,2]", "[1,]", "[1] 2", "[{]}"):
        with pytest.raises((ValueError, PySparkException)):
            json_arrays.elements(spark, at("bad.json", bad), size=2).select(F.parse_json("element")).collect()
    with pytest.raises(FileNotFoundError):
        json_arrays.elements(spark, str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        json_arrays.elements(spark, at("k.json", {"other": [1]}), keys=("data",))
    folder = tmp_path / "parts"
    folder.mkdir()
    raw = json.dumps(records).encode()
    for i, cut in enumerate(range(0, len(raw), 777)):
        (folder / f"part-{i:05d}").write_bytes(raw[cut : cut + 777])
    (folder / "_SUCCESS").write_bytes(b"")
    assert got(str(folder), size=500) == records


def test_records_are_parsed_once(spark, tmp_path):
    good = {"image_path": "i.png", "language": "en", "contains_table": True, "is_english_table_page": True}
    (tmp_path / "r.json").write_text(json.dumps([good | {"page_id": f"p{i}"} for i in range(3000)]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = json_tables.page_records(spark, str(tmp_path / "r.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 3000 and "parse_json" not in plan and "json_elements" not in plan
    for bad in ([good], [good | {"page_id": "a"}, 3], [good | {"page_id": "a", "row_count": {}}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            json_tables.page_records(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("name", ["run+1", "100%25 x", "é,#1"])
def test_folders_of_any_name(spark, tmp_path, name):
    """Page files are written and read back, logs and artifacts too, whatever a folder is called."""
    pages = spark.createDataFrame([(f"page_{i:07d}", 8, 8) for i in range(6)], "page_id string, width int, height int")
    run = tmp_path / name
    for folder, out in (
        (run / "two", runners.adaptive(pages, Q.UNEVEN_2B, *Q.LOW_HIGH, Q.PROMPT, "r", "s")),
        (run / "one", runners.single_pass(pages, Q.STUB_2B, inference.Budget("B_low", 4), Q.PROMPT, "r", "s"))
    ):
        assert drivers._write(out, str(folder)) == 6
        texts = {r.page_id: r.raw_text for r in drivers.run_outputs(spark, str(folder)).collect()}
        assert len(texts) == 6 and all(texts.values())
        assert json_tables.log_rows(spark, {"s": f"{folder}/logs"}).count() == 6
        gold = spark.createDataFrame([(p, t) for p, t in texts.items() if "<table>" in t], "page_id string, html string")
        assert drivers.score_run(spark, drivers.run_outputs(spark, str(folder)), gold, str(folder / "scores"))["macro_cell_f1"] == 1
    sinks.write_json(run / "x.json", [])
    assert len(json_tables.sha256(spark, str(run / "x.json"))) == 64


def test_pages_are_inferred_at_most_twice_on_any_session(spark):
    """An adapter in Python counts what it is given, without a folder for checkpoints."""
    calls = spark.sparkContext.accumulator(0)

    def counting(pages, model, budget, prompt):
        def run(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return Q.fx.uneven(pages.mapInArrow(run, pages.schema), model, budget, prompt)

    inference.register("counting", counting)
    pages = spark.createDataFrame([(f"page_{i:07d}", 8, 8) for i in range(40)], "page_id string, width int, height int")
    out = runners.adaptive(pages, inference.Model("m", "counting"), *Q.LOW_HIGH, Q.PROMPT, "r", "s")
    again = sum(r.reparse_triggered for r in out.collect())
    assert 0 < again < 40 and calls.value == 40 + again


def test_manifests_are_written_by_many_tasks(spark, tmp_path):
    ids = [f'p"{i * 7919 % 500} é\\' for i in range(500)]
    rows = spark.createDataFrame([(i,) for i in ids], "page_id string").repartition(7)
    for name, some, n in (("m.json", rows, 500), ("none.json", rows.limit(0), 0), ("one.json", rows.limit(1), 1)):
        assert sinks.write_manifest(some, str(tmp_path / name), "calibration_split", {"dataset": "d"}, 5) == n
        assert (tmp_path / name).read_text() == sinks.stable(sinks.manifest("calibration_split", [r.page_id for r in some.collect()], {"dataset": "d"}, 5))
        got = json_tables.split_page_ids(spark, str(tmp_path / name)).orderBy("ord").collect() if n else []
        assert [r.page_id for r in got] == sorted(r.page_id for r in some.collect()) and [r.ord for r in got] == list(range(n))
    sinks.write_list(rows.limit(0).selectExpr("page_id", "page_id as e"), str(tmp_path / "empty"), "e", "page_id")
    assert json_arrays.elements(spark, str(tmp_path / "empty")).count() == 0
