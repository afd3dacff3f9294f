"""Grids of generated tables, the verifier and the scorer."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from gridwright.functions import distance, html, scoring
from gridwright.operators import verify
from gridwright.sources import fixtures


def tiling(rng, rows, columns):
    """Rectangles that cover a grid: (row, column, height, width, text), by rows and columns."""
    taken, out = set(), []
    for y in range(rows):
        for x in range(columns):
            if (y, x) in taken:
                continue
            width = rng.randint(1, next((k for k in range(1, columns - x) if (y, x + k) in taken), columns - x))
            height = rng.randint(1, rows - y)
            taken |= {(y + i, x + j) for i in range(height) for j in range(width)}
            out.append((y, x, height, width, rng.choice(["", "ore", "7 t", "Σ&x", "brass <lot>"])))
    return out


def markup(tiles, rows, rng=None, closed=True):
    """HTML of a tiling; attributes' quotes, case and order vary."""
    rng = rng or random.Random(0)
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def cell(height, width, text):
        quote = rng.choice(['"', "'", ""])
        given_ = [f"{k}={quote}{n}{quote}" for k, n in (("rowspan", height), ("COLSPAN", width)) if n > 1 or rng.random() < 0.2]
        rng.shuffle(given_)
        tag = rng.choice(["td", "th", "TD"])
        return f"<{' '.join([tag, *given_])}>{escape(text)}" + (f"</{tag}>" if closed else "")

    lines = ["<tr>" + "".join(cell(h, w, t) for y, _, h, w, t in tiles if y == r) + ("</tr>" if closed else "") for r in range(rows)]
    return "<table>" + rng.choice(["", "\n "]).join(lines) + "</table>"


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 6), st.integers(1, 6), st.booleans())
def test_a_tiling_comes_back(rng, rows, columns, closed):
    tiles = tiling(rng, rows, columns)
    want = {}
    for y, x, h, w, t in tiles:
        want |= {(y + i, x + j): (t if i == j == 0 else "", t) for i in range(h) for j in range(w)}
    n, m, cells = html.expand(markup(tiles, rows, rng, closed))
    assert (n, m) == (rows, columns) and {(r, c): (a, f) for r, c, a, f in cells} == want


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 5), st.integers(2, 5))
def test_a_missing_cell_leaves_a_hole(rng, rows, columns):
    tiles = tiling(rng, rows, columns)
    less = tiles[:-1]
    left = {(y + i, x + j) for y, x, h, w, _ in less for i in range(h) for j in range(w)}
    if not left or len(left) == (max(y for y, _ in left) + 1) * (max(x for _, x in left) + 1):
        return
    with pytest.raises(html.TableError, match=html.RECTANGULAR_INCONSISTENCY):
        html.expand(markup(less, rows, rng))


@pytest.mark.parametrize("value", ["0", "-3", "many", " ", "1.5", "2000000"])
@pytest.mark.parametrize("name", ["rowspan", "colspan"])
def test_spans_that_are_no_count(name, value):
    with pytest.raises(html.TableError, match=html.SPAN_EXPANSION_FAILED):
        html.expand(f"<table><tr><th>lake</th><th {name}='{value}'>depth</th></tr></table>")


def test_odd_tables():
    text = lambda t: [c[2] for c in html.expand(t)[2]]
    with pytest.raises(html.TableError, match=html.SPAN_EXPANSION_FAILED):  # the low cell of the second row runs into the tall one of the first
        html.expand("<table><tr><td>n</td><td>o</td><td>p</td><td rowspan=4>q</td></tr><tr><td colspan=2>r</td><td colspan=2>s</td></tr></table>")
    for t in (None, "  \n", "<ul><li>lake</li></ul>"):
        with pytest.raises(html.TableError, match=html.HTML_PARSE_ERROR):
            html.expand(t)
    assert html.expand("<TABLE id=t></TABLE>") == (0, 0, [])
    assert html.expand("<table><tbody><tr></tr><tr></tr></tbody></table>")[:2] == (0, 0)
    assert text("<table><caption>c</caption>stray<tr>loose<td>kept<!-- hidden --> &eacute;</td></tr></table>") == ["kept é"]
    assert text("<table><tr><td>in <b>bold</b><table><tr><td>and nested</td></tr></table></td><td>next</td></tr></table>") == ["in boldand nested", "next"]
    assert html.expand("<table><tr><td rowspan=2>tall</td></tr></table>")[:2] == (2, 1)
    with pytest.raises(html.TableError, match=html.RECTANGULAR_INCONSISTENCY):
        html.expand("<table><tr><td>1</td><td>2</td><td>3</td></tr><tr></tr><tr><td>4</td><td>5</td><td>6</td></tr></table>")


WELL = markup([(0, 0, 1, 1, "lake"), (0, 1, 1, 2, "depth"), (1, 0, 1, 1, "Ob"), (1, 1, 1, 1, "12"), (1, 2, 1, 1, "m")], 2)
UNEVEN = "<table><tr><th>lake</th><th>m</th></tr><tr><td>Ob</td></tr></table>"
ZERO = "<table><tr><td colspan=0>lake</td></tr></table>"
VOID, BLANK = "<table> </table>", "<table><tr><td>\t</td><td>&nbsp;</td></tr></table>"
FAILS = {UNEVEN: "RECTANGULAR_INCONSISTENCY", ZERO: "SPAN_EXPANSION_FAILED", VOID: "DEGENERATE_TABLE", BLANK: "DEGENERATE_TABLE"}


def test_verifier(spark):
    """Pages of several tables in every order."""
    rng = random.Random(11)
    pages = [[], *([t] for t in (WELL, *FAILS)), *([rng.choice([WELL, *FAILS]) for _ in range(rng.randrange(2, 6))] for _ in range(60))]
    rows = [(i, " and so on\n".join(["# lakes", *p]) if i % 20 or p else None) for i, p in enumerate(pages)]
    got = {r.i: r for r in verify.verified(spark.createDataFrame(rows, "i int, raw_text string").repartition(5)).collect()}
    for i, p in enumerate(pages):
        codes = list(dict.fromkeys(FAILS[t] for t in p if t in FAILS)) if p else ["NO_TABLE_FOUND"]
        r = got[i]
        assert (r.verifier_failure_codes, r.verifier_decision, r.predicted_table_count) == (codes, "REPARSE" if codes else "PASS", len(p))
        assert [t.failure_codes for t in r.tables] == [[FAILS[t]] if t in FAILS else [] for t in p]
        assert r.html_parse_ok and r.span_normalization_ok == (not {"RECTANGULAR_INCONSISTENCY", "SPAN_EXPANSION_FAILED"} & set(codes))
        assert [(t.rows, t.cols) for t in r.tables if not t.failure_codes] == [(2, 3)] * p.count(WELL)


def test_blocks_and_patterns(spark):
    texts = [
        "", "tables of lakes", f"x {WELL}\n\n{VOID.upper()}y</table>", "<tables>no</tables>",
        "<table><thead><tr><th>p<th>q</tr></thead><tr><td rowspan = 2>r</td><td>&nbsp;</td></tr><thead></thead></table>", None
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: r for r in df.select("i", html.table_blocks(df.t).alias("b"), html.metadata(df.t).alias("m"), html.non_empty_cells(df.t).alias("n")).collect()}
    assert [len(rows[i].b) for i in range(6)] == [0, 0, 2, 0, 1, 0]
    assert tuple(rows[4].m) == (2, 2, True, True) and tuple(rows[0].m) == (0, 0, False, False)
    assert rows[2].n == 5 and rows[1].n == 0


def scores(spark, pairs):
    out = spark.createDataFrame([(str(i), p) for i, (p, _) in enumerate(pairs)], "page_id string, raw_text string")
    gold = spark.createDataFrame([(str(i), g) for i, (_, g) in enumerate(pairs) if g is not None], "page_id string, html string")
    return sorted(verify.scored(out, gold).collect(), key=lambda r: int(r.page_id))


def test_scores_against_sets(spark):
    """Generated grids with some cells changed, against counts of their cells."""
    rng, pairs, want = random.Random(2), [], []
    for _ in range(40):
        rows, columns = rng.randrange(1, 5), rng.randrange(1, 5)
        tables = [(rows, columns), (rng.randrange(1, 4), 2)][: rng.randrange(1, 3)]
        gold = [[[rng.choice(["a b", "7", "", "Ob"]) for _ in range(c)] for _ in range(r)] for r, c in tables]
        pred = [[[rng.choice(["zz", x, x, x]) for x in line] for line in t] for t in gold][: rng.randrange(1, 3)]
        if rng.random() < 0.2:
            pred[0].append(["extra"] * len(pred[0][0]))
        show = lambda ts, gap: " prose ".join("<table>" + "".join("<tr>" + "".join(f"<td>{gap.join(x.split(' '))}</td>" for x in line) + "</tr>" for line in t) + "</table>" for t in ts)
        cells = lambda ts: {(i, r, c, x) for i, t in enumerate(ts) for r, line in enumerate(t) for c, x in enumerate(line)}
        pairs.append((show(pred, " \n "), show(gold, "  ")))
        p, g = cells(pred), cells(gold)
        want.append((len(p & g) / len(p), len(p & g) / len(g), 2 * len(p & g) / (len(p) + len(g)), len(p), len(g)))
    for r, w in zip(scores(spark, pairs), want):
        assert (r.precision, r.recall, r.cell_f1, r.pred_cells, r.gold_cells) == pytest.approx(w)
        assert 0 <= r.text_similarity <= 1 and (r.cell_f1 < 1 or r.text_similarity == 1) and not r.gold_missing and r.pred_parse_error is None


def test_scores_of_odd_pages(spark):
    r = scores(spark, [("no lakes", WELL), (UNEVEN + WELL, WELL), (ZERO, WELL), (VOID, VOID), ("no lakes", VOID), (WELL, None), (None, WELL), (WELL.replace("lake", "LAKE"), WELL)])
    assert [x.pred_parse_error for x in r] == ["no_tables", "not_rectangular", "span_expansion_failed", None, "no_tables", None, "no_tables", None]
    assert [x.cell_f1 for x in r] == pytest.approx([0, 0, 0, 1, 1, 0, 0, 5 / 6])
    assert [x.gold_missing for x in r] == [False] * 5 + [True, False, False] and (r[5].gold_cells, r[5].pred_cells) == (0, 6)
    m = verify.macros(spark.createDataFrame(r)).head()
    assert (m.pages_total, m.pages_with_gold, m.pages_with_parse_error) == (8, 7, 5) and m.macro_cell_f1 == pytest.approx((2 + 5 / 6) / 7)
    with pytest.raises(PySparkException, match="gold"):
        scores(spark, [(WELL, "no lakes")])


def test_python_runs_only_for_grids(spark):
    pages = spark.createDataFrame([("p", WELL)], "page_id string, raw_text string")
    plan = verify.verified(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé🎉", max_size=40), st.text("abé🎉", max_size=40), st.sampled_from([1, 2, 5, 64]))
def test_edit_distance(a, b, least):
    was, distance.LEAST = distance.LEAST, least
    try:
        assert distance.distance(a, b) == plain_distance(a, b) == distance.distance(b, a)
        assert distance.distance(a + b, a + a + b) == plain_distance(a + b, a + a + b)
    finally:
        distance.LEAST = was


def test_long_pages_compare(spark, monkeypatch):
    """Both ways to a distance agree, and a page of 100,000 cells is no matter."""
    rng = random.Random(6)
    show = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows) + "</table>"
    rows = [[f"{rng.randrange(10**4)}" for _ in range(100)] for _ in range(1000)]
    other = [[x if rng.random() > 0.002 else "zz" for x in r] for r in rows]
    cells = sum(x != y for r, o in zip(rows, other) for x, y in zip(r, o))
    r = scores(spark, [(show(other), show(rows)), (show(rows), show(rows))])
    assert r[0].gold_cells == 100_000 and r[0].precision == pytest.approx(1 - cells / 100_000) and 0.99 < r[0].text_similarity < 1 and r[1].text_similarity == 1
    pairs = [
        (
            show([[rng.choice(["a b", "cé", ""]) for _ in range(5)] for _ in range(rng.randrange(1, 30))]),
            show([[rng.choice(["a b", "cé", ""]) for _ in range(5)] for _ in range(rng.randrange(1, 30))])
        ) for _ in range(60)
    ]
    found = []
    for at in (0, 10**9):
        found.append(scoring._compare(pa.array([[p] for p, _ in pairs]), pa.array([[g] for _, g in pairs])).to_pylist())
        monkeypatch.setattr(scoring, "LONG", at)
    by_python = scoring._compare(pa.array([[p] for p, _ in pairs]), pa.array([[g] for _, g in pairs])).to_pylist()
    for x, y in zip(found[1], by_python):
        if y["distance"] is None:
            assert x["distance"] == plain_distance(y["pred_text"], y["gold_text"])


@pytest.mark.parametrize("text,rows,columns,told", fixtures.LENIENT)
def test_lenient_markup(text, rows, columns, told):
    if not rows:
        with pytest.raises(html.TableError, match=told):
            html.expand(text)
    else:
        n, m, cells = html.expand(text)
        assert (n, m, "|".join(c[2] for c in cells)) == (rows, columns, told)
