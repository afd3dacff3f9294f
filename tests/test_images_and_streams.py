"""Pixels against a plain reader, models in workers, and streams against batches."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright import queries as Q
from gridwright.functions import pixels
from gridwright.operators import summary
from gridwright.plans import drivers, inference, runners
from gridwright.streaming import logs


def plain_filter(rows, depth, kinds):
    """Filtered bytes of rows, a byte at a time."""
    out, above = [], bytes(len(rows[0])) if rows else b""
    for row, kind in zip(rows, kinds):
        line = bytearray([kind])
        for x, v in enumerate(row):
            a = row[x - depth] if x >= depth else 0
            b, c = above[x], above[x - depth] if x >= depth else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            line.append(v - (0, a, b, (a + b) // 2, near)[kind] & 255)
        out.append(bytes(line))
        above = row
    return b"".join(out)


def png(width, height, bits, colour, data, palette=None, interlaced=0):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = zlib.compress(data)
    return pixels.SIGNATURE + chunk(
        b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)
    ) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", raw[:7]) + chunk(b"IDAT", raw[7:]) + chunk(b"IEND", b"")


@settings(max_examples=120, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 9), st.integers(1, 9), st.sampled_from([(8, 0), (8, 2), (8, 4), (8, 6), (16, 2), (1, 0), (2, 0), (4, 3), (8, 3)]))
def test_png_files(rng, width, height, kind):
    bits, colour = kind
    n = pixels.SAMPLES[colour]
    samples = np.array([[[rng.randrange(1 << min(bits, 8)) for _ in range(n)] for _ in range(width)] for _ in range(height)])
    if bits >= 8:
        rows = [b"".join(bytes([v] if bits == 8 else [v, rng.randrange(256)]) for p in line for v in p) for line in samples.tolist()]
    else:
        rows = [int("".join(f"{p[0]:0{bits}b}" for p in line).ljust(-(-width * bits // 8) * 8, "0"), 2).to_bytes(-(-width * bits // 8), "big") for line in samples.tolist()]
    palette = bytes(rng.randrange(256) for _ in range(3 << min(bits, 8))) if colour == 3 else None
    got = pixels.decode(png(width, height, bits, colour, plain_filter(rows, max(1, n * bits // 8), [rng.randrange(5) for _ in rows]), palette))
    if colour == 3:
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[:, :, 0]]
    else:
        scaled = samples * (255 // ((1 << min(bits, 8)) - 1))
        want = np.repeat(scaled[:, :, :1], 3, axis=2) if colour in (0, 4) else scaled[:, :, :3]
    assert (got == want).all() and (pixels.decode(pixels.encode(got)) == got).all()


def test_files_that_are_no_png():
    good = pixels.encode(np.zeros((2, 3, 3), np.uint8))
    for bad in (b"", b"GIF89a", good[:20], good[:45], png(2, 2, 8, 2, b"\0" * 14, interlaced=1), png(2, 2, 8, 2, b"\0" * 13), png(1, 1, 8, 2, b"\7\0\0\0"), png(1, 1, 8, 3, b"\0\5", b"\0\0\0")):
        with pytest.raises(ValueError):
            pixels.decode(bad)


def test_tiles_and_sizes(spark):
    rng = np.random.default_rng(0)
    for height, width, most in ((7, 20, 6), (31, 30, 12), (5, 5, 1), (40, 9, 4)):
        image = rng.integers(0, 256, (height, width, 3)).astype(np.uint8)
        columns, rows, cut = pixels.tiles(image, most, 4)
        whole = pixels.resized(image, columns * 4, rows * 4)
        assert all((cut[k] == whole[k // columns * 4 :][:4, k % columns * 4 :][:, :4]).all() for k in range(rows * columns)) and columns * rows <= most
        plain = np.zeros_like(whole)
        for y in range(rows * 4):
            for x in range(columns * 4):
                at = lambda i, new, old: [(j, max(0, 1 - abs(j - ((i + 0.5) * old / new - 0.5)) / max(1, old / new))) for j in range(old)]
                wy, wx = at(y, rows * 4, height), at(x, columns * 4, width)
                plain[y, x] = sum(a * b * image[j, i].astype(float) for j, a in wy if a for i, b in wx if b) / (sum(a for _, a in wy) * sum(b for _, b in wx))
        assert np.allclose(plain, whole)
    sizes = [(640, 480), (1000, 1000), (300, 1200), (2000, 500), (1, 999)]
    got = summary.tile_choice(spark.createDataFrame(sizes, "width int, height int"), 12).collect()
    assert {(r.width, r.height): (r.cols, r.rows) for r in got} == {s: pixels.grid(*s, 12) for s in sizes}


def test_models_stay_in_workers(spark):
    """A model is loaded once a worker, gets bounded batches, and sees a page at most twice, with retries of later steps."""
    seen, loads, batches = (spark.sparkContext.accumulator(0) for _ in range(3))

    def load(model):
        loads.add(1)

        def predict(pages, budget, prompt):
            seen.add(len(pages))
            batches.add(1)
            assert len(pages) == 1 or sum(np.prod(pixels.grid(p["width"], p["height"], budget.max_tiles)) for p in pages) <= 20
            return [f"<table><tr><td>{p['page_id']}</td></tr></table>" if budget.max_tiles > 8 or p["page_id"][-1] in "02468" else "none" for p in pages]

        return predict

    inference.register("held", inference.InWorkers(load, most_tiles=20))
    rng = random.Random(1)
    pages = spark.createDataFrame([(f"page_{i:07d}", rng.randrange(5, 90), rng.randrange(5, 90)) for i in range(300)], "page_id string, width int, height int").repartition(6)
    out = runners.adaptive(pages, inference.Model("m", "held"), *Q.LOW_HIGH, Q.PROMPT, "r", "s")
    again = {r.page_id for r in out.collect() if r.reparse_triggered}
    assert again == {f"page_{i:07d}" for i in range(1, 300, 2)} and seen.value == 450 and 0 < loads.value <= 12 and batches.value > 20


def test_brightness_of_images(spark, tmp_path):
    """From PNG files and a manifest to tables."""
    halves = np.zeros((32, 64, 3), np.uint8)
    halves[:, 32:] = 200
    (tmp_path / "a.png").write_bytes(pixels.encode(halves))
    record = {"page_id": "a", "image_path": "a.png", "language": "en", "contains_table": True, "is_english_table_page": True}
    (tmp_path / "r.json").write_text(json.dumps([record]))
    (tmp_path / "m.json").write_text(json.dumps({"page_ids": ["a"]}))
    page = drivers.pages_for(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"), str(tmp_path), content=True)
    # The last of 16 columns of the left tile lies an eighth in the right half: 200 / 8 / 16 is 1.6.
    row = inference.infer(page, inference.Model("m", "brightness"), inference.Budget("b", 2), Q.PROMPT).head()
    assert (row.width, row.height) == (64, 32) and row.raw_text == "# a\n\n<table><tr><td>2</td><td>198</td></tr></table>\n" and row.output_tokens == 3


@pytest.mark.parametrize("files", [1, 3])
def test_stream_and_batch_agree(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [{"page_id": f"p{rng.randrange(40)}", "line_no": i, "output_token_count": rng.randrange(1000), "verifier_failure_codes": ["X"] * (i % 3)} for i in range(300)]
    want = {(s, r["page_id"]): (r["line_no"], r["output_token_count"]) for s in "ab" for r in rows}
    rng.shuffle(rows)
    place = tmp_path / "in"
    for s in "ab":
        (place / f"system_id={s}").mkdir(parents=True)

    def add(part, some):
        for s in "ab":
            (place / f"system_id={s}" / f"{part}.json").write_text("".join(json.dumps(r) + "\n" for r in some))

    def follow():
        logs.keep_latest(logs.follow(spark, str(place), files), str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()

    assert logs.latest(spark, str(tmp_path / "out")).count() == 0
    add("0", rows[:100])
    add("1", rows[100:130])
    follow()
    add("2", rows[130:])
    follow()
    follow()
    out = logs.latest(spark, str(tmp_path / "out"))
    assert {(r.system_id, r.page_id): (r.line_no, r.output_token_count) for r in out.collect()} == want and out.count() == len(want)
    batch = summary.last_rows(spark.read.schema(logs.schemas.ANY_LOG + ", line_no long, system_id string").json(str(place)), "line_no", *logs.KEYS)
    order = sorted(batch.columns)
    assert out.select(order).exceptAll(batch.select(order)).count() == batch.select(order).exceptAll(out.select(order)).count() == 0
    assert {r.sample_size for r in logs.running_results(spark.read.schema(logs.schemas.ANY_LOG + ", system_id string").json(str(place))).collect()} == {300}
