"""Names, release, running sums, staged placement, images and residual skew, against plain loops."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from scanlayout.operators import names, placement, prefix, quality, raster, skew
from scanlayout.sources import files


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one_by_one(requests, existing):
    taken, out = set(existing), {}
    for seq, name in sorted(requests):
        folder, base = os.path.split(name)
        stem, ending = os.path.splitext(base)
        form, n = name, 1
        while form in taken:
            form, n = os.path.join(folder, f"{stem}({n}){ending}"), n + 1
        taken.add(form)
        out[seq] = form
    return out


def test_names_are_those_that_one_by_one_would_give(spark):
    rng = random.Random(5)
    requests, existing, seq = [(1, "z/a.pdf"), (2, "z/a.pdf"), (3, "z/a(1).pdf")], set(), 3
    for world in range(60):  # names of different worlds don't meet
        marks = ["", "", "", "(1)", "(1)", "(2)", "(3)", "(1)(1)", "(2)(1)", "(1)(1)(1)", "(01)"]
        for _ in range(rng.randint(1, 25)):
            seq += 1
            requests.append((seq, f"w{world}/a{rng.choice(marks)}.pdf"))
        existing |= {f"w{world}/a{rng.choice(marks)}.pdf" for _ in range(rng.choice([0, 0, 1, 3]))}
    for k, name in enumerate([".profile", ".profile", "a..b", "a..b", "a(1)", "a", "a", "a(0).x", "a.x", "a.x", "(1).y", ".y", ".y", "..", ".."]):
        requests.append((seq + k + 1, f"odd/{name}"))
    rng.shuffle(requests)
    out = names.allocate_names(spark.createDataFrame([*requests, (10**6, None)], "seq long, name string"), spark.createDataFrame([(x,) for x in sorted(existing)] + [(None,)], "name string"))
    got = {r.seq: r.out_name for r in out.collect()}
    assert got == one_by_one(requests, existing)
    assert [got[k] for k in (1, 2, 3)] == ["z/a.pdf", "z/a(1).pdf", "z/a(1)(1).pdf"] and len(set(got.values())) == len(got)
    empty = spark.createDataFrame([], "seq long, name string")
    assert names.allocate_names(empty, empty.select("name")).collect() == []


def test_labels_of_a_hot_name(spark):
    rng = random.Random(2)
    paths = [(k, f"/{rng.choice('xyz')}/{'a' if rng.random() < 0.7 else rng.choice('bc')}") for k in range(200)]
    first, second, more, wanted = set(), set(), {}, {}
    for k, path in paths:
        parent, base = path.strip("/").split("/")
        if base not in first:
            first.add(base)
            wanted[k] = base
        elif (base, parent) not in second:
            second.add((base, parent))
            wanted[k] = f"{base} — {parent}"
        else:
            more[base] = more.get(base, 1) + 1
            wanted[k] = f"{base} — {more[base]}"
    assert {r.seq: r.label for r in names.dedup_labels(spark.createDataFrame(paths, "seq long, path string")).collect()} == wanted


def test_running_sums_of_a_key_with_ties_and_nulls(spark):
    rows = [("a" if k % 3 else None, k // 40, k, k % 5 if k % 7 else None) for k in range(600)]
    out = prefix.running(spark.createDataFrame(rows, "key string, at long, i long, x long"), ["key"], ["at", "i"], {"total": F.col("x"), "n": F.lit(1)})
    got = {r.i: (r.key, r.x, r.total, r.n) for r in out.collect()}
    sums = {"a": [0, 0], None: [0, 0]}
    for key, _, i, x in rows:
        sums[key][0] += x or 0
        sums[key][1] += 1
        assert got[i] == (key, x, *sums[key])
    parts = prefix.running(spark.createDataFrame([("a", 1, k) for k in range(4000)], "key string, at long, i long"), ["key"], ["at", "i"], {"n": F.lit(1)})
    assert parts.agg(F.max("n"), F.count_distinct("n")).first() == (4000, 4000)


def test_release_of_repeated_null_and_missing_pages(spark):
    rng = random.Random(4)
    rows = [(1, 0, True), (1, 0, True), (1, 1, True), (2, None, True), (2, 0, True), (2, 1, None), (None, 0, True), (3, -1, True), (4, 0, False), (4, 0, True), (4, 1, True)]
    rows += [(doc, rng.choice([p, p, p, None]), rng.random() < 0.97) for doc in range(10, 16) for p in range(40) for _ in range(rng.choice([1, 2]))]
    rows += [(20, p, True) for p in range(30)]
    wanted = []
    ready = {(d, p) for d, p, r in rows if r and p is not None}
    for d, p, _ in rows:
        gap = next(k for k in range(100) if (d, k) not in ready)
        wanted.append((d, p, p is not None and 0 <= p < gap))
    table = spark.createDataFrame(rows, "doc_id long, page_index int, ocr_ready boolean")
    for width in (1, 4, 256):
        assert values(quality.in_order_release(table, width=width), "doc_id", "page_index", "released") == sorted(wanted, key=repr)
    progress = values(quality.progress(table.where("doc_id = 1 OR doc_id IS NULL")), "doc_id", "page_index", "done", "total")
    assert progress == sorted([(1, 0, 1, 3), (1, 0, 2, 3), (1, 1, 3, 3), (None, 0, 1, 1)], key=repr)


def words_to_place(spark, n=40):
    rows = [(doc, page, k, "ab、c", 10.0 * k, 5.0, 10.0 * k + 8, 25.0, 0.0, 10.0 * k, 6.0, 5.0, 9, 1.05, 1.0) for doc in (1, 2) for page in (0, 1) for k in range(n)]
    names_ = "doc_id long, page_index int, seq int, text string, x0 double, y0 double, x1 double, y1 double, angle double, x0_snapped double, v_pitch double, v_fs double, v_samples int, xscale double, bx0 double"
    return spark.createDataFrame(rows, names_)


def test_only_pages_that_went_badly_are_placed_again(spark):
    drawn = []

    def draw(plan):
        drawn.append(plan)
        bad = F.expr("CASE stage WHEN 0 THEN doc_id = 1 WHEN 1 THEN page_index = 1 ELSE true END")
        return plan.withColumn("ok", ~(bad & (F.col("seq") % 5 == 0)))

    plan, stats = placement.staged_plan(words_to_place(spark), F.col("seq") % 2 == 0, draw)
    said = values(stats, "doc_id", "page_index", "fallback_stage", "fallback_reason", "attempted_inserts", "body_rect_used")
    assert said == [(1, 0, 1, "error_rate=0.200", 100, True), (1, 1, 2, "error_rate=0.200 -> error_rate=0.200", 40, True), (2, 0, 0, "", 40, True), (2, 1, 0, "", 40, True)]
    assert [values(p.select("doc_id", "page_index").distinct(), "doc_id", "page_index") for p in drawn] == [[(1, 0), (1, 1), (2, 0), (2, 1)], [(1, 0), (1, 1)], [(1, 1)]]
    assert values(plan.groupBy("doc_id", "page_index", "stage").count(), "doc_id", "page_index", "stage", "count") == [(1, 0, 1, 100), (1, 1, 2, 40), (2, 0, 0, 40), (2, 1, 0, 40)]
    assert values(stats, "doc_id", "page_index", "vertical_tokens", "horizontal_tokens", "vertical_chars", "vertical_exception_chars", "vrun_samples")[0] == (1, 0, 20, 20, 80, 20, 0)
    ratios = stats.where("doc_id = 2").select(F.round("vrun_target_ratio_min", 6), F.round("vrun_target_ratio_max", 6)).first()
    assert ratios == (1.1 * 1.2, 1.1 * 1.2)  # four characters of pitch 6 over a height of 20
    all_good, one = placement.staged_plan(words_to_place(spark), F.lit(False), lambda plan: plan.withColumn("ok", F.lit(True)))
    assert one.where("fallback_stage = 0").count() == 4 and all_good.count() == 160


def test_widths_of_runs(spark):
    widths = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("b", 0.75), ("、", 2.0), ("xy", 9.0), ("c", None)], "ch string, width double")
    tokens = words_to_place(spark, 1).where("doc_id = 1 AND page_index = 0").unionByName(words_to_place(spark, 1).where("doc_id = 2 AND page_index = 0").withColumn("text", F.lit("ddd")))
    wide = placement.text_widths(widths)
    assert values(tokens.select("text", wide(F.col("text")).alias("w")), "text", "w") == [("ab、c", 4.25), ("ddd", 3.0)]
    plain = {r.text: r for r in placement.place_vertical_run(tokens).collect()}
    told = {r.text: r for r in placement.place_vertical_run(tokens, widths=widths).collect()}
    assert told["ddd"] == plain["ddd"] and abs(told["ab、c"].xscale - plain["ab、c"].xscale * 4 / 4.25) < 1e-9


def images(spark, arrays):
    rows = [(1, k, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes())) for k, a in enumerate(arrays)]
    return spark.createDataFrame([*rows, (1, 99, 3, 3, 3, None), (1, 98, 3, 3, 3, bytearray(b"short"))], "doc_id long, page_index int, width int, height int, n_channels int, data binary")


def test_thumbnails_are_means_over_areas(spark):
    rng = np.random.default_rng(1)
    edge = np.zeros((10, 10, 3), dtype=np.uint8)
    edge[:, 9] = 255
    arrays = [edge, *(rng.integers(0, 256, shape).astype(np.uint8) for shape in ((7, 13, 3), (31, 5, 1), (4, 4, 3), (1, 9, 3), (50, 41, 3)))]
    out = {r.page_index: r for r in raster.thumbnail(images(spark, arrays), 4).collect()}
    assert not out[99].is_valid and not out[98].is_valid and out[98].data is None
    for k, a in enumerate(arrays):
        h, w, c = a.shape
        scale = min(1.0, 4 / max(h, w))
        th, tw = max(1, int(h * scale)), max(1, int(w * scale))
        assert (out[k].height, out[k].width, out[k].n_channels) == (th, tw, c)
        got = np.frombuffer(bytes(out[k].data), dtype=np.uint8).reshape(th, tw, c)
        for y in range(th):
            for x in range(tw):
                total, area = 0.0, 0.0
                for i in range(h):
                    for j in range(w):
                        weight = max(0.0, min(i + 1, (y + 1) * h / th) - max(i, y * h / th)) * max(0.0, min(j + 1, (x + 1) * w / tw) - max(j, x * w / tw))
                        total, area = total + weight * a[i, j].astype(float), area + weight
                assert np.abs(got[y, x] - total / area).max() <= 0.5 + 1e-5
    assert abs(np.frombuffer(bytes(out[0].data), dtype=np.uint8).mean() - edge.mean()) < 0.5
    sampled = {r.page_index: r for r in raster.colour_sample(images(spark, [np.zeros((300, 10, 3), np.uint8), np.zeros((200, 256, 3), np.uint8), edge])).collect()}
    assert [(sampled[k].height, sampled[k].width) for k in range(3)] == [(256, 16), (100, 128), (10, 10)]


def test_lab_colours(spark):
    known = {(0, 0, 0): (0, 0), (255, 255, 255): (0, 0), (128, 128, 128): (0, 0), (0, 0, 255): (80, 67), (0, 255, 0): (-86, 83), (255, 0, 0): (79, -108)}  # blue, green, red
    assert {c: tuple(raster.lab_chroma(np.array([c]))[0].tolist()) for c in known} == known
    grey, tinted, red = (np.full((20, 20, 3), c, dtype=np.uint8) for c in ((90, 90, 90), (200, 210, 215), (90, 90, 90)))
    red[0, :2] = (0, 0, 255)
    told = raster.gray_decision(raster.image_chroma_hist(raster.colour_sample(images(spark, [grey, tinted, red]))))
    assert values(told, "page_index", "is_gray") == [(0, True), (1, True), (2, False)]


def test_images_are_written_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((3, 5, 3), (2, 2, 1), (4, 1, 3))]
    written = files.write_page_images(images(spark, arrays).where("page_index <> 98"), f"file://{tmp_path}/images")
    assert sorted(r.name for r in written.collect()) == ["1-0.bmp", "1-1.bmp", "1-2.bmp", "1-99.bmp"] and len(list((tmp_path / "images").iterdir())) == 4
    read = {r.origin.rsplit("-", 1)[1]: r for r in files.read_page_images(spark, f"{tmp_path}/images").collect()}
    assert not read["99.bmp"].is_valid and read["99.bmp"].data is None
    for k, a in enumerate(arrays):
        r = read[f"{k}.bmp"]
        assert np.array_equal(np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width, 3), np.broadcast_to(a, (*a.shape[:2], 3)))


def test_least_rectangle_has_the_least_area_of_all_turns(spark):
    rng = np.random.default_rng(7)
    area = lambda p, t: np.ptp(p @ [np.cos(t), np.sin(t)]) * np.ptp(p @ [-np.sin(t), np.cos(t)])
    for n in (1, 2, 3, 5, 40, 200):
        for _ in range(20):
            p = rng.normal(size=(n, 2)) * [3, 1]
            t = skew._least_rectangle(p)
            assert -45 < t <= 45 and area(p, np.radians(t)) <= min(area(p, x) for x in np.radians(np.arange(-45, 45, 0.25))) + 1e-6
    grid = np.array([(x, y) for x in range(6) for y in range(9)], dtype=float)
    for turn in (0, 2, -2.5, 7, 44):
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        assert abs(skew._least_rectangle(grid @ np.array([[c, s], [-s, c]])) - turn) < 1e-6


def test_residual_skew_has_all_outcomes(spark):
    def page(number, lean, loose, turn, n=60):
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        out = []
        for k in range(n):
            x, y = 60.0 * (k % 10), 30.0 * (k // 10)
            d = 50 * np.tan(np.radians(lean + loose * (k % 9 - 4)))
            corners = [(x, y), (x + 50, y + d), (x + 50, y + 20), (x, y + 20)]
            out.append((1, number, k, [[float(a * c - b * s), float(a * s + b * c)] for a, b in corners]))
        return out

    pages = [page(0, 2, 0, 0), page(1, 8, 0, 0), page(2, 0.1, 0, 0), page(3, 0, 2, 2), page(4, 0, 2, 0), page(5, 0, 2, 7), page(6, 0, 2, 2, n=5)]
    tokens = spark.createDataFrame(sum(pages, []), "doc_id long, page_index int, seq int, points array<array<double>>")
    from dataclasses import replace

    out = skew.residual_skew(tokens, F.lit(600), replace(skew.STRICT, min_len=10.0, min_len_share=0.01), least_corners=100)
    got = {r.page_index: (round(r.angle, 3), r.ok, r.method) for r in out.collect()}
    assert got[0] == (-2.0, True, "hough") and got[1] == (-3.0, True, "hough") and got[2] == (0.0, False, "hough-straight")
    assert got[3][1:] == (True, "minarearect") and abs(got[3][0] + 2) < 0.4 and got[4][2] == "minarearect-straight" and got[5][2] == "minarearect-too-big" and got[6][2] == "minarearect-few"
