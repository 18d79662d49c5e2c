"""Small pages with worked answers, and properties."""

import random
import struct

from pyspark.sql import functions as F

from scanlayout.functions import columns as fc
from scanlayout.operators import names, placement, prefix, quality, raster, reading, skew, words
from scanlayout.sources import files

TOKENS = "doc_id long, page_index int, seq int, text string, x0 double, y0 double, x1 double, y1 double"


def page(spark, boxes):
    return spark.createDataFrame([(1, 0, i, f"t{i}", *map(float, b)) for i, b in enumerate(boxes)], TOKENS)


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tolerance_is_the_upper_median(spark):
    t = page(spark, [(0, 0, 5, 10), (0, 0, 5, 20), (0, 0, 5, 10), (0, 0, 5, 20)])
    assert values(reading.reading_tolerance(t), "tol") == [(16.0,)]
    assert values(reading.reading_tolerance(page(spark, [(0, 5, 5, 5)])), "tol") == [(10.0,)]


def test_column_tolerance_needs_wide_gaps(spark):
    t = page(spark, [(40 * i, 0, 40 * i + 10, 10) for i in range(6)])
    tol = reading.reading_tolerance(t)
    assert values(reading.column_tolerance(t, tol), "tol_x") == [(22.0,)]
    few = page(spark, [(0, 0, 10, 10)])
    assert values(reading.column_tolerance(few, reading.reading_tolerance(few)), "tol_x") == [(8.0,)]


def test_rotation_edges(spark):
    rows = spark.createDataFrame([(a,) for a in (0.0, 80.0, 79.9, 100.0, 355.0, -90.0, 190.1, 270.0, 45.0, 135.0, 135.1, 225.0)], "a double")
    got = {r.a: (r.rot, r.v) for r in rows.select("a", fc.snap_rotation(F.col("a")).alias("rot"), fc.is_vertical(F.col("a")).alias("v")).collect()}
    assert got == {0.0: (0, False), 80.0: (90, True), 79.9: (0, True), 100.0: (90, True), 355.0: (0, False), -90.0: (270, True), 190.1: (0, False), 270.0: (270, True), 45.0: (0, True), 135.0: (0, True), 135.1: (0, False), 225.0: (0, True)}


def test_order_is_a_permutation_and_zones_partition(spark):
    rng = random.Random(1)
    t = page(spark, [(x := rng.randrange(600), y := rng.randrange(820), x + 20, y + 15) for _ in range(100)])
    tol = reading.reading_tolerance(t)
    rows = reading.with_page_values(t, tol, reading.column_tolerance(t, tol), reading.body_region(t, 640.0, 840.0))
    for vertical in (F.lit(True), F.lit(False)):
        out = reading.body_priority(reading.reading_order(rows, vertical), 840.0)
        assert [r[0] for r in values(out, "ord")] == list(range(1, 101))
        assert {r[0] for r in values(out, "zone")} <= {0, 1, 2, 3}


def test_lines_equal_nearest_clusters(spark):
    rng = random.Random(2)
    boxes = [(x := rng.randrange(600), y := rng.randrange(300), x + 20, y + rng.choice([10, 14, 18])) for _ in range(200)]
    t = page(spark, boxes).withColumn("rot", F.lit(0))
    heights = sorted(b[3] - b[1] for b in boxes)
    med = (heights[99] + heights[100]) / 2
    centres, lines = [], {}
    for i in sorted(range(200), key=lambda i: ((boxes[i][1] + boxes[i][3]) / 2, boxes[i][0], i)):
        y = (boxes[i][1] + boxes[i][3]) / 2
        near = [(abs(y - c), k) for k, c in enumerate(centres) if abs(y - c) <= 0.55 * med]
        if near:
            k = min(near)[1]
            centres[k] = centres[k] * 0.8 + y * 0.2
        else:
            k = len(centres)
            centres.append(y)
        lines[i] = k + 1
    assert dict(values(reading.assign_line(t, reading.line_starts(t)), "seq", "line_no")) == lines


def test_line_text_has_a_blank_at_wide_gaps(spark):
    t = page(spark, [(0, 0, 10, 10), (11, 0, 20, 10), (40, 0, 50, 10)]).withColumn("rot", F.lit(0))
    assert values(reading.build_lines(t), "text", "x0", "x1", "base_y") == [("t0t1 t2", 0.0, 50.0, 8.5)]


def test_broken_words_are_dropped(spark):
    sent = '[{"text":"a","points":[[0,0],[1,0],[1,1],[0,1]]},{"text":"","points":[[0,0],[1,0],[1,1],[0,1]]},{"text":"b","points":[[0,0],[1,0],[1,1]]},{"text":"c","points":[[0,0],[2,0],[2,2],[0,2]]}]'
    rows = spark.createDataFrame([(1, 0, sent), (2, 0, "no json"), (3, 0, None)], "doc_id long, page_index int, words string")
    assert values(words.read_words(rows), "doc_id", "seq", "text", "x1") == [(1, 0, "a", 1.0), (1, 3, "c", 2.0)]


def test_otsu_is_the_first_best_threshold(spark):
    rng = random.Random(3)
    for _ in range(3):
        bins = {b: rng.randrange(1, 30) for b in rng.sample(range(256), 12)}
        hist = spark.createDataFrame([(1, 0, b, n) for b, n in bins.items()], "doc_id long, page_index int, bin int, n long")

        def variance(t):
            lo, hi = {b: n for b, n in bins.items() if b <= t}, {b: n for b, n in bins.items() if b > t}
            if not lo or not hi:
                return 0
            w0, w1 = sum(lo.values()), sum(hi.values())
            return w0 * w1 * (sum(b * n for b, n in lo.items()) / w0 - sum(b * n for b, n in hi.items()) / w1) ** 2

        best = max(variance(t) for t in bins)
        assert values(raster.otsu_threshold(hist), "t")[0][0] == min(t for t in bins if variance(t) >= best - 1e-9)


def test_fallback_edges(spark):
    t = page(spark, [(0, 0, 1, 1)] * 30)
    tries = lambda bad0, bad1: spark.createDataFrame([(1, 0, i, s, i >= b) for s, b in ((0, bad0), (1, bad1)) for i in range(30)], "doc_id long, page_index int, seq int, stage int, ok boolean")
    assert values(placement.fallback_stage(t, tries(0, 0)), "fallback_stage", "fallback_reason") == [(0, "")]
    assert values(placement.fallback_stage(t, tries(1, 0)), "fallback_stage", "fallback_reason") == [(1, "error_rate=0.033")]
    assert values(placement.fallback_stage(t, tries(1, 3)), "fallback_stage", "fallback_reason") == [(2, "error_rate=0.033 -> error_rate=0.100")]


def test_released_pages_form_a_prefix(spark):
    rows = spark.createDataFrame([(1, i, i != 3) for i in range(6)] + [(2, i, True) for i in range(2)], "doc_id long, page_index int, ocr_ready boolean")
    assert values(quality.in_order_release(rows).where("released"), "doc_id", "page_index") == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_names(spark):
    wanted = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b.pdf")], "seq int, name string")
    have = spark.createDataFrame([("a(1).pdf",), ("b.pdf",)], "name string")
    assert values(names.allocate_names(wanted, have), "seq", "out_name") == [(1, "a.pdf"), (2, "a(2).pdf"), (3, "b(1).pdf")]
    paths = spark.createDataFrame([(1, "/x/a"), (2, "/y/a"), (3, "/y/a"), (4, "/y/a")], "seq int, path string")
    assert values(names.dedup_labels(paths), "seq", "label") == [(1, "a"), (2, "a — y"), (3, "a — 2"), (4, "a — 3")]


def test_weighted_median_and_mad(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 10.0, 2.0), (1, -5.0, 0.0)], "k int, v double, w double")
    assert values(skew.weighted_mad(rows, ["k"], "v", "w"), "wmedian", "mad") == [(2.0, 1.0)]


def test_images(spark, tmp_path):
    def bmp(w, h, colour):
        row = bytes(colour) * w
        row += b"\0" * (-len(row) % 4)
        body = row * h
        return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body

    (tmp_path / "a.bmp").write_bytes(bmp(4, 4, (10, 20, 30)))
    (tmp_path / "b.bmp").write_bytes(b"no image")
    images = files.read_page_images(spark, str(tmp_path))
    assert values(images, "is_valid", "width", "n_channels") == [(False, None, None), (True, 4, 3)]
    pages = images.withColumns({"doc_id": F.lit(1).cast("long"), "page_index": F.lit(0)})
    assert values(raster.image_luma_hist(pages), "bin", "n") == [(22, 16)]
    assert values(raster.image_chroma_hist(pages), "a", "b", "n") == [(3, 7, 16)]
    small = raster.thumbnail(pages, 2).where("is_valid").first()
    assert (small.width, small.height, bytes(small.data)) == (2, 2, bytes((10, 20, 30)) * 4)


def test_streams_equal_their_batch_twins(spark):
    import __spark_entry__

    from scanlayout.plans import queries as plans

    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.001"
    joined = queries["s1_stream_join_pages"](spark, sf)
    assert joined.columns == ["doc_id", "page_index", "meta_ts", "ocr_ts", "kind"]
    assert queries["s2_stalled_pages"](spark, sf).where("meta_ts IS NULL").count() == 0
    meta, ocr = (x.withColumn("us", F.unix_micros("ts")).collect() for x in plans._sides(spark, sf))
    late = {(r.doc_id, r.page_index): r for r in ocr}
    near = lambda r: (r.doc_id, r.page_index) in late and abs(late[r.doc_id, r.page_index].us - r.us) <= 120_000_000
    wanted = sorted((r.doc_id, r.page_index, r.us, late[r.doc_id, r.page_index].us if near(r) else 0) for r in meta)
    assert sorted((r.doc_id, r.page_index, r.meta_ts, r.ocr_ts or 0) for r in joined.collect()) == wanted and 0 < sum(w[3] == 0 for w in wanted) < len(wanted)


def test_pages_come_out_in_order_and_stop_at_a_gap(spark):
    """Shuffled arrival, repeats, gaps, rows too late, and a document that expires."""
    from scanlayout.plans import queries as plans
    from scanlayout.streaming import pages as streams

    arrivals = [(1, 1, 0), (1, 0, 1), (2, 0, 2), (1, 3, 3), (1, 2, 4), (2, 2, 5), (1, 3, 6), (3, 1, 7), (3, 1, 7), (3, 4, 8)]
    events = spark.createDataFrame(arrivals, "doc_id long, page_index int, s long").select("doc_id", "page_index", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"))
    out = streams.stream_in_order_release(plans._replayed(events, 8).where("doc_id <> -1 OR page_index = 0"), keep="1 hour", late="1 minute")
    seen = []
    with streams.rocksdb(spark):
        query = out.writeStream.foreachBatch(lambda batch, n: seen.extend((n, *r) for r in batch.collect())).option("checkpointLocation", plans.work_dir(spark)).trigger(availableNow=True).start()
        query.awaitTermination()
    told = lambda doc, status: [p for _, d, p, s in seen if d == doc and s == status]
    assert [told(doc, "released") for doc in (1, 2, 3)] == [[0, 1, 2, 3], [0], []]
    assert [told(doc, "expired") for doc in (1, 2, 3)] == [[], [2], [1, 4]]


def test_release_stops_at_missing_and_unknown_pages(spark):
    rows = spark.createDataFrame([(1, 1, True), (2, 0, True), (2, 2, True), (3, 0, True), (3, 1, None), (3, 2, True)], "doc_id long, page_index int, ocr_ready boolean")
    assert values(quality.in_order_release(rows).where("released"), "doc_id", "page_index") == [(2, 0), (3, 0)]


def test_numbers_of_a_hot_key(spark):
    rows = spark.createDataFrame([("a", i % 50, i) for i in range(300)] + [("b", 7, 7), ("b", None, 8)], "key string, at long, i long")
    out = values(prefix.numbered(rows, "key", ["at", "i"]), "key", "k", "at", "i")
    assert [r[1] for r in out] == [*range(1, 301), 1, 2] and [r[2:] for r in out[:300]] == sorted((i % 50, i) for i in range(300)) and out[300:] == [("b", 1, None, 8), ("b", 2, 7, 7)]


def test_a_report_is_read_back_whole(spark, tmp_path):
    from scanlayout.operators import pages as page_ops

    raw = spark.createDataFrame([(1, "abc", "pixel", "90")], "job_id long, dpi string, output_page_mode string, gray_p99_limit string")
    stats = spark.createDataFrame([(1, 0, 5, 5, 4, 1, 0, True, 0.7), (1, 1, 0, 0, 0, 0, 1, False, 0.9)], "doc_id long, page_index int, total_tokens long, attempted_inserts long, ok_inserts long, insert_errors long, fallback_stage int, ocr_fallback_used boolean, ink_ratio double")
    files.write_quality_report(quality.quality_summary(stats), page_ops.normalize_settings(raw), stats, str(tmp_path))
    assert values(spark.read.json(f"{tmp_path}/settings"), "dpi", "gray_p99_limit", "output_page_mode") == [(100, 80.0, "pixel")]
    assert values(spark.read.json(f"{tmp_path}/summary"), "level", "pages", "fallback_pages", "ocr_fallback_pages", "suspected_nonblank_pages", "error_rate") == [(0, 2, 1, 1, 1, 0.2), (1, 2, 1, 1, 1, 0.2)]
    assert values(spark.read.json(f"{tmp_path}/pages"), "page_index", "ok_inserts") == [(0, 4), (1, 0)]


def test_empty_tables_give_empty_results(spark):
    t = spark.createDataFrame([], TOKENS)
    tol = reading.reading_tolerance(t)
    assert reading.column_tolerance(t, tol).count() == reading.body_region(t, 640.0, 840.0).count() == 0
    assert reading.build_lines(t.withColumn("rot", F.lit(0))).count() == 0
