"""Page steps work on words dealt by page, sort natively and shuffle no single words."""

import re

from pyspark.sql import functions as F

from scanlayout.functions import columns as fc
from scanlayout.operators import placement, words
from scanlayout.plans import queries

SMOKE = "/root/testdata/sf0.001"


def _exchanges(df) -> list[str]:
    """Exchanges of the plan as it was before anything ran."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def test_valid_words_are_counted_from_one_reading(spark):
    good, few, bad = "[[0,0],[1,0],[1,1],[0,1]]", "[[0,0],[1,0],[1,1]]", "[[0,0],[1],[1,1],[0,1]]"
    message = f'[{{"text":"a","points":{good}}},{{"text":"","points":{good}}},{{"text":"b","points":{few}}},{{"text":"c","points":{bad}}},{{"text":"d","points":{good}}}]'
    sent = spark.createDataFrame([(1, 0, message), (1, 1, "[]"), (1, 2, "{broken")], "doc_id long, page_index int, words string")
    rows = {r.page_index: (r.valid, r.sent) for r in words.count_words(sent).collect()}
    assert rows[0] == (2, 5) and rows[1] == (0, 0) and rows[2][0] == 0
    assert words.read_words(sent).where("page_index = 0").count() == 2
    plan = queries.QUERIES["b1_valid_word"](spark, SMOKE)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString() and len(_exchanges(plan)) == 1


def test_words_are_exchanged_only_as_texts_of_pages(spark):
    for name in ("a1_read_words", "b18_orientation", "c4_snap_to_column", "d3_column_anchors", "d5_page_metrics", "d8_build_lines", "p1_place_horizontal", "p4_placement_plan", "p6_text_layer", "w4_line_gaps"):
        assert len(_exchanges(queries.QUERIES[name](spark, SMOKE))) == 1, name


def test_arrays_are_in_order_with_nulls_last(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([3.0, None, 1.0],), ([],), ([None],)], "a array<double>")
    got = rows.select(fc.in_order(F.col("a")).alias("s"), fc.upper_median(F.col("a")).alias("m")).collect()
    assert [r.s for r in got] == [[1.0, 2.0, 3.0], [1.0, 3.0, None], [], [None]]
    assert [r.m for r in got] == [2.0, 3.0, None, None]


def test_clean_text_trims_what_the_pattern_says(spark):
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c + "x" + c + "y" + c,) for c in every] + [(c,) for c in every], "t string")
    pattern = F.regexp_replace("t", f"^{fc.SPACE}+|{fc.SPACE}+$", "")
    assert rows.where(fc.clean_text(F.col("t")) != pattern).count() == 0


def test_coord_scale_at_its_bounds(spark):
    """Percentiles that are 268.8 but for the last bit: a fifth of the page is still within reason, whatever they were interpolated from."""
    from scanlayout.operators import reading

    cases = [(n, lo, lo + step) for n in range(5, 60) for lo in range(180, 269) for step in range(1, 90) if abs(lo + step * ((n - 1) * 0.95 % 1) - 268.8) < 1e-9]
    rows = [(k, 0, float(low if i < int((n - 1) * 0.95 + 1e-9) + 1 else high)) for k, (n, low, high) in enumerate(cases) for i in range(n)]
    tokens = spark.createDataFrame(rows, "doc_id long, page_index int, x1 double").withColumn("y1", F.col("x1"))
    out = reading.coord_scale(tokens, F.lit(1344.0), F.lit(268.8 / 0.85)).collect()
    assert len(out) == len(cases) > 20 and {(r.tx, r.ty) for r in out} == {(5.0, 1.0)}


def test_staged_placement_shuffles_no_plan(spark):
    """Plans lie in buckets of pages: to leave out the bad pages of stages 0 and 1, only these pages' keys are exchanged (before: the plans too)."""
    tokens, up = queries._to_place(spark, SMOKE)
    plan, _ = placement.staged_plan(tokens, up, lambda rows: rows.withColumn("ok", F.expr(queries._DRAWN)), parts=8)
    assert len(_exchanges(plan)) == 2 and plan.select("stage").distinct().count() == 3


def test_residual_skew_reads_words_once(spark):
    """a page's words are gathered once for both steps; before, those of unsure pages were made and gathered a second time, behind a join with the written first step."""
    plan = queries.QUERIES["d17_residual_skew"](spark, SMOKE)
    assert len(_exchanges(plan)) == 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()
