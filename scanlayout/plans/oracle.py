"""SQL for DuckDB that says what the queries compute: fixtures and shared steps as common table expressions."""

from __future__ import annotations

P = "doc_id, page_index"
J = "USING (doc_id, page_index)"

TOKENS = r"""
w0 AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
w1 AS (SELECT doc_id, unnest(ws) AS text, CAST(unnest(range(len(ws))) AS BIGINT) AS w FROM w0),
w2 AS (SELECT doc_id, text, w, w % 240 AS p, doc_id % 2 AS v, least(length(text), 10) AS n, CAST(w // 240 AS INTEGER) AS page_index, CAST(w % 240 AS INTEGER) AS seq FROM w1),
w3 AS (SELECT doc_id, page_index, seq, text, v, w,
  CAST(CASE WHEN v = 0 THEN 60 + (p % 12) * 44 + (w * 7) % 5 ELSE 560 - (p // 20) * 42 + (w * 7) % 5 END AS DOUBLE) AS x0,
  CAST(CASE WHEN v = 0 THEN 70 + (p // 12) * 36 + (w * 13 + doc_id) % 7 ELSE 70 + (p % 20) * 36 + (w * 13 + doc_id) % 7 END AS DOUBLE) AS y0,
  CAST(CASE WHEN v = 0 THEN 4 * n ELSE 16 + (w % 3) * 2 END AS DOUBLE) AS bw, CAST(CASE WHEN v = 0 THEN 16 + (w % 3) * 2 ELSE 3 * n END AS DOUBLE) AS bh FROM w2),
tokens AS (SELECT doc_id, page_index, seq, text, x0, y0, x0 + bw AS x1, y0 + bh AS y1 FROM w3)"""

QUADS = """
k0 AS (SELECT *, ((doc_id % 7) - 3) * 0.02::DOUBLE * (x1 - x0) AS k FROM tokens),
k1 AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN degrees(atan2(y0 + k - y0, x1 - x0 + 1e-6::DOUBLE)) ELSE degrees(atan2(y1 - y0, x1 + k - x1 + 1e-6::DOUBLE)) END AS angle,
  CASE WHEN doc_id % 2 = 0 THEN [[x0, y0], [x1, y0 + k], [x1, y1 + k], [x0, y1]] ELSE [[x1, y0], [x1 + k, y1], [x0 + k, y1], [x0, y0]] END AS points FROM k0),
k2 AS (SELECT *, angle - 360 * floor(angle / 360) AS a FROM k1),
quads AS (SELECT doc_id, page_index, seq, text, points, list_min(list_transform(points, lambda q: q[1])) AS x0, list_min(list_transform(points, lambda q: q[2])) AS y0,
  list_max(list_transform(points, lambda q: q[1])) AS x1, list_max(list_transform(points, lambda q: q[2])) AS y1, angle,
  CASE WHEN abs(a - 90) <= 10 THEN 90 WHEN abs(a - 180) <= 10 THEN 180 WHEN abs(a - 270) <= 10 THEN 270 ELSE 0 END AS rot, a BETWEEN 45 AND 135 OR a BETWEEN 225 AND 315 AS is_v FROM k2)"""

MARGINS = """
mtokens AS (SELECT doc_id, page_index, seq, text, x0, x1, top AS y0, top + h AS y1 FROM
  (SELECT *, CASE seq % 40 WHEN 0 THEN 12::DOUBLE WHEN 1 THEN 815::DOUBLE ELSE y0 END AS top, (y1 - y0) * CASE WHEN seq % 31 = 0 THEN 0.5::DOUBLE ELSE 1 END AS h FROM tokens))"""

PAGES = """
pm AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS INTEGER) AS page_index,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS total_pages, CAST(800 + (l_partkey % 50) * 8 AS INTEGER) AS w_px, CAST(1100 + (l_suppkey % 50) * 8 AS INTEGER) AS h_px, l_partkey % 10 <> 0 AS ocr_ready,
  CAST(trunc(l_quantity) AS INTEGER) AS ocr_words, l_discount * 10 AS ink_ratio, CASE WHEN l_suppkey % 17 = 0 THEN 'E' ELSE '' END AS err, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""

RASTER = """
rasters AS (SELECT CAST(label AS BIGINT) AS doc_id, CAST(vec_id AS BIGINT) AS page_index, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5::DOUBLE) * 255))) AS INTEGER)) AS pixels FROM embeddings),
hist AS (SELECT doc_id, page_index, bin, count(*) AS n FROM (SELECT doc_id, page_index, unnest(pixels) AS bin FROM rasters) GROUP BY ALL)"""

CHROMA = """
ch0 AS (SELECT doc_id, page_index, pixels, unnest(range(len(pixels) // 2)) AS i FROM rasters),
chroma AS (SELECT doc_id, page_index, pixels[2 * i + 1] // 32 AS a, pixels[2 * i + 2] // 32 AS b, count(*) AS n FROM ch0 GROUP BY ALL)"""

EVENTS = """
ev0 AS (SELECT user_id AS doc_id, CASE WHEN event_type IN ('view', 'signup') THEN 'meta' WHEN event_type = 'error' THEN 'ocr_error' ELSE 'ocr' END AS kind, event_id, ts, event_type FROM events),
page_events AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, kind = 'meta' ORDER BY ts, event_id) - 1 AS INTEGER) AS page_index FROM ev0)"""


def tolerance(source: str, name: str = "tol") -> str:
    return f"""
{name} AS (SELECT {P}, CASE WHEN hs IS NULL THEN 10::DOUBLE ELSE least(20, greatest(3, 0.8::DOUBLE * hs[len(hs) // 2 + 1])) END AS tol
  FROM (SELECT {P}, list_sort(list(y1 - y0) FILTER (y1 - y0 > 0)) AS hs FROM {source} GROUP BY ALL))"""


def column_tolerance(source: str, tol: str = "tol", name: str = "tolx") -> str:
    return f"""
{name}1 AS (SELECT s.doc_id, s.page_index, any_value(tol) AS tol, list_sort(list((x0 + x1) / 2)) AS c FROM {source} s JOIN {tol} {J} GROUP BY s.doc_id, s.page_index),
{name}2 AS (SELECT *, list_filter(list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]), lambda g: g > 0) AS gaps, greatest(1.2::DOUBLE * tol, 2) AS least_gap FROM {name}1),
{name}3 AS (SELECT *, list_sort(list_filter(gaps, lambda g: g >= least_gap)) AS wide FROM {name}2),
{name} AS (SELECT {P}, CASE WHEN len(c) < 6 OR len(wide) < 3 THEN tol ELSE least(80, greatest(3, greatest(tol, 0.55::DOUBLE * wide[len(wide) // 2 + 1]))) END AS tol_x FROM {name}3)"""


def body(source: str, name: str = "body", w: float = 640, h: float = 840) -> str:
    mx, my = max(8.0, 0.05 * w), max(8.0, 0.05 * h)
    within = f"x0 > {mx} AND x1 < {w - mx} AND y0 > {my} AND y1 < {h - my}"
    edge = lambda c, p: f"list_sort(list_transform(u, lambda b: b.{c}))[CAST(round_even((len(u) - 1) * {p}::DOUBLE, 0) AS INTEGER) + 1]"
    return f"""
{name}1 AS (SELECT {P}, count(*) AS n, median(y1 - y0) FILTER (y1 - y0 > 0.5) AS med FROM {source} GROUP BY ALL),
{name}2 AS (SELECT s.doc_id, s.page_index, n, med, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) FILTER ({within} AND y1 - y0 > 0.5 AND y1 - y0 >= 0.75::DOUBLE * med AND y1 - y0 <= 2.2::DOUBLE * med) AS one,
  list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) FILTER ({within} AND y1 - y0 >= 0.65::DOUBLE * med) AS two FROM {source} s JOIN {name}1 {J} GROUP BY s.doc_id, s.page_index, n, med),
{name}3 AS (SELECT *, CASE WHEN coalesce(len(one), 0) < greatest(12, trunc(n * 0.06::DOUBLE)) THEN coalesce(two, []) ELSE one END AS u, greatest(6, 0.4::DOUBLE * med) AS pad FROM {name}2),
{name}4 AS (SELECT {P}, len(u) >= greatest(10, trunc(n * 0.04::DOUBLE)) AND med IS NOT NULL AS ok, greatest(0, {edge("x0", 0.05)} - pad) AS bx0, greatest(0, {edge("y0", 0.05)} - pad) AS by0, least({w}, {edge("x1", 0.95)} + pad) AS bx1, least({h}, {edge("y1", 0.95)} + pad) AS by1 FROM {name}3),
{name}5 AS (SELECT *, ok AND bx1 - bx0 >= 0.2 * {w} AND by1 - by0 >= 0.2 * {h} AS sure FROM {name}4),
{name} AS (SELECT {P}, CASE WHEN sure THEN bx0 END AS bx0, CASE WHEN sure THEN by0 END AS by0, CASE WHEN sure THEN bx1 END AS bx1, CASE WHEN sure THEN by1 END AS by1 FROM {name}5)"""


INSIDE = "(bx0 IS NULL OR ((x0 + x1) / 2 >= bx0 AND (x0 + x1) / 2 < bx1 AND (y0 + y1) / 2 >= by0 AND (y0 + y1) / 2 < by1))"


def ordered(source: str, name: str = "ord", tol: str = "tol", tolx: str = "tolx") -> str:
    v = "doc_id % 2 = 1"
    return f"""
{name} AS (SELECT s.*, tol, tol_x, row_number() OVER (PARTITION BY s.doc_id, s.page_index ORDER BY CASE WHEN {v} THEN -trunc((x0 + x1) / 2 / tol_x) ELSE trunc(y0 / tol) END, CASE WHEN {v} THEN y0 ELSE x0 END, CASE WHEN {v} THEN x0 END, seq) AS ord
  FROM {source} s JOIN {tol} {J} JOIN {tolx} {J})"""


def zoned(source: str, name: str = "zoned", boxes: str = "body", h: float = 840) -> str:
    my = max(8.0, 0.05 * h)
    return f"""
{name} AS (SELECT s.*, bx0, by0, bx1, by1, CASE WHEN (y0 + y1) / 2 <= 1.2::DOUBLE * {my} THEN 0 WHEN (y0 + y1) / 2 >= {h} - 1.2::DOUBLE * {my} THEN 3 WHEN {INSIDE} THEN 1 ELSE 2 END AS zone FROM {source} s LEFT JOIN {boxes} {J})"""


def anchors(source: str, name: str = "anchors") -> str:
    """source: tokens with tol_x and the body box."""
    return f"""
{name} AS (SELECT {P}, CAST(trunc((x0 + x1) / 2 / tol_x) AS INTEGER) AS col_id, median(x0) AS x0_med, median((x0 + x1) / 2) AS cx_med FROM {source} WHERE tol_x > 1e-6 AND {INSIDE} GROUP BY ALL)"""


LINES = """
med AS (SELECT doc_id, page_index, median(greatest(1, y1 - y0)) AS med_h FROM quads GROUP BY ALL),
ys AS (SELECT q.doc_id, q.page_index, rot, any_value(med_h) AS med_h, any_value(0.55::DOUBLE * med_h) AS ltol, list_sort(list((y0 + y1) / 2)) AS ys FROM quads q JOIN med USING (doc_id, page_index) GROUP BY q.doc_id, q.page_index, rot),
starts AS (SELECT doc_id, page_index, rot, med_h, list_reduce(list_transform(ys, lambda y: {'c': y, 'starts': [y]}), lambda s, y: CASE WHEN abs(y.c - s.c) <= ltol THEN {'c': 0.8::DOUBLE * s.c + 0.2::DOUBLE * y.c, 'starts': s.starts} ELSE {'c': y.c, 'starts': list_append(s.starts, y.c)} END).starts AS starts FROM ys),
lined AS (SELECT q.*, med_h, len(list_filter(starts, lambda s: s <= (y0 + y1) / 2)) AS line_no FROM quads q JOIN starts USING (doc_id, page_index, rot)),
gaps AS (SELECT *, row_number() OVER w AS pos, CASE WHEN rot IN (0, 180) THEN x0 - lag(x1) OVER w ELSE y0 - lag(y1) OVER w END AS gap FROM lined WINDOW w AS (PARTITION BY doc_id, page_index, rot, line_no ORDER BY CASE WHEN rot IN (0, 180) THEN x0 ELSE y0 END, y0 + y1, seq))"""


def sql(*parts: str) -> str:
    """Common table expressions, and a select over them."""
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1] if len(parts) > 1 else parts[0]
