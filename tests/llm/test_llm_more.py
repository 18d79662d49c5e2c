"""More of the operators against brute force: whole given tables, hot groups, parts of filters, clashing names, broken batches."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlayout.llm import chat, common, decontaminate, exact_dedup, language_id, near_dedup, queries, sharding, substring_dedup, token_counts
from test_llm import edited, prose, rows, table

SF = "/root/testdata/sf0.01"


def roots(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {i: find(i) for i in nodes}


def test_near_dedup_finds_all_links_of_a_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    idf = near_dedup.inverse_frequencies(docs)
    own = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    vectors = dict(zip(own, near_dedup.vectors(list(own.values()), idf, 5)))
    sums = {i: v[1].sum() for i, v in vectors.items() if len(v[0])}
    sets = {i: set(vectors[i][0].tolist()) for i in sums}
    linked = [(a, b) for a, b in combinations(sums, 2) if min(sums[a], sums[b]) >= 0.8 * max(sums[a], sums[b]) and not sets[a].isdisjoint(sets[b]) and near_dedup.similarity(vectors[a], vectors[b]) >= 0.8 - 1e-9]
    assert linked and sum(got[a] == got[b] for a, b in linked) >= 0.99 * len(linked)
    wanted = roots(own, linked)
    assert sum(got[i] == wanted[i] for i in own) >= 0.99 * len(own)


def test_near_dedup_of_a_large_loose_group(spark):
    """Texts that share most of their words with all others: those over the similarity are linked, others not, whatever bucket they share."""
    base = prose(150, 71)
    texts = [(i, edited(base, 1 + i % 9, 5000 + i)) for i in range(150)]
    docs = table(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    idf = near_dedup.inverse_frequencies(docs)
    vectors = dict(zip([i for i, _ in texts], near_dedup.vectors([t for _, t in texts], idf, 5)))
    wanted = roots([i for i, _ in texts], [(a, b) for a, b in combinations(vectors, 2) if near_dedup.similarity(vectors[a], vectors[b]) >= 0.8 - 1e-9])
    assert 1 < len(set(wanted.values())) < 150 and sum(got[i] == wanted[i] for i in wanted) >= 148


def test_prefixes_of_similar_texts_meet():
    rng = np.random.default_rng(3)
    for trial in range(400):
        f = np.unique(rng.integers(1, 1 << 62, 90).astype(np.uint64))
        w = rng.random(len(f)) * 3 + 0.3
        hub = f[rng.random(len(f)) < rng.random()]
        keep = rng.random((2, len(f))) < rng.uniform(0.8, 1)
        a, b = ((f[k], w[k] * rng.choice([1, 1, 1, 1.2], k.sum())) for k in keep)
        if a[1].sum() > b[1].sum():
            a, b = b, a
        if near_dedup.similarity(a, b) >= 0.8:
            x, y = (near_dedup.prefixes(v, np.sort(hub), 77, 0.8) for v in (a, b))
            small, large = x[~x["large"]], y[y["large"]]
            need = 0.8 / 1.8 * (a[1].sum() + b[1].sum()) - 1e-9
            met = [(p["before"], q["before"]) for p in small for q in large if p["key"] == q["key"]]
            assert any(a[1].sum() - p >= need and b[1].sum() - q >= need for p, q in met)


def test_passages_that_share_one_line_are_all_found(spark):
    line = prose(20, 7)
    texts = []
    for k in range(60):
        passage = f"{prose(20, 12000 + k)} {line} {prose(20, 13000 + k)}"
        texts += [(2 * k + e, f"{prose(40, 14000 + 2 * k + e)} {passage} {prose(40, 16000 + 2 * k + e)}") for e in range(2)]
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_passages_of_a_hot_group_are_linked(spark):
    """More texts share a passage than a task's range of a signature holds."""
    shared = prose(120, 21)
    texts = [(i, f"{prose(30, 20000 + i)} {edited(shared, i % 2, 30000 + i)} {prose(30, 40000 + i)}") for i in range(300)]
    before, substring_dedup.ROWS = substring_dedup.ROWS, 2000
    try:
        got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(table(spark, texts)).collect()}
    finally:
        substring_dedup.ROWS = before
    assert len(got) >= 297 and Counter(got.values()).most_common(1)[0][1] >= 297


def test_a_filter_in_parts_changes_nothing(spark):
    texts = [(i, prose(4, i % 3000)) for i in range(5000)]
    one, parts = (sorted(tuple(r) for r in exact_dedup.exact_dedup(table(spark, texts), max_blocks=n).collect()) for n in (100, 1))
    assert one == parts and sum(r[3] for r in one) == len({t for _, t in texts})


def test_a_long_item_changes_no_other_result(spark):
    items = [(i, prose(30 + i, 800 + i)) for i in range(20)]
    long = (99, prose(5000, 77))
    texts = [(i, f"{prose(700, 60 + i)} {items[i][1]} {prose(500, 90 + i)}") for i in range(20)] + [(50, f"{prose(100, 1)} {long[1]}")]
    ask = lambda some: sorted(tuple(r) for r in decontaminate.contaminated(table(spark, texts), spark.createDataFrame(some, "item_id long, text string")).collect())
    without, with_it = ask(items), ask([*items, long])
    assert [r for r in with_it if r[1] != 99] == without and {(r[0], r[1]) for r in with_it} == {*((i, i) for i in range(20)), (50, 99)}


def test_shards_equal_a_recount(spark):
    out = rows(queries.op4_sharding(spark, "/root/testdata/sf0.001"))

    def draw(key, node, weight):
        return -math.log((int(hashlib.md5(f"{node}/{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weight

    def shard(key, tree):
        level = tree
        for name, of in (("g{0.region}", lambda s: s.region), ("r{0.region}.{0.rack}", lambda s: (s.region, s.rack)), ("s{0.shard}", lambda s: s.shard)):
            groups = defaultdict(list)
            for s in level:
                groups[of(s)].append(s)
            level = min(groups.values(), key=lambda own: draw(key, name.format(own[0]), sum(s.weight for s in own)))
        return level[0].shard

    for r in out:
        assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], sharding.tree_of(8)), shard(r["doc_id"], sharding.tree_of(9)))
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def test_a_hot_key_is_ranked_in_many_groups(spark):
    got = rows(sharding.assign_shards(table(spark, [(None, f"t {i}") for i in range(500)] + [(None, "same")] * 100), sharding.tree_of(8), buckets=16))
    assert sorted(r["slot"] for r in got) == list(range(600)) and len({r["shard"] for r in got}) == 1


def test_token_counts_of_a_given_table_equal_a_recount(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    whole.encode_special_tokens = True
    sf = "/root/testdata/sf0.001"
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    wanted = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id not in toxic:
            for version, n in (("words-1", len([w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").split() if w])), ("byte-bpe-50k", len(whole.encode(r.text or "", add_special_tokens=False).ids))):
                for key in ((version, r.source, r.lang, 0), (version, r.source, None, 1), (version, None, None, 2), (None, None, None, 3)):
                    wanted[key][0] += 1
                    wanted[key][1] += n
    got = {(r["tokenizer"], r["source"], r["lang"], r["level"]): [r["docs"], r["tokens"]] for r in rows(queries.op5_token_counts(spark, sf))}
    assert {k: v for k, v in got.items() if None not in k[:3] or k[3]} == dict(wanted)


def test_a_batch_that_broke_off_leaves_no_trace(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    state = token_counts.TokenCounts.create(spark, str(tmp_path / "state"))
    state.apply("1", spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], schema))
    spark.createDataFrame([("z", "z", "z", 9, 9)], token_counts.TOTALS).write.parquet(str(tmp_path / "state" / "version=2"))  # written, but not in the log
    assert state.version() == 1 and [tuple(r) for r in state.totals().collect()] == [("a", "en", "v1", 1, 10)]
    for k in range(2, 6):
        assert state.apply(str(k), spark.createDataFrame([("insert", "a", "en", "v1", 1, None)], schema))
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "v1", 5, 14)]
    assert sorted(p.name for p in (tmp_path / "state").glob("version=*")) == ["version=4", "version=5"]


CLASHES = ["rid", "k1", "k2", "total", "bands", "sketch", "class", "text", "score", "stop", "copies", "key", "pos", "_row", "_row_file", "_n", "first", "lang_pred", "carried_"]


@pytest.mark.parametrize("name", ["near", "passages", "exact", "language", "contaminated"])
def test_carried_columns_may_have_the_names_that_operators_use(spark, name):
    text = prose(70, 5)
    made = {
        "near": (near_dedup.near_dedup, near_dedup.RESULT), "passages": (substring_dedup.repeated_passages, substring_dedup.RESULT), "exact": (exact_dedup.exact_dedup, exact_dedup.RESULT),
        "language": (lambda d, **k: language_id.predict(d, language_id.fit(d), **k), language_id.RESULT), "contaminated": (lambda d, **k: decontaminate.contaminated(d, spark.createDataFrame([(1, text)], "item_id long, text string"), **k), decontaminate.RESULT),
    }
    operator, result = made[name]
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    carry = [c for c in CLASHES if c not in result]
    docs = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in carry if c not in docs.columns])
    out = rows(operator(docs, carry=carry))
    assert len(out) == 2 and all(r[c] == (text if c == "text" else f"{c} {r['doc_id']}") for r in out for c in carry)
    with pytest.raises(ValueError):
        operator(docs, carry=[result[-1] if result[-1] in docs.columns else "doc_id"])


def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, prose(40, 3000))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, whole_row string, _row_file string, _row_index long, _metadata string"
    for n, data in enumerate(([], [(None, None, None, None, None, "w", "x", 1, "m"), (1, prose(90, 4), None, None, None, "w", "x", 1, "m"), (2, prose(90, 4), "en", "s", 3, None, None, None, None)])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"d{n}"))
        docs = spark.read.parquet(str(tmp_path / f"d{n}"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = common.saved(stage(spark, docs, str(tmp_path)))
            assert out.columns == docs.columns
            docs = out
        assert docs.count() == (1 if data else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == (1 if data else 0)


def test_templates_that_end_too_early_are_errors():
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% if 1 %}")


def test_formatted_chars_and_long_turns(spark):
    long = "x " * 200_000 + "<|im_end|>"
    turns = spark.createDataFrame([(1, 0, "user", long, "a"), (1, 1, "assistant", "ok", "b")], "conv_id long, turn long, role string, text string, formatted string")
    parts = chat.format_turns(turns)
    out = rows(chat.read_back(parts))[0]
    assert out["formatted_chars"] == sum(len(r["formatted"]) for r in rows(parts)) and (out["n_turns"], out["loss_chars"]) == (2, 2)


def test_chains_given_up_early_are_those_below_the_floor():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        runs = np.stack([np.sort(rng.choice(300, n, replace=False)) + 5, rng.integers(5, 300, n), rng.integers(1, 30, n)], axis=1)
        every = substring_dedup._chained(runs, (5, 5), 0.8, -np.inf, (400, 400))
        floor = -float(rng.random()) * 12
        got = substring_dedup._chained(runs, (5, 5), 0.8, floor, (400, 400))
        assert sorted(got) == sorted(t for t in every if t[2] >= floor - 1e-6)
