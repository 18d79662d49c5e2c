"""Operators against brute force, round trips and odd input: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanlayout.llm import chat, common, decontaminate, exact_dedup, language_id, lm_scoring, near_dedup, packing, sharding, substring_dedup, token_counts
from scanlayout.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, class string, score string"
VOCAB = ["".join(p) for p in zip("abcdefghij" * 30, "klmnopqrst" * 30, "uvwxyzabcd" * 30)]
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(3000)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", 0, 7, "x", "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """A null id, null and blank texts, a long one, repeated rows, and columns whose names operators use inside."""
    long = prose(30_000, 99)
    return table(spark, [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n"), (4, long), (5, "a b c d e f"), (5, "a b c d e f"), (6, "x" * 5000), (7, "Été日本 ok"), (8, long + " end")])


def rows(df):
    return [r.asDict() for r in df.collect()]


# Words


def test_word_hashes_split_on_ascii_blanks_and_lower_ascii_only():
    h, n = common.word_hashes(["The\x0bthe É", None, "", " é x "])
    assert n.tolist() == [3, 0, 0, 1] and h[0] == h[1] and h[2] != common.word_hashes(["é"])[0][0]


@given(st.lists(st.text(alphabet="aB \n\té"), max_size=8), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_word_hashes_don_t_depend_on_chunks(texts, chunk):
    a, b = common.word_hashes(texts), common.word_hashes(texts, chunk)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert a[1].tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 3), (3, 2), (5, 5)], "a long, b long")
    assert dict(common.components(edges).collect()) == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 3: 1, 5: 5}


# 1


def test_lm_scoring_equals_brute_force(spark):
    texts = [(i, prose(RNG.randrange(1, 40), i % 9)) for i in range(60)] + [(60, None), (61, ""), (5, prose(9, 3))]
    out = {(r["doc_id"], r["n_tokens"]): r for r in rows(lm_scoring.score_texts(table(spark, texts), F.col("doc_id") % 7 == 2, block_bytes=400))}
    docs = [(i, ["<s>", *(re.findall(r"[^\x20\x09-\x0D]+", t or "")), "</s>"]) for i, t in texts]
    c = [Counter() for _ in range(4)]
    for i, w in docs:
        if i % 7 != 2:
            for k in range(1, len(w)):
                for n in (1, 2, 3):
                    if k - n + 1 >= 0:
                        c[n][tuple(w[k - n + 1 : k + 1])] += 1
    total, known, starts = sum(c[1].values()), len(c[1]), sum(i % 7 != 2 for i, _ in docs)
    at = lambda h: starts if h == ("<s>",) else c[len(h)][h]
    place = lambda x: min(int(2 * math.log2(x)), 127)
    seen, once = np.zeros((4, 128)), np.zeros((4, 128))
    for n in (2, 3):
        for g, m in c[n].items():
            seen[n, place(at(g[:-1]))] += m
            once[n, place(at(g[:-1]))] += m == 1
    weight = np.clip((once + 0.5) / (seen + 1), 1e-4, 0.9999)
    root = min((sum(m == 1 for m in c[1].values()) + 1) / (total + 1), 0.5)
    for i, w in docs:
        score = base = known_here = 0
        for k in range(1, len(w)):
            x = c[1][(w[k],)]
            known_here += x > 0
            base += math.log10((x + 1) / (total + known + 1))
            p = (1 - root) * x / total if x else root
            for n in (2, 3):
                if k - n + 1 >= 0 and at(h := tuple(w[k - n + 1 : k])):
                    b = weight[n, place(at(h))]
                    p = (1 - b) * c[n][tuple(w[k - n + 1 : k + 1])] / at(h) + b * p
            score += math.log10(p)
        r = out[i, len(w) - 1]
        assert (r["n_known"], r["train_tokens"]) == (known_here, total)
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)


def test_lm_scoring_tells_n_grams_of_similar_keys_apart(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(2500)})
    h = common.word_hashes([" ".join(words)])[0]
    keys = common.mix((h * np.uint64(0xD6E8FEB86659FD93))[:, None] + h[None, :] + np.uint64(2)).ravel() >> np.uint64(24)
    order = np.argsort(keys)
    i, j = next((x, y) for x, y in zip(order, order[1:]) if keys[x] == keys[y] and len({x // len(h), x % len(h), y // len(h), y % len(h)}) == 4)
    a, b, c, d = (words[k] for k in (i // len(h), i % len(h), j // len(h), j % len(h)))
    texts = [(k, f"{a} {b}") for k in range(6)] + [(10, d), (11, "other"), *((20 + k, f"{c} {w}") for k, w in enumerate("vwxyz"))] + [(100, f"{c} {d}"), (101, f"{c} other")]
    out = {r["doc_id"]: r["score"] for r in rows(lm_scoring.score_texts(table(spark, texts), F.col("doc_id") >= 100))}
    assert out[100] == pytest.approx(out[101])


def test_the_automaton_s_weights_sum_to_one_and_walks_don_t_depend_on_pieces():
    rng, lengths = random.Random(3), np.array([1, 40, 7, 23, 90])
    at = np.array([0 if i in np.cumsum(lengths) - 1 else rng.randrange(1, 9) for i in range(lengths.sum())])
    ranked = np.sort(common.mix(np.arange(1, 10, dtype=np.uint64)))
    row = {"lengths": lengths, "words": lm_scoring._pack(ranked), "at": lm_scoring._pack(at.astype(np.uint32)), "train": [True, True, True, True, False]}
    block = lm_scoring._Block(row, 3)
    totals = [block.train_counts(n) for n in (1, 2, 3)]
    weights = [np.full(lm_scoring.BINS, b) for b in (0.3, 0.4)]
    own = lm_scoring.automaton(block, totals, weights, 0.1, int(totals[0].sum()), 4)
    arcs = {int(k): (int(n), float(w)) for k, n, w in zip(own.keys, own.into, own.weight)}

    def step(state, word):
        log = 0.0
        while state and state * own.words + word not in arcs:
            log, state = log + own.slip[state], int(own.fail[state])
        to, w = arcs[state * own.words + word] if state else (int(own.root_into[word]), own.root_weight[word])
        return to, log + w

    known = np.flatnonzero(totals[0])
    for state in range(len(own.fail)):
        if any(k // own.words == state for k in arcs) or state == 0:
            assert sum(10 ** step(state, w)[1] for w in known) + 0.1 * 10 ** sum_of_slips(own, state) == pytest.approx(1)
    told, state = [], 1
    for e, word in enumerate(block.places[0].tolist()):
        state, log = step(1 if e in block.starts else state, word)
        told.append(log)
    for piece in (2, 3, 16, 512):
        assert own.walk(block.places[0], block.lengths, 2, piece) == pytest.approx(np.array(told))


def sum_of_slips(own, state):
    return own.slip[state] + sum_of_slips(own, int(own.fail[state])) if state else 0.0


def test_lm_scoring_odd_input(spark):
    out = rows(lm_scoring.score_texts(odd(spark), F.lit(False)))
    assert len(out) == 10 and all(math.isfinite(r["score"]) for r in out)
    assert all(r["score"] == r["base_score"] == 0 for r in rows(lm_scoring.score_texts(odd(spark), F.lit(True))))
    assert rows(lm_scoring.score_texts(table(spark, []), F.lit(False))) == []


# 2


def edited(text, k, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = rng.choice(WORDS)
    return " ".join(words)


def test_near_dedup_equals_brute_force(spark):
    base = [prose(120, 100 + i) for i in range(12)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(100 + 10 * i + j, edited(base[i], k, i * 10 + j)) for i in range(12) for j, k in enumerate((1, 2, 3, 6))]
    texts += [(300 + j, edited(base[0], 1, 1000 + j)) for j in range(40)] + [(400, base[1].upper()), (401, None), (402, " "), (403, "one two"), (404, "ONE two")]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in rows(near_dedup.near_dedup(docs))}
    idf = near_dedup.inverse_frequencies(docs)
    sets = [v[:2] for v in near_dedup.vectors([t for _, t in texts], idf, 5)]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(zip([i for i, _ in texts], sets), 2):
        if near_dedup.similarity(x, y) >= 0.8:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i, _ in texts}
    assert sum(r["kept"] for r in got.values()) == len({find(i) for i, _ in texts})


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    w = rng.random(300) * 5 + 0.5
    a, b = (f[:250], w[:250]), (f[50:], w[50:] * rng.choice([1, 1.5], 250))
    drawn = near_dedup.Sampler(2000).draw(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 250]))
    assert abs((drawn[0] == drawn[1]).mean() - near_dedup.similarity(tuple(x[np.argsort(a[0])] for x in a), tuple(x[np.argsort(b[0])] for x in b))) < 0.05


def test_near_dedup_odd_input(spark):
    out = rows(near_dedup.near_dedup(odd(spark), carry=["source"]))
    assert len(out) == 10
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert [r["class_size"] for r in by[5]] == [3, 3] and by[None][0]["kept"] and not any(r["kept"] for r in by[5])
    assert by[8][0]["class_id"] == 4 and by[1][0]["kept"] and by[2][0]["kept"] and by[3][0]["kept"]
    assert rows(near_dedup.near_dedup(table(spark, []))) == []


# 3


@given(st.text(), st.text())
@settings(max_examples=200, deadline=None)
def test_escapes_are_reversible_and_hide_marks(text, role):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape_line(role)) == role and "\n" not in chat.escape_line(role)


def test_template_folds_constants_and_refuses_the_rest():
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}{{ 'd'|upper }}{% endif %}")) == chat.Node("block", None, (chat.Node("text", "abcD"),))
    for bad in ("{{ m.__class__() }}", "{% import os %}", "{{ x|eval }}", "{% if 1 %}", "{{ 1 + }}", "{% for a in b %}{% endfor %}"):
        with pytest.raises((chat.TemplateError, IndexError)):
            chat.compile_template(bad)
    made = chat.compile_template("<{% for m in messages %}{% if loop.first and not loop.last %}^{% endif %}{{ m['text'] }}{% generation %}!{% endgeneration %}{% endfor %}>")
    assert made.render({"text": "a"}, 0, False) == ("<^a!", [(3, 4)]) and made.render({"text": "b"}, 1, True) == ("b!>", [(1, 2)])


def test_chat_round_trip(spark):
    turns = [(1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx\\n"), (1, 0, "us\ner", None), (2, 0, None, "q"), (2, None, "assistant", "é\\|日"), (None, 0, "assistant", "z"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows(chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == []


# 4


def test_shards(spark):
    docs = table(spark, [(i, "t" * (i % 5)) for i in range(4000)])
    got = rows(sharding.assign_shards(docs, sharding.tree_of(8), sharding.tree_of(9), buckets=16))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and 300 < sum(r["grown_shard"] == 8 for r in got) < 600
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 380 < len(slots) < 620
    assert all(r["size"] == r["doc_id"] % 5 + 1 and r["text_crc32"] == zlib.crc32(b"t" * (r["doc_id"] % 5)) for r in got)


def test_weights_move_rows_only_across_changed_subtrees(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.tree_of(8)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 0 else 1.0) for s in tree]
    moved = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).where("a != b").collect()
    assert moved and all(not (r.a >= 4 and r.b >= 4) and not (r.a in (2, 3) and r.b in (2, 3)) for r in moved) and all(r.b < 4 for r in moved)


def test_shards_odd_input(spark):
    got = rows(sharding.assign_shards(odd(spark), sharding.tree_of(8)))
    assert len(got) == 10 and len({(r["shard"], r["slot"]) for r in got}) == 10 and all(r["grown_shard"] is None for r in got)
    assert [(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 1] == [(1, 0)]
    assert rows(sharding.assign_shards(table(spark, []), sharding.tree_of(8))) == []


# 5


def test_batches_commit_once(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    state = token_counts.TokenCounts.create(spark, str(tmp_path / "state"))
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", None, None), ("other", "a", "en", "v1", 9, 9)], schema)
    two = spark.createDataFrame([("revise", "a", "en", "v1", 7, 5), ("delete", "a", "en", "v1", 10, None), ("delete", None, "en", "v1", None, None)], schema)
    assert state.apply("1", one) and not state.apply("1", one) and state.apply("2", two) and not state.apply("1", one)
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "v1", 1, 7)]
    assert state.apply("3", spark.createDataFrame([], schema)) and state.version() == 3
    assert sorted((r.level, r.docs, r.tokens) for r in token_counts.rolled_up(state.totals()).collect()) == [(k, 1, 7) for k in range(4)]


# 6


def test_decontamination_equals_brute_force(spark):
    items = [(i, prose(20 + i, 500 + i)) for i in range(30)] + [(30, "two words"), (31, None), (32, "")]
    texts = [(i, prose(600, 900 + i)) for i in range(20)]
    texts += [(100 + i, f"{prose(300, i)} {items[i][1].upper()}\n{prose(400, i + 50)}") for i in range(30)] + [(200, items[3][1]), (201, " ".join(items[4][1].split()[:8])), (202, None), (203, "Two Words")]
    found = decontaminate.contaminated(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [t.lower().split()] for i in range(len(w) - n + 1)}
    expected = set()
    for i, t in texts:
        for k, item in items:
            words = (item or "").lower().split()
            cut = len(words) - int(len(words) * 0.25)
            question, answer = grams(" ".join(words[:cut]), min(5, cut)) if cut else set(), set(words[cut:])
            own = grams(t or "", min(5, cut)) if cut else set()
            if question and len(question & own) >= 0.8 * len(question) and len(answer & set((t or "").lower().split())) >= 0.8 * len(answer):
                expected.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in rows(found)} == expected and len(expected) == 32
    split = decontaminate.contaminated(table(spark, texts), spark.createDataFrame(items, "item_id long, text string"), decontaminate.Params(index_chars=1500))
    assert {(r["doc_id"], r["item_id"]) for r in rows(split)} == expected


def test_retrieval_keeps_all_above_the_threshold():
    p = decontaminate.Params()
    index = decontaminate.Index([(i, prose(30, 700 + i % 7) if i % 2 else prose(25, 300 + i), None) for i in range(50)], p)
    words = common.word_hashes([prose(400, 701) + " " + prose(30, 703)])[0]
    terms = np.unique(index.lookup(words)[index.lookup(words) >= 0])
    scores = np.zeros(50)
    for t in terms.tolist():
        for place in range(index.at[t], index.at[t + 1]):
            scores[index.item[place]] += index.impact[place]
    for least in (0.05, 0.2, 0.6):
        assert [i for _, i, _ in index.retrieve(np.zeros(len(terms), dtype=np.int64), terms, 1, least)] == np.flatnonzero(scores >= least - 1e-9).tolist()


def test_decontamination_odd_input(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contaminated(odd(spark), none)) == []
    some = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    assert len(rows(decontaminate.contaminated(odd(spark), some, carry=["source"]))) == 6
    assert rows(decontaminate.contaminated(table(spark, []), some)) == []


# 7


def test_exact_dedup(spark):
    texts = [(i, prose(30, i % 40)) for i in range(120)] + [(200, "a b"), (201, "ab"), (202, "a  b"), (199, "ba  "), (None, "a\nb"), (203, None), (204, " ")] + [(205, "z"), (205, "z")]
    got = rows(exact_dedup.exact_dedup(table(spark, texts), carry=["source"]))
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    keep = {k: min(v, key=lambda x: (-len(x[1]), x[0] is not None, x[0] or 0)) for k, v in groups.items()}
    assert len(got) == len(texts) and sum(r["kept"] for r in got) == len(groups)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): (keep[k][0], len(v)) for k, v in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]] for r in got)
    assert rows(exact_dedup.exact_dedup(table(spark, []))) == [] and len(rows(exact_dedup.exact_dedup(odd(spark)))) == 10


def test_the_filter_misses_no_repeated_key(spark):
    keys = spark.range(3000).selectExpr("CAST(id % 2500 AS STRING) AS k")
    bloom = exact_dedup.repeated_filter(keys, "k", 1, 3)
    got = exact_dedup.maybe_repeated(keys, "k", bloom, 1, 3).groupBy(F.col("k").cast("int") < 500, "maybe").count().collect()
    counts = {(r[0], r.maybe): r["count"] for r in got}
    assert counts[True, True] == 1000 and (True, False) not in counts and counts.get((False, True), 0) < 400


# 8


def test_language_id_learns_and_holds_out(spark):
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "ghijk"}
    rng = random.Random(4)
    rows_ = [(lang, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(30))) for _ in range(60) for lang, a in alphabets.items()]
    docs = table(spark, [(i, t) for i, (_, t) in enumerate(rows_)], [x for x, _ in rows_])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~held), per_lang=20)
    told = language_id.predict(docs.where(held), model, carry=["lang"]).collect()
    assert told and sum(r.lang_pred == r.lang for r in told) >= 0.95 * len(told) and all(0 <= r.score <= 1 for r in told)
    none = {r.doc_id: r for r in language_id.predict(table(spark, [(1, None), (2, "12 .,"), (3, ""), (None, "abc")]), model).collect()}
    assert [none[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and none[None].lang_pred == "xx"
    empty = language_id.fit(table(spark, []))
    assert [r.lang_pred for r in language_id.predict(table(spark, [(1, "abc")]), empty).collect()] == ["und"]
    assert len(language_id.predict(odd(spark), model).collect()) == 10


def test_small_languages_keep_their_features_and_long_words_all_of_theirs(spark):
    rng = random.Random(6)
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    large = [made("abcdefgh", 5) for _ in range(400)]
    small = [made("abcdefgh", 5) for _ in range(20)]
    tail = made("pqrstu", 60)
    texts = [("big", " ".join(rng.choice(large) for _ in range(300))) for _ in range(60)] + [("few", " ".join(small)) for _ in range(2)] + [("run", made("klmno", 100) + tail)]
    model = language_id.fit(table(spark, [(i, t) for i, (_, t) in enumerate(texts)], [x for x, _ in texts]))
    told = language_id.predict(table(spark, [(1, " ".join(small)), (2, tail[:50]), (3, " ".join(large[:40]))]), model).collect()
    assert {r.doc_id: r.lang_pred for r in told} == {1: "few", 2: "run", 3: "big"}
    assert (model.tables[0].find(language_id.Words.of(small).keys) >= 0).all()


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(9)
    made = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    docs = [(x, " ".join(made(a) for _ in range(rng.randrange(1, 25)))) for _ in range(25) for x, a in (("aa", "abcdé"), ("bb", "cdefß"), ("cc", "日本語ab"))]
    docs += [("aa", None), (None, "abc"), ("bb", ""), ("cc", "12 ½")]
    model = language_id.fit(table(spark, list(enumerate(t for _, t in docs)), [x for x, _ in docs]))
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower().replace("½", " "))
    grams_of = lambda w, n: [m[i : i + n] for m in [f"\x02{w}\x03"] for i in range(len(m) - n + 1)]
    counts = [defaultdict(Counter) for _ in range(6)]
    for x, t in docs:
        if x and t is not None:
            for w in words_of(t):
                counts[0][w][x] += 1
                for n in range(1, 6):
                    for g in grams_of(w, n):
                        counts[n][g][x] += 1
    counts[0] = {w: Counter({x: k for x, k in c.items() if k > 1}) for w, c in counts[0].items() if max(c.values()) > 1}
    langs = ["aa", "bb", "cc"]
    sums = [{x: sum(c[x] for c in level.values()) for x in langs} for level in counts]

    def score(n, f):
        logs = [math.log((counts[n][f][x] + 1) / (sums[n][x] + len(counts[n]))) for x in langs]
        return np.array(logs) - sum(logs) / 3

    def word(w):
        if w in counts[0]:
            return score(0, w)
        for n in range(5, 0, -1):
            if found := [score(n, g) for g in grams_of(w, n) if g in counts[n]]:
                return sum(found) / len(found)
        return np.zeros(3)

    asked = [(i, t) for i, (_, t) in enumerate(docs)] + [(500 + i, " ".join(made("abcdefghéß日x") for _ in range(12)) + ", q½" * (i % 2)) for i in range(40)] + [(600, "½ ² ①"), (601, "x" * 3000), (602, "İ")]
    told = {r.doc_id: r for r in language_id.predict(table(spark, asked), model).collect()}
    for i, t in asked:
        words = words_of(t) if i != 600 else []
        if not words:
            assert (told[i].lang_pred, told[i].score) == ("und", 0)
            continue
        total = sum(word(w) for w in words)
        best = int(total.argmax())
        assert told[i].lang_pred == langs[best] or total.max() - total[langs.index(told[i].lang_pred)] < 1e-4
        assert told[i].score == pytest.approx(1 / np.exp((total - total[best]) / len(words) ** 0.5).sum(), abs=1e-4)


# 9


@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_each_run_has_one_compact_window(values, shortest):
    v = np.array(values, dtype=np.uint64)
    _, left, centre, right = substring_dedup.compact_windows(v, np.array([len(v)]), shortest)
    spans = list(zip(left.tolist(), centre.tolist(), right.tolist()))
    for i in range(len(v)):
        for j in range(i + shortest - 1, len(v)):
            least = i + int(v[i : j + 1].argmin())
            assert [c for a, c, b in spans if a <= i <= c <= j <= b] == [least]


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    shared, edit = prose(60, 1), edited(prose(120, 2), 2, 3)
    texts = [(i, prose(200, 10 + i)) for i in range(10)] + [(20 + i, f"{prose(80, 40 + i)} {shared} {prose(90, 60 + i)}") for i in range(5)] + [(30, f"{prose(70, 80)} {prose(120, 2)}"), (31, f"{edit} {prose(70, 81)}")]
    texts += [(40, f"{prose(30, 90)} {prose(40, 4)}"), (41, f"{prose(40, 4)} {prose(30, 91)}"), (50, prose(70, 5)), (51, prose(70, 5).upper()), (52, prose(60, 6) + " " + prose(60, 6))]
    got = defaultdict(list)
    for r in rows(substring_dedup.repeated_passages(table(spark, texts))):
        got[r["doc_id"]].append(r)
    assert set(got) == {20, 21, 22, 23, 24, 30, 31, 50, 51}
    assert all(len(got[i]) == 1 and got[i][0]["start"] <= 80 and got[i][0]["stop"] >= 140 and got[i][0]["stop"] - got[i][0]["start"] < 80 and got[i][0]["class_id"] == 20 for i in range(20, 25))
    assert got[30][0]["class_id"] == got[31][0]["class_id"] == 30 and got[50][0]["copies"] == 2


def test_passages_with_an_insertion_or_deletion_in_one_place_are_found():
    p, rng = substring_dedup.Params(), random.Random(8)
    for trial in range(200):
        n = rng.randrange(60, 160)
        own = prose(n, 1000 + trial).split()
        k, at = rng.randrange(1, n // 10 - 2), rng.randrange(5, n - 20)
        other = own[:at] + prose(k, 3000 + trial).split() + own[at:] if trial % 2 else own[:at] + own[at + k :]
        texts = [prose(a, 5000 + 3 * trial + a).split() + t + prose(b, 9000 + 3 * trial + b).split() for t, a, b in ((own, 70, 80), (other, 60, 90))]
        hashes, counts = common.word_hashes([" ".join(t) for t in texts])
        shingles, runs = common.windows(hashes, counts, p.width)
        x, y = shingles[: runs[0]], shingles[runs[0] :]
        px, py = x[70 : 70 + n - 4], y[60 : 60 + len(other) - 4]
        alike = len(np.intersect1d(px, py)) / len(np.union1d(px, py))
        first, both = {int(v): i for i, v in reversed(list(enumerate(y)))}, np.flatnonzero(np.isin(x, py))
        anchor = int(rng.choice(both.tolist()))
        found = substring_dedup.align(x, y, [(anchor, first[int(x[anchor])])], p)
        if alike >= p.similarity and min(len(px), len(py)) >= p.shortest:
            (a, b, c, d, s), = found
            assert a <= 70 and b >= 70 + len(px) and c <= 60 and d >= 60 + len(py) and s >= p.similarity
        for a, b, c, d, s in found:
            assert s == pytest.approx(len(np.intersect1d(x[a:b], y[c:d])) / len(np.union1d(x[a:b], y[c:d]))) and s >= p.similarity - 1e-9


def test_passages_around_a_frequent_line_are_found(spark):
    line = prose(20, 7)
    texts = [(i, f"{prose(60, 100 + i)} {line} {prose(60, 900 + i)}") for i in range(200)]
    for k in range(120):
        passage = f"{prose(15, 2000 + k)} {line} {prose(15, 3000 + k)}"
        texts += [(1000 + 2 * k + e, f"{prose(50, 4000 + 2 * k + e)} {passage} {prose(50, 6000 + 2 * k + e)}") for e in range(2)]
    random.Random(3).shuffle(texts)
    got = {r["doc_id"]: r["class_id"] for r in rows(substring_dedup.repeated_passages(table(spark, texts)))}
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in texts}
    alike = {i for x, y in combinations(sets, 2) if len(sets[x] & sets[y]) >= 46 for i in (x, y)}
    assert alike == set(range(1000, 1240)) and got == {i: i - i % 2 for i in alike}


def test_repeated_passages_odd_input(spark):
    out = rows(substring_dedup.repeated_passages(odd(spark), carry=["source"]))
    assert {r["doc_id"] for r in out} == {4, 8} and all(r["stop"] - r["start"] >= 29_990 for r in out)
    assert rows(substring_dedup.repeated_passages(table(spark, []))) == []


# 10


def test_ids_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    from scanlayout.llm.tokens import TokenBytes

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    texts = ["a  b", " x", "x ", "a\n\nb", "a \nb", "it's 's", "a\tb c", " x y", "日本 語、x", "a\x1cb c", "<|endoftext|> x", "'s 's\n's", "", None, "a\nb c\nd", prose(50, 1)]
    assert TokenBytes(tokenizer_path(), 5).encode(texts) == [np.asarray(whole.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_bounds_hold_and_packings_fit(sizes):
    sizes = np.array(sizes)
    bins, offsets = packing.best_fit(sizes, 30)
    loads = np.bincount(bins, weights=sizes)
    assert loads.max() <= 30

    def least(left, rooms):
        if not left:
            return len(rooms)
        options = {r for r in rooms if r >= left[0]}
        return min([least(left[1:], sorted([*(list(rooms)[: list(rooms).index(r)] + list(rooms)[list(rooms).index(r) + 1 :]), r - left[0]])) for r in options] + [least(left[1:], [*rooms, 30 - left[0]])])

    best = least(sorted(sizes[:6].tolist(), reverse=True), [])
    assert packing.lower_bound(*np.unique(sizes[:6], return_counts=True), 30) <= best


def check_packing(out, capacity):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= capacity
    return len(by)


def test_packing(spark):
    docs = table(spark, [(i, prose(RNG.randrange(0, 400), i)) for i in range(150)] + [(200, None), (None, "a"), (201, "b"), (201, "b")])
    out = rows(packing.pack_documents(common.saved(packing.pieces_of(docs, tokenizer_path(), capacity=256)), capacity=256, per_group=30))
    total = sum(r["length"] for r in out)
    assert check_packing(out, 256) <= 1.04 * -(-total // 256) + 1
    assert [r["length"] for r in out if r["doc_id"] == 200] == [1] and sum(r["doc_id"] == 201 for r in out) == 2
    for i in {r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] < 200}:
        own = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == i)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 256 for _, _, n in own[1:]) and all(a + n == b for (_, a, n), (_, b, _) in zip(own, own[1:]))
    assert rows(packing.pack_documents(packing.pieces_of(table(spark, []), tokenizer_path()))) == []
    check_packing(rows(packing.pack_documents(common.saved(packing.pieces_of(odd(spark), tokenizer_path())))), 1024)


# Pipeline


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [(i, prose(150, 2000 + i)) for i in range(30)]
    item = prose(40, 3000)
    texts = clean + [(100, clean[0][1] + " "), (101, edited(clean[1][1], 1, 1)), (102, f"{prose(90, 3001)} {item} {prose(60, 3002)}"), (103, None), (104, "123 456"), (5, clean[5][1])]
    table(spark, texts).drop("_row", "class", "score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, str(tmp_path)))
        sizes.append(docs.count())
    assert sizes == [34, 32, 31, 30] and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted([100, *range(1, 30)])
    check_packing(rows(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))), 1024)


def test_sql_agrees(spark):
    import duckdb

    from scanlayout.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        order = sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall())), name
