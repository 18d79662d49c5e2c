"""Runs, alignment and the n-gram join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlayout.llm import alignment, ngram_join, periodic_runs, queries
from test_llm import odd, prose, rows, table

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words):
    """(start, length, period) of each maximal stretch of smallest period q with max(6, 4q) words or more."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k - p] for k in range(s + p, s + length)) for p in range(1, q)):
                out.add((s, length, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng):
    k, out = rng.choice([1, 2, 3, 4, 7]), []
    while len(out) < rng.randint(0, 90):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 9))[: rng.randint(1, 60)]
    return out * rng.choice([1, 1, 2, 3])


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        docs = [repeating(rng) for _ in range(rng.randint(1, 4))]
        found = [[] for _ in docs]
        for d, *run in zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(sum(docs, []), dtype=np.int64), np.array([len(d) for d in docs])))):
            found[d].append(tuple(run))
        assert found == [all_runs(d) for d in docs]


def test_each_nonterminal_stands_for_its_places():
    """Grammars give the text back, no pair is left twice, and only documents' own pairs are replaced."""
    rng = random.Random(3)
    docs = [repeating(rng) for _ in range(30)]
    own = np.unique(np.array([(d, x) for d, doc in enumerate(docs) for x in doc]), axis=0, return_inverse=True)[1].ravel()
    of = np.repeat(np.arange(30), [len(d) for d in docs])
    rounds, (at, left) = periodic_runs.re_pair(own.astype(np.int64), of.copy(), np.arange(len(of)))
    expansions = defaultdict(set)
    for names, start, middle, end in rounds:
        for n, a, m, b in zip(names.tolist(), start.tolist(), middle.tolist(), end.tolist()):
            assert a < m < b and of[a] == of[b - 1]
            expansions[n].add((tuple(own[a:b].tolist()), m - a))
    assert expansions and all(len(x) == 1 for x in expansions.values())
    ends = np.append(at[1:], len(of))
    parts = [tuple(own[a:b].tolist()) for a, b in zip(at, ends)]
    assert sum(map(len, parts)) == len(of)
    seen = Counter()
    for k in range(len(parts) - 1):
        if left[k] == left[k + 1]:
            seen[(left[k], parts[k], parts[k + 1])] += 1
    assert max(seen.values(), default=0) <= 2  # twice at most where occurrences of one pair overlap


def test_runs_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    for i, text in docs.items():
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        elif n > 700:
            continue  # too long for brute force
        if n > 700:
            continue
        runs = all_runs(words)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = got[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest()
        if runs:
            planted += 1
            s, m, q = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted > 20


def test_runs_of_odd_texts(spark):
    out = periodic_runs.periodic_runs(odd(spark).drop("runs"), carry=["doc_id", "text", "source"])
    for r in rows(out):
        words = WORDS.findall(r["text"] or "")
        assert r["n_words"] == len(words) and r["source"] == "s" and (r["collapsed"] == " ".join(words) or r["runs"])
    assert sum(r["doc_id"] == 5 for r in rows(out)) == 2
    hot = table(spark, [(1, " ".join("ab c d".split() * 20_000)), (2, "a " * 9 + "b\t" + "A a " * 5)])
    assert [[tuple(x) for x in r["runs"]] for r in sorted(rows(periodic_runs.periodic_runs(hot)), key=lambda r: r["doc_id"])] == [[(0, 60_000, 3)], [(0, 9, 1), (10, 10, 2)]]
    assert periodic_runs.periodic_runs(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd(spark).withColumn("runs", F.lit(1)), carry=["runs"])


# Alignment


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_products_of_incidence_matrices_are_overlaps_and_groups():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        cut = lambda: np.diff(np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, rng.integers(0, 20))])))
        a, b = cut(), cut()
        spans = lambda lengths: [(e - s, e) for s, e in zip(lengths, np.cumsum(lengths))]
        dense = np.array([[max(0, min(x[1], y[1]) - max(x[0], y[0])) for y in spans(b)] for x in spans(a)])
        got, of_product = np.zeros_like(dense), alignment.overlap_links(a, b)
        got[of_product.row_numbers(), of_product.indices] = of_product.data
        assert (got == dense).all() and of_product.data.all()
        of_a, of_b, count = alignment.groups(a, b)
        shared, linked = np.zeros_like(dense), alignment.group_links(of_a, of_b, count)
        shared[linked.row_numbers(), linked.indices] = 1
        assert (shared == (of_a[:, None] == of_b[None, :])).all() and (shared >= (dense > 0)).all() and count == len(set(np.cumsum(a)) & set(np.cumsum(b)))


def by_whole_texts(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups), every text encoded as a whole."""
    know = alignment.Aligner(*paths())
    docs, held = [], Counter()
    for text in texts:
        links, said, groups_ = [], "", []
        a = b = []
        if text:
            a, b = know.a.encode(" " + text, add_special_tokens=False).ids, know.b.encode(text)
            x, y = [know.a_bytes[i] for i in a], [know.b_bytes[i] for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
                low = i = j = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    i2, j2 = ends[0].index(e) + 1, ends[1].index(e) + 1
                    groups_.append((a[i:i2], b[j:j2]))
                    i, j, low = i2, j2, e
                i = j = 0
                while i < len(a):
                    links.append((a[i], b[j]))
                    p, q = ends[0][i], ends[1][j]
                    i, j = i + (p <= q), j + (q <= p)
                said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups_)
            else:
                a = b = []
        held.update(set(links))
        docs.append((len(a), len(b), len(groups_), links, sum(len(g) * len(h) for g, h in groups_), said))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, ng, len(links), gl, sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), said) for na, nb, ng, links, gl, said in docs]


ODD_TEXTS = [None, "", " ", "a  b", " lead", "trail ", "x\ny", "\n\na\tb", "▁x y", "it's 's \n's", "日本語 テキスト　だ", "<|endoftext|> <s> </s>", "é é x", "\x1c a\x85b", "a\r\nb", "﻿z 12345 6789", "a \n b\n", "🙂 🙂🙂", "x" * 3000, "a\n", "the the the"]


def test_alignment_equals_that_of_whole_texts(spark):
    texts = [*ODD_TEXTS, *ODD_TEXTS[6:12], prose(4000, 5), *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]]
    docs = table(spark, list(enumerate(texts))).withColumns({"block": F.lit("b"), "links": F.lit(1), "n": F.lit(2), "pair": F.lit(3)})
    out = alignment.align(docs.repartition(3), *paths(), carry=["doc_id", "block", "links", "n", "pair"], block_bytes=40_000)
    got = {r.doc_id: r for r in out.collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum", "groups"]
    assert [tuple(got[i][c] for c in names) for i in range(len(texts))] == by_whole_texts(texts)
    assert {(r.block, r.links, r.n, r.pair) for r in got.values()} == {("b", 1, 2, 3)}
    assert alignment.align(docs.limit(0), *paths()).count() == 0
    with pytest.raises(ValueError):
        alignment.align(docs.withColumn("n_a", F.lit(1)), *paths(), carry=["n_a"])


def test_alignment_forgets_between_blocks():
    know = alignment.Aligner(*paths())
    before = know.align(["some words, some"])
    know.forget()
    know.align(["other things"])
    after = know.align(["some words, some"])
    assert before[1] == after[1] and (before[0] == after[0]).all() and not set(know.pairs) <= set(after[2][0].tolist())


def test_alignment_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    wanted = {i: (*x[:4], *x[5:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for (i, _), x in zip(docs, by_whole_texts([t for _, t in docs]))}
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op12_tokenizer_alignment(spark, SF).collect()} == wanted


# N-gram join


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1))))


def joined(docs):
    """(doc_id, set size, component) by all pairs of different sets."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first, links = {}, 0
    for k, s in enumerate(sets):
        if s:
            root[find(k)] = find(first.setdefault(s, k))
    by_size = sorted(first.values(), key=lambda k: len(sets[k]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if 100 * len(sets[a]) < 90 * len(sets[b]):
                break
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
                links += 1
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(docs):
        old = least[find(k)]
        least[find(k)] = i if old is None else old if i is None else min(old, i)
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(docs)), key=repr), links


def families(seed, groups=25, star=250, line=120):
    """Families of edited texts of all sizes, a star whose rays aren't similar to each other, and a line that many texts hold."""
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(2500)]
    texts = []
    for _ in range(groups):
        base = rng.choices(voc, k=rng.choice([8, 10, 11, 12, 13, 30, 60, 100, 330, 700]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(voc)
            words = words[rng.randrange(4) :] if rng.random() < 0.3 else words
            texts.append(" ".join(words).upper() if rng.random() < 0.1 else "\t".join(words))
    common = rng.choices(voc, k=40)
    texts += [" ".join(common + rng.choices(voc, k=rng.choice([3, 4, 5, 20, 60]))) for _ in range(line)]
    base = rng.choices(voc, k=120)
    for _ in range(star):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"u{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return [*enumerate(texts), (9000, None), (9001, ""), (9002, "a b"), (9003, "A b"), (9004, " \n"), (None, "a b"), (None, texts[0]), (9005, prose(20_000, 8)), (9006, prose(20_000, 8) + " end")]


def test_keys_of_similar_sets_meet():
    """Whatever is frequent, and on both sides of the sizes at which indexing changes."""
    rng = np.random.default_rng(5)
    params, met = ngram_join.Params(), 0
    for trial in range(600):
        size = int(rng.choice([10, 20, 40, 150, 285, 300, 320, 335, 360, 600]))
        universe = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        keep = rng.random((2, len(universe))) < rng.uniform(0.93, 1)
        frequent = rng.random(len(universe)) < rng.choice([0, 0.3, 0.9, 1.0])
        rank = np.where(frequent, ngram_join._FREQUENT, 0) + np.arange(len(universe))
        sets_ = [(rank[k], universe[k]) for k in keep]
        n = np.array([len(s[0]) for s in sets_])
        shared = int(keep.all(axis=0).sum())
        if not params.linked(shared, *n) or (keep[0] == keep[1]).all():
            continue
        of = np.repeat([0, 1], n)
        texts, keys = ngram_join.index_keys(of, np.concatenate([s[0] for s in sets_]), np.concatenate([s[1] for s in sets_]), n, params)
        assert np.intersect1d(keys[texts == 0], keys[texts == 1]).size
        met += 1
    assert met > 150


@pytest.mark.parametrize("params", [ngram_join.Params(), ngram_join.Params(frequent=3, pairs_up_to=60)])
def test_components_equal_all_pairs(spark, params):
    docs = families(3 if params.frequent > 3 else 4)
    wanted, links = joined(docs)
    made = table(spark, docs).withColumns({"bucket": F.lit("x"), "rid": F.lit(1), "keys": F.lit(2)})
    got = ngram_join.jaccard_components(made, params, carry=["bucket", "rid", "keys"])
    assert links > 500 and sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == wanted
    assert {(r.bucket, r.rid, r["keys"]) for r in got.collect()} == {("x", 1, 2)}


def test_components_of_a_given_table_and_of_none(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op13_ngram_jaccard_join(spark, SF).collect()), key=repr) == joined(docs)[0]
    assert ngram_join.jaccard_components(table(spark, docs[:1]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(table(spark, docs[:1]).withColumn("n_shingles", F.lit(1)), carry=["n_shingles"])


# Earlier operators


def test_equal_pieces_are_dealt_over_groups(spark):
    from scanlayout.llm import packing

    rows_ = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    pieces = packing.saved(rows_)
    first = packing._pack(packing.with_row_key(pieces), 0, 15, 1024)
    sizes = [r["count"] for r in first.groupBy(F.shiftright("sequence_id", 26).alias("g")).count().collect()]
    assert len(sizes) == 15 and max(sizes) < 3000
    out = packing.pack_documents(pieces, per_group=2000)
    n, sequences, most = out.agg(F.count("*"), F.count_distinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()
    assert (n, most) == (30_000, 900) and 10_000 <= sequences <= 10_015  # a group's last sequence may stay open


def test_parts_of_the_filter_read_their_own_files(spark):
    from scanlayout.llm import exact_dedup

    texts = [(i, f"text number {i % 4000}") for i in range(9000)]
    docs = table(spark, texts)
    parts = exact_dedup.exact_dedup(docs, max_blocks=2)
    whole = exact_dedup.exact_dedup(docs)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(parts) == key(whole)
    folders = {f.split("/_part=")[0] for f in parts.inputFiles() if "/_part=" in f}
    assert len(folders) == 1 and len({f.split("/_part=")[1].split("/")[0] for f in parts.inputFiles() if "/_part=" in f}) == 3
