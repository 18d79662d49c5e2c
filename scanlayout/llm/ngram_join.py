"""N-gram Jaccard join: prefixes of token combinations find all pairs that can be similar enough, whole texts verify them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, carried, components, forget, mix, saved, windows, with_row_key, word_hashes
from .near_dedup import _sides, slices

#: Hashed words of which document counts are kept, and the most frequent shingles that are told apart: fixed sizes, so both may be broadcast.
SLOTS = 1 << 18
MOST_FREQUENT = 1 << 19
_FREQUENT = 1 << 40
RESULT = ["doc_id", "n_shingles", "component_id"]


@dataclass(frozen=True)
class Params:
    """Words in a shingle; least similarity in percent; texts that make a key frequent; the largest set whose frequent shingles are indexed by pairs, larger ones index them singly."""

    width: int = 3
    percent: int = 90
    frequent: int = 16
    pairs_up_to: int = 320

    def overlap(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of n shares at least with any set that is similar enough."""
        return -(-n * self.percent // 100)

    def linked(self, shared: int, n: int, m: int) -> bool:
        return 100 * shared >= self.percent * (n + m - shared)


@dataclass(frozen=True)
class Frequencies:
    """rarity: by slot of hashed words, 1000 ln(documents + 1). frequent: sorted keys of the shingles that are."""

    rarity: np.ndarray
    frequent: np.ndarray

    def order(self, shingles: np.ndarray, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where shingles stand in the order that all texts share (then by hash): by how rare their words are, but frequent ones after all others."""
        sums = np.concatenate([[0], np.cumsum(self.rarity[(words % np.uint64(SLOTS)).astype(np.int64)])])
        rank = sums[at + size] - sums[at]
        if len(self.frequent):
            keys = mix(shingles)
            where = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
            rank = np.where(self.frequent[where] == keys, _FREQUENT + rank, rank)
        return rank


def word_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """1000 ln(documents + 1) of each slot of hashed words, over all documents. A task sends SLOTS rows at most, and as many reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                hashes, counts = word_hashes(part.column(0).to_pylist())
                own = np.repeat(np.arange(len(counts)), counts) * SLOTS + (hashes % np.uint64(SLOTS)).astype(np.int64)
                df += np.bincount(np.unique(own) % SLOTS, minlength=SLOTS)
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(df[slots])], names=["slot", "df"])

    rows = docs.select(F.col(text)).mapInArrow(count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(SLOTS, dtype=np.int64)
    df[rows["slot"].to_numpy()] = rows["df"].to_numpy()
    return np.round(1000 * np.log(df + 1)).astype(np.int64)


def frequent_keys(counts: DataFrame, least: int) -> np.ndarray:
    """Sorted keys of counts (bucket, count) with `least` texts or more, or, if there are more than MOST_FREQUENT of them, with the next power of two that leaves no more."""
    by_power = counts.where(F.col("count") >= least).groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect()  # 64 rows at most
    total = 0
    for row in sorted(by_power, key=lambda r: -r["power"]):
        total += row["count"]
        if total > MOST_FREQUENT:
            least = 2 ** (row["power"] + 1)
            break
    return np.sort(counts.where(F.col("count") >= least).select("bucket").toArrow()["bucket"].to_numpy().view(np.uint64))


def sets(texts: Sequence[str | None], known: Frequencies | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, order, shingle) of the distinct shingles of all texts, by text and, with frequencies, in the common order."""
    hashes, counts = word_hashes(texts)
    shingles, runs = windows(hashes, counts, width)
    of = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(counts) - counts, runs)
    rank = known.order(shingles, hashes, at, np.minimum(counts, width)[of]) if known else np.zeros(len(of), dtype=np.int64)
    order = np.lexsort((shingles, rank, of))
    of, rank, shingles = of[order], rank[order], shingles[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1]) | (rank[1:] != rank[:-1])
    return of[new], rank[new], shingles[new]


def index_keys(of: np.ndarray, rank: np.ndarray, shingles: np.ndarray, n: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) such that two different sets, similar enough, share a key.

    Sets are in one order, frequent shingles last. The j-th smallest shingle that two such sets share is among the first
    n - overlap + j of each. If the smallest is rare, it is a key. If it is frequent, so are all others they share, and the
    smallest two are a key, of which the first lies in the prefix and the second in the prefix extended by one. Sets above
    0.9 pairs_up_to index frequent ones singly too, those above pairs_up_to only so: sizes of similar sets lie no further apart.
    """
    starts = np.cumsum(n) - n
    place = np.arange(len(of)) - starts[of]
    prefix = n - params.overlap(n) + 1
    can = n * 100 >= params.percent * (n + 1)  # a smaller set has no similar set but itself
    first = can[of] & (place < prefix[of])
    rare = rank < _FREQUENT
    single = first & (rare | (n[of] * 100 > params.percent * params.pairs_up_to))
    texts, keys = [of[single]], [mix(shingles[single])]
    paired = np.flatnonzero(first & ~rare & (n[of] <= params.pairs_up_to))
    room = np.maximum(np.minimum(prefix[of[paired]] + 1, n[of[paired]]) - place[paired] - 1, 0)  # places after it in the extended prefix
    one = np.repeat(paired, room)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(room) - room, room)
    texts.append(of[one])
    keys.append(mix(mix(shingles[one]) * np.uint64(0x9E3779B97F4A7C15) + shingles[two]))
    return np.concatenate(texts), np.concatenate(keys)


def _indexed(docs: DataFrame, known, params: Params) -> DataFrame:
    """Adds to (text, others) of docs: n, two hashes of its set, and its keys."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                of, rank, shingles = sets(part.column(0).to_pylist(), known.value, params.width)
                n = np.bincount(of, minlength=len(part))
                texts, keys = index_keys(of, rank, shingles, n, params)
                order = np.argsort(texts, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=len(part)))]).astype(np.int32)
                ends, made = np.cumsum(n), []
                for mixed in (mix(shingles), mix(shingles * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                    made.append(pa.array((total[ends] - total[ends - n]).view(np.int64)))
                made = [pa.array(n), *made, pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64)))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *made], names=[*(f.name for f in others), "n", "k1", "k2", "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.select("text", *[f.name for f in others]).mapInArrow(index, f"{schema}, n long, k1 long, k2 long, keys array<long>")


def _hubs_of(part: pa.RecordBatch, known: Frequencies | None, width: int) -> Iterator[tuple[int, tuple, np.ndarray]]:
    """(row, (order, shingles) of text_a, sorted shingles of text_b); the latter once for neighbouring rows with one b."""
    b = part.column("b").to_numpy()
    new = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
    of, _, shingles = sets(part.column("text_b").take(pa.array(new)).to_pylist(), None, width)
    ends = np.searchsorted(of, np.arange(len(new) + 1))
    which = np.searchsorted(new, np.arange(len(b)), side="right") - 1
    own, rank, mine = sets(part.column("text_a").to_pylist(), known, width)
    mine_at = np.searchsorted(own, np.arange(len(b) + 1))
    for row, w in enumerate(which.tolist()):
        x, y = mine_at[row], mine_at[row + 1]
        yield row, (rank[x:y], mine[x:y]), shingles[ends[w] : ends[w + 1]]


def _fitting(pairs: DataFrame, reps: DataFrame, params: Params) -> DataFrame:
    """Pairs whose sizes allow the similarity."""
    sized = _sides(pairs, reps, "n")
    return sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * params.percent).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """Pairs that are similar enough by their whole texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 3):
                found = []
                for _, (_, own), hub in _hubs_of(part, None, params.width):
                    at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    found.append(params.linked(int((hub[at] == own).sum()), len(own), len(hub)))
                yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return _sides(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _unsettled(spokes: DataFrame, classes: DataFrame, params: Params, small: int = 64) -> DataFrame:
    """(a, b, class) of spokes (bucket, a, b, n, count) whose bucket holds, its hub aside, texts of several classes; in small buckets only those that a text of fitting size stands next to by size."""
    classed = spokes.where("count > 2").join(classes.select(F.col("node").alias("a"), F.col("component").alias("class")).hint("merge"), "a", "left").select("bucket", "a", "b", "n", "count", F.coalesce("class", "a").alias("class"))
    classed = saved(classed)
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("bucket")
    open_ = classed.join(mixed.hint("merge"), "bucket", "left_semi")
    by_size = Window.partitionBy("bucket").orderBy("n", "a")
    fits = (F.lag("n").over(by_size) * 100 >= F.col("n") * params.percent) | (F.lead("n").over(by_size) * params.percent <= F.col("n") * 100)
    few = open_.where(F.col("count") <= small).withColumn("fits", fits).where("fits")
    return open_.where(F.col("count") > small).select("a", "b", "class").unionByName(few.select("a", "b", "class")).distinct()


def _rest(compared: DataFrame, texts: DataFrame, known, params: Params) -> DataFrame:
    """Pairs (a, b) of different classes among texts (a, class) that were compared with one hub (b): all that can be similar enough.

    The prefix rule holds for any order that the texts of a group share; here what the hub lacks comes first, so that texts that
    only share what all have seldom meet. `before` is a shingle's place, which bounds what two texts can share from there on.
    """
    schema = "rid long, class long, n long, key long, before long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 4):
                rid, hub, kind = (part.column(c).to_numpy() for c in ("a", "b", "class"))
                rows, keys, before, sizes = [], [], [], []
                for row, (rank, own), other in _hubs_of(part, known.value, params.width):
                    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    order = np.lexsort((own, rank, other[at] == own))
                    n = len(own)
                    took = own[order[: n - int(params.overlap(np.int64(n))) + 1]]
                    rows.append(np.full(len(took), row))
                    before.append(np.arange(len(took)))
                    sizes.append(np.full(len(took), n))
                    keys.append(mix(mix(took) + np.uint64(int(hub[row]) * 0x9E3779B97F4A7C15 % (1 << 64))))
                at = np.concatenate(rows)
                made = [rid[at], kind[at], np.concatenate(sizes), np.concatenate(keys).view(np.int64), np.concatenate(before)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=[x.split()[0] for x in schema.split(", ")])

    tokens = saved(_sides(compared, texts, "text").select("a", "b", "class", "text_a", "text_b").mapInArrow(emit, schema))
    mixed = tokens.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key")
    kept = saved(tokens.join(mixed.hint("merge"), "key"))
    side = lambda x: kept.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("rid", "class", "n", "before")])
    shared = F.least(F.col("n_a") - F.col("before_a"), F.col("n_b") - F.col("before_b"))
    fit = (F.col("class_a") != F.col("class_b")) & (F.struct("n_a", "rid_a") < F.struct("n_b", "rid_b")) & (shared * (100 + params.percent) >= (F.col("n_a") + F.col("n_b")) * params.percent)
    a, b = side("a"), side("b")
    pairs = saved(a.join(b.hint("merge"), (a["key"] == b["key"]) & fit).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct())
    forget(tokens, kept)
    return pairs


def jaccard_components(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, and the columns named in carry.

    A document's set are its distinct shingles of `width` words (A-Z in lower case; fewer words: all as one). Documents link
    when 100 x intersection >= percent x union; component_id is the smallest doc_id that links reach. A text without words, or
    null, has an empty set and links with nothing. Equal sets (repeated rows, copies) are one set here and never paired. A null
    doc_id is never the smallest, but where all are null. Empty table: empty result. Carried columns may have any names but those
    of the result (ValueError).

    All pairs that can be similar share a key (index_keys): first with all shingles taken as rare; then those texts are indexed again in
    whose prefixes shingles turned out frequent (`frequent` texts or more), with these last and in pairs. Texts of a key are compared with one hub, the one with most company in
    its keys; what was compared with one hub and then lies in several classes meets by prefixes of what the hub lacks (_rest). So
    no link between different components is lost, and no key's texts are paired with one another.
    """
    spark = docs.sparkSession
    pack, unpack = carried(carry, RESULT)
    keyed = with_row_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *pack))
    rarity = word_rarity(keyed)
    row = ["doc_id", *ROW_KEY, *(["carried_"] if carry else [])]
    indexed = saved(_indexed(keyed.select("text", *row), spark.sparkContext.broadcast(Frequencies(rarity, np.zeros(0, dtype=np.uint64))), params))
    reps = indexed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(*ROW_KEY)).alias("rep")).withColumn("rid", F.monotonically_increasing_id())
    reps = saved(reps.select("k1", "k2", "n", "rid", *[F.col(f"rep.{c}").alias(c) for c in ROW_KEY]))
    where = reps.select("rid", "n", *ROW_KEY)
    listed = indexed.where("size(keys) > 0").select(*ROW_KEY, "keys").join(where.hint("merge"), ROW_KEY)
    banded = saved(listed.select("rid", "n", F.explode("keys").alias("bucket")))
    counts = saved(banded.groupBy("bucket").count().where("count > 1"))
    known = spark.sparkContext.broadcast(Frequencies(rarity, frequent_keys(counts, params.frequent)))
    if len(known.value.frequent):  # texts that have frequent shingles in their prefix are indexed again, with these last
        hot = saved(banded.join(counts.where(F.col("count") >= params.frequent).select("bucket").hint("merge"), "bucket", "left_semi").select("rid").distinct())
        hot_texts = keyed.select("text", *ROW_KEY).join(where.join(hot.hint("merge"), "rid", "left_semi").hint("merge"), ROW_KEY).select("text", "rid", F.col("n").alias("size"))
        again = _indexed(hot_texts, known, params).select("rid", F.col("size").alias("n"), F.explode("keys").alias("bucket"))
        both = saved(banded.join(hot.hint("merge"), "rid", "left_anti").unionByName(again))
        forget(banded, counts, hot)
        banded = both
        counts = saved(banded.groupBy("bucket").count().where("count > 1"))
    members = saved(banded.join(counts.hint("merge"), "bucket"))
    forget(banded, counts)
    company = members.groupBy("rid").agg(F.sum("count").alias("company"))
    hubs = saved(members.join(company.hint("merge"), "rid").groupBy("bucket").agg(F.max_by("rid", F.struct("company", "rid")).alias("b")))
    spokes = saved(members.withColumnRenamed("rid", "a").join(hubs.hint("merge"), "bucket").where("a != b"))
    forget(hubs)
    compared = spokes.select("a", "b").distinct()
    wanted = saved(members.select("rid").distinct().join(where.select("rid", *ROW_KEY).hint("merge"), "rid").select("rid", *ROW_KEY))
    texts = saved(keyed.select("text", *ROW_KEY).join(wanted.hint("merge"), ROW_KEY).select("rid", "text"))
    forget(members, wanted)
    fitting = saved(_fitting(compared, reps, params))
    found = saved(_verified(fitting, texts, params))
    classes = components(found)
    rest = _rest(_unsettled(spokes, classes, params), texts, known, params)
    more = saved(_verified(rest, texts, params))
    if more.limit(1).count():
        forget(classes)
        classes = components(found.unionByName(more))
    linked = saved(reps.select("k1", "k2", "n", "rid").join(classes.hint("merge"), F.col("rid") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "rid").alias("class")))
    rows = saved(indexed.where("n > 0").select(*row, "n", "k1", "k2").join(linked.hint("merge"), ["k1", "k2", "n"]).drop("k1", "k2"))
    least = saved(rows.groupBy("class").agg(F.min("doc_id").alias("component_id")))
    forget(spokes, texts, fitting, found, rest, more, linked, classes, reps)
    out = rows.join(least.hint("merge"), "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *unpack)
    alone = indexed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *unpack)
    return out.unionByName(alone)
