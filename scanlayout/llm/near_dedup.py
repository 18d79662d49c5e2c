"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, carried, components, forget, mix, saved, text_keys, windows, with_row_key, word_hashes

#: Hashed words of which document frequencies are kept: the table's size is fixed, so it may be broadcast.
WORD_SLOTS = 1 << 18
_TABLE = 1 << 14
#: Classes of sums of weights in which pairs of the least similarity lie apart at most.
_STEPS = 8
#: Of a hub's texts, if they are more, about so many are drawn to tell which shingles are common among them: those in COMMON of the drawn ones.
DRAWN, COMMON = 64, 3
RESULT = ["doc_id", "class_id", "class_size", "kept"]


@dataclass(frozen=True)
class Params:
    """Words in a shingle, least similarity, bands and samples in a band. At similarity 0.8, 20 bands of 6 find 99.8 % of pairs, at 0.85 all but one in 30,000."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 6


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """ln((N + 1) / (df + 1)) + 1 of each slot of hashed words, over all documents. WORD_SLOTS rows at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WORD_SLOTS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                hashes, counts = word_hashes(part.column(0).to_pylist())
                own = np.repeat(np.arange(len(counts)), counts) * WORD_SLOTS + (hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
                df += np.bincount(np.unique(own) % WORD_SLOTS, minlength=WORD_SLOTS)
                n += len(counts)
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*slots.tolist(), -1], pa.int32()), pa.array([*df[slots].tolist(), n], pa.int64())], names=["slot", "df"])

    rows = docs.select(F.col(text)).mapInArrow(count, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).toArrow()
    slots, df = rows["slot"].to_numpy(), rows["df"].to_numpy()
    known, n = np.zeros(WORD_SLOTS), int(df[slots < 0].sum())
    known[slots[slots >= 0]] = df[slots >= 0]
    return (np.log((n + 1) / (known + 1)) + 1).astype(np.float32)


def slices(batch: pa.RecordBatch, *columns: int, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the texts of the columns reach `budget` bytes."""
    sizes = np.zeros(len(batch), dtype=np.int64)
    for c in columns:
        sizes += pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // budget)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if a < b:
            yield batch.slice(a, b - a)


def vectors(texts: Sequence[str | None], idf: np.ndarray, width: int, ranked: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text its distinct shingles in order, and their weights: times it occurs, by the mean inverse frequency of its words. Ranked: also how rare their words are, in whole numbers, so that a shingle has the same rank in all texts."""
    yield from _vectors(*word_hashes(texts), idf, width, ranked)


def _vectors(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray, width: int, ranked: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    shingles, runs = windows(hashes, counts, width)
    rare = np.concatenate([[0], np.cumsum(np.round(1000 * idf).astype(np.int64)[(hashes % np.uint64(WORD_SLOTS)).astype(np.int64)])]) if ranked else None
    sums = np.concatenate([[0.0], np.cumsum(idf[(hashes % np.uint64(WORD_SLOTS)).astype(np.int64)], dtype=np.float64)])
    ends, at = np.cumsum(counts), np.cumsum(runs)
    for i, n in enumerate(counts.tolist()):
        first, size = ends[i] - n, min(n, width)
        own = shingles[at[i] - runs[i] : at[i]]
        mean = np.round((sums[first + size : ends[i] + 1] - sums[first : ends[i] + 1 - size]) / max(size, 1), 4) if n else np.zeros(0)
        features, where, times = np.unique(own, return_index=True, return_counts=True)
        if ranked:
            at_word = first + where
            yield features, times * mean[where], rare[at_word + size] - rare[at_word]
        else:
            yield features, times * mean[where]


def similarity(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Weighted Jaccard similarity: sum of smaller by sum of greater weights; 0 if either has none."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


class Sampler:
    """Improved consistent weighted sampling: of a weighted set, `size` samples; two sets share a sample with a chance of their weighted Jaccard similarity.

    For feature f with weight S and sample k, r and c are Gamma(2, 1) and b uniform by hashes of f: t = floor(ln S / r + b),
    ln a = ln c - r (t - b + 1); the feature with the smallest a is drawn, together with its t. r and b come from one table by
    14 bits of the hash of f, c from another by 14 others.
    """

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        self.r = rng.gamma(2, 1, (size, _TABLE)).astype(np.float32)
        self.beta = rng.random((size, _TABLE), dtype=np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (size, _TABLE))).astype(np.float32)

    def draw(self, features: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (sets by size, uint64) of several sets, one after the other, each with a feature at least."""
        hashed = mix(features)
        i, j = (hashed & np.uint64(_TABLE - 1)).astype(np.int64), (hashed >> np.uint64(14) & np.uint64(_TABLE - 1)).astype(np.int64)
        log_s = np.log(weights).astype(np.float32)
        lengths = np.diff(np.append(starts, len(features)))
        out = np.empty((len(starts), self.size), dtype=np.uint64)
        for k in range(self.size):
            r, b = self.r[k].take(i), self.beta[k].take(i)
            t = np.floor(log_s / r + b)
            a = self.log_c[k].take(j) - r * (t - b + 1)
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
            drawn = least[np.searchsorted(least, starts)]
            out[:, k] = mix(features[drawn] + t[drawn].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        return out


_SIGNED = "k1 long, k2 long, total double, bands array<long>, sketch binary"


def _signatures(docs: DataFrame, idf, params: Params, chunk: int = 8192) -> DataFrame:
    """Adds to (text, others) of docs: two hashes of its words, the sum of weights (0: no words), a key per band, and a byte per sample."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, frequencies = Sampler(params.bands * params.rows), idf.value
        for batch in batches:
            for part in slices(batch, 0):
                n = len(part)
                total, bands, sketch = np.zeros(n), [[]] * n, [b""] * n
                rows, features, weights, size = [], [], [], 0
                hashes, counts = word_hashes(part.column(0).to_pylist())
                k1, k2 = text_keys(hashes, counts)

                def flush() -> None:
                    starts = np.cumsum([0, *map(len, features[:-1])])
                    drawn = sampler.draw(np.concatenate(features), np.concatenate(weights), starts)
                    keys = np.zeros((len(rows), params.bands), dtype=np.uint64)
                    for r in range(params.rows):
                        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + drawn[:, r :: params.rows] + np.uint64(1))
                    keys = mix(keys + np.arange(params.bands, dtype=np.uint64)).view(np.int64)
                    for m, row in enumerate(rows):
                        bands[row], sketch[row] = keys[m].tolist(), (drawn[m] & np.uint64(255)).astype(np.uint8).tobytes()

                for row, (own, weight) in enumerate(_vectors(hashes, counts, frequencies, params.width)):
                    if len(own):
                        total[row] = weight.sum()
                        rows.append(row)
                        features.append(own)
                        weights.append(weight)
                        size += len(own)
                        if size >= chunk:
                            flush()
                            rows, features, weights, size = [], [], [], 0
                if rows:
                    flush()
                made = [pa.array(k1), pa.array(k2), pa.array(total), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in others] + made, names=[*(f.name for f in others), "k1", "k2", "total", "bands", "sketch"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.select("text", *[f.name for f in others]).mapInArrow(sign, f"{schema}, {_SIGNED}")


def _sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Columns of both nodes of pairs (a, b), as c_a and c_b. b is joined last, so neighbouring rows tend to share it."""
    for x in "ab":
        pairs = pairs.join(of.select(F.col("rid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]).hint("merge"), x)
    return pairs


def _promising(pairs: DataFrame, reps: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) whose sums of weights allow the similarity and whose samples agree to it less four standard errors."""
    least = params.similarity - 4 * (params.similarity * (1 - params.similarity) / (params.bands * params.rows)) ** 0.5
    joined = _sides(pairs, reps, "sketch", "total").where(F.least("total_a", "total_b") >= (params.similarity - 1e-9) * F.greatest("total_a", "total_b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))

    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(agree, "a long, b long")


def _both(part: pa.RecordBatch, idf: np.ndarray, width: int, ranked: bool = False) -> Iterator[tuple[int, tuple, tuple]]:
    """(row, vector of text_a, vector of text_b); that of a text_b is made once for neighbouring rows with one b."""
    b = part.column("b").to_numpy()
    new = np.flatnonzero(np.diff(b, prepend=b[:1] - 1))
    hubs = list(vectors(part.column("text_b").take(pa.array(new)).to_pylist(), idf, width))
    which = np.searchsorted(new, np.arange(len(b)), side="right") - 1
    for row, own in enumerate(vectors(part.column("text_a").to_pylist(), idf, width, ranked)):
        yield row, own, hubs[which[row]]


def _verified(pairs: DataFrame, texts: DataFrame, idf, params: Params) -> DataFrame:
    """Pairs with at least the similarity by their whole texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 3):
                found = [similarity(x, y) >= params.similarity - 1e-9 for _, x, y in _both(part, idf.value, params.width)]
                yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return _sides(pairs, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _classed(compared: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, class): each text with each hub it shares a bucket with, and the text's class."""
    own = classes.select(F.col("node").alias("a"), F.col("component").alias("class"))
    return compared.join(own.hint("merge"), "a", "left").select("a", F.explode("hubs").alias("b"), F.coalesce("class", "a").alias("class"))


def _apart(compared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts and the hubs that aren't in their class: a link within a class would tell nothing new."""
    hub = classes.select(F.col("node").alias("b"), F.col("component").alias("of_hub"))
    other = _classed(compared.withColumn("hubs", F.array_remove("hubs", F.col("best"))), classes)
    return other.join(hub.hint("merge"), "b", "left").where(F.col("class") != F.coalesce("of_hub", "b")).select("a", "b")


_PREFIX = np.dtype([("key", "<i8"), ("large", "?"), ("before", "<f8")])


def prefixes(own: tuple[np.ndarray, ...], hub: np.ndarray, group: int, s: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Rows (key, large, before) of a text's lightest cover: what two texts of one group need to share to have similarity s or more.

    Shingles are in one order for the whole group: those that are not common in it first, then by how common they are (common: shingles in
    order, and in how many drawn texts each is); of these those that its hub lacks first, and of these and of the others the rarest first (by
    own's rank, if it has one), so that texts that only share what many have seldom meet. The order decides who meets, not who is found. `before` is the weight before a shingle. With
    sums A <= B, s needs an overlap of (A + B) s / (1 + s); so the first common shingle has at most A, or B, less that before it.
    Sums are in classes by powers of s ** (1 / 8). For each distance d between the classes of A and of B, a text offers what it may
    have as the smaller one, and as the larger one; a key is made of group, shingle, class of the smaller and d.
    """
    features, weights = own[:2]
    rank = own[2] if len(own) > 2 else np.zeros(len(features), dtype=np.int64)
    often = np.zeros(len(features), dtype=np.int64)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], features), len(common[0]) - 1)
        often = np.where(common[0][at] == features, common[1][at], 0)
    order = np.lexsort((features, -rank, np.isin(features, hub, assume_unique=True), often))
    features, weights = features[order], weights[order]
    total, step, share = weights.sum(), -np.log(s) / _STEPS, s / (1 + s)
    before = np.cumsum(weights) - weights
    k = int(np.floor(np.log(total) / step))
    out = []
    for d in range(_STEPS + 1):
        for large in (False, True):
            most = 1 - share * (1 + (np.exp(-(d + 1) * step) if large else np.exp(max(d - 1, 0) * step)))
            n = int(np.searchsorted(before, (most + 1e-6) * total, side="right"))
            rows = np.empty(n, dtype=_PREFIX)
            seed = (group * 0x9E3779B97F4A7C15 + ((k - d if large else k) * 16 + d) * 0xD6E8FEB86659FD93) % (1 << 64)
            rows["key"], rows["large"], rows["before"] = mix(mix(features[:n]) + np.uint64(seed)).view(np.int64), large, before[:n]
            out.append(rows)
    return np.concatenate(out)


_COMMON = pa.struct([("shingle", pa.int64()), ("n", pa.int64())])


def _shared(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(b, common) out of rows (b, text) in order of b: one row for each hub b that has some, with the shingles that COMMON of its texts or more have, and how many have each."""
    hub, held = None, []

    def row() -> Iterator[pa.RecordBatch]:
        shingles, n = np.unique(np.concatenate(held or [np.zeros(0, dtype=np.uint64)]), return_counts=True)
        often = n >= COMMON
        if often.any():
            pairs = pa.StructArray.from_arrays([pa.array(shingles[often].view(np.int64)), pa.array(n[often].astype(np.int64))], fields=list(_COMMON))
            yield pa.RecordBatch.from_arrays([pa.array([hub], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)], names=["b", "common"])

    for batch in batches:
        for part in slices(batch, 1):
            own, runs = windows(*word_hashes(part.column(1).to_pylist()), width)
            for b, shingles in zip(part.column(0).to_pylist(), np.split(own, np.cumsum(runs)[:-1])):
                if b != hub:
                    yield from row()
                    hub, held = b, []
                held.append(np.unique(shingles))
    yield from row()


def _common(compared: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """(b, common): for each hub b with more than DRAWN texts a, the shingles that several of about DRAWN drawn ones have, and how many have each. These few texts are counted in one place, and a row for each hub comes out."""
    many = compared.groupBy("b").count().where(F.col("count") > DRAWN)
    drawn = saved(compared.join(many.hint("merge"), "b").where(F.pmod(F.xxhash64("a", "b"), F.col("count")) < DRAWN).select("b", F.col("a").alias("rid")))
    rows = drawn.join(texts.hint("merge"), "rid").select("b", "text").repartition("b").sortWithinPartitions("b")
    return saved(rows.mapInArrow(lambda batches: _shared(batches, params.width), "b long, common array<struct<shingle: long, n: long>>"))


def _rest(compared: DataFrame, texts: DataFrame, idf, params: Params) -> DataFrame:
    """Pairs (a, b) of different classes among texts (a, class) compared with one hub (b), as far as their weights allow the similarity: none is lost."""
    schema = "rid long, class long, total double, key long, large boolean, before double"

    def told(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each row its hub's common shingles in order, with their numbers; rows side by side mostly have one hub."""
        flat, out, last, made = column.flatten(), [], None, None
        shingle, n = flat.field("shingle").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("n").to_numpy(zero_copy_only=False)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            if a == b:
                out.append(None)
                continue
            if last is None or not np.array_equal(last, shingle[a:b]):
                last, order = shingle[a:b], np.argsort(shingle[a:b])
                made = last[order], n[a:b][order]
            out.append(made)
        return out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 4):
                rid, hub, kind = (part.column(c).to_numpy() for c in ("a", "b", "class"))
                common = told(part.column("common"))
                made = [(row, x[1].sum(), prefixes(x, y[0], int(hub[row]), params.similarity, common[row])) for row, x, y in _both(part, idf.value, params.width, ranked=True)]
                at = np.repeat([m[0] for m in made], [len(m[2]) for m in made]).astype(np.int64)
                all_ = np.concatenate([m[2] for m in made])
                total = np.array([m[1] for m in made])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[at], kind[at], total[at], np.ascontiguousarray(all_["key"]), np.ascontiguousarray(all_["large"]), np.ascontiguousarray(all_["before"]))], names=[x.split()[0] for x in schema.split(", ")])

    side = lambda n: texts.select(F.col("rid").alias(n), F.col("text").alias(f"text_{n}")).hint("merge")
    hubs = compared.groupBy("a", "class").agg(F.collect_list("b").alias("hubs")).join(side("a"), "a").select("a", "class", "text_a", F.explode("hubs").alias("b"))
    hubs = hubs.join(side("b"), "b").join(_common(compared, texts, params).hint("merge"), "b", "left")
    tokens = saved(hubs.select("a", "b", "class", "text_a", "text_b", "common").mapInArrow(emit, schema))
    side = lambda large, n: tokens.where(F.col("large") == large).select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("rid", "class", "total", "before")])
    share = params.similarity / (1 + params.similarity)
    need = (F.col("total_a") + F.col("total_b")) * (share - 1e-9)
    fit = (F.col("class_a") != F.col("class_b")) & (F.struct("total_a", "rid_a") < F.struct("total_b", "rid_b")) & (F.col("total_a") - F.col("before_a") >= need) & (F.col("total_b") - F.col("before_b") >= need)
    small, large = side(False, "a"), side(True, "b")
    pairs = small.join(large.hint("merge"), (small["key"] == large["key"]) & fit)
    return pairs.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct()


def near_dedup(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A row per row of docs: doc_id, class_id, class_size, kept, and the columns named in carry.

    A class is what links of similarity 0.8 or more join, links of links included; class_id is its smallest doc_id (a null one
    first), and one row with it is kept. Texts are the same if their words are (A-Z in lower case); they are one text here and are
    never paired. A text without words, or null, is a class of its own; one of fewer than five words has one shingle, all of
    them. Empty table: empty result. Carried columns may have any names but those of the result (ValueError).

    No bucket is paired within. Its texts are compared with one hub, the one with most company in its buckets. Each text is first compared with the hub
    it shares most buckets with, and then with those that aren't in its class by that. What was compared with one
    hub and then lies in several classes meets by prefixes: texts whose weights allow the similarity share a shingle among their first
    ones, those that the hub lacks coming first. So no candidate is lost, and texts that only share what all have don't meet.
    """
    spark = docs.sparkSession
    pack, unpack = carried(carry, RESULT)
    keyed = with_row_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *pack))
    idf = spark.sparkContext.broadcast(inverse_frequencies(keyed))
    row = ["doc_id", *ROW_KEY, *(["carried_"] if carry else [])]
    signed = saved(_signatures(keyed.select("text", *row), idf, params))
    any_of = [F.any_value(c).alias(c) for c in ("total", "bands", "sketch")]
    reps = saved(signed.where("total > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", *ROW_KEY)).alias("rep"), *any_of).withColumn("rid", F.monotonically_increasing_id()))
    banded = reps.select("rid", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1")
    members = saved(banded.join(shared.hint("merge"), "bucket"))
    company = members.groupBy("rid").agg(F.sum("count").alias("company"))
    hubs = saved(members.join(company.hint("merge"), "rid").groupBy("bucket").agg(F.max_by("rid", F.struct("company", "rid")).alias("b")))
    met = members.select("bucket", F.col("rid").alias("a")).join(hubs.hint("merge"), "bucket").where("a != b").groupBy("a", "b").count()
    compared = saved(met.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("best"), F.collect_list("b").alias("hubs")))
    wanted = saved(members.select("rid").distinct().join(reps.select("rid", "rep").hint("merge"), "rid").select("rid", *[F.col(f"rep.{c}").alias(c) for c in ROW_KEY]))
    texts = saved(keyed.select("text", *ROW_KEY).join(wanted.hint("merge"), ROW_KEY).select("rid", "text"))
    found, classes = None, None
    for pairs in (lambda: compared.select("a", F.col("best").alias("b")), lambda: _apart(compared, classes)):
        tested = saved(_promising(saved(pairs()), reps, params))
        links = _verified(tested, texts, idf, params)
        found = saved(links if found is None else links.unionByName(found))
        classes = components(found)
        forget(tested)
    classed = saved(_classed(compared, classes))
    split = saved(classed.groupBy("b").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("b"))
    rest = saved(_rest(classed.join(split.hint("merge"), "b", "left_semi"), texts, idf, params))
    more = saved(_verified(saved(_promising(rest, reps, params)), texts, idf, params))
    if more.limit(1).count():
        classes = components(found.unionByName(more))
    linked = saved(reps.select("k1", "k2", "rid").join(classes.hint("merge"), F.col("rid") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rid").alias("class")))
    rows = saved(signed.where("total > 0").select(*row, "k1", "k2").join(linked.hint("merge"), ["k1", "k2"]).drop("k1", "k2"))
    first = F.struct("doc_id", *ROW_KEY)
    sizes = saved(rows.groupBy("class").agg(F.min(first).alias("first"), F.count("*").alias("class_size")))
    forget(members, hubs, compared, wanted, texts, found, classed, split, rest, more, linked)
    rows = rows.join(sizes.hint("merge"), "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", first.eqNullSafe(F.col("first")).alias("kept"), *unpack)
    alone = signed.where("total = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), *unpack)
    return rows.unionByName(alone)
