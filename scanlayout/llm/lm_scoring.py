"""LM scoring: a weighted backoff automaton over smoothed n-grams, counted by Spark and walked from left to right.

Events are words (A-Z in lower case) and one end per text; a word that training never saw is one class, `unknown`. With c the
training counts, a state is the longest run of the last order - 1 events (a start mark before the first) that was counted.

- The arc for w from state h weighs log10((1 - b) c(hw) / c(h) + b p(w | h')), h' being h without its first event.
- For a w without arc, the failure arc to h' weighs log10 b, and w is looked up there; a context that was never counted fails
  with weight 0. At the root, p(w) = (1 - b) c(w) / N, and p(unknown) = b.

b depends on the order and on c(h), by halves of a power of two: the share of training events in such contexts that occurred once,
so would be new if left out; at the root it is (words seen once + 1) / (N + 1). For every state the arcs' weights sum to 1.

No count is dropped and no table collected: texts are cut into blocks of whole documents, written bucketed by block; a block sends
each of its distinct n-grams once, to the task of that n-gram's hash range, and gets the corpus count back. So some 6 bytes
shuffle for each n-gram of a block, and 1 back, and a hot n-gram is an entry a block. All n-grams keep 64 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, saved, shared_dir, word_hashes

END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bins of c(h): two for each power of two.
BINS = 128
#: In how many turns n-grams are counted.
PASSES = 2
_BLOCKS = "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, words binary, at binary, tokens long, train_tokens long"


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that high zeros cost nothing."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block of whole documents: their events as places in the block's sorted distinct event hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes, counts = word_hashes(texts)
            events = np.insert(hashes, np.cumsum(counts), END)
            words, at, times = np.unique(events, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words, at, lengths = words[order], rank[at], counts + 1
            values = [(task << 32) + made, ids, train, lengths.astype(np.int32), _pack(words), _pack(at.astype(np.uint32)), len(events), int(lengths[np.asarray(train)].sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            for i, t, x in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = x.as_py()
                ids.append(i.as_py())
                train.append(t.as_py())
                texts.append(text)
                size += len(text or "")
                if size >= block_bytes or len(ids) >= 20_000:
                    yield block()
                    ids, train, texts, size, made = [], [], [], 0, made + 1
        if ids:
            yield block()

    return docs.mapInArrow(build, _BLOCKS)


def _written(blocks: DataFrame) -> DataFrame:
    """The blocks as a table bucketed by block, so that counts come to them and they never shuffle."""
    spark, path = blocks.sparkSession, shared_dir(blocks.sparkSession)
    name = "llm_blocks_" + path.rsplit("-", 1)[-1]
    blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table._table, table._saved_path = name, path
    return table


class _Block:
    """A block's events, and by order its n-grams: their sorted distinct keys, and at each event the place of the n-gram ending there (-1: reaches before the start)."""

    def __init__(self, row: dict, order: int):
        self.lengths = np.asarray(row["lengths"], dtype=np.int64)
        ranked, at = _unpack(row["words"], "<u8"), _unpack(row["at"], "<u4")
        by_hash = np.argsort(ranked)
        words, place = ranked[by_hash], np.empty(len(ranked), dtype=np.int32)
        place[by_hash] = np.arange(len(ranked))
        at = place[at]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(np.asarray(row["train"], dtype=bool), self.lengths)
        index = np.arange(len(at)) - np.repeat(self.starts, self.lengths)
        self.keys, self.places = [words], [at]
        events, key = words[at], words[at]
        for n in range(2, order + 1):
            before = np.empty_like(key)
            before[1:] = key[:-1]
            if n == 2:
                before[index == 0] = START
            key = mix(before * np.uint64(0xD6E8FEB86659FD93) + events + np.uint64(n))
            whole = index >= n - 2
            distinct, place = np.unique(key[whole], return_inverse=True)
            full = np.full(len(key), -1, dtype=np.int32)
            full[whole] = place
            self.keys.append(distinct)
            self.places.append(full)

    def train_counts(self, n: int) -> np.ndarray:
        own = self.places[n - 1][self.trained]
        return np.bincount(own[own >= 0], minlength=len(self.keys[n - 1]))

    def counts_at(self, totals: list[np.ndarray], starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order from 2: at each event, the counts of its n-gram and of the context before it."""
        first = np.zeros(len(self.places[0]), dtype=bool)
        first[self.starts] = True
        for n in range(2, len(totals) + 1):
            own, context = self.places[n - 1], np.zeros(len(first), dtype=np.int64)
            context[1:] = np.append(totals[n - 2], 0)[self.places[n - 2][:-1]]  # the place -1 takes the 0
            context[first] = starts if n == 2 else 0
            yield np.append(totals[n - 1], 0)[own], np.where(own >= 0, context, 0)


def _bin(context: np.ndarray) -> np.ndarray:
    return np.minimum((2 * np.log2(np.maximum(context, 1))).astype(np.int64), BINS - 1)


def _entries(blocks: DataFrame, order: int, bits: int, turn: int) -> DataFrame:
    """(bucket, block, n, keys, counts): the block's distinct n-grams of one hash range, with their training counts in the block. Every PASSES-th range, from `turn` on."""
    kinds = [("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, rows = _Block(row, order), []
                for n in range(1, order + 1):
                    keys, counts = block.keys[n - 1], block.train_counts(n).astype(np.uint32)
                    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
                    for a, b in zip(cuts, cuts[1:]):
                        if a < b and bucket[a] % PASSES == turn:
                            rows.append((int(bucket[a]), row["block"], n, _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[c for c, _ in kinds])

    return blocks.mapInArrow(emit, "bucket long, block long, n int, keys binary, counts binary")


def _corpus_counts(entries: DataFrame) -> DataFrame:
    """(block, bucket, n, totals, known, once): each row's n-grams' training counts in the corpus; one row of a hash range has its numbers of words seen and seen once."""

    def add(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for n in sorted({r["n"] for r in rows}):
            own = [r for r in rows if r["n"] == n]
            keys = [np.cumsum(_unpack(r["keys"], "<u8"), dtype=np.uint64) for r in own]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([_unpack(r["counts"], "<u4") for r in own]), minlength=len(distinct)).astype(np.uint32)
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            for i, (r, part) in enumerate(zip(own, np.split(total[place], cuts))):
                tell = n == 1 and i == 0
                out.append({"block": r["block"], "bucket": r["bucket"], "n": n, "totals": _pack(part), "known": int((total > 0).sum()) if tell else 0, "once": int((total == 1).sum()) if tell else 0})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("totals", pa.binary()), ("known", pa.int64()), ("once", pa.int64())]))

    return entries.groupBy("bucket").applyInArrow(add, "block long, bucket long, n int, totals binary, known long, once long")


def _counted(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    """The corpus counts of all entries, written in PASSES parts; what a part shuffled is dropped once it is written, which saves disk."""
    parts = [saved(_corpus_counts(_entries(blocks, order, bits, turn))) for turn in range(PASSES)]
    return reduce(DataFrame.unionByName, parts)


def _totals(right: pa.Table, order: int) -> tuple[list[np.ndarray], int, int]:
    parts = sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
    totals = [np.concatenate([_unpack(r["totals"], "<u4") for r in parts if r["n"] == n] or [np.zeros(0, "<u4")]).astype(np.int64) for n in range(1, order + 1)]
    return totals, sum(r["known"] for r in parts), sum(r["once"] for r in parts)


def _statistics(blocks: DataFrame, counts: DataFrame, order: int, starts: int) -> DataFrame:
    """(i, n): sums over blocks of what the failure weights need: by order, kind (training events, those seen once) and bin; -1 and -2 are the words seen, and seen once."""

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left.to_pylist()[0], order)
        totals, known, once = _totals(right, order)
        stats = np.zeros((order - 1, 2, BINS), dtype=np.int64)
        for k, (own, context) in enumerate(block.counts_at(totals, starts)):
            use = block.trained & (context > 0)
            bins = _bin(context[use])
            stats[k, 0] = np.bincount(bins, minlength=BINS)
            stats[k, 1] = np.bincount(bins, weights=own[use] == 1, minlength=BINS)
        flat = stats.ravel()
        at = np.flatnonzero(flat)
        return pa.table({"i": pa.array([*at.tolist(), -1, -2], pa.int32()), "n": pa.array([*flat[at].tolist(), known, once], pa.int64())})

    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(sums, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))


def failure_weights(events: np.ndarray, once: np.ndarray) -> np.ndarray:
    """b by bin: the share of events seen once, by add-a-half."""
    return np.clip((once + 0.5) / (events + 1), 1e-4, 0.9999)


@dataclass
class Automaton:
    """The states that a block's texts can reach: 0 is the root, 1 the start mark, then the counted n-grams below the order.

    `keys` has state * words + word of each arc, sorted; `into` and `weight` its next state and log10 weight. The root's arcs are
    apart, by word, and lead back to it for a word never counted. Other states fail to `fail` with log10 weight `slip`.
    """

    words: int
    start: int
    keys: np.ndarray
    into: np.ndarray
    weight: np.ndarray
    root_into: np.ndarray
    root_weight: np.ndarray
    fail: np.ndarray
    slip: np.ndarray

    def walk(self, at: np.ndarray, lengths: np.ndarray, warm: int, piece: int = 512) -> np.ndarray:
        """The weight of each event of several texts, all walked in step. Long texts go in pieces; as a state depends on the last `warm` events only, a piece starts so many before."""
        pieces = -(-lengths // piece)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        before = np.where(nth > 0, warm, 0)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * piece - before
        size = np.minimum(np.repeat(lengths, pieces) - nth * piece, piece) + before
        order = np.argsort(-size, kind="stable")
        begin, size, before, state = begin[order], size[order], before[order], np.where(nth > 0, 0, self.start)[order]
        out = np.zeros(len(at))
        for t in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -t, side="left"))
            event = begin[:active] + t
            word, now, log = at[event].astype(np.int64), state[:active], np.zeros(active)
            left = np.flatnonzero(now)
            while len(left):
                key = now[left] * self.words + word[left]
                arc = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(left), dtype=bool)
                took, failed = left[hit], left[~hit]
                log[took] += self.weight[arc[hit]]
                now[took] = -1 - self.into[arc[hit]]  # done; a state below 0 is the next one
                log[failed] += self.slip[now[failed]]
                now[failed] = self.fail[now[failed]]
                left = failed[now[failed] > 0]
            root = np.flatnonzero(now == 0)
            log[root] += self.root_weight[word[root]]
            now[root] = -1 - self.root_into[word[root]]
            state[:active] = -1 - now
            use = before[:active] <= t
            out[event[use]] = log[use]
        return out


def automaton(block: _Block, totals: list[np.ndarray], weights: list[np.ndarray], root: float, trained: int, starts: int) -> Automaton:
    """States, arcs and failure arcs out of the corpus counts of a block's n-grams."""
    order, words, size, numbers = len(totals), len(totals[0]), 2, []
    for total in totals[:-1]:
        numbers.append(np.where(total > 0, size + np.cumsum(total > 0) - 1, -1))
        size += int((total > 0).sum())
    fail, slip = np.zeros(size, dtype=np.int64), np.zeros(size)
    p = np.where(totals[0] > 0, (1 - root) * totals[0] / max(trained, 1), root)
    root_into, root_weight = np.maximum(numbers[0], 0) if numbers else np.zeros(words, dtype=np.int64), np.log10(p)
    keys, into, weight = [], [], []
    for n in range(2, order + 1):
        own = block.places[n - 1]
        event = np.full(len(totals[n - 1]), -1, dtype=np.int64)
        event[own[own >= 0]] = np.flatnonzero(own >= 0)  # one of each n-gram's places
        word, suffix = block.places[0][event].astype(np.int64), block.places[n - 2][event]
        context = np.append(block.places[n - 2], 0)[event - 1]
        state, count = numbers[n - 2][context], totals[n - 2][context]
        if n == 2:
            first = np.isin(event, block.starts)
            state, count = np.where(first, 1, state), np.where(first, starts, count)
        seen = totals[n - 1] > 0
        b = weights[n - 2][_bin(count)]
        p = np.where(seen, (1 - b) * totals[n - 1] / np.maximum(count, 1) + b * p[suffix], 1.0)
        keys.append((state * words + word)[seen])
        into.append((numbers[n - 1] if n < order else numbers[n - 2][suffix])[seen])
        weight.append(np.log10(p[seen]))
        if n < order:
            fail[numbers[n - 1][seen]] = numbers[n - 2][suffix[seen]]
        below = numbers[n - 2] >= 0
        slip[numbers[n - 2][below]] = np.log10(weights[n - 2][_bin(totals[n - 2][below])])
        if n == 2:
            slip[1] = np.log10(weights[0][_bin(np.array([starts]))[0]])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    keys = join(keys, np.int64)
    sort = np.argsort(keys)
    return Automaton(words, 1 if starts and order > 1 else 0, keys[sort], join(into, np.int64)[sort], join(weight, np.float64)[sort], root_into, root_weight, fail, slip)


def score_texts(docs: DataFrame, held_out: Column, order: int = 3, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents where held_out is false, scores all. A null text is empty: one event, the end. score is the
    log10 probability of the text in the automaton above, base_score that of add-one smoothed single events (N events, V
    distinct ones: (c + 1) / (N + V + 1)). Without training documents both are 0. Repeated rows count each; other columns
    aren't read; an empty table gives an empty table.
    """
    blocks = _written(_blocks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (~held_out).alias("train"), F.col(text).alias("text")), block_bytes))
    tokens, trained, starts = blocks.select("tokens", "train_tokens", F.size(F.filter("train", lambda t: t)).cast("long").alias("d")).agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("d")).first()
    tokens, trained, starts = tokens or 0, trained or 0, starts or 0
    bits = max(5, (tokens * order // 2_000_000).bit_length())
    counts = _counted(blocks, order, bits)
    sums = {r.i: r.n for r in _statistics(blocks, counts, order, starts).collect()}
    known, once = sums.pop(-1, 0), sums.pop(-2, 0)
    stats = np.zeros((order - 1) * 2 * BINS)
    stats[list(sums)] = list(sums.values())
    weights = [failure_weights(*s) for s in stats.reshape(order - 1, 2, BINS)]
    root = min((once + 1) / (trained + 1), 0.5) if trained else 1.0
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block, (totals, _, _) = _Block(row, order), _totals(right, order)
        single = totals[0][block.places[0]]
        weight = automaton(block, totals, weights, root, trained, starts).walk(block.places[0], block.lengths, order - 1)
        base = np.log10((single + 1) / (trained + known + 1))
        sums_of = lambda x: pa.array(np.add.reduceat(x, block.starts))
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(block.lengths), sums_of((single > 0).astype(np.int64)), pa.array(np.full(len(block.lengths), trained, dtype=np.int64)), sums_of(base), sums_of(weight)], names=names)

    scored = saved(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(walk, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    docs.sparkSession.sql(f"DROP TABLE {blocks._table}")
    forget(blocks)
    return scored
