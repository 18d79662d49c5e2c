"""Best-fit packing: best-fit decreasing in partitions, certified by dual-feasible-function bounds, repacked where bounds leave a gap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, forget, saved, with_row_key
from .tokens import token_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    A text's ids and then end_id. Only longer ones are cut, into pieces of `capacity`; the first takes the rest and may be shorter.
    A null or empty text is end_id alone, one piece. Repeated rows, and a null doc_id, have pieces of their own; an empty table has none.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_bytes(tokenizer).encode
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(texts), 500):
                row, piece, start, length, crc = [], [], [], [], []
                for k, data in enumerate(encode(texts.slice(low, 500).to_pylist()), low):
                    data += end
                    n = len(data) // 4
                    at, first = 0, n % capacity or capacity
                    for p in range(-(-n // capacity)):
                        to = first if p == 0 else at + capacity
                        row.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(data[4 * at : 4 * to]))
                        at = to
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing of these sizes has fewer bins: the best of several dual feasible functions.

    For each threshold k: sizes over capacity - k count as a whole bin, sizes under k as nothing, others as they are. And for each
    k up to 20: floor((k + 1) x / capacity) / k of a bin, or x / capacity where (k + 1) x is a multiple of capacity.
    """
    if not len(sizes):
        return 0
    hist = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(hist, sizes, counts)
    number = np.concatenate([[0], np.cumsum(hist)])
    volume = np.concatenate([[0], np.cumsum(hist * np.arange(capacity + 1))])
    k = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - k + 1]
    between = volume[capacity - k + 1] - volume[k]
    best = int((large + -(-between // capacity)).max())
    x = np.arange(capacity + 1)
    for m in range(1, 21):
        scaled = np.where((m + 1) * x % capacity == 0, m * x, (m + 1) * x // capacity * capacity)
        best = max(best, -(-int((scaled * hist).sum()) // (m * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each size: sizes by decreasing size (ties in order given), each into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets


def _pack(rows: DataFrame, turn: int, groups: int, capacity: int) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_numpy()
        bins, offsets = best_fit(sizes, capacity)
        group, load = table["_group"][0].as_py(), np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(*np.unique(sizes, return_counts=True), capacity)
        out = {
            **{c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": pa.array((turn << 58) + (group << 26) + bins), "offset": pa.array(offsets), "_load": pa.array(load[bins]),
            "_certified": pa.array(np.full(len(sizes), len(load) == bound)),
        }
        return pa.table(out)

    keyed = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(turn), *ROW_KEY), F.lit(groups)))
    return keyed.groupBy("_group").applyInArrow(pack, PIECES + ", sequence_id long, offset long, _load long, _certified boolean")


def pack_documents(pieces: DataFrame, capacity: int = 1024, per_group: int = 20_000, rounds: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (see pieces_of): sequences of at most `capacity`, each filled from offset 0 without gaps.

    Whole pieces are sequences by themselves and don't shuffle. The others are dealt by the hash of their row, so equal rows too, into groups of about per_group rows and
    packed by best-fit decreasing. A lower bound over the histogram of all sizes (`capacity` rows at most, whatever the input)
    tells whether fewer sequences are possible. While they are, the groups exchange the pieces of their sequences that aren't
    full, deal them anew into fewer groups, and pack again, as long as that saves sequences; a round that saves none is dropped and ends the rounds
    (as do `rounds` of them, if given).
    In a group whose bound is reached (certified) only its last, open sequences can gain from an exchange, so it gives
    those under half full; other groups give all that aren't full. Equal rows are packed one by one; an empty table gives an
    empty table. A null doc_id is kept.
    """
    columns = pieces.columns
    keyed = with_row_key(pieces)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    sizes = rest.groupBy("length").count().collect()  # capacity rows at most
    n, bound = sum(r["count"] for r in sizes), lower_bound(np.array([r["length"] for r in sizes], dtype=np.int64), np.array([r["count"] for r in sizes], dtype=np.int64), capacity)
    done, packed = [], saved(_pack(keyed.where(F.col("length") < capacity), 0, -(-n // per_group) or 1, capacity)) if n else None
    columns = [*columns, "sequence_id", "offset"]
    settled = 0
    for turn in count(1):
        if packed is None or turn - 1 == rounds:
            break
        give = (F.col("_load") < capacity) & (~F.col("_certified") | (F.col("_load") < capacity / 2))
        first = F.col("offset") == 0
        total, open_bins, open_rows = packed.agg(F.count_if(first), F.count_if(first & give), F.count_if(give)).first()
        if settled + total <= bound or open_bins < 2:
            break
        again = saved(_pack(with_row_key(packed).where(give), turn, -(-open_rows // per_group), capacity))
        if again.where(first).count() >= open_bins:
            forget(again)
            break
        done.append(packed.where(~give).select(*columns))
        settled += total - open_bins
        packed = again
    for part in [*done, *([packed.select(*columns)] if packed is not None else [])]:
        full = full.unionByName(part)
    return full
