"""Cross-tokenizer alignment: token-byte incidence matrices in CSR, overlap links by Gustavson row products, shared-group links by group incidence."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, forget, saved
from .near_dedup import slices

RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum"]
_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
_TWO_BLANKS = re.compile(r"\s\s")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i has columns indices[indptr[i] : indptr[i + 1]], with the values of data there."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @classmethod
    def of(cls, lengths: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
        return cls(np.concatenate([[0], np.cumsum(lengths)]), indices, np.ones(len(indices), dtype=np.int64), columns)

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of other's rows k, each times the value at (i, k)."""
        many = np.diff(other.indptr)[self.indices]
        where = np.repeat(other.indptr[self.indices] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keys = np.repeat(self.row_numbers(), many) * other.columns + other.indices[where]
        cells, which = np.unique(keys, return_inverse=True)
        values = np.zeros(len(cells), dtype=np.int64)
        np.add.at(values, which, np.repeat(self.data, many) * other.data[where])
        rows = cells // max(other.columns, 1)
        return Csr(np.searchsorted(rows, np.arange(len(self.indptr))), cells - rows * other.columns, values, other.columns)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """Tokens of A by tokens of B, as far as they overlap, with the bytes they share; both cut the same bytes."""
    n = int(a_lengths.sum())
    bytes_of_a = Csr.of(a_lengths, np.arange(n), n)
    b_of_bytes = Csr.of(np.ones(n, dtype=np.int64), np.repeat(np.arange(len(b_lengths)), b_lengths), len(b_lengths))
    return bytes_of_a.times(b_of_bytes)


def groups(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and their number: a group ends where tokens of both end."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    common = np.intersect1d(a_ends, b_ends)
    return np.searchsorted(common, a_ends), np.searchsorted(common, b_ends), len(common)


def group_links(of_a: np.ndarray, of_b: np.ndarray, n: int) -> Csr:
    """Tokens of A by tokens of B of the same group."""
    return Csr.of(np.ones(len(of_a), dtype=np.int64), of_a, n).times(Csr.of(np.bincount(of_b, minlength=n), np.arange(len(of_b)), len(of_b)))


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner:
    """Two tokenizers over blank + text, cut into units that neither merges across; what a unit gives is kept for the task.

    A cut lies before a blank or line feed that stands between two other characters. The byte-level tokenizer always cuts there,
    and the piece tokenizer has no piece with a blank after another character, nor one with a line feed (else units are whole texts).
    """

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        of_char = _byte_of_char()
        self.a_bytes = {i: bytes(of_char[c] for c in t) if all(c in of_char for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.blank = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.pair_index: dict[int, int] = {}
        self.pairs: list[int] = []
        self.texts: list[str] = []
        self.counts = np.zeros((0, 5), dtype=np.int64)  # of each unit: n_a, n_b, n_groups, n_group_links, whether the bytes agree
        self.link_at, self.links = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.size = 0

    def cut(self, text: str) -> list[str]:
        if not self.cuts:
            return [" " + text]
        if _TWO_BLANKS.search(text) or text[0].isspace() or text[-1].isspace():
            return _CUTS.split(" " + text)
        return [p if p[0] == "\n" else " " + p for p in text.replace("\n", " \n").split(" ")]

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [x if u[0] == " " else x[1:] if x[:1] == [self.blank] else [] for u, x in zip(units, b)]

    def learn(self, units: list[str]) -> None:
        """Adds units that are new."""
        a, b = self.encode(units)
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == u.encode("utf-8", "surrogatepass") for u, x, y in zip(units, a, b)]
        rows = [k for k, g in enumerate(good) if g]
        a_ids, b_ids = (np.array([i for k in rows for i in of[k]], dtype=np.int64) for of in (a, b))
        a_lengths = np.array([len(self.a_bytes[i]) for i in a_ids.tolist()], dtype=np.int64)
        b_lengths = np.array([len(self.b_bytes[i]) for i in b_ids.tolist()], dtype=np.int64)
        a_unit, b_unit = np.repeat(rows, [len(a[k]) for k in rows]).astype(np.int64), np.repeat(rows, [len(b[k]) for k in rows]).astype(np.int64)
        links = overlap_links(a_lengths, b_lengths)
        of_a, of_b, n = groups(a_lengths, b_lengths)
        unit_of_group = np.zeros(n, dtype=np.int64)
        unit_of_group[of_a] = a_unit
        counts = np.zeros((len(units), 5), dtype=np.int64)
        for k, of in enumerate((a_unit, b_unit, unit_of_group, a_unit[group_links(of_a, of_b, n).row_numbers()])):
            counts[:, k] = np.bincount(of, minlength=len(units))
        counts[:, 4] = good
        said: list[list[str]] = [[] for _ in units]
        a_said, b_said = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        a_at, b_at = (np.searchsorted(of, np.arange(n + 1)).tolist() for of in (of_a, of_b))
        for g, unit in enumerate(unit_of_group.tolist()):
            said[unit].append(f"{','.join(a_said[a_at[g] : a_at[g + 1]])}|{','.join(b_said[b_at[g] : b_at[g + 1]])}")
        linked = (a_ids[links.row_numbers()] << 32) | b_ids[links.indices]
        names, which = np.unique(linked, return_inverse=True)
        numbers = np.empty(len(names), dtype=np.int32)
        for k, pair in enumerate(names.tolist()):
            numbers[k] = self.pair_index.setdefault(pair, len(self.pairs))
            if numbers[k] == len(self.pairs):
                self.pairs.append(pair)
        self.units.update(zip(units, range(len(self.texts), len(self.texts) + len(units))))
        self.texts += [";".join(s) for s in said]
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, numbers[which]])
        many = np.bincount(a_unit[links.row_numbers()], minlength=len(units))
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(many)])
        self.size += sum(map(len, units)) * 8 + 400 * len(units)

    def align(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """For each text: n_a, n_b, n_groups, n_group_links; its groups; the numbers of its links' pairs. Nothing for null and empty texts, and for those whose bytes don't agree."""
        cut = [self.cut(t) if t else [] for t in texts]
        if new := list({u for c in cut for u in c if u not in self.units}):
            self.learn(new)
        sizes = np.array([len(c) for c in cut])
        ids = np.fromiter((self.units[u] for c in cut for u in c), dtype=np.int64, count=int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(doc, weights=1 - self.counts[ids, 4], minlength=len(texts)) > 0
        totals = np.stack([np.bincount(doc, weights=self.counts[ids, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)
        totals[bad] = 0
        ends, said, linked = np.cumsum(sizes), [], []
        many = self.link_at[ids + 1] - self.link_at[ids]
        at = np.concatenate([[0], np.cumsum(many)])
        numbers = self.links[np.repeat(self.link_at[ids] - at[:-1], many) + np.arange(at[-1])]
        for k, (low, high) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            none = bad[k] or low == high
            said.append("" if none else ";".join(map(self.texts.__getitem__, ids[low:high].tolist())))
            linked.append(numbers[:0] if none else numbers[at[low] : at[high]])
        return totals, said, linked


@lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


_DOC = "block long, n_a long, n_b long, n_groups long, n_group_links long, groups string, links binary"
_PAIRS = "numbers array<int>, pairs array<long>, docs array<int>"


def _aligned(docs: DataFrame, a: str, b: str, block_bytes: int, most_kept: int = 96 << 20) -> DataFrame:
    """A row for each document of (text, others), and one for each block of documents of about block_bytes: its different linked pairs, their numbers and how many of its documents hold them."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    made_names = [x.split()[0] for x in f"{_DOC}, {_PAIRS}".split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know, task, number, size, held = _aligner(a, b), TaskContext.get().partitionId(), 0, 0, []
        types = None

        def pairs_row() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((found, pa.int32()), (np.array(know.pairs, dtype=np.int64)[found], pa.int64()), (times, pa.int32()))]
            none = [pa.nulls(1, t) for t in types]
            return pa.RecordBatch.from_arrays([*none, pa.array([(task << 32) + number]), *(pa.nulls(1, t) for t in [pa.int64()] * 4 + [pa.string(), pa.binary()]), *lists], names=[*(f.name for f in others), *made_names])

        for batch in batches:
            types = [batch.column(f.name).type for f in others]
            for part in slices(batch, 0):
                totals, said, linked = know.align(part.column(0).to_pylist())
                doc = np.repeat(np.arange(len(linked)), [len(x) for x in linked])
                held.append(np.unique(doc * len(know.pairs) + np.concatenate(linked)) % max(len(know.pairs), 1))
                made = [pa.array(np.full(len(part), (task << 32) + number)), *(pa.array(totals[:, k]) for k in range(4)), pa.array(said, pa.string()), pa.array([x.tobytes() for x in linked], pa.binary())]
                empty = [pa.nulls(len(part), pa.list_(t)) for t in (pa.int32(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *made, *empty], names=[*(f.name for f in others), *made_names])
                size += part.column(0).nbytes
                if size >= block_bytes:
                    yield pairs_row()
                    number, size, held = number + 1, 0, []
                    if know.size > most_kept:
                        know.forget()
        if held:
            yield pairs_row()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.select("text", *[f.name for f in others]).mapInArrow(align, f"{schema}{', ' if schema else ''}{_DOC}, {_PAIRS}")


def align(docs: DataFrame, a: str, b: str, text: str = "text", carry: Sequence[str] = ("doc_id",), keep: Sequence[Column] | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """A row per row of docs: the columns named in carry, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, and `keep`.

    a is a byte-level BPE file, b a piece model that adds a blank; both get blank + text without special tokens. Links are pairs of
    overlapping token occurrences, group links those of one group (between two places where tokens of both end). A pair
    of ids counts the documents that hold it linked; n_best are links whose pair counts most for its id of A (ties included), count_sum
    is the sum over links. `keep`: columns over each document's real outputs, of which only these stay (all of groups, if not
    given): groups (`a1,a2|b1;a3|b2,b3`), links (int32 numbers of pairs) and the counts. A text that is null or empty, or whose bytes either
    tokenizer doesn't give back, has no tokens: zeros and '' for groups; but a repeated row counts again. An empty table gives an
    empty one. Carried columns may have any names but those of the result (ValueError).

    Each block of documents sends its different pairs once, with its own counts, and gets the corpus's back; no pair of a document is shuffled.
    """
    pack, unpack = carried(carry, RESULT)
    keep = [F.col("groups")] if keep is None else keep
    aligned = _aligned(docs.select(F.col(text).cast("string").alias("text"), *pack), a, b, block_bytes)
    stay = [c for c in aligned.columns if c != "groups"]
    table = saved(aligned.select(*stay, F.when(F.col("links").isNotNull(), F.struct(*keep)).alias("kept_") if keep else F.lit(None).cast("int").alias("kept_")))
    listed = saved(table.where("links IS NULL").select("block", F.explode(F.arrays_zip("numbers", "pairs", "docs")).alias("x")).select("block", F.col("x.numbers").alias("number"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs")))
    counts = saved(listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = saved(counts.join(most.hint("merge"), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    told = saved(listed.join(known.hint("merge"), "pair").select("block", "number", "n", "best"))
    forget(listed, counts, known)
    rows = table.where("links IS NOT NULL").drop("numbers", "pairs", "docs")
    fields = [f for f in rows.schema.fields if f.name not in ("block", "links")]

    def look_up(mine: pa.Table, answers: pa.Table) -> pa.Table:
        links = mine["links"].to_pylist()
        sizes = np.array([len(x) // 4 for x in links], dtype=np.int64)
        numbers = np.frombuffer(b"".join(links), dtype=np.int32)
        n, best = (np.zeros(int(numbers.max(initial=-1)) + 1, dtype=np.int64) for _ in range(2))
        at = answers["number"].to_numpy()
        n[at], best[at] = answers["n"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
        ends, out = np.cumsum(sizes), [sizes]
        for values in (best, n):
            total = np.concatenate([[0], np.cumsum(values[numbers])])
            out.append(total[ends] - total[ends - sizes])
        return pa.table({**{f.name: mine[f.name] for f in fields}, **{c: pa.array(x, pa.int64()) for c, x in zip(("n_links", "n_best", "count_sum"), out)}})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_links long, n_best long, count_sum long"
    done = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(look_up, schema)
    return done.select(*unpack, *RESULT, *(["kept_.*"] if keep else []))
