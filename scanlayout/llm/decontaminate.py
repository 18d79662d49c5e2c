"""Benchmark decontamination: a BM25 index of test items with block maxima, asked with every passage of every document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, windows, word_hashes
from .near_dedup import slices


RESULT = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"]


@dataclass(frozen=True)
class Params:
    """BM25's k1 and b, items in a block, and what share must be reached: of an item's own score, of question shingles, of answer words."""

    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    least_score: float = 0.6
    width: int = 5
    overlap: float = 0.8
    #: The last quarter of an item's words is its answer, unless a column holds the answers.
    answer_share: float = 0.25
    #: Words in a passage, for items of up to a quarter of it; longer items have passages of twice their class of length.
    passage: int = 256
    #: Characters of items in one index, so in one broadcast; more items are asked for in several such indexes.
    index_chars: int = 32 << 20


class Index:
    """Postings by term: items with their impacts, and blocks of items with the greatest impact there.

    Impacts are BM25 parts divided by the item's score for itself, so an item's greatest score is 1 and one threshold fits all.
    """

    def __init__(self, items: Sequence[tuple[int, str | None, str | None]], p: Params, reach: int = 64):
        self.reach = reach
        hashes, counts = word_hashes([f"{q or ''}\n{a or ''}" for _, q, a in items])
        questions = word_hashes([q for _, q, _ in items])[1]
        ends = np.cumsum(counts)
        self.items, self.question, self.answer = [i for i, _, _ in items], [], []
        for k, (_, _, answer) in enumerate(items):
            words = hashes[ends[k] - counts[k] : ends[k]]
            cut = int(questions[k]) if answer is not None else len(words) - int(len(words) * p.answer_share)
            self.question.append((min(p.width, cut), np.unique(windows(words[:cut], np.array([cut]), p.width)[0])))
            self.answer.append(np.unique(words[cut:]))
        pairs, tf = np.unique(np.stack([hashes, np.repeat(np.arange(len(items), dtype=np.uint64), counts)]), axis=1, return_counts=True) if len(hashes) else (np.zeros((2, 0), np.uint64), np.zeros(0))
        self.terms, term, df = np.unique(pairs[0], return_inverse=True, return_counts=True)
        item, n = pairs[1].astype(np.int64), len(items)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * counts / max(counts.mean() if n else 1, 1e-9))
        part = idf[term] * tf * (p.k1 + 1) / (tf + norm[item])
        part = part / np.bincount(item, weights=part, minlength=n)[item] if n else part
        self.item, self.impact, self.at = item, part, np.concatenate([[0], np.cumsum(df)])
        self.block, self.blocks = p.block, -(-n // p.block)
        keys, where = np.unique(term * self.blocks + item // p.block, return_inverse=True)
        self.block_max = np.zeros(len(keys))
        np.maximum.at(self.block_max, where, part)
        self.block_no = keys % max(self.blocks, 1)
        self.block_at = np.searchsorted(keys, np.arange(len(self.terms) + 1) * self.blocks)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the index, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    @staticmethod
    def _spread(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of the terms, and for each the number of its term in `terms`."""
        n = at[terms + 1] - at[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + at[terms][which], which

    def retrieve(self, passage: np.ndarray, terms: np.ndarray, passages: int, least: float) -> list[tuple[int, int, float]]:
        """All (passage, item, score) with score >= least, of passages given as distinct (passage, term) pairs.

        The bound of a block for a passage is the sum of the block maxima of the passage's terms; blocks under the threshold
        are skipped, and only in the others are items scored.
        """
        place, which = self._spread(self.block_at, terms)
        bound = np.bincount(passage[which] * self.blocks + self.block_no[place], weights=self.block_max[place], minlength=passages * self.blocks)
        out = []
        live = np.flatnonzero(bound >= least - 1e-9)
        for p in np.unique(live // self.blocks).tolist():
            blocks = live[live // self.blocks == p] % self.blocks
            place, _ = self._spread(self.at, terms[passage == p])
            place = place[np.isin(self.item[place] // self.block, blocks)]
            score = np.bincount(self.item[place], weights=self.impact[place], minlength=len(self.items))
            out += [(p, i, float(score[i])) for i in np.flatnonzero(score >= least - 1e-9).tolist()]
        return out


def indexes(items: Sequence[tuple[int, str | None, str | None]], p: Params) -> list[Index]:
    """An index for each class of item lengths, by powers of two: what a long item needs changes nothing for short ones."""
    words = word_hashes([f"{q or ''}\n{a or ''}" for _, q, a in items])[1]
    classes: dict[int, list] = {}
    for item, n in zip(items, words.tolist()):
        classes.setdefault(max(p.passage // 4, 1 << max(n - 1, 0).bit_length()), []).append(item)
    return [Index(own, p, reach) for reach, own in sorted(classes.items())]


def _hits(words: np.ndarray, index: Index, p: Params) -> list[tuple[int, float, float, float, int]]:
    """(item, score, question overlap, answer overlap, first word of the passage) of one document, the best passage of each item.

    Passages overlap by the longest item of the index's class, so that each occurrence lies within one.
    """
    known = index.lookup(words)
    if not (known >= 0).any():
        return []
    size = max(p.passage, 2 * index.reach)
    step = size - index.reach
    starts = np.arange(0, max(len(words) - index.reach, 1), step)
    best: dict[int, tuple] = {}
    for low in range(0, len(starts), 64):
        some = starts[low : low + 64]
        length = np.minimum(size, len(words) - some)
        inside = np.repeat(some - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        number, term = np.repeat(np.arange(len(some)), length), known[inside]
        pairs = np.unique((number * (len(index.terms) + 1) + term)[term >= 0])
        for k, item, score in index.retrieve(pairs // (len(index.terms) + 1), pairs % (len(index.terms) + 1), len(some), p.least_score):
            own = words[some[k] : some[k] + size]
            width, question = index.question[item]
            q = float(np.isin(question, windows(own, np.array([len(own)]), width)[0]).mean()) if len(question) else 1.0
            a = float(np.isin(index.answer[item], own).mean()) if len(index.answer[item]) else 1.0
            if q >= p.overlap - 1e-9 and a >= p.overlap - 1e-9 and (item not in best or (q + a, score) > best[item][:2]):
                best[item] = (q + a, score, q, a, int(some[k]))
    return [(item, *found[1:]) for item, found in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """A row per document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap, passage_start (in words), and the columns in carry.

    Found: a passage whose BM25 score for the item is at least least_score of the item's own, and which holds overlap of the
    question's five-word shingles (of all its words, if fewer) and of the answer's distinct words. Whole texts are read. Null and
    empty texts are in no row, an item without words is never found, items that are equal are each found, repeated rows are
    each reported. With an empty table on either side the result is empty. Carried columns may have any names but those of the
    result (ValueError).

    The indexes, one for each class of item lengths, are broadcast. Their size is checked: items of more than index_chars
    characters in all are dealt by hash into as many parts as that takes, each asked in turn.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(question).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"))
    size = rows.agg(F.sum(F.coalesce(F.char_length("q"), F.lit(0)) + F.coalesce(F.char_length("a"), F.lit(0)))).first()[0] or 0
    parts = -(-size // params.index_chars) or 1
    pack, unpack = carried(carry, RESULT)
    own = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *pack)
    others = [own.schema["carried_"]] if carry else []
    schema = ", ".join(["doc_id long", "item_id long", "score double", "question_overlap double", "answer_overlap double", "passage_start long", *(f"{f.name} {f.dataType.simpleString()}" for f in others)])
    out = None
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "q"), F.lit(parts)) == k).orderBy("item_id", "q").collect()
        shared = spark.sparkContext.broadcast(indexes([tuple(r) for r in some], params))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 0):
                    hashes, counts = word_hashes(part.column(0).to_pylist())
                    ends, at, found = np.cumsum(counts), [], []
                    for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                        for index in shared.value:
                            for hit in _hits(hashes[e - n : e], index, params):
                                at.append(i)
                                found.append((index.items[hit[0]], *hit[1:]))
                    took = part.take(pa.array(at, pa.int64()))
                    made = [pa.array([h[0] for h in found], pa.int64()), *(pa.array([h[c] for h in found], pa.float64()) for c in (1, 2, 3)), pa.array([h[4] for h in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays([took.column("doc_id"), *made, *(took.column(f.name) for f in others)], names=[*RESULT, *(f.name for f in others)])

        part = own.mapInArrow(find, schema).select(*RESULT, *unpack)
        out = part if out is None else out.unionByName(part)
    return out
