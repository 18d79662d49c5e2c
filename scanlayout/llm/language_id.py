"""Language ID: word-first backoff. Known words score by per-language log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mix
from .near_dedup import slices

#: Longest and shortest character n-grams; words are written between two marks.
LONGEST, SHORTEST = 5, 1
RESULT = ["doc_id", "lang_pred", "score"]
#: Languages that a model may know. More are an error: the table of their sample shares is broadcast.
MOST_LANGS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.array([2, 3], dtype=np.uint32)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (categories L*)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Runs of letters of several texts, in lower case: their distinct ones, which one each is, and how many each text has."""

    codes: np.ndarray  # code points of all texts
    start: np.ndarray  # of each distinct word
    length: np.ndarray
    keys: np.ndarray
    which: np.ndarray  # of each word, its place among the distinct ones
    counts: np.ndarray  # of each text

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Words:
        lower = [(t or "").lower() for t in texts]
        codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) + 1 for t in lower])
        inside = _letters()[codes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends]))) if len(lower) else np.zeros(0, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        if not len(starts):
            return cls(codes, none, none, none.astype(np.uint64), none, counts)
        at = np.flatnonzero(inside)
        size = np.diff(np.append(np.searchsorted(at, starts), len(at)))
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        value = (codes[at].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
        hashes = mix(np.add.reduceat(value, np.cumsum(size) - size))
        keys, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        return cls(codes, starts[where], size[where], keys, which, counts)

    def grams(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, key, word) of the n-grams of some distinct words (places), written between marks; longest first. `word` counts within `of`."""
        size = self.length[of] + 2
        ends = np.cumsum(size)
        begin = ends - size
        marked = np.empty(int(size.sum()), dtype=np.uint64)
        word = np.repeat(np.arange(len(of)), size)
        inner = np.ones(len(marked), dtype=bool)
        inner[begin] = inner[ends - 1] = False
        marked[begin], marked[ends - 1] = _MARKS
        offset = np.arange(len(marked)) - np.repeat(begin, size) - 1
        marked[inner] = self.codes[(self.start[of][word] + offset)[inner]]
        marked += np.uint64(1)
        left = np.repeat(ends, size) - np.arange(len(marked))
        sums, total = [], np.zeros(len(marked), dtype=np.uint64)
        for n in range(LONGEST):
            total = total.copy()
            if n < len(marked):
                total[: len(marked) - n] += marked[n:] * _powers(n + 1)[n]
            sums.append(total)
        for n in range(LONGEST, SHORTEST - 1, -1):
            fits = left >= n
            yield n, mix(sums[n - 1][fits] + np.uint64(n)), word[fits]


@dataclass
class Table:
    """Features by the sorted 64-bit keys of their text, and for the languages that have them (from ptr[i] on) the log of their count plus one.

    A feature's log frequency in a language, add-one smoothed, is that log, or 0, less log(features + all counts of the language);
    it is centred on the mean over languages: what all share says nothing, and words and n-grams of any length are on one scale.
    """

    keys: np.ndarray
    ptr: np.ndarray
    lang: np.ndarray
    log: np.ndarray
    mean: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, counts: np.ndarray, langs: int) -> Table:
        order = np.lexsort((lang, keys))
        keys, lang, counts = keys[order], lang[order], counts[order]
        distinct, ptr = np.unique(keys, return_index=True)
        base = -np.log(np.bincount(lang, weights=counts, minlength=langs) + max(len(distinct), 1))
        log = np.log(counts + 1.0).astype(np.float32)
        mean = np.add.reduceat(log.astype(np.float64), ptr) / langs if len(ptr) else np.zeros(0)
        return cls(distinct, np.append(ptr, len(keys)), lang.astype(np.int32), log, mean, base - base.mean() if langs else base)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """A table of words (0), and one for each length of n-grams."""

    langs: list[str]
    tables: dict[int, Table]

    def totals(self, words: Words) -> np.ndarray:
        """Sums over the words of each text (texts by languages): the scores of a known word; else the mean over its known n-grams of the longest length that has any; else 0."""
        n, langs = len(words.keys), len(self.langs)
        level = np.full(n, -1)  # the table that scores the word
        less = np.zeros(n)  # means over languages
        whose, lang, log = [], [], []

        def score(n_: int, word: np.ndarray, row: np.ndarray, share: np.ndarray) -> None:
            table = self.tables[n_]
            level[word] = n_
            less[:] += np.bincount(word, weights=table.mean[row] * share, minlength=n)
            size = table.ptr[row + 1] - table.ptr[row]
            at = np.arange(int(size.sum())) + np.repeat(table.ptr[row] - (np.cumsum(size) - size), size)
            whose.append(np.repeat(word, size))
            lang.append(table.lang[at])
            log.append(table.log[at] * np.repeat(share, size))

        row = self.tables[0].find(words.keys)
        known = np.flatnonzero(row >= 0)
        score(0, known, row[known], np.ones(len(known)))
        new = np.flatnonzero(row < 0)
        if len(new):
            for size, keys, word in words.grams(new):
                open_ = np.flatnonzero(level[new[word]] < 0)
                row = self.tables[size].find(keys[open_])
                hit = np.flatnonzero(row >= 0)
                word = word[open_][hit]
                many = np.bincount(word, minlength=len(new))
                score(size, new[word], row[hit], 1.0 / many[word])
        whose, lang, log = np.concatenate(whose), np.concatenate(lang), np.concatenate(log)
        order = np.argsort(whose, kind="stable")
        whose, lang, log = whose[order], lang[order], log[order]
        at = np.searchsorted(whose, np.arange(n + 1))
        texts = len(words.counts)
        text = np.repeat(np.arange(texts), words.counts)
        pairs, times = np.unique(text * max(n, 1) + words.which, return_counts=True)
        text, word = pairs // max(n, 1), pairs % max(n, 1)
        size = at[word + 1] - at[word]
        where = np.arange(int(size.sum())) + np.repeat(at[word] - (np.cumsum(size) - size), size)
        out = np.bincount(np.repeat(text, size) * langs + lang[where], weights=log[where] * np.repeat(times, size), minlength=texts * langs).reshape(texts, langs)
        out -= np.bincount(text, weights=less[word] * times, minlength=texts)[:, None]
        for k, table in self.tables.items():
            own = level[word] == k
            out += np.bincount(text[own], weights=times[own], minlength=texts)[:, None] * table.base
        return out


def fit(docs: DataFrame, per_lang: int = 2000, chars_per_lang: int = 16_000_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from a bounded sample of labelled rows: of each language about per_lang documents, and about chars_per_lang characters, those with the smallest hashes of the id.

    The whole texts of the sample count, and all its features: words that occur twice or more in a language, and n-grams of all
    words. The model is as large as they are, at most some 16 bytes for each 5 * chars_per_lang n-grams of a language. Rows with a
    null id, text or language aren't learned from; over MOST_LANGS languages are a ValueError.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return Model([], {})
    share = {r.lang: min(1.0, per_lang / r.n, chars_per_lang / max(r.chars, 1)) for r in sizes}
    shares = spark.createDataFrame([(x, k, int(share[x] * (1 << 40))) for k, x in enumerate(langs)], "lang string, lang_no int, below long")
    sample = rows.join(F.broadcast(shares), "lang").where(F.xxhash64("id").bitwiseAND((1 << 40) - 1) < F.col("below")).select("lang_no", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words, out = Words.of(part.column(1).to_pylist()), []
                n = max(len(words.keys), 1)
                both, times = np.unique(np.repeat(part.column(0).to_numpy().astype(np.int64), words.counts) * n + words.which, return_counts=True)
                own, word = both // n, both % n
                out.append((own, np.zeros(len(own), dtype=np.int32), words.keys[word], times))
                for k in np.unique(own).tolist():
                    mine = np.flatnonzero(own == k)
                    for size, keys, at in words.grams(word[mine]):
                        distinct, where = np.unique(keys, return_inverse=True)
                        out.append((np.full(len(distinct), k), np.full(len(distinct), size, dtype=np.int32), distinct, np.bincount(where, weights=times[mine][at]).astype(np.int64)))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2].view(np.int64)), pa.array(columns[3])], names=["lang", "size", "key", "n"])

    counted = sample.mapInArrow(count, "lang int, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).where("size > 0 OR n > 1")
    told = counted.toArrow()
    lang_no, size, key, n = (told[c].to_numpy() for c in ("lang", "size", "key", "n"))
    pick = lambda k: (key[size == k].view(np.uint64), lang_no[size == k].astype(np.int64), n[size == k], len(langs))
    return Model(langs, {k: Table.of(*pick(k)) for k in range(LONGEST + 1)})


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """A row per row of docs: doc_id, lang_pred, score, and the columns named in carry (any names but these: ValueError); others aren't read.

    `und` with score 0 for a null text, one without letters, or a model without languages. Else the language with the highest
    sum over the words of the whole text (on ties the first by name), and its share of exp(sum / sqrt(words)), from 0 to 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    pack, unpack = carried(carry, RESULT)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                langs, sure = np.full(len(part), "und", dtype=object), np.zeros(len(part))
                words = Words.of(part.column(1).to_pylist())
                some = np.flatnonzero(words.counts)
                if len(some) and own.langs:
                    total = own.totals(words)[some]
                    best = total.argmax(axis=1)
                    langs[some] = np.array(own.langs, dtype=object)[best]
                    away = total - total[np.arange(len(some)), best][:, None]
                    sure[some] = 1 / np.exp(away / np.sqrt(words.counts[some])[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(sure), *part.columns[2:]], names=[*RESULT, *part.schema.names[2:]])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *pack)
    schema = ", ".join(["doc_id long, lang_pred string, score double", *([f"carried_ {rows.schema['carried_'].dataType.simpleString()}"] if carry else [])])
    return rows.mapInArrow(label, schema).select(*RESULT, *unpack)
