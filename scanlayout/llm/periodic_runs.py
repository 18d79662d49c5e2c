"""Periodic run detection: Re-Pair of the word ids, runs across each nonterminal's boundary once, translated to all its places, merged."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, mix
from .near_dedup import slices

RUN = "struct<start: long, length: long, period: long>"
RESULT = ["n_words", "runs", "collapsed"]
#: A run has four periods and six words, so its first five words come again one period later.
TIMES, LEAST, SEED_WORDS = 4, 6, 5
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def _doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the 2 * width words from each place on, out of those of width words; the array's end is padded by itself."""
    after = np.concatenate([grams[width:], np.arange(min(width, len(grams)), dtype=np.uint64)])
    return mix(grams * _MULTIPLIER + after + np.uint64(1))


def _comes_again(ids: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Which documents hold some five words in a row twice; the others have no run."""
    out = np.zeros(n_docs, dtype=bool)
    n = len(ids) - SEED_WORDS + 1
    if n < 2:
        return out
    grams = docs[:n].astype(np.uint64)
    for k in range(SEED_WORDS):
        grams = grams * _MULTIPLIER + ids[k : n + k].astype(np.uint64) + np.uint64(1)
        grams ^= grams >> np.uint64(29)
    whole = np.flatnonzero(docs[:n] == docs[SEED_WORDS - 1 :])
    order = whole[np.argsort(grams[whole])]
    same = grams[order[1:]] == grams[order[:-1]]
    out[docs[order[1:][same]]] = True
    return out


def re_pair(symbols: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, np.ndarray]]:
    """Grammar of several documents' symbols (below 2^31, no two documents share one).

    Each round replaces the pairs that are more frequent than their neighbours by nonterminals (of overlapping equal pairs every second
    one), so a document's most frequent pair always goes, until no pair comes twice. Returns, for each round, the
    places (nonterminal, start, boundary, end) of its nonterminals, and starts and documents of the symbols that are left.
    """
    ends, rounds, fresh = at + 1, [], int(symbols.max(initial=0)) + 1
    while len(symbols) > 1:
        keys = (symbols[:-1] << 32) | symbols[1:]
        inside = docs[:-1] == docs[1:]
        names, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((mix(names.astype(np.uint64)), times))
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        rank[times < 2] = -1
        first = np.where(inside, rank[which], -1)
        padded = np.concatenate([[-1], first, [-1]])
        best = np.flatnonzero((first >= 0) & (first >= padded[:-2]) & (first >= padded[2:]))
        if not len(best):
            break
        new = np.diff(best, prepend=-2) != 1
        group = np.maximum.accumulate(np.where(new, np.arange(len(best)), 0))
        best = best[(np.arange(len(best)) - group) % 2 == 0]
        made, inverse = np.unique(which[best], return_inverse=True)
        rounds.append((inverse + fresh, at[best], ends[best], ends[best + 1]))
        symbols[best] = inverse + fresh
        ends[best] = ends[best + 1]
        fresh += len(made)
        keep = np.ones(len(symbols), dtype=bool)
        keep[best + 1] = False
        symbols, docs, at, ends = symbols[keep], docs[keep], at[keep], ends[keep]
    return rounds, (at, docs)


def _squares(ids: np.ndarray, middle: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(boundary number, q, left): two equal stretches of q words end at the boundary (left), or begin there, between low and high.

    q from g to 2g - 1, for each power g of two: the g words at the boundary lie at distance q too. Places of equal g words
    are found in their sorted order, those that stand alone need no longer words; at most `most` candidates are looked at together.
    known: by side and boundary, a period found and how far it reaches; the caller fills it in, and its multiples are passed over.
    """
    n, g, grams = len(ids), 1, mix(ids.astype(np.uint64) + np.uint64(1))
    repeated, live = np.arange(n), [np.arange(len(middle)), np.arange(len(middle))]
    name = np.full(n, -1, dtype=np.int64)
    while len(middle) and len(repeated) and g <= int((high - low).max()) // TIMES:
        order = repeated[np.argsort(grams[repeated], kind="stable")]
        same = grams[order[1:]] == grams[order[:-1]]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order = order[shared]
        name[repeated] = -1
        name[order] = np.cumsum(~np.concatenate([[False], same])[shared])
        repeated = np.sort(order)
        keys = name[order] * (n + 1) + order
        for left in (True, False):
            own = live[left]
            own = own[((middle[own] - low[own] if left else high[own] - middle[own]) >= 2 * g) & (high[own] - low[own] >= TIMES * g)]
            gram = middle[own] - g if left else middle[own]
            live[left] = own = own[name[gram] >= 0]
            gram = middle[own] - g if left else middle[own]
            near, far = (gram - 2 * g + 1, gram - g) if left else (gram + g, gram + 2 * g - 1)
            base = name[gram] * (n + 1)
            a, b = np.searchsorted(keys, base + np.maximum(near, 0)), np.searchsorted(keys, base + np.minimum(far, n - 1), side="right")
            count = np.maximum(b - a, 0)
            has = np.flatnonzero(count)
            own, gram, a, count = own[has], gram[has], a[has], count[has]
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                part = np.repeat(np.arange(x, y), count[x:y])
                within = np.arange(len(part)) - np.repeat(np.cumsum(count[x:y]) - count[x:y], count[x:y])
                q = np.abs(order[a[part] + within] - gram[part])
                k = own[part]
                mid, (period, reach) = middle[k], known[int(left), :, k].T
                fits = ((mid - 2 * q >= low[k]) if left else (mid + 2 * q <= high[k])) & (high[k] - low[k] >= TIMES * q) & ((q % period != 0) | (2 * q > reach))
                q, mid, k = q[fits], mid[fits], k[fits]
                one, two = (mid - 2 * q, mid - q) if left else (mid + q - g, mid + 2 * q - g)
                equal = grams[one] == grams[two]
                yield k[equal], q[equal], left
        grams = _doubled(grams, g)
        g *= 2


def _reach(ids: np.ndarray, x: int, q: int, end: int, step: int) -> int:
    """How many words from x on, in steps of +1 or -1 as far as end, equal those q before (step 1) or after (step -1) them."""
    done, block, room = 0, 32, abs(end - x)
    while done < room:
        size = min(block, room - done)
        low = x + done if step > 0 else x - done - size + 1
        other = low - q if step > 0 else low + q
        differs = ids[low : low + size] != ids[other : other + size]
        if differs.any():
            return done + int(differs.argmax() if step > 0 else differs[::-1].argmax())
        done, block = done + size, block * 4
    return done


def find_runs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, start, length, period) of several documents, one after the other in ids, sorted by document, start and period.

    A run is a stretch of smallest period q and max(6, 4q) words or more that can't be extended. It lies as a whole in the lowest
    nonterminal that covers it, or in the document itself, and crosses that one's boundary (or one between the symbols left).
    So each nonterminal is looked at once, at its first place, and what is found is moved to all its places. Stretches cut off by
    a nonterminal's edge are parts of runs found higher up, and go when stretches of one period are merged.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    used = np.flatnonzero(_comes_again(ids, docs, len(counts)))
    none = np.zeros(0, dtype=np.int64)
    if not len(used):
        return none, none, none, none
    sizes = counts[used]
    taken = np.repeat(np.cumsum(counts)[used] - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.cumsum(sizes + 1) - (sizes + 1)  # one separator, found nowhere else, after each document
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(np.arange(len(used)), sizes)
    text = -1 - np.arange(int((sizes + 1).sum()))
    symbols = np.unique(owner * (int(ids.max()) + 1) + ids[taken], return_inverse=True)[1].astype(np.int64)
    text[at] = symbols
    rounds, (left_at, left_doc) = re_pair(symbols, owner, at.copy())

    names, where, bounds, ends = (np.concatenate(x) for x in zip(*rounds)) if rounds else (none, none, none, none)
    rules, one = np.unique(names, return_index=True)
    inner = np.flatnonzero(left_doc[1:] == left_doc[:-1]) + 1
    middle = np.concatenate([bounds[one], left_at[inner]])
    low = np.concatenate([where[one], starts[left_doc[inner]]])
    high = np.concatenate([ends[one], starts[left_doc[inner]] + sizes[left_doc[inner]]])
    long = np.flatnonzero(high - low >= LEAST)
    middle, low, high = middle[long], low[long], high[long]
    found, known = [], np.zeros((2, 2, len(middle)), dtype=np.int64)
    known[:, 0] = 1
    for k, q, left in _squares(text, middle, low, high, known):
        for j, p in zip(k.tolist(), q.tolist()):
            m, back, on = int(middle[j]), p if left else 0, 0 if left else p
            start = m - back - _reach(text, m - back - 1, p, int(low[j]) - 1, -1)
            end = m + on + _reach(text, m + on, p, int(high[j]), 1)
            known[int(left), :, j] = p, m - start if left else end - m
            if end - start >= max(LEAST, TIMES * p):
                found.append((j, start, end, p))
    if not found:
        return none, none, none, none
    j, start, end, period = np.array(found, dtype=np.int64).T
    rule = long[j]
    inside = rule < len(rules)
    order = np.argsort(names, kind="stable")
    first = np.searchsorted(names[order], rules)
    many = np.append(first[1:], len(names)) - first
    times = many[rule[inside]]
    shift = where[order[np.repeat(first[rule[inside]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]] - np.repeat(low[j[inside]], times)
    start = np.concatenate([np.repeat(start[inside], times) + shift, start[~inside]])
    end = np.concatenate([np.repeat(end[inside], times) + shift, end[~inside]])
    period = np.concatenate([np.repeat(period[inside], times), period[~inside]])

    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    far = len(text) + 1
    base = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * far
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], (start[1:] + base[1:] > reach[:-1] - period[1:])])
    heads = np.flatnonzero(new)
    start, period, end = start[heads], period[heads], np.maximum.reduceat(end, heads)
    order = np.lexsort((period, -end, start))
    keep, over = [], []
    for k, s, e, q in zip(order.tolist(), start[order].tolist(), end[order].tolist(), period[order].tolist()):
        over = [x for x in over if x[0] > s]
        if not any(x[0] >= e and q % x[1] == 0 for x in over):  # else q is a multiple of that stretch's smallest period
            keep.append(k)
            over.append((e, q))
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    doc = np.searchsorted(starts, start, side="right") - 1
    return used[doc], start - starts[doc], end - start, period


def _told(texts: Sequence[bytes | None]) -> tuple[list[int], list[list[dict]], list[bytes]]:
    words = [(t or b"").split() for t in texts]  # bytes are split at the six ASCII white-space characters
    counts = np.array([len(w) for w in words], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    ids, base = [], 0
    for w in words:
        ids.append(np.fromiter(map(numbers.setdefault, w, range(base, base + len(w))), dtype=np.int64, count=len(w)))
        base += len(w)
    runs: list[list[dict]] = [[] for _ in words]
    keep: dict[int, np.ndarray] = {}
    for d, s, length, q in zip(*(x.tolist() for x in find_runs(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), counts))):
        runs[d].append({"start": s, "length": length, "period": q})
        keep.setdefault(d, np.ones(len(words[d]), dtype=bool))[s + q : s + length] = False
    collapsed = [b" ".join([w[i] for i in np.flatnonzero(keep[d]).tolist()] if d in keep else w) for d, w in enumerate(words)]
    return counts.tolist(), runs, collapsed


def periodic_runs(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row per row of docs: the columns named in carry, n_words, runs and collapsed.

    runs: (start, length, period) by start, then period, of all stretches of words with smallest period q and max(6, 4q) words or
    more that no neighbouring word extends; words are runs of characters other than ASCII white space, numbered from 0.
    collapsed: the words by one blank, without those that some run holds after its first q words. A null, empty or blank text has no
    words, no runs and collapses to ''. Rows don't depend on one another: repeated rows give repeated results, an empty table an
    empty one; a text of any length is taken as a whole, in memory in proportion to its length. Carried columns may have any names
    but those of the result (ValueError).
    """
    pack, unpack = carried(carry, RESULT)
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("text"), *pack)
    kind = rows.schema["carried_"].dataType.simpleString() if carry else ""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                n, runs, collapsed = _told(part.column(0).to_pylist())
                made = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*part.schema.names[1:], *RESULT])

    return rows.mapInArrow(told, (f"carried_ {kind}, " if carry else "") + f"n_words long, runs array<{RUN}>, collapsed string").select(*unpack, *RESULT)
