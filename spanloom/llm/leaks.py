"""Passages of held-out test items inside training records, by pigeonhole edit matching.

A passage is at least ``least`` words of an item in one or two stretches, of which at most one in ``per_error`` is altered, dropped or added.
A stretch begins and ends with an equal word. Of two, each keeps to its own share of edits; up to one in ``per_stretch`` is let pass where
as many words that few items have are equal, else chance matches of common words would complete any sentence that many texts share.
Such a passage allows ``budget = least // per_error`` edits and one break, so of ``budget + 2`` pieces one is exact: every run of
``least // (budget + 2)`` item words is a piece, found in the records by its hash and compared word for word. Pairs of a record and an item with
as many piece places as any passage has go on. From each of their exact runs the item is aligned in both directions, for all runs of a batch at
once, which tells how far a stretch reaches with how many edits; that bounds what one or two stretches can be. What may be a passage is verified
by Myers' bit-parallel search for its stretches in the record, with words as symbols. A second stretch without an exact piece is looked for
by runs one word shorter beside a first one that leaves few enough words to it.

The test items are the broadcast side. They go in blocks of at most ``block_words`` words, each a broadcast of its own. A task meets block after
block with a slab of records that it has read and split into words once, so the records are scanned once however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bitmaps import P, chunks
from spanloom.llm.tokens import Shared
from spanloom.llm.wordforms import FORMS

REACH = 34  # words that a stretch is followed to either side of an exact run
BAND = 6  # words that it may shift by
EDITS = 12
PAD = REACH + BAND + 4
FAR = 60  # more edits than can be
SLAB = 4_000_000  # words of records that meet one block of items after another


def myers(pattern: list, text: list, anywhere: bool = False) -> int:
    """Edit distance of two sequences of words, bit-parallel over the pattern; ``anywhere``: of the pattern and the part of the text nearest to it."""
    m = len(pattern)
    if not m:
        return 0 if anywhere else len(text)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, free = m, 0 if anywhere else 1
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best = score
        ph = ph << 1 | free
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best if anywhere else score


def reach(item: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Column a run: how many item words of ``item`` at most can be aligned from its start on with ``0..EDITS`` edits, ending with an equal word.

    ``rec`` has the record's words in the same direction, from ``BAND`` before the start on. Rows are words, so each step is a pass over whole rows.
    """
    n, width = item.shape[1], 2 * BAND + 1
    d = np.full((width + 1, n), FAR, dtype=np.int8)  # edits by how many record words more than item words are used; the last row stays far
    d[BAND:width] = np.arange(BAND + 1, dtype=np.int8)[:, None]
    out = np.zeros((EDITS + 1, n), dtype=np.int16)
    for k in range(item.shape[0]):
        other = rec[k : k + width] != item[k]
        ended = (d[:-1] + other * np.int8(FAR)).min(axis=0)
        new = np.minimum(d[:-1] + other, d[1:] + np.int8(1))
        for gap in (1, 2, 4, 8):  # record words that the item lacks
            if gap < width:
                np.minimum(new[gap:], new[:-gap] + np.int8(gap), out=new[gap:])
        d[:-1] = np.minimum(new, FAR)
        hit = np.flatnonzero(ended <= EDITS)
        out[ended[hit], hit] = k + 1  # the farthest comes last
    return np.maximum.accumulate(out, axis=0)


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two tables of words by edits, the most words of both by edits of both."""
    out = np.zeros_like(a)
    for e in range(len(a)):
        np.maximum(out[e:], a[e] + b[: len(a) - e], out=out[e:])
    return out


class Items:
    """An index of the items' pieces, built once in each worker."""

    def __init__(self, items: list[tuple[str, str]], least: int, per_error: int, per_stretch: int = 3):
        self.least, self.per_error, self.per_stretch = least, per_error, per_stretch
        self.piece = least // (least // per_error + 2)
        # places of pieces that any passage has, whatever its size: its words lie in at most edits + 2 exact runs
        self.least_pieces = max(1, min(n - self.few(n) - (self.piece - 1) * (self.few(n) + 2) for n in range(least, 4 * least)))
        self.names = [n for n, _ in items]
        words = [FORMS.words(t) for _, t in items]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.words = [[self.ids[w] for w in ws] for ws in words]
        items_of = np.bincount([w for ws in self.words for w in set(ws)], minlength=len(self.ids) + 1)
        self.rare = items_of <= max(3, len(items) // 100)
        flat, starts = [-1] * PAD, []  # -1 equals no word of a record
        for ws in self.words:
            starts.append(len(flat))
            flat += ws + [-1] * PAD
        self.flat, self.starts = np.array(flat, dtype=np.int32), np.array(starts, dtype=np.int64)
        self.ends = self.starts + np.array([len(w) for w in self.words], dtype=np.int64)
        places = [np.arange(s, max(s, e - self.piece + 1)) for s, e in zip(starts, self.ends.tolist())]
        at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(starts)), [len(x) for x in places])
        h = self.hash(self.flat)[at]
        order = np.argsort(h, kind="stable")
        self.at, self.owner, h = at[order], owner[order], h[order]
        self.keys, self.first = np.unique(h, return_index=True)
        self.last = np.append(self.first[1:], len(h))

    def few(self, size: int) -> int:
        """About one in ``per_error``: the allowance is rounded to the nearest whole number."""
        return int(size / self.per_error + 0.5)

    def fits(self, item: list[int], text: list[int], edits: int) -> bool:
        """Whether one of two stretches, given as words of item and record, has few enough edits for itself, or is borne out by rare words."""
        more = edits - self.few(len(item))
        return more <= 0 or (edits * self.per_stretch <= len(item) and len({w for w in item if self.rare[w]}.intersection(text)) > more)

    def hash(self, x: np.ndarray) -> np.ndarray:
        """Hash of the piece that starts at each place (the last few are of no use)."""
        u = x.astype(np.uint64)
        out = np.zeros(len(u), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.piece):
                out[: len(u) - k] = out[: len(u) - k] * P + u[k:] + np.uint64(1)
        return out

    def pairs(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """``(text number, item number)`` of every text that holds a passage of an item."""
        return self.held([FORMS.words(t) for t in texts])

    def held(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """The same of texts given in words."""
        get = self.ids.get
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = PAD + np.cumsum(sizes + PAD) - sizes - PAD
        rec = np.zeros(int(sizes.sum()) + PAD * (len(texts) + 1), dtype=np.int32)  # 0 is a word of no item
        numbers = np.fromiter((get(w, 0) for w in chain.from_iterable(texts)), dtype=np.int32, count=int(sizes.sum()))
        rec[np.arange(len(numbers)) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)] = numbers
        known = rec > 0
        whole = known.copy()
        for k in range(1, self.piece):
            whole[:-k] &= known[k:]
            whole[-k:] = False
        q = np.flatnonzero(whole)
        if not len(q) or not len(self.keys):
            return []
        h = self.hash(rec)[q]
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[i] == h
        q, i = q[hit], i[hit]
        n = self.last[i] - self.first[i]
        q = np.repeat(q, n)
        at = np.repeat(self.first[i], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        p, owner = self.at[at], self.owner[at]
        same = np.ones(len(q), dtype=bool)
        for k in range(self.piece):
            same &= self.flat[p + k] == rec[q + k]
        q, p, owner = q[same], p[same], owner[same]
        # pairs with as many item places in exact pieces as any passage has; a place of all items tells the item
        pair = (np.searchsorted(begins, q, "right") - 1) * len(self.starts) + owner
        order = np.lexsort((q, p, pair))
        q, p, pair = q[order], p[order], pair[order]
        fresh = np.ones(len(q), dtype=bool)
        fresh[1:] = (p[1:] != p[:-1]) | (pair[1:] != pair[:-1])
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        enough = np.add.reduceat(fresh, head) >= self.least_pieces if len(head) else np.zeros(0, bool)
        keep = np.repeat(enough, np.diff(np.append(head, len(q))))
        q, p, pair = q[keep], p[keep], pair[keep]
        if not len(q):
            return []
        # neighbours in (diagonal, place) are one exact run
        order = np.lexsort((q, q - p, pair))
        q, p, pair = q[order], p[order], pair[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1] + 1) | (p[1:] != p[:-1] + 1) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(q))) + self.piece - 1
        runs = self.followed(rec, q[first], p[first], size, pair[first])
        found = self.single(runs) | self.double(runs)
        short = self.lone(rec, begins, sizes, runs, found)
        out = []
        for x in sorted(found | short.keys()):
            d, o = divmod(x, len(self.starts))
            own = short[x] if x in short else {k: v[..., runs["pair"] == x] for k, v in runs.items()}
            own |= {"p": own["p"] - self.starts[o], "q": own["q"] - begins[d]}
            if self.verified(self.words[o], rec[begins[d] : begins[d] + sizes[d]].tolist(), own):
                out.append((d, o))
        return out

    def followed(self, rec: np.ndarray, q: np.ndarray, p: np.ndarray, size: np.ndarray, pair: np.ndarray) -> dict[str, np.ndarray]:
        """Exact runs by pair and item place, with how far they reach to the left and right by edits."""
        order = np.lexsort((q, p, pair))
        q, p, size, pair = q[order], p[order], size[order], pair[order]
        k, wide = np.arange(REACH), np.arange(-BAND, REACH + BAND)
        end = p + size
        ahead = reach(self.flat[end + k[:, None]], rec[q + size + wide[:, None]])
        behind = reach(self.flat[p - 1 - k[:, None]], rec[q - 1 - wide[:, None]])
        return {"q": q, "p": p, "n": size, "pair": pair, "ahead": ahead, "behind": behind, "words": sums(ahead, behind) + size.astype(np.int16)}

    def asked(self, less: int = 0) -> np.ndarray:
        """Words of a passage by edits, but for ``less``."""
        e = np.arange(EDITS + 1)
        return np.maximum(self.least - less, self.per_error * e - self.per_error // 2 - less)[:, None]

    def single(self, runs: dict[str, np.ndarray]) -> set[int]:
        return set(runs["pair"][(runs["words"] >= self.asked()).any(axis=0)].tolist())

    def double(self, runs: dict[str, np.ndarray]) -> set[int]:
        """Pairs in which two runs of the same order in both may make a passage: between the runs no more words are used than there are."""
        q, p, n, pair, words, out = runs["q"], runs["p"], runs["n"], runs["pair"], runs["words"], set()
        e = np.arange(EDITS + 1)[:, None]
        for step in range(1, len(q)):
            a = np.flatnonzero(pair[step:] == pair[:-step])
            if not len(a):
                break
            b = a + step
            ok = (p[b] >= p[a] + n[a]) & (q[b] >= q[a] + n[a]) & (words[-1, a] + words[-1, b] >= self.least)
            a, b = a[ok], b[ok]
            ok = (sums(words[:, a], words[:, b]) >= self.asked()).any(axis=0)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            room = np.minimum(p[b] - p[a] - n[a], q[b] - q[a] - n[a] + e).astype(np.int16)
            between = np.minimum(sums(self.fair(runs, "ahead", a), self.fair(runs, "behind", b)), room)
            whole = sums(sums(self.fair(runs, "behind", a), self.fair(runs, "ahead", b)), between) + (n[a] + n[b]).astype(np.int16)
            out.update(pair[a[(whole >= self.asked()).any(axis=0)]].tolist())
        return out

    def fair(self, runs: dict[str, np.ndarray], side: str, at: np.ndarray) -> np.ndarray:
        """How far runs reach to a side with no more edits than one in ``per_stretch`` of the words, those of the run included."""
        x = runs[side][:, at]
        return np.maximum.accumulate(np.where(x + runs["n"][at] >= self.per_stretch * np.arange(EDITS + 1)[:, None], x, 0), axis=0).astype(np.int16)

    def lone(self, rec: np.ndarray, begins: np.ndarray, sizes: np.ndarray, runs: dict[str, np.ndarray], found: set[int]) -> dict[int, dict[str, np.ndarray]]:
        """The runs of pairs with a stretch that leaves at most ``3 * piece - 1`` words to a second one that has no exact piece: that has runs one word shorter."""
        rest = 3 * self.piece - 1
        strong = ((runs["words"] >= self.asked(rest)) & (np.arange(EDITS + 1) <= self.few(self.least))[:, None]).any(axis=0)
        strong &= ~np.isin(runs["pair"], list(found))
        short, at = self.piece - 1, []
        for x in np.unique(runs["pair"][strong]).tolist():
            d, o = divmod(x, len(self.starts))
            item, text = self.flat[self.starts[o] : self.ends[o]], rec[begins[d] : begins[d] + sizes[d]]
            equal = item[:, None] == text
            run = equal[: len(item) - short + 1, : len(text) - short + 1]
            for k in range(1, short):
                run = run & equal[k : len(item) - short + 1 + k, k : len(text) - short + 1 + k]
            i, j = np.nonzero(run)
            at.append((i + self.starts[o], j + begins[d], np.full(len(i), x)))
        if not at:
            return {}
        p, q, pair = (np.concatenate(c) for c in zip(*at))
        other = self.followed(rec, q, p, np.full(len(p), short), pair)
        both = {k: np.concatenate([v[..., strong], other[k]], axis=-1) for k, v in runs.items()}
        order = np.lexsort((both["q"], both["p"], both["pair"]))
        both = {k: v[..., order] for k, v in both.items()}
        return {x: {k: v[..., both["pair"] == x] for k, v in both.items()} for x in self.double(both)}

    def verified(self, item: list[int], text: list[int], own: dict[str, np.ndarray]) -> bool:
        """Whether Myers' search finds in the text what the runs of a pair tell: one stretch, or two in order, with few enough edits."""
        stretches = []
        for p, q, n, back, on in zip(own["p"].tolist(), own["q"].tolist(), own["n"].tolist(), own["behind"].T.tolist(), own["ahead"].T.tolist()):
            for x in sorted(set(back)):
                for y in sorted(set(on)):
                    stretches.append((p - x, p + n + y, q - x - back.index(x), q + n + y + on.index(y), back.index(x) + on.index(y)))
        stretches.sort(key=lambda s: (s[4] * self.per_error - (s[1] - s[0]), s))
        for a, b, c, d, e in stretches:
            if b - a >= self.least and e <= self.few(b - a) and myers(item[a:b], text[max(c, 0) : d], True) <= self.few(b - a):
                return True
        fair = [s for s in dict.fromkeys(stretches) if self.fits(item[s[0] : s[1]], text[max(s[2], 0) : s[3]], s[4])]
        if not fair:
            return False
        i, j, q, r, e = np.array(fair).T
        size, edits = (j - i)[:, None] + (j - i), e[:, None] + e
        ok = (j[:, None] <= i) & ((r - e)[:, None] <= q + e) & (size >= self.least) & (edits <= np.floor(size / self.per_error + 0.5))
        x, y = np.nonzero(ok)
        best = np.argsort(edits[x, y] * self.per_error - size[x, y], kind="stable")
        for first, second in zip(x[best].tolist(), y[best].tolist()):
            (a, b, c, d, n), (a2, b2, c2, d2, _) = fair[first], fair[second]
            middle = max(d - n, min(d, c2))  # they part in the record where the second begins
            if myers(item[a:b], text[max(c, 0) : middle], True) + myers(item[a2:b2], text[middle:d2], True) <= self.few(b - a + b2 - a2):
                return True
        return False


_ITEMS: dict[int, Items] = {}


def leaks(records: DataFrame, items: DataFrame, key: str = "id", item_key: str = "case_id", text: str = "text", least: int = 30, per_error: int = 6, block_words: int = 200_000) -> DataFrame:
    """``(item_key, key)``, distinct, of every record that holds a passage of an item. Null keys and texts take no part."""
    spark = records.sparkSession
    it = items.select(F.col(item_key).cast("string"), text).where(F.col(item_key).isNotNull() & F.col(text).isNotNull())
    size = it.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    # the driver holds one block at a time, about block_words words
    shared = [Shared(spark, [tuple(r) for r in it.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k).collect()]) for k in range(blocks)]

    def index_of(block: Shared) -> Items:
        if block.id not in _ITEMS:
            _ITEMS.clear()
            _ITEMS[block.id] = Items(block.value, least, per_error)
        return _ITEMS[block.id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: list[tuple[pa.Array, list[list[str]]]] = []
        held = 0

        def met() -> Iterator[pa.RecordBatch]:
            for block in shared:
                index = index_of(block)
                for ids, words in slab:
                    pairs = index.held(words)
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([index.names[o] for _, o in pairs]), ids.take(pa.array([d for d, _ in pairs]))], names=[item_key, key])

        for part in chunks(batches):
            slab.append((part.column(0), [FORMS.words(t) for t in part.column(1).to_pylist()]))
            held += sum(map(len, slab[-1][1]))
            if blocks == 1 or held >= SLAB:
                yield from met()
                slab.clear()
                held = 0
        yield from met()

    kind = records.schema[key].dataType.simpleString()
    found = records.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"`{item_key}` string, `{key}` {kind}")
    return found.distinct()
