"""Operator 6, benchmark decontamination: CGK embedding, bit sampling, exact edit distance.

Windows have a size in proportion to their class of items, but are parts of an item, one
from each of its words (or characters, in scripts without spaces): a window as long as the
item meets all of its edits, which throw the walks out of step for long (README has the
measured recall of both).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD_BREAKS, in_batches, mix, table

#: Items of one pass over the documents; more items mean more passes, each with an index of this size.
ITEMS = 5000
#: A document holds an item within this share of the item's characters in edits.
EDITS = 0.1
#: Walks; for each walk the first and second halves of its samples. A key is a first half with a second.
WALKS, FIRSTS, SECONDS = 2, 4, 3
#: For each size class the least bytes of its items, the steps of a walk (a window is about half as many characters,
#: two fifths of the shortest item), and the positions of a first and of a second half.
SIZES, STEPS, POSITIONS = (72, 48, 36, 20, 0), (64, 40, 30, 18, 9), ((7, 8), (7, 8), (7, 7), (6, 6), (4, 5))
#: Bytes of a word beyond which windows start at each of its characters.
LONG = 48
#: A key that more windows of items have is a shared one, whose items are measured as a set.
SHARED = 8
#: Characters whose places in a set of items are remembered at a time.
CHARACTERS = 256
#: Windows that walk at once: few enough for their state to stay in the processor's cache.
WINDOWS = 1 << 14

_RNG = np.random.RandomState(20240611)
#: For each walk and byte 64 random bits: one for each step says whether the walk moves on, all together stand for the byte in a key.
_BITS = _RNG.randint(0, 1 << 32, (WALKS, 256), np.uint64) << np.uint64(32) | _RNG.randint(0, 1 << 32, (WALKS, 256), np.uint64)
#: For each size class and walk the steps of each half: those that a sample of the whole walk falls on.
_TAKES = [[[np.sort(_RNG.choice(steps, min(n, steps), replace=False)) for n in [a] * FIRSTS + [b] * SECONDS] for _ in range(WALKS)] for steps, (a, b) in zip(STEPS, POSITIONS, strict=True)]


def normal(text: str | None) -> bytes:
    """A-Z lower-cased, white space as single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def size_class(n: int) -> int:
    """The class of an item of n bytes."""
    return next(k for k, least in enumerate(SIZES) if n >= least)


def embed(buffer: np.ndarray, at: np.ndarray, classes: list[int]) -> Iterator[tuple[int, slice, np.ndarray]]:
    """The bit-sampling keys of the windows that start at the given bytes: (class, windows, keys), a row of keys a sample.

    A walk of the CGK embedding stands on a byte, writes it and, by a random bit that the
    step and the byte select, stays or moves on. Strings at a small edit distance soon
    walk in step again, so few written bytes differ: edit distance becomes Hamming
    distance, and a few written bytes chosen at random agree with good chance. All
    windows walk at once, and all classes share a walk: shorter windows are its first
    steps. The buffer must end with enough zeros.
    """
    steps = max(STEPS[k] for k in classes)
    written = [bits[buffer] for bits in _BITS]
    for begin in range(0, len(at), WINDOWS):
        part = slice(begin, min(begin + WINDOWS, len(at)))
        n = part.stop - begin
        keys = {k: np.empty((WALKS * FIRSTS * SECONDS, n), np.uint64) for k in classes}
        pos, c = np.empty(n, np.int64), np.empty(n, np.uint64)
        for w in range(WALKS):
            asked: dict[int, list[np.ndarray]] = defaultdict(list)
            halves = {k: np.ones((FIRSTS + SECONDS, n), np.uint64) for k in classes}
            for k in classes:
                for h, taken in enumerate(_TAKES[k][w]):
                    for j in taken:
                        asked[int(j)].append(halves[k][h])
            pos[:] = at[part]
            for j in range(steps):
                written[w].take(pos, out=c, mode="clip")
                for half in asked.get(j, ()):
                    half *= np.uint64(0x9E3779B97F4A7C15)
                    half += c
                c >>= np.uint64(j % 64)
                c &= np.uint64(1)
                pos += c.view(np.int64)
            for k in classes:
                for a in range(FIRSTS):
                    first = mix(halves[k][a] + np.uint64(1 + w * FIRSTS + a))
                    for b in range(SECONDS):
                        np.add(first, halves[k][FIRSTS + b] * np.uint64(2 * b + 3), out=keys[k][(w * FIRSTS + a) * SECONDS + b])
        for k in classes:
            yield k, part, keys[k]


def distance(item: str, text: str) -> int:
    """The least edit distance of the item to any stretch of the text (Myers' bit vectors)."""
    m = len(item)
    if item in text:
        return 0
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, score)
    return best


#: Bits of a key that the first look goes by: a small table that stays in the processor's cache.
LOOK = 22


def _look(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - LOOK)).view(np.int64)


#: Kinds of bytes: white space, letters and digits and first bytes of others, ASCII punctuation, later bytes of a character.
_KIND = np.full(256, 2, np.uint8)
_KIND[[ord(c) for c in WORD_BREAKS]] = 0
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0xC0, 256)]] = 1
_KIND[0x80:0xC0] = 3
#: Whether a window starts at a byte, by four times the kind before it and its own.
_STARTS = np.zeros(16, bool)
_STARTS[[1, 2, 3, 9]] = True


def starts(data: bytes) -> np.ndarray:
    """Where windows start in a text: at each word, behind punctuation, at and behind each
    character of three bytes or more (scripts without spaces are such), and at every
    character of a word longer than ``LONG``.

    All but the last look at no more than two neighbouring characters, so an item that
    begins at a start of a document has its starts there, too.
    """
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    kind = _KIND[b]
    pair = kind.copy()
    pair[1:] += kind[:-1] << 2
    out = _STARTS[pair]
    wide = b >= 0xE0
    if wide.any():
        lead = np.flatnonzero(wide)
        out[lead] = True
        behind = lead + np.where(b[lead] < 0xF0, 3, 4)
        behind = behind[behind < len(b)]
        out[behind] |= (kind[behind] == 1) | (kind[behind] == 2)
    breaks = np.concatenate(([-1], np.flatnonzero(kind == 0), [len(b)]))
    for k in np.flatnonzero(np.diff(breaks) > LONG + 1).tolist():
        s, e = breaks[k] + 1, breaks[k + 1]
        out[s:e] |= kind[s:e] != 3
    return np.flatnonzero(out)


class Batch:
    """Edit distances of many items to one stretch at a time: Myers' bit vectors in blocks of 64 characters, all items side by side."""

    def __init__(self, items: list[str]):
        self.groups = []
        by: dict[int, list[int]] = defaultdict(list)
        for n, t in enumerate(items):
            by[-(-len(t) // 64)].append(n)
        for words, own in by.items():
            codes = np.zeros((len(own), 64 * words), np.uint32)
            for r, n in enumerate(own):
                codes[r, : len(items[n])] = np.frombuffer(items[n].encode("utf-32-le"), np.uint32)
            sizes = np.array([len(items[n]) for n in own])
            self.groups.append((np.array(own), sizes, words, codes, {}))
        self.count = len(items)

    def distances(self, text: str) -> np.ndarray:
        """The least distance of each item to any stretch of the text."""
        out = np.zeros(self.count, np.int64)
        for own, sizes, words, codes, known in self.groups:
            pv = [np.full(len(own), ~np.uint64(0)) for _ in range(words)]
            mv = [np.zeros(len(own), np.uint64) for _ in range(words)]
            last = np.uint64(1) << ((sizes - 1) % 64).astype(np.uint64)
            score, best = sizes.copy(), sizes.copy()
            one, top = np.uint64(1), np.uint64(1) << np.uint64(63)
            for c in text:
                if c not in known:
                    if len(known) >= CHARACTERS:
                        known.clear()
                    bits = np.packbits(codes == ord(c), axis=1, bitorder="little").view("<u8")
                    known[c] = [np.ascontiguousarray(bits[:, w]) for w in range(words)]
                up, down = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)  # the step from the block before
                for w in range(words):
                    eq, p, m = known[c][w], pv[w], mv[w]
                    xv = eq | m
                    eq = eq | down
                    xh = (((eq & p) + p) ^ p) | eq
                    ph, mh = m | ~(xh | p), p & xh
                    end = last if w == words - 1 else top
                    rise, fall = (ph & end) != 0, (mh & end) != 0
                    ph, mh = (ph << one) | up, (mh << one) | down
                    pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                    up, down = rise.astype(np.uint64), fall.astype(np.uint64)
                score += rise
                score -= fall
                np.minimum(best, score, out=best)
            out[own] = best
        return out


class Index:
    """The items' windows by key; a bounded number of items, made on the driver.

    A key that more than ``SHARED`` windows have comes from what items share, as a common
    template. Such keys are kept apart, with whole sets of items for each key: a text that
    holds what they share is measured against a set at once, equal stretches of it once.
    No key is dropped: a copy may have its edits where its item differs from the others.
    """

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.edits = edits
        self.items = [(i, normal(t)) for i, t in items]
        self.items = [(i, b) for i, b in self.items if b]
        self.texts = [b.decode("utf-8", "ignore") for _, b in self.items]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.shared: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        self.sets: list[np.ndarray] = []
        self._number: dict[bytes, int] = {}
        self._batches: dict[int, Batch] = {}
        by: dict[int, list[int]] = defaultdict(list)
        for n, (_, b) in enumerate(self.items):
            by[size_class(len(b))].append(n)
        pad = bytes(STEPS[0] + 1)
        for k, own in by.items():
            who, where, at, base = [], [], [], 0
            for n in own:
                b = self.items[n][1]
                start = starts(b)
                start = start[(start + STEPS[k] // 2 <= len(b)) | (start == start[0])]
                who.append(np.full(len(start), n))
                where.append(start)
                at.append(start + base)
                base += len(b) + len(pad)
            buffer = np.frombuffer(pad.join(self.items[n][1] for n in own) + pad, np.uint8)
            who, where = np.concatenate(who), np.concatenate(where)
            found = [(keys, part) for _, part, keys in embed(buffer, np.concatenate(at), [k])]
            keys = np.concatenate([x.ravel() for x, _ in found])
            window = np.concatenate([np.tile(np.arange(len(who))[part], len(x)) for x, part in found])
            order = np.argsort(keys, kind="stable")
            keys, window = keys[order], window[order]
            values, first, count = np.unique(keys, return_index=True, return_counts=True)
            common = np.repeat(count > SHARED, count)
            seen = np.zeros(1 << LOOK, bool)
            seen[_look(values)] = True
            self.tables[k] = (keys[~common], who[window[~common]], where[window[~common]], seen)
            hot = count > SHARED
            self.shared[k] = (values[hot], [self._groups(who[window[s : s + n]], where[window[s : s + n]]) for s, n in zip(first[hot], count[hot], strict=True)])

    def _groups(self, who: np.ndarray, where: np.ndarray) -> list[tuple[int, int]]:
        """(place in the item, number of the set of items that have it there) of a shared key's windows."""
        out = []
        for place in np.unique(where).tolist():
            items = np.unique(who[where == place])
            number = self._number.setdefault(items.tobytes(), len(self.sets))
            if number == len(self.sets):
                self.sets.append(items)
            out.append((place, number))
        return out

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the (item, edit distance, item's length) of the items that it holds."""
        parts = [normal(t) for t in texts]
        pad = bytes(STEPS[0] + 1)
        buffer = np.frombuffer(pad.join(parts) + pad, np.uint8)
        base = np.concatenate(([0], np.cumsum([len(p) + len(pad) for p in parts])[:-1])).astype(np.int64)
        # the same starts as in the items: a verbatim copy always has all windows of its item
        at = np.concatenate([*(starts(p) + b0 for p, b0 in zip(parts, base, strict=True)), np.zeros(0, np.int64)])
        hits: dict[tuple[int, int], set[int]] = defaultdict(set)
        common: dict[int, list[np.ndarray]] = defaultdict(list)
        for k, part, found in embed(buffer, at, sorted(self.tables)) if self.tables else ():
            keys, who, where, seen = self.tables[k]
            sample, window = np.nonzero(seen[_look(found)])
            x = found[sample, window]
            if len(keys):
                lo = np.searchsorted(keys, x)
                real = keys[np.minimum(lo, len(keys) - 1)] == x
                low, a = lo[real], at[part][window[real]]
                n = np.searchsorted(keys, x[real], "right") - low
                a, q = np.repeat(a, n), np.repeat(low + n - np.cumsum(n), n) + np.arange(n.sum())
                d = np.searchsorted(base, a, "right") - 1
                # where the item would begin, to 32 bytes
                got = np.unique(np.stack([d, who[q], (a - base[d] - where[q] + 16) // 32]), axis=1)
                for doc, item, begin in zip(*got.tolist(), strict=True):
                    hits[doc, item].add(begin)
            values, groups = self.shared[k]
            if len(values):
                g = np.minimum(np.searchsorted(values, x), len(values) - 1)
                real = values[g] == x
                order = np.argsort(g[real], kind="stable")
                g, a = g[real][order], at[part][window[real][order]]
                d = np.searchsorted(base, a, "right") - 1
                spots = (d << 40) + (1 << 32) + a - base[d]
                each, first = np.unique(g, return_index=True)
                for e, here in zip(each.tolist(), np.split(spots, first[1:])):
                    for place, number in groups[e]:
                        common[number].append(np.unique(here - place))
        best: dict[tuple[int, int], int] = {}
        for (d, n), begins in sorted(hits.items()):
            x = self._nearest(n, parts[d], sorted(begins))
            if x is not None:
                best[d, n] = x
        for number, begins in common.items():
            for d, n, x in self._measured(number, parts, np.unique(np.concatenate(begins))):
                best[d, n] = min(x, best.get((d, n), x))
        out: list[list] = [[] for _ in texts]
        for (d, n), x in sorted(best.items()):
            out[d].append((self.items[n][0], x, len(self.texts[n])))
        return out

    def _measured(self, number: int, parts: list[bytes], begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance) of a set's items that are near enough to what stands at the given places of the texts."""
        items = self.sets[number]
        limit = np.array([int(self.edits * len(self.texts[n])) for n in items])
        size = max(len(self.items[n][1]) for n in items)
        held: dict[bytes, set[int]] = defaultdict(set)
        d, rel = begins >> 40, (begins & ((1 << 40) - 1)) - (1 << 32)
        at = 0
        while at < len(d):
            text = parts[d[at]]
            if not at or d[at] != d[at - 1]:
                slack = int(limit.max()) * (1 if text.isascii() else 4)
            to = at + 1  # places that an edit or two have moved are one
            while to < len(d) and d[to] == d[at] and rel[to] - rel[at] <= slack:
                to += 1
            lo, hi = max(0, int(rel[at]) - slack), max(0, int(rel[to - 1]) + size + slack)
            held[text[lo:hi]].add(int(d[at]))
            at = to
        if number not in self._batches:
            self._batches[number] = Batch([self.texts[n] for n in items])
        for stretch, docs in held.items():
            x = self._batches[number].distances(stretch.decode("utf-8", "ignore"))
            for j in np.flatnonzero(x <= limit).tolist():
                yield from ((doc, int(items[j]), int(x[j])) for doc in docs)

    def _nearest(self, n: int, text: bytes, begins: list[int]) -> int | None:
        """The item's least distance to the text about the given places, if it is near enough."""
        item, size = self.texts[n], len(self.items[n][1])
        most = int(self.edits * len(item))
        # a place is known to 16 bytes; each edit before it may shift it by a character
        slack = 32 + (most if text.isascii() else 4 * most)
        stretches: list[list[int]] = []
        for x in begins:
            lo, hi = max(0, 32 * x - slack), 32 * x + size + slack
            if stretches and lo <= stretches[-1][1] and hi - stretches[-1][0] <= 4 * (size + 2 * slack):
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
        best = most + 1
        for stretch in dict.fromkeys(text[lo:hi] for lo, hi in stretches):  # a text may repeat itself
            best = min(best, distance(item, stretch.decode("utf-8", "ignore")))
            if best == 0:
                break
        return best if best <= most else None


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``size``, so that no table of any size reaches the driver at once."""
    n = -(-items.count() // size)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)) == k)
        yield [tuple(r) for r in part.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).collect()]


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about a MB of text each: a search takes some thirty times as much."""
    texts = b.column(column).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > 1 << 20 or i + 1 == len(texts):
            yield b.slice(at, i + 1 - at), texts[at : i + 1]
            at, size = i + 1, 0


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars) of the items that documents hold.

    Texts are compared with A-Z lower-cased and white space as single spaces. An item is
    held if its edit distance to some stretch of the document is at most ``edits`` of
    its characters; the distance is exact for every candidate, and candidates are found
    with the chance that the tests measure, where the item begins at a start of the document
    (see ``starts``): not inside a word of up to ``LONG`` bytes. Null and empty documents hold nothing; null
    and empty items are held by nothing. Rows that share an id are searched each; items
    that share an id are searched each, too. Empty tables give an empty result.

    Documents are read once for each block of items and never shuffled. The index of a
    block is broadcast: its size is bounded by the block's.
    """
    spark, rows = docs.sparkSession, None
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(doc_text).cast("string").alias("t"))
    schema = "doc_id long, item_id long, distance int, item_chars int"
    for part in blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(Index(part, edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece, texts in _chunks(b, 1):
                    got = [(d, *x) for d, xs in zip(piece.column(0).to_pylist(), index.value.search(texts), strict=True) for x in xs]
                    cols = list(zip(*got, strict=True)) or [()] * 4
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "item_chars"])

        found = source.transform(in_batches, run, schema)
        rows = found if rows is None else rows.unionByName(found)
    return rows if rows is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    at = docs.columns.index(doc_text)
    for part in blocks(items, item_id, item_text):
        index = docs.sparkSession.sparkContext.broadcast(Index(part, edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece, texts in _chunks(b, at):
                    yield piece.filter(pa.array([not x for x in index.value.search(texts)], pa.bool_()))

        docs = docs.transform(in_batches, run, docs.schema)
    return docs


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
