"""Benchmark passages in documents: q-grams counted in diagonal bands, then banded alignment."""

from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow, slices
from demandcast.session import materialize

#: Characters of a gram; of one for items so short that an edit too many would spoil all the longer ones.
Q, SHORT_Q = 8, 4
#: Text that is looked at together; expanded hits that are counted together; cells of one row of an alignment.
SLICE, HITS, CELLS = 2_000_000, 4_000_000, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
FAR = 1 << 28
NOTHING = np.uint32(0xFFFFFFFF)
#: A-Z to a-z, ASCII white space to a space.
FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with one space for a run of white space, and the place of each in `text`.

    A letter whose lower case is longer than one character stays as it is.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0)
    codes[space] = 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.flatnonzero(keep)
    return codes[place], place


def folded(text: str) -> np.ndarray:
    """The code points that normal() gives, without their places."""
    if not text.isascii():
        return normal(text)[0]
    codes = np.frombuffer(text.encode().translate(FOLD), dtype=np.uint8)
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    return codes[keep].astype(np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A key of every window of q (8 or 4) code points; equal windows have equal keys.

    A code point counts as one byte of it, so unequal windows may share a key.
    That only lets more regions through to the alignment.
    """
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    one = (codes ^ (codes >> np.uint32(8))).astype(np.uint8)
    return np.ndarray((len(one) - q + 1,), f"<u{q}", one, strides=(1,)).astype(np.uint64)


@dataclass
class Items:
    """A block of benchmark items, prepared for the search. Sorted keys lead to (item, place) lists."""

    ids: list[int]
    codes: list[np.ndarray]
    rate: float
    q: int = Q

    def __post_init__(self):
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        #: Edits that an item may have: so many that the lemma still asks for one shared q-gram.
        self.edits = np.minimum((size * self.rate).astype(np.int64), (size - self.q) // self.q)
        #: The q-gram lemma: an occurrence with k edits shares at least this many.
        self.least = size - self.q + 1 - self.edits * self.q
        self.width = self.edits + 1
        self.lengths = size
        keys = [grams(c, self.q) for c in self.codes]
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, int)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bits = np.uint64(max(20, int(np.ceil(np.log2(len(flat) * 32 + 1)))))
        self.sieve = np.zeros(1 << int(self.bits), dtype=bool)
        self.sieve[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> (np.uint64(64) - self.bits)


def bands(items: Items, codes: np.ndarray) -> list[tuple[int, int]]:
    """(item, lowest diagonal) of the bands in `codes` that share enough q-grams with an item.

    A diagonal is a place in the text less the place in the item. Band b of an item
    covers width + edits diagonals from b * width on, so neighbours overlap by the
    edits and every occurrence lies inside one band.
    """
    if len(codes) < items.q or not len(items.keys):
        return []
    keys = grams(codes, items.q)
    at = np.flatnonzero(items.sieve[items._slot(keys)])
    found = np.searchsorted(items.keys, keys[at])
    found = np.minimum(found, len(items.keys) - 1)
    same = items.keys[found] == keys[at]
    at, found = at[same], found[same]
    if not len(at):
        return []
    number = items.count[found]
    ends = np.cumsum(number)
    cuts = [0, *np.searchsorted(ends, np.arange(HITS, ends[-1], HITS)).tolist(), len(at)]
    groups: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    span = np.int64(len(codes) + max(map(len, items.codes)) + 1)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        n = number[a:b]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(items.first[found[a:b]], n) + inner
        item = items.item[entry]
        diagonal = np.repeat(at[a:b], n) - items.place[entry]
        width, edits = items.width[item], items.edits[item]
        band = diagonal // width
        lower = diagonal - band * width < edits
        item, band = np.concatenate([item, item[lower]]), np.concatenate([band, band[lower] - 1])
        group, count = np.unique(item * (2 * span) + band + span, return_counts=True)
        groups.append(group)
        counts.append(count)
    group, where = np.unique(np.concatenate(groups), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
    item, band = group // (2 * span), group % (2 * span) - span
    enough = total >= items.least[item]
    return list(zip(item[enough].tolist(), (band * items.width[item])[enough].tolist(), strict=True))


@dataclass
class Jobs:
    """Alignments to make, one for each entry: `patterns` against stretches of `codes`.

    The text of an entry is `size` code points from `base` on, backwards where `step`
    is -1; its band has the diagonals from `low` on, `width` of them.
    """

    patterns: list[np.ndarray]
    base: np.ndarray
    size: np.ndarray
    low: np.ndarray
    width: np.ndarray
    most: np.ndarray
    step: int = 1

    def part(self, rows) -> "Jobs":
        columns = (x[rows] for x in (self.base, self.size, self.low, self.width, self.most))
        return Jobs([self.patterns[i] for i in rows.tolist()], *columns, self.step)


def align(jobs: Jobs, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each job (edits, end) of the best occurrence of the pattern in its band.

    Edit distance with free ends in the text, row by row over the pattern; a row has
    the band's diagonals, and bands of like length go down together. Places outside of the text match nothing.
    Where no occurrence can have as few as `most` edits, edits are greater than that.
    """
    n = len(jobs.patterns)
    cost, end = np.full(n, FAR), np.zeros(n, np.int64)
    length = np.array([len(p) for p in jobs.patterns], np.int64)
    order = np.lexsort((jobs.width, length))
    while len(order):
        first = order[0]
        alike = (length[order] <= length[first] * 5 // 4) & (jobs.width[order] <= jobs.width[first] * 3 // 2)
        alike[0] = True
        rows, order = order[alike], order[~alike]
        each = max(1, CELLS // int(length[rows].max() + jobs.width[rows].max()))
        for a in range(0, len(rows), each):
            some = rows[a : a + each]
            cost[some], end[some] = _align(jobs.part(some), length[some], codes)
    return cost, end


def _align(jobs: Jobs, length: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, rows, width = len(length), int(length.max()), int(jobs.width.max())
    cost, end = np.full(n, FAR), np.zeros(n, np.int64)
    place = jobs.low[:, None] + np.arange(rows + width)
    inside = (place >= 0) & (place < jobs.size[:, None])
    text = np.where(inside, codes[np.where(inside, jobs.base[:, None] + jobs.step * place, 0)], NOTHING)
    pattern = np.full((n, rows), NOTHING - np.uint32(1))
    for i, p in enumerate(jobs.patterns):
        pattern[i, : len(p)] = p
    step = np.arange(width, dtype=np.int32)
    at = place[:, :width]
    # The occurrence starts at a text place from 0 to the end.
    row = np.where((at >= 0) & (at <= jobs.size[:, None]) & (step < jobs.width[:, None]), 0, FAR).astype(np.int32)
    # Diagonals that are outside of the band, or past the text after i rows, are far.
    band, past = jobs.width, jobs.size - jobs.low
    left, most = np.arange(n), jobs.most
    for i in range(rows):
        new = row + (text[:, i : i + width] != pattern[:, i, None])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        new -= step
        np.minimum.accumulate(new, axis=1, out=new)
        new += step
        new[step >= np.minimum(band, past - i)[:, None]] = FAR
        row = new
        done = length == i + 1
        stay = ~done & (row.min(axis=1) <= most) if i % 8 == 7 or i + 1 == rows else ~done
        if stay.all():
            continue
        if done.any():
            best = row[done].argmin(axis=1)
            cost[left[done]] = row[done, best]
            end[left[done]] = jobs.low[left[done]] + best + i + 1
        text, pattern, row = text[stay], pattern[stay], row[stay]
        band, past, length, left, most = band[stay], past[stay], length[stay], left[stay], most[stay]
        if not len(left):
            break
    return cost, end


def occurrences(items: Items, codes: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of verified occurrences; overlapping ones of an item count once, the best.

    Text k of `codes` begins at start[k] and one place of no text stands before the
    next. Every text that a band reaches is aligned on its own, so an occurrence lies
    in one text and doesn't depend on the others.
    """
    near = []
    for item, low in bands(items, codes):
        size, edits = len(items.codes[item]), int(items.edits[item])
        low, width = low - edits, int(items.width[item]) + 3 * edits
        first = max(int(np.searchsorted(start, low, "right")) - 1, 0)
        last = int(np.searchsorted(start, low + width + size, "left"))
        for at, after in zip(start[first:last].tolist(), start[first + 1 : last + 1].tolist(), strict=False):
            # What the band sees of the text must be able to hold an occurrence.
            if min(after - 1, low + width + size) - max(at, low) >= size - edits:
                near.append((item, at, after - 1 - at, low - at, width, edits))
    if not near:
        return []
    item, at, size, low, width, edits = np.array(near, np.int64).T
    patterns = [items.codes[i] for i in item.tolist()]
    cost, end = align(Jobs(patterns, at, size, low, width, edits), codes)
    hit = np.flatnonzero(cost <= edits)
    item, at, end, edits, cost = item[hit], at[hit], end[hit], edits[hit], cost[hit]
    backward = [items.codes[i][::-1] for i in item.tolist()]
    back, length = align(Jobs(backward, at + end - 1, end, -edits, 2 * edits + 1, cost, -1), codes)
    begin = np.where(back <= cost, end - length, end - items.lengths[item])
    found = np.stack([item, cost, at + np.maximum(begin, 0), at + end], axis=1)
    kept: list[tuple[int, int, int, int]] = []
    spans: list[tuple[int, int]] = []
    last = None
    for i, c, a, b in sorted(found.tolist()):
        if i != last:
            last, spans = i, []
        # The spans kept of an item are disjoint and in order; only neighbours can overlap.
        k = bisect(spans, (a, b))
        if (k and spans[k - 1][1] > a) or (k < len(spans) and spans[k][0] < b):
            continue
        spans.insert(k, (a, b))
        kept.append((i, a, b, c))
    return kept


def prepared(pairs: list[tuple[int, str]], rate: float) -> list[Items]:
    """The usable items of (id, text) pairs, those that need short grams apart."""
    known = [(i, folded(t.strip())) for i, t in sorted(pairs, key=lambda x: x[0])]
    long = [(i, c) for i, c in known if len(c) >= Q and (len(c) - Q) // Q >= int(len(c) * rate)]
    short = [(i, c) for i, c in known if len(c) >= Q and (len(c) - Q) // Q < int(len(c) * rate)]
    parts = [(long, Q), (short, SHORT_Q)]
    return [Items([i for i, _ in p], [c for _, c in p], rate, q) for p, q in parts if p]


def blocks(benchmark: DataFrame, rate: float, block: int):
    """The items in blocks of about `block` characters, each fetched when it is asked for.

    The number of blocks follows the benchmark's size, so what is sent to the
    tasks at once is bounded; every block is held against all documents. Null
    items and those under Q characters (they would occur everywhere) are left out.
    """
    usable = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, -(-total // block))
    for k in range(number):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).collect()
        yield prepared([(r["item_id"], r["text"]) for r in rows], rate), k == number - 1


def search(texts: list[str], block: list[Items]):
    """For each text its occurrences as (item id, start, end, edits); places are code points of the text."""
    for a, b in slices(texts, SLICE):
        parts = [folded(t) for t in texts[a:b]]
        start = np.cumsum([0] + [len(c) + 1 for c in parts])
        # Texts of a slice are searched together, a zero between them.
        joined = np.zeros(start[-1], dtype=np.uint32)
        for codes, at in zip(parts, start, strict=False):
            joined[at : at + len(codes)] = codes
        out: list[list] = [[] for _ in parts]
        places: dict[int, np.ndarray] = {}
        for items in block:
            for item, first, end, cost in occurrences(items, joined, start):
                if end <= first:
                    continue
                doc = int(np.searchsorted(start, first, "right")) - 1
                if doc not in places:
                    places[doc] = normal(texts[a + doc])[1]
                place = places[doc]
                span = place[first - start[doc]], place[end - 1 - start[doc]] + 1
                out[doc].append((items.ids[item], int(span[0]), int(span[1]), cost))
        yield from out


FOUND = "doc_id bigint, item_id bigint, start int, end int, edits int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, edits): occurrences of benchmark items in whole texts.

    An item occurs if a stretch of the text equals it after at most `rate` times
    its length of edits (single characters, case and runs of white space aside);
    at rates up to 0.125 items of every length from Q characters on may have that many, rounded down.
    Null and empty texts have none; a repeated document or item gives its rows
    again. Empty tables give an empty one. Documents aren't shuffled.

    A benchmark of several blocks is searched one block after the other; each block's
    finds are stored and its broadcast is destroyed before the next is fetched.
    """
    spark, found = docs.sparkSession, None
    for items, last in blocks(benchmark, rate, block):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches, sent=sent):
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = batch.column("doc_id").to_pylist()
                rows = [(i, *x) for i, spans in zip(ids, search(texts, sent.value), strict=True) for x in spans]
                if rows:
                    yield arrow(FOUND, *zip(*rows, strict=True))

        part = docs.select("doc_id", "text").mapInArrow(scan, FOUND)
        if not last:
            part = materialize(part, "leaks")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block: int = 4_000_000) -> DataFrame:
    """The rows of `docs` in whose text no benchmark item occurs, unchanged, as find_leaks() has it.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark keeps all rows. What is left
    after a block is stored before the next one is fetched.
    """
    place, schema = docs.columns.index("text"), docs.schema
    for items, last in blocks(benchmark, rate, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, sent=sent):
            for batch in batches:
                texts = [t or "" for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array([not spans for spans in search(texts, sent.value)], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
        if not last:
            docs = materialize(docs, "without_leaks")
            sent.destroy()
    return docs
