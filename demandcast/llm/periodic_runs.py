"""Maximal periodic runs of words: tiles by period octave, Z-functions at boundaries, fragments stitched by period.

A run is a stretch of words with smallest period q (words q apart are equal) that no
neighbouring word extends, of at least LEAST words and ROUNDS periods.
"""

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.tokens import array_slices
from demandcast.session import materialize, scratch

LEAST, ROUNDS = 24, 3
#: Words of a gram; periods of the lowest octave end before BASE.
GRAM, BASE = 8, 16
#: Words that boundaries of one tile span, at least.
CORE = 512
_MIX = np.random.default_rng(12).integers(0, 1 << 63, GRAM + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

TILE = "node binary, octave int, boundary bigint, boundaries int, start bigint, codes binary"
LOOKED = f"doc_id bigint, text string, {TILE}"
FRAGMENTS = "node binary, period bigint, start bigint, end bigint"
OUT = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed_text string"
)


def octave(lo: int) -> tuple[int, int, int, int, int]:
    """(least period, end of the periods, stride of boundaries, words before, words after a boundary).

    A run of period q has at least 3 q words and 24, so the first boundary in it has a
    whole period of the run after it, and the words a boundary sees reach the next ones with q words in common.
    """
    return (1, BASE, BASE // 2, BASE, 2 * BASE) if lo < BASE else (lo, 2 * lo, lo, 2 * lo, 4 * lo)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, equal for equal words, and where each text's words start."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    counts = np.bincount(owner[full], minlength=len(split))
    return codes[full].astype(np.int32), np.append(0, np.cumsum(counts))


def next_places(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the grams that occur again in their text, to their next occurrence.

    Grams are compared by a 64-bit hash; unequal ones with equal hashes can only
    shorten a distance, which lets more tiles through.
    """
    n = len(codes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = codes.astype(np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    key = text[:n] * _MIX[GRAM]
    for k in range(GRAM):
        key += wide[k : k + n] * _MIX[k]
    key ^= key >> np.uint64(31)
    key *= _MIX[0]
    bits = np.uint64(max(10, int(n).bit_length() + 1))
    slot = (key >> (np.uint64(64) - bits)).astype(np.int64)
    inside = text[:n] == text[GRAM - 1 :]
    place = np.flatnonzero((np.bincount(slot, minlength=1 << int(bits)) > 1)[slot] & inside)
    key = key[place]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at, after = place[order[:-1][same]], place[order[1:][same]]
    order = np.argsort(at)
    return at[order], (after - at)[order]


def tile_spans(place: np.ndarray, distance: np.ndarray, first: np.ndarray):
    """(text, least period, first boundary, boundaries) of the tiles that a run may lie in.

    In a run of period q every gram that ends a period before the run does occurs again
    within q words. So only places with such grams, in stretches that are long enough
    for the octave, are looked at; every run is in one.
    """
    longest = int(np.diff(first).max(initial=0))
    lo = 1
    while ROUNDS * lo <= longest and len(place):
        lo, hi, stride, _, _ = octave(lo)
        near = place[distance < hi]
        cut = np.flatnonzero(np.diff(near) != 1) + 1
        begin, end = near[np.append(0, cut)] if len(near) else near, near[np.append(cut, len(near)) - 1] if len(near) else near
        # max(24, 3 q) words less q and all but one of a gram: at least 9 in the lowest octave.
        long = end - begin + 1 >= max(9, 2 * lo - GRAM + 1)
        begin, end = begin[long], end[long]
        text = np.searchsorted(first, begin, "right") - 1
        low = -(-(begin - first[text]) // stride)
        high = (end + GRAM - first[text]) // stride
        each = max(1, CORE // stride) if stride < CORE else 8
        parts = high // each - low // each + 1
        parts[high < low] = 0
        which = np.repeat(np.arange(len(low)), parts)
        block = low[which] // each + np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        one = np.maximum(low[which], block * each)
        last = np.minimum(high[which], block * each + each - 1)
        for t, a, b in zip(text[which].tolist(), one.tolist(), last.tolist(), strict=True):
            yield t, lo, a * stride, b - a + 1
        lo = hi


def _tiled(part, codes, first) -> list[list]:
    """For each text of a batch its tiles, as columns after `node`."""
    out: list[list] = [[] for _ in range(len(part))]
    for text, lo, boundary, number in tile_spans(*next_places(codes, first), first):
        _, _, stride, before, after = octave(lo)
        start = max(0, boundary - before)
        end = min(first[text + 1] - first[text], boundary + (number - 1) * stride + after)
        window = codes[first[text] + start : first[text] + end]
        out[text].append((lo, boundary, number, start, window.astype("<i4").tobytes()))
    return out


def _parts(batches):
    for batch in batches:
        for a, b in array_slices(batch.column("text")):
            yield batch.slice(a, b - a)


def look_over(texts: DataFrame) -> DataFrame:
    """The documents (doc_id, text, node) that may hold a run, and the tiles of their words.

    A document has a row with its text; each of its overlapping tiles, one for an
    octave and stretch of boundaries, has a row without.
    """

    def look(batches):
        for part in _parts(batches):
            out, seen = [], set()
            codes, first = words_of(part.column("text"))
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "node"))
            for doc, text, node, found in zip(*columns, _tiled(part, codes, first), strict=True):
                if found:
                    out.append((doc, text, node, *[None] * 5))
                    out += [(None, None, node, *tile) for tile in found if node not in seen]
                    seen.add(node)
            if out:
                yield arrow(LOOKED, *zip(*out, strict=True))

    return texts.select("doc_id", "text", "node").mapInArrow(look, LOOKED)


def without_runs(texts: DataFrame) -> DataFrame:
    """The finished rows of the documents that look_over() leaves out."""

    def finish(batches):
        for part in _parts(batches):
            out = []
            codes, first = words_of(part.column("text"))
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text"))
            for doc, text, found in zip(*columns, _tiled(part, codes, first), strict=True):
                if not found:
                    words = text.encode().split()
                    out.append((doc, len(words), 0, None, None, None, [], [], [], b" ".join(words).decode()))
            if out:
                yield arrow(OUT, *zip(*out, strict=True))

    return texts.select("doc_id", "text").mapInArrow(finish, OUT)


def z_function(words: np.ndarray) -> np.ndarray:
    """For each place, how many words from there on equal those from the start on (0 at the start)."""
    n, plain = len(words), words.tolist()
    z = [0] * n
    left = right = 0
    for i in (np.flatnonzero(words[1:] == words[0]) + 1).tolist():
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        few = min(n - i, k + 16)
        while k < few and plain[k] == plain[i + k]:
            k += 1
        step = 64
        while k == few < n - i:
            differ = words[k : n - i][:step] != words[i + k : i + k + step]
            if differ.any():
                k += int(differ.argmax())
                break
            few = k = k + len(differ)
            step *= 4
        z[i] = k
        left, right = i, i + k
    return np.array(z, np.int64)


def primitive(z: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The periods q whose first q words aren't a shorter block repeated."""
    half = int(periods.max(initial=0)) // 2
    shorter = np.arange(1, half + 1)
    shorter = shorter[z[1 : half + 1] >= shorter]
    while len(shorter) and len(periods):
        p, reach = shorter[0], shorter[0] + z[shorter[0]]
        periods = periods[(periods % p != 0) | (periods == p) | (periods > reach)]
        # What a multiple of p rules out, p has ruled out as far as it reaches.
        shorter = shorter[(shorter % p != 0) | (shorter + z[shorter] > reach)]
    return periods


def fragments_at(words: np.ndarray, at: int, lo: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches around boundary `at` of the words that it sees, with a period of
    the octave that is their smallest.

    The Z-function of the words after the boundary tells how far each period goes on;
    that of the words before it, read backwards, how far it reaches back.
    """
    lo, hi, _, before, after = octave(lo)
    ahead = words[at : at + after]
    if len(ahead) <= lo:
        return []
    z = z_function(ahead)
    periods = lo + np.flatnonzero(z[lo:hi])
    periods = primitive(z, periods)
    if not len(periods):
        return []
    back = words[max(0, at - before) : at]
    both = np.concatenate([back[::-1], [-1], words[at - len(back) : at + hi][::-1]])
    # A word q after the boundary, in what is read backwards up to len(back) words before it.
    start = at - z_function(both)[len(both) - len(back) - periods] if len(back) else np.full(len(periods), at)
    end = at + periods + z[periods]
    long = end - start >= np.maximum(2 * periods, BASE if lo < BASE else 0)
    return list(zip(periods[long].tolist(), start[long].tolist(), end[long].tolist(), strict=True))


def merged(spans, period: int):
    """Stretches of one period, sorted by start; those with a period of words in common are one."""
    held = None
    for start, end in spans:
        if held and held[1] - start >= period:
            held = held[0], max(held[1], end)
            continue
        if held:
            yield held
        held = start, end
    if held:
        yield held


def solve(cut: DataFrame) -> DataFrame:
    """(node, period, start, end): fragments of periodic stretches in each tile."""

    def find(batches):
        for batch in batches:
            out = []
            for node, lo, boundary, number, start, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(codes, "<i4")
                stride = octave(lo)[2]
                found = [x for k in range(number) for x in fragments_at(words, boundary - start + k * stride, lo)]
                for q, group in groupby(sorted(found), key=lambda x: x[0]):
                    out += [(node, q, a + start, b + start) for a, b in merged((x[1:] for x in group), q)]
            if out:
                yield arrow(FRAGMENTS, *zip(*out, strict=True))

    return cut.mapInArrow(find, FRAGMENTS)


def stitched(fragments: DataFrame) -> DataFrame:
    """(node, period, start, end) of the runs: fragments of a text and period, joined where they overlap by a period."""

    def join(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for (node, q), group in groupby(rows, key=lambda x: x[:2]):
            for start, end in merged((x[2:] for x in group), q):
                if end - start >= max(LEAST, ROUNDS * q):
                    out.append((node, q, start, end))
            if len(out) >= 10_000:
                yield arrow(FRAGMENTS, *zip(*out, strict=True))
                out = []
        if out:
            yield arrow(FRAGMENTS, *zip(*out, strict=True))

    spread = fragments.repartition("node", "period").sortWithinPartitions("node", "period", "start", "end")
    return spread.mapInArrow(join, FRAGMENTS)


def packed(runs: DataFrame) -> DataFrame:
    """(node, starts, lengths, periods): the runs of each text that has any, by start, then period."""
    listed = runs.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "period", "end"))).alias("runs"))
    lengths = F.transform("runs", lambda x: x["end"] - x["start"])
    return listed.select(
        "node", F.col("runs.start").alias("starts"), lengths.alias("lengths"), F.col("runs.period").alias("periods")
    )


def collapse(words: list, starts, lengths, periods) -> list:
    """The words outside of runs and those of each run's first period, unless another run drops them."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in zip(starts, lengths, periods, strict=True):
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def sharpest(starts, lengths, periods) -> tuple[int, int, int]:
    """(start, length, period) of the run with most periods; of equal ones the first, then the shortest period."""
    best = None
    for start, length, period in zip(starts, lengths, periods, strict=True):
        # Runs come by start, then period, so only a greater share takes over.
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def collapse_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its runs, the sharpest of them, and the text with runs collapsed.

    Words are stretches without ASCII white space, numbered from 0. `starts`, `lengths`
    and `periods` list all runs by start, then period; start, length and period are
    those of the run with the greatest exact length / period (the first, then the
    shortest period, of equal ones), null without runs. `collapsed_text` has the words that
    no run contains after its first period, joined by single spaces.

    Null and empty texts have no words and no runs. Repeated rows give repeated rows, an
    empty table an empty one; other columns are left out. Whole texts of any length are
    searched: an n-word text costs about n log n steps, spread over its tiles. Words
    are compared by codes of a task's dictionary, so results are exact; texts are known
    by MD5. Only documents that may hold a run take part in a join; the others are
    looked over twice and written as they come.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))
    looked = materialize(look_over(texts), "looked")
    with scratch(docs.sparkSession) as store:
        # Copies of a text have the same tiles; they collapse before they are shuffled.
        cut = looked.where("codes IS NOT NULL").dropDuplicates(["node", "octave", "boundary"])
        fragments = store(solve(cut.select(*(f.split()[0] for f in TILE.split(", ")))), "fragments")
        runs = materialize(packed(stitched(fragments)), "runs")

    def write(batches):
        columns = ("doc_id", "text", "starts", "lengths", "periods")
        for batch in batches:
            out = []
            for doc, text, *runs in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                words = text.encode().split()
                found = [x or [] for x in runs]
                best = sharpest(*found) or (None, None, None)
                out.append((doc, len(words), len(found[0]), *best, *found, b" ".join(collapse(words, *found)).decode()))
            if out:
                yield arrow(OUT, *zip(*out, strict=True))

    joined = looked.where("codes IS NULL").join(runs, "node", "left").select("doc_id", "text", "starts", "lengths", "periods")
    return without_runs(texts).unionByName(joined.mapInArrow(write, OUT))
