"""Token ids of whole texts; each distinct chunk between spaces is encoded once a batch."""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the word pattern that byte-level pre-tokenizers apply.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = (
    "The quick brown fox, 12345 jumps; over\n\n  the lazy dog's  back.\t",
    " Ééà ñandú größer ﬁ ½ 漢字かな 한글 🙂👍🏽 ​\xa0x ",
    "x=1;if(a<b){c[d]+=\"e\\n\"}  # 100% <|end|> don't we'll I'M",
)


def _printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _rank_model(facts: dict, library):
    """A faster engine for the same vocabulary, or None where it may differ.

    Merging by rank equals the file's merges if its ids stand in merge order.
    The library stays the measure: the engine must agree with it on probes.
    """
    import tiktoken

    model, steps = facts["model"], facts.get("pre_tokenizer") or {}
    if (
        model.get("type") not in (None, "BPE")
        or facts.get("normalizer") is not None
        or steps.get("type") != "ByteLevel"
        or not steps.get("use_regex", True)
        or steps.get("add_prefix_space")
        or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    ):
        return None
    byte, vocab = _printable_bytes(), model["vocab"]
    special = {x["content"] for x in facts.get("added_tokens", [])}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if merged != sorted(merged) or any(c not in byte for t in vocab if t not in special for c in t):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    engine = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    same = all(engine.encode_ordinary(p) == library.encode(p, add_special_tokens=False).ids for p in PROBES)
    if not same:
        return None
    width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return engine, width


def _kinds() -> np.ndarray:
    """For each byte: 0 never in white space, 1 ASCII white space, 2 may belong to other white space."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
    return kind


KIND = _kinds()
BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def borders(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start: at text starts, and at spaces before which a byte-level
    pre-tokenizer surely has a border.

    A space next to at least one character that isn't white space starts a new
    piece: a word takes one leading space at most, and a run of white space
    before a word leaves its last space to that word.
    """
    n = len(buf)
    at = np.flatnonzero(buf == 32)
    at = at[at > 0]
    before = buf[at - 1]
    lead2, lead3 = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    solid = (before < 128) & (KIND[before] == 0)
    solid |= (before >= 128) & (lead2 != 0xC2) & ((lead3 < 0xE1) | (lead3 > 0xE3))
    after = KIND[buf[np.minimum(at + 1, n - 1)]] == 0
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    solid &= ~first[at]
    after &= ~first[at + 1] & (at + 1 < n)
    first[at[solid | after]] = True
    first[n] = False
    return np.flatnonzero(first)


def chunk_hashes(buf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk buf[cuts[i]:cuts[i+1]]; the last cut is the end.

    Polynomial sums modulo 2^64 of a fixed random word for each byte; blocks
    keep the arrays small, longer chunks are summed over their blocks.
    """
    rng = np.random.default_rng(7)
    word = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, inverse = _POWER
    total = np.zeros(len(cuts) - 1, dtype=np.uint64)
    for low in range(0, len(buf), BLOCK):
        high = min(len(buf), low + BLOCK)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(word[buf[low:high]] * power[: high - low], out=sums[1:])
        a, b = np.searchsorted(cuts, low, "right") - 1, np.searchsorted(cuts, high, "left")
        start, end = np.maximum(cuts[a:b], low), np.minimum(cuts[a + 1 : b + 1], high)
        part = (sums[end - low] - sums[start - low]) * inverse[start - low]
        total[a:b] = total[a:b] * _P + part
    return (total ^ (total >> np.uint64(29))) * _P + np.diff(cuts).astype(np.uint64)


def distinct_chunks(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of a chunk for each distinct one, and for each chunk its place in that list.

    Chunks with equal hashes are compared byte by byte with one of them; those that
    differ from it are told apart by their bytes.
    """
    _, first, which = np.unique(chunk_hashes(buf, cuts), return_index=True, return_inverse=True)
    like = first[which]
    size, start = np.diff(cuts), cuts[:-1]
    odd = size != size[like]
    shift = np.where(odd, 0, start[like] - start)
    for low in range(0, len(buf), BLOCK):
        high = min(len(buf), low + BLOCK)
        a, b = np.searchsorted(cuts, low, "right") - 1, np.searchsorted(cuts, high, "left")
        inside = np.minimum(cuts[a + 1 : b + 1], high) - np.maximum(start[a:b], low)
        at = np.arange(low, high) + np.repeat(shift[a:b], inside)
        wrong = np.flatnonzero(buf[at] != buf[low:high])
        if len(wrong):
            odd[np.searchsorted(cuts, wrong + low, "right") - 1] = True
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        which[i] = known.setdefault(buf[cuts[i] : cuts[i + 1]].tobytes(), len(first) + len(known))
    if known:
        extra = np.zeros(len(known), np.int64)
        extra[which[odd] - len(first)] = np.flatnonzero(odd)
        first = np.concatenate([first, extra])
    return first, which


_POWER = (_powers(np.uint64(0xD6E8FEB86659FD93)), _powers(np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))


class Encoder:
    """Ids of `path` (a tokenizers .json or a sentencepiece .model file).

    For byte-level pre-tokenizers a text is the concatenation of chunks that can
    be encoded on their own (see `borders`). Every distinct chunk of a batch is
    encoded once; the texts' ids are gathered from them. Texts with a special
    token's string, and all texts of other tokenizers, are encoded whole by
    their library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = self.ranks = None
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            facts = json.load(file)
        self.ranks = _rank_model(facts, self.library)
        self.special = [x["content"] for x in facts.get("added_tokens", [])]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids from the library, text by text."""
        if not texts:
            return []
        if self.model:
            found = self.model.encode(texts, num_threads=1)
        else:
            found = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
        return [np.asarray(ids, dtype="<u4") for ids in found]

    def _distinct(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Ids of distinct chunks, one after the other, and how many each has."""
        engine, width = self.ranks
        raw = buf.tobytes()
        second = KIND[buf[np.minimum(start + 1, len(buf) - 1)]]
        regular = (buf[start] == 32) & (end > start + 1) & (second == 0)
        order = np.concatenate([np.flatnonzero(regular), np.flatnonzero(~regular)])
        spans = list(zip(start[order].tolist(), end[order].tolist(), strict=True))
        k = int(regular.sum())
        ids = [np.asarray(engine.encode_ordinary(b"".join([raw[a:b] for a, b in spans[:k]]).decode()), dtype="<u4")]
        ends = np.searchsorted(np.cumsum(width[ids[0]]), np.cumsum((end - start)[order[:k]])) + 1
        counts = np.diff(ends, prepend=0)
        rest = [np.asarray(engine.encode_ordinary(raw[a:b].decode()), dtype="<u4") for a, b in spans[k:]]
        counts = np.concatenate([counts, np.array([len(x) for x in rest], dtype=np.int64)])
        return np.concatenate(ids + rest), counts, order

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other (null as empty), and each text's count."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        plain = np.full(n, self.ranks is not None)
        for content in self.special:
            plain &= ~pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        alone = self.whole(texts.filter(pa.array(~plain)).to_pylist())
        rows = texts.filter(pa.array(plain)) if alone else texts
        ids, count = self._chunked(rows) if len(rows) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        if not alone:
            return ids, count
        parts, counts = np.split(ids, np.cumsum(count)[:-1]) if len(rows) else [], np.zeros(n, np.int64)
        whole, split = iter(alone), iter(parts)
        out = [next(split) if p else next(whole) for p in plain]
        counts[:] = [len(x) for x in out]
        return np.concatenate(out), counts

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buf = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(buf):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        starts = borders(buf, offsets[:-1][np.diff(offsets) > 0])
        cuts = np.append(starts, len(buf))
        first, which = distinct_chunks(buf, cuts)
        ids, counts, order = self._distinct(buf, cuts[first], cuts[first + 1])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(counts) - counts
        size = np.empty(len(order), dtype=np.int64)
        size[order] = counts
        size, place = size[which], place[which]
        ends = np.cumsum(size)
        every = np.repeat(place - (ends - size), size) + np.arange(ends[-1])
        until = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids[every], np.diff(until)


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def array_slices(texts: pa.Array, budget: int = 12_000_000):
    """Ranges of `texts` with about `budget` bytes each, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + budget, "right")))
        yield start, min(end, len(texts))
        start = end
