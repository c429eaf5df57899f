"""Secrets in texts: fixed shapes, and values in credential contexts that are hard to guess."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from math import log10

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.quality_rules import holds_any
from demandcast.session import materialize, scratch

# The base shapes and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Credential contexts beyond the base shapes: a name, a link, and after a scheme word if there is one the start of a
#: value: six characters or more up to the closing quote of the line, or without quotes up to white space, a quote, `,` or `;`.
CONTEXT = re.compile(
    r"""(?P<name>pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|auth(?:orization)?|bearer|credentials?"""
    r"""|private[_-]?key|access[_-]?key|client[_-]?secret)["']?\s*(?::=|=>|[:=]|\sis\s)\s*"""
    r"""(?:(?:bearer|basic|digest|negotiate|apikey|token)\s+)?+"""
    r"""(?:(?P<quote>["'])|(?=[^\s"',;]{6}))""",
    re.ASCII | re.IGNORECASE,
)
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:([^\s/@]{6,})@")
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")

# Words that people choose for passwords or that stand in for one, commonest first.
COMMON = tuple(
    """password admin welcome login letmein monkey dragon master qwerty sunshine princess football baseball shadow
    superman batman trustno hello freedom whatever secret summer winter spring autumn flower love money family friend
    computer internet server system network default guest user root test testing example sample demo dummy placeholder
    changeme change me your my the this here token key here value string null none undefined true false empty insert enter
    replace redacted removed hidden xxx abc api auth access private public client name pass word mustang michael jordan
    hunter killer pepper ginger cookie soccer hockey tiger jessica jennifer thomas charlie daniel andrew matthew joshua
    george amanda ashley nicole blue green black white red silver golden orange purple star moon sun house dog cat horse
    correct battery staple bearer basic digest negotiate apikey""".split()
)
RANK = {word: i + 1 for i, word in enumerate(dict.fromkeys(COMMON))}
LONGEST = max(map(len, RANK))
#: A run of letters; a word of a document is one without digits or underscores beside it.
RUN = re.compile(r"[^\W\d_]{3,30}")
WORD = re.compile(r"(?<!\w)[^\W\d_]{3,30}(?!\w)")
#: Words that a task counts before it gives them out.
HELD = 200_000
LEET = str.maketrans("@4831!05$7", "aabeiiosst")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(
    r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)"
)
DATES, YEARS = log10(150 * 365 * 4), log10(150)
#: What each further segment adds: the guesser has to try the splits too.
SPLIT = 0.3


def _brute(value: str) -> float:
    """Cost of one character: the size of the smallest usual alphabet that holds the value."""
    size = 0
    for test, n in ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26)):
        size += n * any(map(test, value))
    if size == 36 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        size = 16
    return log10(size + 33 * any(not c.isalnum() for c in value) or 100)


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that find `value` by its cheapest split into segments.

    Segments: a common word in any case and with digits for letters, a whole run of
    letters that `ranks` knows, a date or year,
    a block repeated, a walk over neighbouring keys or an alphabet, and
    single characters by brute force. One pass over the positions; a segment is a
    word of bounded length or a run that is followed as far as it goes, so the time
    follows the length. An empty value costs 0.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [float("inf")] * n
    brute = _brute(value) if n else 0.0
    ends = dict(m.span() for m in RUN.finditer(value))
    walk = [0] * (n + 1)  # steps of the walk that ends before i
    for i in range(1, n):
        walk[i] = walk[i - 1] + 1 if low[i - 1 : i + 1] in NEXT or low[i - 1 : i + 1][::-1] in NEXT else 0
    period = {k: 0 for k in (1, 2, 3, 4)}
    for i in range(n):
        here = best[i]
        step = here + (0.6 if value[i] in "_-. " else brute)
        if step < best[i + 1]:
            best[i + 1] = step
        here += SPLIT if i else 0.0
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(low[i:j])
            cost = 0.0
            if not rank and plain[i:j] != low[i:j]:
                rank, cost = RANK.get(plain[i:j]), 0.6
            if rank:
                cost += log10(rank) + (0.0 if value[i:j].islower() or value[i:j] == low[i:j] else 0.6)
                best[j] = min(best[j], here + cost)
        run = ends.get(i)
        if run and low[i:run] in ranks:
            cost = log10(ranks[low[i:run]]) + (0.0 if value[i:run].islower() else 0.6)
            best[run] = min(best[run], here + cost)
        found = DATE.match(value, i)
        if found:
            cost = DATES if found.end() - i > 4 else YEARS
            best[found.end()] = min(best[found.end()], here + cost)
        if walk[i] and walk[i] >= 2:
            start = i - walk[i]
            cost = best[start] + (SPLIT if start else 0.0) + log10(40 * (walk[i] + 1))
            best[i + 1] = min(best[i + 1], cost)
        for k in period:
            period[k] = period[k] + 1 if i >= k and value[i] == value[i - k] else 0
            if period[k] >= max(2, k):
                start = i + 1 - k - period[k]
                cost = best[start + k] + log10(period[k] // k + 2)
                best[i + 1] = min(best[i + 1], cost)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if _hinted(text) else []
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(hint in low for hint in HINTS)


STOPS = re.compile(r"[\s\"',;]", re.ASCII)


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential contexts; a value may hold another context.

    Ends are looked up among the places of what ends a value, so that many values with one end cost no more.
    """
    found = []
    if _hinted(text):
        stops = None
        m = CONTEXT.search(text)
        while m:
            if stops is None:
                stops = {'"': _places('["\n]', text), "'": _places("['\n]", text), None: _places(STOPS, text)}
            start, quote = m.end(), m["quote"]
            k = bisect_left(stops[quote], start)
            end = stops[quote][k] if k < len(stops[quote]) else len(text)
            # A quoted value ends on its own line.
            if quote is None or (end - start >= 6 and end < len(text) and text[end] == quote):
                found.append((start, end))
            m = CONTEXT.search(text, m.end("name"))
    if "://" in text:
        found += [m.span(1) for m in ADDRESS.finditer(text)]
    return sorted(set(found))


def _places(pattern, text: str) -> list[int]:
    return [m.start() for m in re.finditer(pattern, text)]


def guess_spans(text: str, base, least: float, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """Values in credential contexts that cost at least 10**`least` guesses, outside of base spans."""
    taken, out, cheap = sorted(base), [], set()
    for start, end in values(text):
        # The end of a cheap value isn't dearer than the value.
        if end in cheap or any(a < end and start < b for a, b, _ in taken):
            continue
        if guess_cost(text[start:end], ranks) >= least:
            out.append((start, end, "guess"))
            taken.append(out[-1])
        else:
            cheap.add(end)
    return out


COUNTED = "word string, n bigint"
ASKED = "node binary, word string"


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all documents that occur twice or more outside of candidate values.

    Copies of a secret don't make it a word.
    """

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at, text = 0, text or ""
                for start, end in values(text):
                    if start > at:
                        seen.update(WORD.findall(text[at:start].lower()))
                    at = max(at, end)
                seen.update(WORD.findall(text[at:].lower()))
                if len(seen) > HELD:
                    yield arrow(COUNTED, list(seen.keys()), list(seen.values()))
                    seen = Counter()
        yield arrow(COUNTED, list(seen.keys()), list(seen.values()))

    words = docs.select("text").mapInArrow(count, COUNTED)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")


def asked(docs: DataFrame) -> DataFrame:
    """(node, word): the runs of letters in the candidate values of each distinct text."""

    def runs(batches):
        for batch in batches:
            out = []
            for name, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, found = 0, set()
                for start, end in values(text):
                    # What a value shares with one before it has been looked at.
                    if end > at:
                        found.update(w.lower() for w in RUN.findall(text[max(start, at) : end]))
                    at = max(at, end)
                out += [(name, word) for word in found]
            if out:
                yield arrow(ASKED, *zip(*out, strict=True))

    return docs.select("node", "text").mapInArrow(runs, ASKED).distinct()


def ranks_by_count(words: DataFrame) -> DataFrame:
    """(n, rank) of every count: how many words are seen as often or more.

    Running totals within a power of two of counts, after the totals of the (at
    most 63) powers above.
    """
    numbers = words.groupBy("n").agg(F.count("*").alias("number")).withColumn("power", F.floor(F.log2("n")))
    above = Window.orderBy(F.desc("power")).rowsBetween(Window.unboundedPreceding, -1)
    powers = numbers.groupBy("power").agg(F.sum("number").alias("number"))
    powers = powers.select("power", F.coalesce(F.sum("number").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy("power").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    totals = numbers.withColumn("within", F.sum("number").over(within)).join(powers, "power")
    return totals.select("n", (F.col("before") + F.col("within")).alias("rank"))


def with_ranks(docs: DataFrame, known: str) -> DataFrame:
    """`docs` and a map `known` of the ranks of words in each text's candidate values, null where there is none.

    Ranks are joined to texts as tables; nothing of them goes through the driver.
    Only texts that hold a credential context are joined.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    low = F.lower(text)
    context = "(?i)" + CONTEXT.pattern.replace("(?P<", "(?<")
    may = (holds_any(low, HINTS) & text.rlike(context)) | (low.contains("://") & text.rlike(ADDRESS.pattern))
    node = F.unhex(F.md5(text))
    with scratch(docs.sparkSession) as store:
        words = store(counted(docs), "words")
        ranks = store(ranks_by_count(words), "ranks")
        runs = store(asked(docs.where(may).select(node.alias("node"), text.alias("text"))), "asked")
        found = runs.join(words, "word").join(ranks, "n").groupBy("node")
        found = found.agg(F.map_from_entries(F.collect_list(F.struct("word", "rank"))).alias("ranks"))
        found = materialize(found, "known_words")
    own, name = known + "_", known + "__"
    found = found.select(F.col("node").alias(name), F.col("ranks").alias(known))
    marked = docs.where(may).withColumn(own, node)
    marked = marked.join(found, F.col(own) == F.col(name), "left").drop(own, name)
    none = F.lit(None).cast("map<string,bigint>").alias(known)
    return docs.where(~may).select("*", none).unionByName(marked)


def word_ranks(found) -> dict[str, int]:
    """The ranks for guess_cost() from a map of with_ranks()."""
    return {word: min(rank, RANK.get(word, rank)) for word, rank in found or ()}


def free_name(columns) -> str:
    name = "known"
    while any(column.lower().startswith(name) for column in columns):
        name = "_" + name
    return name


def written(spans) -> str:
    ordered = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint"


def find_secrets(docs: DataFrame, least: float = 9.0) -> DataFrame:
    """Secret spans of every whole text, one row for each row of `docs` (doc_id, text).

    Positions are code points, the end exclusive. Null and empty texts have no
    spans (an empty list's digest, empty `spans`). Repeated rows give repeated
    rows. An empty table gives an empty one. Other columns are left out.
    `least` is the log10 of guesses from which a value in a credential context
    counts as a secret; cheaper ones are placeholders or examples. The words of
    all documents are counted first, see with_ranks().
    """

    def scan(batches):
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                base = base_spans(text or "")
                more = guess_spans(text or "", base, least, word_ranks(found))
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc, *counts, digest, written(base + more), len(more)))
            if rows:
                yield arrow(FOUND, *zip(*rows, strict=True))

    return with_ranks(docs.select("doc_id", "text"), "known").mapInArrow(scan, FOUND)


def redact(docs: DataFrame, least: float = 9.0, mark: str = "[REDACTED]") -> DataFrame:
    """`docs` with every secret span replaced by `mark`; n_chars follows the text, null text stays null."""
    schema = docs.schema
    place = docs.columns.index("text")
    known = free_name(docs.columns)

    def cover(text, found):
        base = base_spans(text)
        out, end = [], 0
        for a, b, _ in sorted(base + guess_spans(text, base, least, word_ranks(found))):
            if b > end:
                out += [text[end:a], mark] if a >= end else []
                end = b
        return "".join(out) + text[end:] if out else text

    def replace(batches):
        import pyarrow as pa

        for batch in batches:
            both = zip(batch.column(place).to_pylist(), batch.column(known).to_pylist(), strict=True)
            texts = [None if t is None else cover(t, found) for t, found in both]
            batch = batch.drop_columns([known])
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = with_ranks(docs, known).mapInArrow(replace, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
