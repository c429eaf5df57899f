"""Lines that many documents share, dropped through sharded perfect-hash indexes.

Documents are read once for the digests of their lines. Repeated lines are counted
and indexed in shards; every page of documents asks each shard once for the lines it
holds, as one packed array, so that lines are never joined with lines.
"""

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import SPACES, arrow
from demandcast.llm.perfect_hash import LineIndex
from demandcast.session import materialize, scratch

WHITE = SPACES.encode()
#: Documents and distinct lines of a page; the least documents of a common line, and code points of its key.
PAGE_DOCS, PAGE_LINES = 500, 100_000
DOCS, CHARS = 5, 40
#: Lines that a shard is asked for, at most about as many as it holds; the least number of shards.
SHARD, SHARDS = 250_000, 256

PAGED = "page string, row binary, doc_id bigint, digests binary"
COUNTED = "one bigint, two bigint, n bigint, owner bigint"
ASKED = "shard bigint, page string, data binary"
ANSWER = "page string, row binary, doc_id bigint, data binary"
DROPS = "row binary, drops binary"
KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string"


def line_digest(line: bytes, chars: int) -> bytes | None:
    """16 bytes for the key of a line, None for keys under `chars` code points."""
    key = line.strip(WHITE)
    if len(key) < chars:
        return None
    key = key.lower()  # of bytes: A-Z only
    if not key.isascii() and len(key.decode()) < chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def row_key(doc_id, text):
    """16 bytes for a (doc_id, text) pair; null ids are a value of their own, null texts are empty."""
    name = F.coalesce(doc_id.cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), F.coalesce(text, F.lit("")))))


def _halves(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _packed(one: np.ndarray, two: np.ndarray) -> bytes:
    return np.stack([one, two], axis=1).tobytes()


def pages(docs: DataFrame, chars: int) -> DataFrame:
    """(page, row, doc_id, digests): the distinct long lines of every document that has any."""

    def read(batches):
        task, page, held, lines = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            out = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                found = {d for d in (line_digest(x, chars) for x in (text or "").encode().split(b"\n")) if d}
                if not found:
                    continue
                if held >= PAGE_DOCS or lines >= PAGE_LINES:
                    page, held, lines = page + 1, 0, 0
                held, lines = held + 1, lines + len(found)
                out.append((f"{task}-{page}", row, doc, b"".join(sorted(found))))
            if out:
                yield arrow(PAGED, *zip(*out, strict=True))

    return docs.select(row_key(docs["doc_id"], docs["text"]).alias("row"), "doc_id", "text").mapInArrow(read, PAGED)


def repeated_lines(paged: DataFrame) -> DataFrame:
    """(one, two, n, owner) of every line that two rows or more hold and one with an id does.

    n counts rows, `owner` is the greatest doc_id. Lines are combined in each batch and
    each input task before they are shuffled, so a line of a third of all documents
    arrives as one row from each task.
    """

    def count(batches):
        for batch in batches:
            both = [np.frombuffer(d, "<u8").reshape(-1, 2) for d in batch.column("digests").to_pylist()]
            if not both:
                continue
            docs = batch.column("doc_id").to_pylist()
            owner = np.repeat(np.array([x or 0 for x in docs], np.int64), [len(x) for x in both])
            none = np.repeat(np.array([x is None for x in docs]), [len(x) for x in both])
            both = np.concatenate(both)
            order = np.lexsort((owner, ~none, both[:, 1], both[:, 0]))
            both, owner, none = both[order], owner[order], none[order]
            last = np.append((both[1:] != both[:-1]).any(axis=1), True)
            n = np.diff(np.flatnonzero(last), prepend=-1)
            one, two = both[last].view(np.int64).T
            yield arrow(COUNTED, one, two, n, pa.array(owner[last], mask=none[last]))

    counted = paged.select("doc_id", "digests").mapInArrow(count, COUNTED).groupBy("one", "two")
    counted = counted.agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))
    return counted.where("n >= 2 AND owner IS NOT NULL")


def _by_key(batches):
    """Runs of rows with the same first column."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[0])


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, page, data): a LineIndex of each shard of the repeated lines; `page` is null."""

    def build(batches):
        held: list[pa.RecordBatch] = []

        def index(parts):
            part = pa.Table.from_batches(parts)
            one, two, n, owner = (part.column(c).to_numpy() for c in ("one", "two", "n", "owner"))
            data = LineIndex.build(one.view(np.uint64), two.view(np.uint64), n, owner).to_bytes()
            return arrow(ASKED, [part.column("shard")[0].as_py()], [None], [data])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("shard")[0].as_py() != shard[a]:
                    yield index(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield index(held)

    spread = repeated.withColumn("shard", F.pmod("one", F.lit(shards)).cast("long"))
    return spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, ASKED)


def questions(paged: DataFrame, shards: int) -> DataFrame:
    """(shard, page, data): the distinct lines of each batch of a page that a shard would hold, packed."""

    def ask(batches):
        for page, group in _by_key(batches):
            both = np.frombuffer(b"".join(d for _, d in group), "<u8").reshape(-1, 2)
            both = np.unique(both, axis=0)
            shard = both[:, 0].view(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            both, shard = both[order], shard[order]
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            yield arrow(ASKED, [int(shard[a]) for a, _ in spans], [page] * len(spans), [both[a:b].tobytes() for a, b in spans])

    return paged.select("page", "digests").mapInArrow(ask, ASKED)


def answers(index: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(page, row, doc_id, data): lines of a page that at least `least` rows hold, with their owners.

    Rows of a shard meet in one task, the index first; questions pass one by one.
    """

    def probe(batches):
        for _, group in _by_key(batches):
            arrays = None
            for _, page, data in group:
                if page is None:
                    arrays = LineIndex.from_bytes(data)
                    continue
                if arrays is None:
                    break
                one, two = _halves(data)
                slot = arrays.slots(one, two)
                hit = slot >= 0
                hit[hit] = arrays.counts[slot[hit]] >= least
                if hit.any():
                    owner = arrays.owners[slot[hit]]
                    found = np.stack([one[hit], two[hit], owner.view(np.uint64)], axis=1)
                    yield arrow(ANSWER, [page], [None], [None], [found.tobytes()])

    both = index.unionByName(asked).repartition("shard")
    return both.sortWithinPartitions("shard", F.col("page").isNotNull()).mapInArrow(probe, ANSWER)


def dropped_lines(paged: DataFrame, answered: DataFrame) -> DataFrame:
    """(row, drops): digests of the lines that each document loses, packed; a row for documents that lose any."""

    def decide(batches):
        for _, group in _by_key(batches):
            owners, out = {}, []
            for _, row, doc, data in group:
                if row is None:
                    for at in range(0, len(data), 24):
                        owners[data[at : at + 16]] = int.from_bytes(data[at + 16 : at + 24], "little", signed=True)
                    continue
                if not owners:
                    break
                lost = [data[i : i + 16] for i in range(0, len(data), 16) if owners.get(data[i : i + 16], doc) != doc]
                if lost:
                    out.append((row, b"".join(lost)))
            if out:
                yield arrow(DROPS, *zip(*out, strict=True))

    both = answered.unionByName(paged.withColumnRenamed("digests", "data")).repartition("page")
    return both.sortWithinPartitions("page", F.col("row").isNotNull()).mapInArrow(decide, DROPS).dropDuplicates(["row"])


def drop_common_lines(docs: DataFrame, least: int = DOCS, chars: int = CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row of `docs` (doc_id, text).

    A line's key is the line without ASCII white space at its ends, A-Z as a-z. A key of
    at least `chars` code points that at least `least` rows hold (2 or more) is common: all
    its lines are dropped but those of the greatest doc_id that holds it. Other lines stay as they
    are, joined by newlines. A text has one line more than newlines; null and empty
    texts have one empty line. Rows with equal doc_id count as several documents and
    all keep what their id owns. Null ids are less than all others and own nothing;
    a line that null ids alone hold isn't dropped. An empty table gives an empty one;
    other columns are left out.

    Keys are known by 128 bits; two different ones are taken for the same with chance
    2**-64 for each question to the index. Lines of one document alone are counted, not indexed.
    Shards and pages are bounded, so tasks hold one shard's arrays or one page's
    answers. Texts move only to take their drops, and not even then where Spark finds
    the stored drops small enough to send to the tasks.
    """
    if least < 2:
        raise ValueError("a line is common from two documents on")
    with scratch(docs.sparkSession) as store:
        paged = store(pages(docs, chars), "pages")
        repeated = store(repeated_lines(paged), "repeated")
        asked = paged.agg(F.sum(F.length("digests") / 16)).first()[0] or 0
        shards = max(SHARDS, -(-int(asked) // SHARD))
        index = store(build_index(repeated, shards), "index")
        answered = store(answers(index, questions(paged, shards), least), "answers")
        drops = materialize(dropped_lines(paged, answered), "drops")

    def apply(batches):
        for batch in batches:
            out = []
            for doc, text, lost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "drops")), strict=True):
                if not lost:
                    out.append((doc, text.count("\n") + 1, 0, text))
                    continue
                gone = {lost[i : i + 16] for i in range(0, len(lost), 16)}
                lines = text.encode().split(b"\n")
                stay = [x for x in lines if line_digest(x, chars) not in gone]
                out.append((doc, len(lines), len(lines) - len(stay), b"\n".join(stay).decode()))
            if out:
                yield arrow(KEPT, *zip(*out, strict=True))

    rows = docs.select(row_key(docs["doc_id"], docs["text"]).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(drops, "row", "left").select("doc_id", "text", "drops").mapInArrow(apply, KEPT)
