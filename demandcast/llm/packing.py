"""Best-fit packing planned on the histogram of lengths."""

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.tokens import array_slices, encoder
from demandcast.session import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLAN = "length bigint, first bigint, last bigint, each bigint, sequence bigint, place bigint"


@dataclass
class Alike:
    """`count` open sequences with the same lengths in them; slots are
    (length, first rank, pieces in each sequence, offset of the first)."""

    count: int
    slots: list[tuple[int, int, int, int]]
    used: int


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest lengths first, over counts of lengths.

    Sequences that hold the same lengths are one entry with a count, so the work
    and the plan depend on the number of distinct lengths (at most `size`), not on
    the number of pieces. Each length goes to the open sequences with the least
    room that fits, as many pieces in each as fit, then to new ones.

    Rows (length, first, last, each, sequence, place): pieces whose rank within
    their length is in [first, last) lie in sequences from `sequence` on, `each`
    in one, the first at offset `place`.
    """
    open_: dict[int, list[Alike]] = {}
    rooms: list[int] = []
    done: list[Alike] = []

    def keep(entry: Alike) -> None:
        room = size - entry.used
        if not entry.count:
            return
        if not room:
            done.append(entry)
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(entry)

    def fill(entry: Alike, length: int, rank: int, count: int, each: int) -> Alike:
        """The first `count` sequences of `entry` with `each` more pieces; they leave the entry."""
        slots = [*entry.slots, (length, rank, each, entry.used)]
        filled = Alike(count, slots, entry.used + each * length)
        entry.count -= count
        entry.slots = [(n, first + count * k, k, at) for n, first, k, at in entry.slots]
        return filled

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                entry = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, entry = size, Alike(left, [], 0)
            each = min(room // length, left)
            count = min(entry.count, left // each)
            keep(fill(entry, length, rank, count, each))
            if entry.used or entry.slots:
                keep(entry)
            rank, left = rank + count * each, left - count * each
    rows, sequence = [], 0
    for entry in [*done, *(x for group in open_.values() for x in group)]:
        rows += [(n, first, first + entry.count * k, k, sequence, at) for n, first, k, at in entry.slots]
        sequence += entry.count
    return rows


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, ids_crc32).

    A document is its tokens and `end_id`. One longer than `size` is cut into
    pieces of `size`; the first piece takes what is over. Null text is empty and
    gives one piece, the end id alone.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            for a, b in array_slices(batch.column("text")):
                ids, counts = encode(batch.column("text").slice(a, b - a))
                raw, at, rows = ids.tobytes(), 0, []
                for doc, n in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), counts.tolist(), strict=True):
                    own, total, start = raw[4 * at : 4 * (at + n)] + end, n + 1, 0
                    at += n
                    for piece in range(-(-total // size)):
                        stop = total - (-(-total // size) - piece - 1) * size
                        rows.append((doc, piece, start, stop - start, zlib.crc32(own[4 * start : 4 * stop])))
                        start = stop
                yield arrow(PIECES, *zip(*rows, strict=True))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Place stored pieces (rows with a `length` from 1 to `size`) into sequences.

    Adds sequence_id and offset; within a sequence offsets have no gaps. The
    histogram has at most `size` rows and is planned on the driver. Rows take
    planned slots by their rank within their length. No length is ranked in one
    task: rows are dealt by a hash of their keys into parts, ranked within
    (length, part), and the counts of the parts before are added. Which of the
    equally long pieces gets which slot follows the hash and the keys, so a run
    repeats; equal rows (repeated doc_id) take different slots in any order.
    """
    spark = cut.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(histogram, size), PLAN)
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    up_to = F.sum("count").over(Window.partitionBy("length").orderBy("part"))
    before = keyed.groupBy("length", "part").count().withColumn("before", up_to - F.col("count")).drop("count")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    fits = (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["first"]) & (ranked["rank"] < slots["last"])
    # The plan's size is bounded by the number of lengths, whatever the input.
    placed = ranked.join(F.broadcast(slots), fits).drop(slots["length"])
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div each"))
    placed = placed.withColumn("offset", F.expr("place + pmod(rank - first, each) * length"))
    return placed.select(*cut.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """All documents as pieces in as few sequences of at most `size` tokens as best fit gives.

    Empty table: no rows. Columns of `docs` besides doc_id and text are left out.
    """
    return pack(materialize(pieces(docs, path, size), "pieces"), size)
