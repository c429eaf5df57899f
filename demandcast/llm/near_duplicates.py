"""Classes of near-duplicate documents from order MinHash candidates and verified links."""

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import arrow
from demandcast.llm.components import components
from demandcast.llm.order_minhash import (
    aligned,
    digest,
    least_common,
    occurrence_labelled,
    shingle_hashes,
    shingles_of,
    similar,
    sketch,
    word_hashes,
)
from demandcast.session import materialize

SKETCHED = "doc_id bigint, node binary, keys array<bigint>"
VALUES = "node binary, size int, least array<bigint>"
LINK = "a binary, b binary"
#: Shingles that the comparison inside a bucket has of a text: all in their order of
#: most texts, else the least labelled ones. Of those, pairs at 0.8 share 0.8 on
#: average; five standard deviations less are asked for.
KEPT, ENOUGH = 2048, 0.755
#: Rows of a block with one value up to which their pairs are listed.
RARE = 16
#: Rows of one block of a bucket's comparison.
BLOCK = 1000


def node(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, keys) of every whole text; texts without a word have no keys."""

    def draw(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = [sketch(shingle_hashes(word_hashes(t))) for t in texts]
            yield arrow(SKETCHED, batch.column("doc_id"), [digest(t) for t in texts], keys)

    return docs.select("doc_id", "text").mapInArrow(draw, SKETCHED)


def shared_buckets(sketched: DataFrame) -> DataFrame:
    """(key, node) of every key that several texts have."""
    spread = sketched.dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    spread = materialize(spread, "keys")
    full = materialize(spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    return materialize(spread.join(full, "key"), "members")


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every text with the text of each of its buckets that has the most company.

    The text whose buckets are fullest is likely to be the one that the others were
    made from, so that few of its links fail.
    """
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    known = members.select("key", "node").join(company, "node")
    heads = known.groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("head"))
    heads = materialize(heads, "heads")
    pairs = members.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose alignment reaches the similarity."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("two")), "b")

    def align(batches):
        last, other, bag = None, [], Counter()
        for batch in batches:
            keep = []
            for one, b, two in zip(*(batch.column(n).to_pylist() for n in ("one", "b", "two")), strict=True):
                if b != last:
                    last, other = b, shingles_of(two)
                    bag = Counter(other)
                mine = shingles_of(one)
                keep.append(similar(mine, other, (Counter(mine), bag)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "one", "two").mapInArrow(align, LINK)


def _values(texts: DataFrame) -> DataFrame:
    def least(batches):
        for batch in batches:
            found = [shingle_hashes(word_hashes(t)) for t in batch.column("text").to_pylist()]
            kept = [(x if len(x) <= KEPT else np.sort(occurrence_labelled(x))[:KEPT]).view(np.int64) for x in found]
            yield arrow(VALUES, batch.column("node"), [len(x) for x in found], kept)

    return texts.select("node", "text").mapInArrow(least, VALUES)


def _labels(row) -> np.ndarray:
    """The labelled shingles of a (class, size, least); texts past KEPT have them labelled already."""
    values = np.asarray(row[2], dtype=np.int64).view(np.uint64)
    return occurrence_labelled(values) if row[1] <= KEPT else values


def _label_set(row) -> set:
    """The same as a set. Where no shingle comes twice the labels are the shingles."""
    values = set(row[2])
    return values if len(values) == len(row[2]) else set(_labels(row).view(np.int64).tolist())


def close(rest, members):
    """Index pairs of two lists of (class, size, least) that may reach the similarity, classes apart;
    those with most in common come first."""
    names: dict = {}
    own = np.array([names.setdefault(x[0], len(names)) for x in (*rest, *members)])
    apart = own[: len(rest), None] != own[None, len(rest) :]
    if len(rest) * len(members) <= 256:
        rows, columns = [_label_set(x) for x in rest], [_label_set(x) for x in members]
        common = np.array([[len(x & y) for y in columns] for x in rows], dtype=np.float32)
    else:
        sets = [_labels(x) for x in (*rest, *members)]
        _, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        common = _rare(owner, index, (count[index] > 1) & (count[index] <= RARE), len(rest), len(members))
        often = count[index] > RARE
        owner, column = owner[often], (np.cumsum(count > RARE) - 1)[index[often]]
        for low in range(0, int(column.max(initial=-1)) + 1, 1024):
            part = (column >= low) & (column < low + 1024)
            grid = np.zeros((len(sets), 1024), dtype=np.float32)
            grid[owner[part], column[part] - low] = 1
            common += grid[: len(rest)] @ grid[len(rest) :].T
    n = np.array([x[1] for x in rest], dtype=np.float32)[:, None]
    m = np.array([x[1] for x in members], dtype=np.float32)[None, :]
    need = np.where(np.maximum(n, m) <= KEPT, 4 * (n + m) / 9, ENOUGH * KEPT)
    found = np.argwhere((common >= need - 1e-3) & (np.minimum(n, m) >= 0.8 * np.maximum(n, m)) & apart)
    return found[np.argsort(-common[found[:, 0], found[:, 1]], kind="stable")]


def _rare(owner, value, used, rest: int, members: int) -> np.ndarray:
    """How many of the used values each of `rest` rows shares with each of `members` rows.

    For values that few rows have: their pairs of rows are listed, not multiplied out.
    """
    owner, value = owner[used], value[used]
    first, order = owner < rest, np.argsort(value[owner >= rest], kind="stable")
    other, names = value[owner >= rest][order], owner[owner >= rest][order] - rest
    low = np.searchsorted(other, value[first], "left")
    n = np.searchsorted(other, value[first], "right") - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    cell = np.repeat(owner[first], n) * members + names[at]
    return np.bincount(cell, minlength=rest * members).reshape(rest, members).astype(np.float32)


def joining(pairs, first, second):
    """The pairs, most alike first, that join classes which no pair before them has joined.

    `first` and `second` are lists of (class, size, shingles). Where both shingles
    are complete a pair must also hold in the alignment, else the next one is tried.
    Other pairs are all given out and join nothing here: they are aligned later.
    """
    head: dict = {}

    def find(x):
        top = x
        while head.get(top, top) != top:
            top = head[top]
        while x != top:
            head[x], x = top, head[x]
        return top

    for i, j in pairs:
        (one, n, x), (two, m, y) = first[i], second[j]
        a, b = find(one), find(two)
        if a == b:
            continue
        if max(n, m) > KEPT:
            yield i, j
        elif aligned(x, y) >= least_common(n + m):
            head[a] = b
            yield i, j


def rest_pairs(members: DataFrame, classes: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b): pairs of one bucket in different classes whose links would join what may belong together.

    In every bucket, the texts outside of its largest class are compared with all
    of its texts, in blocks, by their labelled shingles. Of the pairs that are or
    may be similar a block gives out those that join its classes, so their number
    follows the texts, not the pairs (but for pairs of texts past KEPT shingles in
    different classes).
    """
    known = members.select("key", "node").join(classes, "node", "left")
    known = known.withColumn("class", F.coalesce("component", "node")).select("key", "node", "class")
    known = materialize(known, "known")
    sizes = known.groupBy("key", "class").count()
    mixed = sizes.groupBy("key").agg(
        F.count("*").alias("classes"), F.sum("count").alias("n"), F.max(F.struct("count", "class")).alias("top")
    )
    mixed = mixed.where("classes > 1").select("key", "n", (F.col("n") - F.col("top.count")).alias("r"), F.col("top.class").alias("main"))
    rows = known.join(materialize(mixed, "mixed"), "key").join(values, "node")
    across = F.ceil(F.col("n") / BLOCK).cast("int")
    down = F.ceil(F.col("r") / BLOCK).cast("int")

    def dealt(part, own, other, rest):
        own_block = F.pmod(F.xxhash64("node"), own).cast("int")
        blocks = F.explode(F.sequence(F.lit(0), other - 1))
        part = part.withColumn("own", own_block).withColumn("other", blocks).withColumn("rest", F.lit(rest))
        first, second = ("own", "other") if rest else ("other", "own")
        names = ("rest", "node", "class", "size", "least")
        return part.select("key", F.col(first).alias("x"), F.col(second).alias("y"), *names)

    both = dealt(rows.where("class <> main"), down, across, True).unionByName(dealt(rows, across, down, False))
    both = both.repartition(F.col("key"), F.col("x"), F.col("y")).sortWithinPartitions("key", "x", "y")

    def compare(batches):
        def rows_of():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out = []
        for _, group in groupby(rows_of(), key=lambda r: r[:3]):
            sides = ([], [])
            names = ([], [])
            for _, _, _, rest, name, own, size, least in group:
                sides[rest].append((own, size, least))
                names[rest].append(name)
            if sides[0] and sides[1]:
                pairs = close(sides[1], sides[0]).tolist()
                for i, j in joining(pairs, sides[1], sides[0]):
                    out.append((min(names[1][i], names[0][j]), max(names[1][i], names[0][j])))
            if len(out) > 10_000:
                yield arrow(LINK, *zip(*sorted(set(out)), strict=True))
                out = []
        if out:
            yield arrow(LINK, *zip(*sorted(set(out)), strict=True))

    return both.mapInArrow(compare, LINK).distinct()


def link_classes(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, component) of every text that is linked with another one."""
    members = shared_buckets(sketched)
    wanted = members.select("node").distinct()
    texts = docs.select(node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("node").agg(F.first("text").alias("text")).join(wanted, "node", "left_semi")
    texts = materialize(texts, "texts")
    found = materialize(components(verified(star_pairs(members), texts)), "classes")
    values = materialize(_values(texts), "values")
    more = materialize(verified(rest_pairs(members, found, values), texts), "links")
    return found if more.isEmpty() else materialize(merged(found, more), "classes")


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The classes (node, component) joined along further links (a, b); nodes without a class are one by themselves.

    A class enters the components as its least node, which names it, so their work follows
    the links and not the nodes linked before.
    """
    for end in ("a", "b"):
        known = found.select(F.col("node").alias(end), "component")
        more = more.join(known, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = materialize(components(more, "joined"), "joined")
    heads = joined.withColumnRenamed("node", "component")
    old = found.join(heads, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    new = joined.join(found, "node", "left_anti").select("node", F.col("joined").alias("component"))
    return old.unionByName(new)


def classes(docs: DataFrame) -> DataFrame:
    """(node, doc_id, class_id, class_node) of every distinct text.

    doc_id is the least of the text's documents, class_id that of its class, which
    class_node has. Null ids count as greater than all others.
    """
    sketched = materialize(sketches(docs), "sketches")
    linked = link_classes(docs, sketched)
    texts = sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = texts.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    texts = materialize(texts, "texts")
    heads = materialize(texts.groupBy("component").agg(F.min(order).alias("head")), "heads")
    out = texts.join(heads, "component")
    return out.select("node", "doc_id", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): every document with the least doc_id of its class.

    Classes are connected components of links. Equal texts (null as empty) are
    linked, and texts of which an alignment pairs up at least 0.8 of all their
    five-word shingles; texts with fewer words have one shingle. Texts without a
    word are linked with equal ones alone. Repeated rows give repeated rows, an
    empty table an empty one; other columns are left out.

    Copies of a text are one node. Candidates share an order MinHash key; in each
    bucket every text is held against one, then what stays apart is compared with
    the bucket in blocks. Buckets' joins are plain equality joins of stored tables,
    whose hot keys adaptive execution splits.
    """
    rows = docs.select("doc_id", node(F.col("text")).alias("node"))
    return rows.join(classes(docs).select("node", "class_id"), "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class: the one with the least doc_id, unchanged."""
    known = materialize(classes(docs).where("node = class_node").select("node"), "kept")
    whole = F.struct(*docs.columns)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    rows = docs.groupBy(node(F.col("text")).alias("node")).agg(F.min_by(whole, order).alias("row"))
    return rows.join(known, "node", "left_semi").select("row.*")
