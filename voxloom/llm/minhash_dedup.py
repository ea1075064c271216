"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

1.  One pass over the texts gives each document its number of distinct word shingles, a fingerprint of
    the set, and a signature of ``SYMBOLS`` b-bit symbols (b = 16), the minima under as many hash
    functions.  Documents with equal sets are folded into one class at once.
2.  Pigeonhole: the signature is split into ``CHUNKS`` chunks.  Two signatures that differ in at most
    ``DISTANCE`` symbols have a chunk with at most one error, as 13 chunks of two errors each make 26.
    Each chunk is therefore entered under every deletion of one of its symbols: pairs within the
    distance share a key, without exception.  (Errors in such a chunk: none or one.)
3.  Buckets of equal members are kept once.  Within a bucket, signatures are compared in blocks, and
    only a spanning forest of the pairs within the distance is emitted: candidate clusters are its
    components, so nothing grows with the square of a group.
4.  Within a cluster the texts meet in blocks of at most ``BLOCK`` and a few landmarks that all blocks
    share.  All pairs within the distance that are not yet connected are verified on the full shingle
    sets.  If a cluster of several blocks is then in several components, the documents outside its
    largest component are held against all others the same way, block by block.
5.  Verified links give the components.

At a Jaccard similarity of exactly 0.8 a pair differs in 12.8 of 64 symbols on average, with a standard
deviation of 3.2; more than 25 come once in ten thousand such pairs, and rarer above 0.8.

Scale.  Rows that carry texts are shuffled only for documents in clusters.  A bucket or cluster of any
size is cut into blocks.  Tables needed twice are checkpointed.

Links are confirmed on the full sets of 64-bit hashes of shingles.

Edge cases.  Null and empty texts and texts without words have an empty set and link with nothing; a
text with fewer words than the shingle width is one shingle.  Rows that repeat a doc_id are rows of
their own: each has the component of its own text.  Rows whose doc_id is null link with nothing, have
a null component and are kept by ``near_duplicates``; ``deduplicated`` groups them like any other.  An
empty table gives an empty result.  Extra columns are carried along by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.arrow import runs
from voxloom.llm import textkernels as tk
from voxloom.llm.common import keyed, small_batches, union_find
from voxloom.operators.graph import components
from voxloom.session import checked_broadcast, durable, written

SYMBOLS, CHUNKS, DISTANCE = 64, 13, 25
#: Documents of a block of a cluster; signatures of a block of a bucket; landmarks of a cluster, about.
BLOCK, BUCKET_BLOCK, LANDMARKS = 512, 2048, 32
WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100

_RNG = np.random.Generator(np.random.PCG64(64_000_064))
_A = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_BOUNDS = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(int)


# --- signatures and keys -----------------------------------------------------------------------


def signature_batch(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: size of its set, two fingerprints of the set, and its (SYMBOLS,) 16-bit symbols."""
    count = np.zeros(len(column), np.int64)
    fingerprints = np.zeros((2, len(column)), np.uint64)
    symbols = np.zeros((len(column), SYMBOLS), np.uint16)
    for row, end, offs, data in tk.chunks(column):
        values, at = tk.shingles(tk.Words(offs, data), width)
        distinct = [np.unique(values[at[i] : at[i + 1]]) for i in range(end - row)]
        sizes = np.array([len(d) for d in distinct])
        count[row:end] = sizes
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        everything = np.concatenate([distinct[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        fingerprints[0, row + full] = np.add.reduceat(tk.mix(everything ^ _A[0]), starts)
        fingerprints[1, row + full] = np.add.reduceat(tk.mix(everything ^ _A[1]), starts)
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(everything * _A[k] + _B[k], starts)
            symbols[row + full, k] = (tk.mix(low) >> tk.U64(48)).astype(np.uint16)
    return count, fingerprints[0], fingerprints[1], symbols


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """(rows, keys): each chunk under each deletion of one of its symbols."""
    out = []
    wide = symbols.astype(np.uint64)
    for c in range(CHUNKS):
        start, end = _BOUNDS[c], _BOUNDS[c + 1]
        for gone in range(start, end):
            key = np.full(len(symbols), c * SYMBOLS + gone + 1, np.uint64)
            for j in range(start, end):
                if j != gone:
                    key = tk.mix(key * tk.BASE + wide[:, j])
            out.append(key)
    return np.stack(out, 1)


def _symbols(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SYMBOLS)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, f1, f2, symbols) of each row (doc_id, text)."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, symbols = signature_batch(batch.column(1), width)
            raw = [row.tobytes() for row in symbols]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "n", "f1", "f2", "symbols"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(signed, f"doc_id {kind}, n long, f1 long, f2 long, symbols binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): the entries of the multi-index."""

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(_symbols(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))], names=["key", "rep"])

    return classes.select("rep", "symbols").mapInArrow(entered, f"key long, rep {classes.schema['rep'].dataType.simpleString()}")


# --- candidate clusters ------------------------------------------------------------------------


def _close(symbols: np.ndarray, n: np.ndarray, rows: slice, numerator: int, denominator: int) -> np.ndarray:
    """Whether each row of ``rows`` and each row of all may be linked: by distance and by the sizes of their sets."""
    part = symbols[rows]
    out = np.empty((len(part), len(symbols)), bool)
    for i in range(0, len(part), 32):
        apart = (part[i : i + 32, None, :] != symbols[None]).sum(2, dtype=np.uint8)
        out[i : i + 32] = apart <= DISTANCE
    small, large = np.minimum(n[rows, None], n[None]), np.maximum(n[rows, None], n[None])
    return out & (denominator * small >= numerator * large)


def _forest(close: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, other) edges that connect what a symmetric matrix connects."""
    free = np.ones(len(close), bool)
    for root in range(len(close)):
        if free[root]:
            free[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(close[front].any(0) & free)
                free[front] = False
                for i in front:
                    yield root, int(i)


def _blocked(df: DataFrame, group: str, member: str, count: str, size: int) -> DataFrame:
    """Adds i <= j, for each pair of blocks that the member takes part in; groups of up to ``size`` are one block."""
    blocks = F.ceil(F.col(count) / size)
    df = df.withColumn("__own", F.pmod(F.xxhash64(member, group), blocks)).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return df.withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other")).drop("__own", "__other")


def candidate_edges(classes: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of classes within the distance."""
    keys = index_keys(classes)
    kind = classes.schema["rep"].dataType.simpleString()
    buckets = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("lo < hi")
    buckets = durable(buckets.groupBy("lo", "hi", "c", "x").agg(F.min("key").alias("key")))
    pairs = buckets.where("c = 2").select("key", "c", F.explode(F.array("lo", "hi")).alias("rep"))
    wanted = checked_broadcast(buckets.where("c > 2").select(F.col("key").alias("__key"), "c"))
    members = keys.join(wanted, F.col("key") == F.col("__key")).select("key", "c", "rep").union(pairs)
    members = members.join(classes.select(F.col("rep").alias("__rep"), "n", "symbols"), F.col("rep") == F.col("__rep"))
    members = _blocked(members, "key", "rep", "c", BUCKET_BLOCK).withColumn("__group", F.xxhash64("key", "i", "j"))
    members = members.repartition("__group").sortWithinPartitions("__group").select("__group", "rep", "n", "symbols")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for table in runs(batches, ["__group"]):
            ids, n, symbols = table.column("rep").to_numpy(), table.column("n").to_numpy(), _symbols(table.column("symbols"))
            for i, j in _forest(_close(symbols, n, slice(None), numerator, denominator)):
                src.append(ids[i])
                dst.append(ids[j])
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
                src, dst = [], []
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return members.mapInArrow(linked, f"src {kind}, dst {kind}").where("src != dst")


# --- verification ------------------------------------------------------------------------------


def verified(table: pa.Table, width: int, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows (rep, n, symbols, text, comp) of a block.

    Rows of one comp count as connected; only pairs across are verified, on their full sets, nearest first.
    """
    ids, n, symbols = table.column("rep").to_numpy(), table.column("n").to_numpy(), _symbols(table.column("symbols"))
    comp = table.column("comp").to_numpy()
    find, join = union_find(len(ids))
    first: dict[int, int] = {}
    for i, c in enumerate(comp.tolist()):
        join(first.setdefault(c, i), i)
    close = _close(symbols, n, slice(None), numerator, denominator)
    left, right = np.nonzero(np.triu(close & (comp[:, None] != comp[None]), 1))
    if not len(left):
        return []
    apart = np.concatenate([(symbols[left[i : i + 4096]] != symbols[right[i : i + 4096]]).sum(1) for i in range(0, len(left), 4096)])
    needed = np.unique(np.concatenate([left, right]))
    texts = table.column("text").combine_chunks().take(pa.array(needed))
    own = {int(needed[i]): values for i, values in tk.sets(texts, width)}
    out = []
    order = np.argsort(apart, kind="stable")
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if find(i) != find(j):
            a, b = own[i], own[j]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if denominator * both >= numerator * (len(a) + len(b) - both):
                join(i, j)
                out.append((ids[i], ids[j]))
    return out


def _verify(blocks: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    kind = blocks.schema["rep"].dataType.simpleString()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["__group"]):
            edges = verified(table, width, numerator, denominator)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["src", "dst"])

    blocks = blocks.repartition("__group").sortWithinPartitions("__group", "rep").select("__group", "rep", "n", "symbols", "comp", "text")
    return blocks.mapInArrow(checked, f"src {kind}, dst {kind}")


def links(docs: DataFrame, classes: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """(src, dst) verified links that connect all classes which any chain of links connects."""
    roots = components(candidate_edges(classes, numerator, denominator))
    clusters = roots.union(roots.select(F.col("root").alias("id"), "root").distinct()).withColumnsRenamed({"id": "rep", "root": "cluster"})
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("c"))
    members = durable(clusters.join(sizes, "cluster"))

    def with_texts(chosen: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("__id"), "text").join(checked_broadcast(chosen), F.col("__id") == F.col("rep")).drop("__id")
        return texts.join(classes.select(F.col("rep").alias("__rep"), "n", "symbols"), F.col("rep") == F.col("__rep")).drop("__rep")

    blocks = F.ceil(F.col("c") / BLOCK)
    own = F.pmod(F.xxhash64("rep", "cluster"), blocks)
    landmark = F.pmod(F.xxhash64(F.lit(1), "rep"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("c") / LANDMARKS))) == 0
    spread = F.when(landmark, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))
    diagonal = with_texts(members).withColumn("block", F.explode(spread)).withColumn("__group", F.xxhash64("cluster", "block")).withColumn("comp", F.xxhash64("rep"))
    found = durable(_verify(diagonal, width, numerator, denominator))
    if members.where(F.col("c") > BLOCK).limit(1).count() == 0:
        return found

    # Clusters of several blocks that are not one component yet: all outside the largest, against all others.
    known = components(found).withColumnsRenamed({"id": "__rep", "root": "comp"})
    large = members.where(F.col("c") > BLOCK).join(known, F.col("rep") == F.col("__rep"), "left").select("cluster", "c", "rep", F.coalesce("comp", "rep").alias("comp"))
    parts = large.groupBy("cluster", "c", "comp").agg(F.count("*").alias("k"))
    largest = parts.groupBy("cluster", "c").agg(F.max(F.struct("k", "comp")).alias("m")).select(F.col("cluster").alias("__cluster"), F.col("m.comp").alias("most"), (F.col("c") - F.col("m.k")).alias("others")).where("others > 0")
    large = durable(large.join(largest, F.col("cluster") == F.col("__cluster")).select("rep", "cluster", "c", "comp", "most", "others"))
    if large.limit(1).count() == 0:
        return found
    rest = with_texts(large)
    outer, inner = F.ceil(F.col("others") / BLOCK), F.ceil(F.col("c") / BLOCK)
    as_outer = rest.where("comp != most").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(2)), outer)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), inner - 1)))
    as_inner = rest.withColumn("j", F.pmod(F.xxhash64("rep", F.lit(3)), inner)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), outer - 1)))
    both = as_outer.unionByName(as_inner).withColumn("__group", F.xxhash64("cluster", "i", "j"))
    return found.union(_verify(both, width, numerator, denominator))


def _grouped(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """As ``near_duplicates``, of rows whose ids repeat nowhere but for null."""
    small_batches(docs.sparkSession, 1024)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = durable(signatures(docs, width))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("symbols").alias("symbols"))
    classes = durable(classes)
    roots = components(links(docs, classes, width, numerator, denominator))
    named = classes.join(roots, F.col("rep") == F.col("id"), "left").select(F.col("n").alias("__n"), F.col("f1").alias("__f1"), F.col("f2").alias("__f2"), F.coalesce("root", "rep").alias("root"))
    rows = signed.select("doc_id", "n", "f1", "f2")
    out = rows.join(named, (F.col("n") == F.col("__n")) & (F.col("f1") == F.col("__f1")) & (F.col("f2") == F.col("__f2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row (doc_id, text).

    Links are pairs with denominator * intersection >= numerator * union of their sets of ``width``-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return _grouped(docs, width, numerator, denominator)
    # Ids repeat: rows are grouped by numbers of their own, and a component is named by the smallest id in it.
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()))
    found = _grouped(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), width, numerator, denominator)
    found = durable(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component")))
    ids = found.where("row is not null").join(rows.select("row", "doc_id"), "row")
    names = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = ids.join(names, "component").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(found.where("row is null").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def deduplicated(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """One row of each component: that of the smallest id, a null id after all others; rows without words all stay.

    Decided row by row, also where ids repeat or are null: of equal rows one stays.
    """
    rows, are_ids = keyed(docs)
    found = near_duplicates_of_rows(rows, width, numerator, denominator)
    if not are_ids:
        found = durable(found)
        ids = rows.select(F.col("key").alias("__key"), F.col("row.doc_id").alias("id"))
        first = found.join(ids, F.col("key") == F.col("__key")).groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))["key"].alias("first"))
        found = found.join(first, "component").select("key", F.col("first").alias("component"))
    gone = checked_broadcast(durable(found.where("key != component").select(F.col("key").alias("__gone"))))
    return rows.join(gone, F.col("key") == F.col("__gone"), "left_anti").select("row.*")


def near_duplicates_of_rows(rows: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """(key, component) of each of the rows (key, row) that has words; a component is named by its smallest key."""
    found = _grouped(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), width, numerator, denominator)
    return found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"))
