"""Near-duplicate vectors: a robust-pruned flat graph, built on overlapping cluster shards.

1.  Vectors are checked and normalised in double precision; equal vectors of one label are folded
    into one with a count, so copies never meet each other again.
2.  Centres are fitted on a bounded sample of each label (``sample_sizes``, in hash order).  A vector's
    home is the shard of its label and nearest centre.  Of two linked vectors one is nearer than half
    the length of a link to the plane between their centres, so it may need the other's shard: a vector
    also joins the next nearest shards whose plane is so near, ``NEAR`` in all, and up to ``OVERLAP`` in
    all of those whose centre is within ``RADIUS``, as in dense groups that many shards part.
3.  Each shard builds a graph by inserting its vectors in doubling batches: a batched greedy search
    from the medoid finds candidates, which are pruned robustly (``DEGREE``, ``ALPHA``), and edges are
    made mutual.
4.  The adjacency lists of all shards are united.  A shard's searchable graph has its members and, as
    leaves, the neighbours within reach of a link that its members got in other shards.
5.  Each vector is searched in its home shard: greedily from the medoid, then, where the search ends
    in range, by expanding through all vertices within a slack of the range.  Hits are verified by
    their exact cosine.
6.  Nothing emits all pairs of a shard: a task emits a count for each vector, a spanning forest of its
    links, and pairs only where an end lies outside the other's home shard.

A shard holds some ``SHARD`` vectors of one label (times ``NEAR``, in dense groups ``OVERLAP``) while a label has at most
``CENTRES`` times that many and all labels together a quarter of ``SAMPLE_ALL`` times that many; beyond,
centres are dealt by the labels' counts, and shards grow with the data, as do those of labels after the
``LABELS`` largest, which are one shard each.

Edge cases.  Vectors that are null, empty, zero or hold null or non-finite components, and rows whose
label is null, link with nothing.  Vectors of different lengths never link.  Rows that repeat an id and a vector count
as so many vectors and share a component.  Rows whose id is null link with nothing and have a
null component.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxloom.arrow import runs
from voxloom.llm.common import small_batches, union_find
from voxloom.operators.graph import components
from voxloom.session import durable

THRESHOLD = 0.93
#: Vectors of a shard, centres of a label at most, vectors of a label that its centres are fitted on (four a centre if that is more).
SHARD, CENTRES, SAMPLE = 750, 4096, 4000
#: Vectors that centres are fitted on, of all labels together; labels that are cut into shards at most (the largest).
SAMPLE_ALL, LABELS = 1 << 16, 4096
#: Shards that a vector joins if its halved link crosses over, and at most if their centres are within the radius.
NEAR, OVERLAP, RADIUS = 4, 16, 0.8
DEGREE, BEAM, ALPHA = 16, 32, 1.2
#: Vertices so far below the threshold still pass the expansion on.
SLACK = 0.05


# --- the graph, on a matrix of unit rows -------------------------------------------------------


def greedy(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Batched greedy search: (queries, beam) best vertices found, by falling cosine, and those cosines."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    sims = np.full((n, beam), -np.inf)
    done = np.ones((n, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, queries @ unit[start], False
    rows = np.arange(n)
    while True:
        open_sims = np.where(done, -np.inf, sims)
        at = open_sims.argmax(1)
        active = rows[open_sims[rows, at] > -np.inf]
        if not len(active):
            return ids, sims
        done[active, at[active]] = True
        near = edges[ids[active, at[active]]]
        known = (near < 0) | (near[:, :, None] == ids[active][:, None, :]).any(2)
        got = np.einsum("qd,qrd->qr", queries[active], unit[np.maximum(near, 0)])
        got[known] = -np.inf
        near = np.where(known, -1, near)
        all_ids = np.concatenate([ids[active], near], 1)
        all_sims = np.concatenate([sims[active], got], 1)
        all_done = np.concatenate([done[active], known], 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        sims[active] = np.take_along_axis(all_sims, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)


def _distinct(pools: np.ndarray) -> np.ndarray:
    """The rows sorted, with -1 for what repeats."""
    pools = np.sort(pools, 1)
    pools[:, 1:][pools[:, 1:] == pools[:, :-1]] = -1
    return pools


def prune(unit: np.ndarray, points: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each point's row of candidates (-1: none), nearest first: keep one, drop those that it serves alpha times better, and go on."""
    out = np.full((len(points), degree), -1)
    n = np.zeros(len(points), int)
    vectors = unit[np.maximum(pools, 0)]
    far = 2 - 2 * np.einsum("pkd,pd->pk", vectors, unit[points])
    far[(pools < 0) | (pools == points[:, None])] = np.inf
    order = np.argsort(far, 1, kind="stable")
    pools, far = np.take_along_axis(pools, order, 1), np.take_along_axis(far, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
    alive = far < np.inf
    for k in range(pools.shape[1]):
        at = np.flatnonzero(alive[:, k] & (n < degree))
        out[at, n[at]] = pools[at, k]
        n[at] += 1
        alive[at] &= alpha * alpha * between[at, k] > far[at]
    return out


def _pruned(unit: np.ndarray, points: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """``prune`` in parts of bounded memory, the longest rows of candidates first."""
    out = np.full((len(points), degree), -1)
    pools = np.sort(pools, 1)[:, ::-1]
    sizes = (pools >= 0).sum(1)
    order = np.argsort(-sizes, kind="stable")
    done = 0
    while done < len(order):
        width = max(1, int(sizes[order[done]]))
        part = order[done : done + max(1, (1 << 21) // (width * (width + unit.shape[1])))]
        out[part] = prune(unit, points[part], pools[part, :width], degree, alpha)
        done += len(part)
    return out


def medoid(unit: np.ndarray) -> int:
    return int((unit @ unit.mean(0)).argmax())


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency lists (n, degree), -1 where there is no edge, of a graph over the rows of ``unit``."""
    n = len(unit)
    edges = np.full((n, degree), -1)
    order = np.random.Generator(np.random.PCG64(7)).permutation(n)
    start = medoid(unit)
    order = np.concatenate([[start], order[order != start]])
    built = 1
    while built < n:
        batch = order[built : min(n, 2 * built, built + 512)]
        found, _ = greedy(unit, edges, unit[batch], start, beam)
        mates = unit[batch] @ unit[batch].T
        np.fill_diagonal(mates, -np.inf)
        close = np.argsort(-mates, 1)[:, : min(4, len(batch) - 1)]
        edges[batch] = _pruned(unit, batch, _distinct(np.concatenate([found, batch[close]], 1)), degree, alpha)
        # Back along the new edges: each vertex that they name has its own list and those who name it to choose from.
        row, slot = np.nonzero(edges[batch] >= 0)
        named = edges[batch][row, slot]
        order_in = np.argsort(named, kind="stable")
        named, asking = named[order_in], batch[row[order_in]]
        targets, first, count = np.unique(named, return_index=True, return_counts=True)
        pools = np.full((len(targets), degree + int(count.max(initial=0))), -1)
        pools[:, :degree] = edges[targets]
        pools[np.repeat(np.arange(len(targets)), count), degree + np.arange(len(named)) - np.repeat(first, count)] = asking
        pools = _distinct(pools)
        full = (pools >= 0).sum(1) > degree
        edges[targets[~full]] = -np.sort(-pools[~full], 1)[:, :degree]
        edges[targets[full]] = _pruned(unit, targets[full], pools[full], degree, alpha)
        built += len(batch)
    return edges


def mutual(edges: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each vertex along its own edges and against those of others.

    Pruning to a fixed degree leaves vertices of dense groups that no list names; backwards they are reached.
    """
    src, slot = np.nonzero(edges >= 0)
    dst = edges[src, slot]
    both = np.unique(np.concatenate([src * len(edges) + dst, dst * len(edges) + src]))
    return np.split(both % len(edges), np.searchsorted(both, np.arange(1, len(edges)) * len(edges)))


def within(unit: np.ndarray, near: list[np.ndarray], query: np.ndarray, seeds: np.ndarray, threshold: float, slack: float) -> np.ndarray:
    """Vertices with cosine >= threshold that an expansion from ``seeds`` through the slack reaches."""
    seen = np.zeros(len(unit), bool)
    hits = []
    front = np.unique(seeds)
    while len(front):
        seen[front] = True
        sims = unit[front] @ query
        hits.append(front[sims >= threshold])
        onward = front[sims >= threshold - slack]
        reached = np.zeros(len(unit), bool)
        for i in onward:
            reached[near[i]] = True
        front = np.flatnonzero(reached & ~seen)
    return np.concatenate(hits) if hits else np.zeros(0, int)


# --- shards ------------------------------------------------------------------------------------


def _matrix(table: pa.Table, column: str = "unit") -> np.ndarray:
    data = table.column(column).combine_chunks()
    width = len(data[0]) if len(data) else 0
    return data.flatten().to_numpy(zero_copy_only=False).reshape(len(data), width)


def _centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """k-means, seeded far apart so that a dense group of near copies gets about one centre."""
    rng = np.random.Generator(np.random.PCG64(11))
    centres = vectors[rng.integers(len(vectors))][None]
    far = 2 - 2 * (vectors @ centres[0])
    while len(centres) < k:
        chance = np.maximum(far, 0) ** 2
        if chance.sum() <= 1e-12:
            break
        new = vectors[rng.choice(len(vectors), p=chance / chance.sum())]
        centres = np.concatenate([centres, new[None]])
        far = np.minimum(far, 2 - 2 * (vectors @ new))
    for _ in range(8):
        own = np.concatenate([(part @ centres.T - (centres**2).sum(1) / 2).argmax(1) for part in np.array_split(vectors, math.ceil(len(vectors) / 4096))])
        centres = np.stack([vectors[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def sample_sizes(counts: dict, least: int = 64) -> dict:
    """How many vectors of each label centres are fitted on, ``SAMPLE_ALL`` in all besides the ``least`` of each.

    Each label asks for four vectors a centre; what is over is shared evenly, up to ``SAMPLE`` a label.
    """
    asked = {label: 4 * min(CENTRES, math.ceil(count / SHARD)) for label, count in counts.items()}
    total = max(1, sum(asked.values()))
    even = min(SAMPLE, max(0, SAMPLE_ALL - total) // max(1, len(counts)))
    return {label: max(least, even, n * min(SAMPLE_ALL, total) // total) for label, n in asked.items()}


def nearest_shards(centres: np.ndarray, vector: np.ndarray, reach: float) -> np.ndarray:
    """The nearest centre, and those of the next ones whose parting plane is within ``reach``: ``NEAR`` in all, or within ``RADIUS`` ``OVERLAP``."""
    score = centres @ vector - (centres**2).sum(1) / 2
    near = np.argsort(-score, kind="stable")[:OVERLAP]
    apart = np.sqrt(((centres[near] - centres[near[0]]) ** 2).sum(1))
    joins = score[near[0]] - score[near] <= reach * apart + 1e-9
    joins[NEAR:] &= (vector @ vector - 2 * score[near[NEAR:]]) <= RADIUS**2
    return near[joins]


def _unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length 1, or None if it cannot be compared; scaled first, so that squares neither overflow nor vanish."""
    top = np.abs(values).max(initial=0.0)
    if not 0 < top < np.inf:  # also false where a component is not a number
        return None
    values = values / top
    return values / np.sqrt((values * values).sum())


def _units(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, unit): unit is null where the vector is unusable."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, label, vector in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                usable = vec_id.is_valid and label.is_valid and vector.is_valid
                unit = _unit(vector.values.cast(pa.float64()).to_numpy(zero_copy_only=False)) if usable else None
                out.append(None if unit is None else unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "label", "unit"])

    kind = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, label {embeddings.schema['label'].dataType.simpleString()}, unit array<double>"
    return embeddings.select("vec_id", "label", "embedding").mapInArrow(scaled, kind)


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(label, unit, vec_id, copies) of the usable vectors: equal ones of a label folded, the smallest id kept."""
    unit = _units(embeddings).where("unit is not null")
    return unit.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count("vec_id").alias("copies"))


def shards(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(label, vec_id, unit, copies, home, shards): the vectors with their home shard and all their shards."""
    half = math.sqrt(2 - 2 * threshold) / 2
    spark = points.sparkSession
    wide = points.groupBy("label").count().where(F.col("count") > SHARD).orderBy(F.desc("count"), "label").limit(LABELS)
    counts = {r[0]: r[1] for r in wide.collect()}
    centres = {}
    if counts:
        shares = [(label, n / counts[label]) for label, n in sample_sizes(counts).items()]
        dealt = spark.createDataFrame(shares, StructType([points.schema["label"], StructField("share", DoubleType())]))
        few = points.select("label", "vec_id", "unit", (F.xxhash64("vec_id") / 2.0**63).alias("u")).join(F.broadcast(dealt), "label")
        sample = few.where(F.col("u") < 2 * F.col("share") - 1).select("label", "vec_id", "unit").toArrow().sort_by("vec_id")
        labels = np.array(sample.column("label").to_pylist(), object)
        for label, count in counts.items():
            own = [np.array(v.values) for v in sample.filter(pa.array(labels == label)).column("unit")]
            own = [v for v in own if len(v) == len(own[0])]
            if own:
                centres[label] = _centres(np.array(own), min(CENTRES, math.ceil(count / SHARD), max(1, len(own) // 4)))
    shared = spark.sparkContext.broadcast(centres)
    label_type = points.schema["label"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            homes, all_shards = [], []
            for label, vector in zip(labels, batch.column("unit"), strict=True):
                middle = shared.value.get(label)
                vector = vector.values.to_numpy()
                if middle is None or middle.shape[1] != len(vector):
                    homes.append(0)
                    all_shards.append([0])
                    continue
                near = nearest_shards(middle, vector, half)
                homes.append(int(near[0]))
                all_shards.append([int(c) for c in near])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("vec_id"), batch.column("unit"), batch.column("copies"), pa.array(homes, pa.int32()), pa.array(all_shards, pa.list_(pa.int32()))],
                names=["label", "vec_id", "unit", "copies", "home", "shards"],
            )

    kind = f"label {label_type}, vec_id {points.schema['vec_id'].dataType.simpleString()}, unit array<double>, copies long, home int, shards array<int>"
    return points.mapInArrow(placed, kind)


def _group(df: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of one shard together in one partition, in a fixed order; __group tells shards (and vector lengths) apart."""
    df = df.withColumn("__group", F.xxhash64("label", "shard", F.size("unit")))
    return df.repartition("__group").sortWithinPartitions("__group", "vec_id").select("__group", *extra)


def adjacency(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, near, close): each vector's united adjacency list over the graphs of all its shards, and what of it is linked or within the slack."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["__group"]):
            ids, unit = table.column("vec_id").to_numpy(), _matrix(table)
            edges = build(unit)
            src, slot = np.nonzero(edges >= 0)
            dst = edges[src, slot]
            close = np.concatenate([np.einsum("ed,ed->e", unit[a], unit[b]) for a, b in zip(*(np.array_split(e, 1 + len(src) // 4096) for e in (src, dst)), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst]), pa.array(close >= threshold - SLACK)], names=["src", "dst", "close"])

    kind = members.schema["vec_id"].dataType.simpleString()
    edges = _group(members, ["vec_id", "unit"]).mapInArrow(built, f"src {kind}, dst {kind}, close boolean")
    lists = (F.sort_array(F.collect_set("dst")).alias("near"), F.sort_array(F.collect_set(F.when(F.col("close"), F.col("dst")))).alias("close"))
    return edges.groupBy(F.col("src").alias("vec_id")).agg(*lists)


def links(embeddings: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The folded vectors, (vec_id, n) links of each to others' copies, and (src, dst) edges that connect what is linked.

    All pairs found have a cosine of at least ``threshold`` in double precision.
    """
    small_batches(embeddings.sparkSession, 2048)
    points = durable(unit_vectors(embeddings))
    placed = durable(shards(points, threshold))
    members = placed.withColumn("shard", F.explode("shards"))
    near = durable(adjacency(members, threshold))
    # A shard's graph: members with their lists, and as leaves what those lists name in reach beyond the shard.
    inside = members.join(near.drop("close"), "vec_id", "left").select("label", "shard", "vec_id", "unit", "copies", "home", "shards", "near", F.lit(True).alias("inside"))
    named = members.select("label", "shard", "vec_id").join(near.where(F.size("close") > 0).drop("near"), "vec_id").select("label", "shard", F.explode("close").alias("vec_id")).distinct()
    leaves = named.join(placed, ["label", "vec_id"]).where(~F.array_contains("shards", F.col("shard")))
    leaves = leaves.select("label", "shard", "vec_id", "unit", "copies", "home", "shards", F.array().cast(near.schema["near"].dataType).alias("near"), F.lit(False).alias("inside"))
    whole = _group(inside.unionByName(leaves), ["shard", "vec_id", "unit", "copies", "home", "shards", "near", "inside"])
    kind = placed.schema["vec_id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["__group"]):
            yield _search(table, threshold)

    found = durable(whole.mapInArrow(searched, f"vec_id {kind}, n long, src {kind}, dst {kind}, src_n long, dst_n long"))
    pairs = found.where("src is not null").select("src", "dst", "src_n", "dst_n").distinct()
    counts = found.where("n > 0").select("vec_id", "n").union(pairs.where("src_n > 0").select("src", "src_n")).union(pairs.where("dst_n > 0").select("dst", "dst_n"))
    return points, counts.groupBy("vec_id").agg(F.sum("n").alias("n")), pairs.select("src", "dst")


def _search(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links of the vectors whose home is this shard: counts and credits, and a spanning forest."""
    ids = table.column("vec_id").to_numpy()
    unit, copies = _matrix(table), table.column("copies").to_numpy()
    home, shard = table.column("home").to_numpy(), int(table.column("shard")[0].as_py())
    inside = table.column("inside").to_numpy(zero_copy_only=False)
    own_shards = table.column("shards").to_pylist()
    place = {int(v): i for i, v in enumerate(ids)}
    lists = [[place[v] for v in (named or ()) if v in place] for named in table.column("near").to_pylist()]
    edges = np.full((len(ids), max(1, max(map(len, lists)))), -1)
    for i, named in enumerate(lists):
        edges[i, : len(named)] = named
    near = mutual(edges)
    mine = np.flatnonzero(inside & (home == shard))
    members = np.flatnonzero(inside)
    start = int(members[medoid(unit[members])])
    n = np.zeros(len(ids), np.int64)
    across: list[tuple[int, int, int, int]] = []
    _, join = union_find(len(ids))
    for part in np.array_split(mine, max(1, len(mine) // 512)):
        best, sims = greedy(unit, edges, unit[part], start, BEAM)
        for i, row, value in zip(part, best, sims, strict=True):
            seeds = row[(row >= 0) & (value >= threshold - SLACK)]
            hits = within(unit, near, unit[i], np.append(seeds, i), threshold, SLACK)
            hits = hits[hits != i]
            n[i] += copies[hits[inside[hits]]].sum()
            for j in hits:
                joined = join(int(i), int(j))
                # A vector counts the members of its home shard itself.  What one end cannot count so is
                # emitted as a pair, which is the same whichever end finds it.
                lost_i, lost_j = not inside[j], home[j] != shard and int(home[j]) not in own_shards[i]
                if lost_i or lost_j:
                    pair = (ids[i], ids[j], copies[j] * lost_i, copies[i] * lost_j)
                    across.append(pair if ids[i] < ids[j] else (pair[1], pair[0], pair[3], pair[2]))
                elif joined:
                    across.append((min(ids[i], ids[j]), max(ids[i], ids[j]), 0, 0))
    hit = np.flatnonzero(n)
    kind = table.schema.field("vec_id").type
    none, zero = [None] * len(hit), [0] * len(hit)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*ids[hit], *(None for _ in across)], kind),
            pa.array([*n[hit], *(0 for _ in across)], pa.int64()),
            *(pa.array([*none, *(a[k] for a in across)], kind) for k in (0, 1)),
            *(pa.array([*zero, *(a[k] for a in across)], pa.int64()) for k in (2, 3)),
        ],
        names=["vec_id", "n", "src", "dst", "src_n", "dst_n"],
    )


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding, label)."""
    points, counts, edges = links(embeddings, threshold)
    roots = components(edges)
    folded = points.join(counts, "vec_id", "left").join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    folded = folded.select(F.col("label").alias("__label"), F.col("unit").alias("__unit"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    rows = _units(embeddings)
    out = rows.join(folded, (F.col("label") == F.col("__label")) & (F.col("unit") == F.col("__unit")), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def audit(embeddings: DataFrame, threshold: float = THRESHOLD, every: int = 20) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by ``every``, against all rows by brute force.

    The queries are a stated set; each Arrow batch of vectors is held against them in one block.
    """
    spark = embeddings.sparkSession
    points = durable(unit_vectors(embeddings))
    queries = [(r[0], r[1], r[2]) for r in points.where(F.col("vec_id") % every == 0).select("vec_id", "label", "unit").collect()]
    if not queries:
        return 0, 0
    shared = spark.sparkContext.broadcast(([q[1] for q in queries], [q[2] for q in queries], np.array([q[0] for q in queries])))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, units, ids = shared.value
        for batch in batches:
            widths = np.array([len(v) for v in batch.column("unit")], int)
            for width in np.unique(widths):
                asked = np.array([i for i, u in enumerate(units) if len(u) == width], int)
                table = pa.Table.from_batches([batch]).filter(pa.array(widths == width))
                if len(asked):
                    sims = _matrix(table) @ np.array([units[i] for i in asked]).T
                    same = np.array(table.column("label").to_pylist(), object)[:, None] == np.array(labels, object)[asked][None]
                    same &= table.column("vec_id").to_numpy()[:, None] != ids[asked][None]
                    n = ((sims >= threshold) & same) * table.column("copies").to_numpy()[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asked]), pa.array(n.sum(0))], names=["vec_id", "n"])

    kind = points.schema["vec_id"].dataType.simpleString()
    there = points.mapInArrow(counted, f"vec_id {kind}, n long").agg(F.sum("n")).first()[0]
    _, counts, _ = links(embeddings, threshold)
    asked = spark.createDataFrame([(q[0],) for q in queries], "vec_id long")
    got = counts.join(F.broadcast(asked), "vec_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return int(got), int(there)
