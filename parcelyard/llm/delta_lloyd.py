"""Centroid clustering by delta Lloyd: assignments and sums are kept, a round looks at what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.common import forget, saved

DIM, CLUSTERS, ROUNDS, SALT, SCALE = 64, 40, 5, 2, 256
#: Components (after scaling) up to which squared distances of 64 components fit a long; larger ones are an error.
LARGEST = 1 << 27
#: Components up to which a matrix product of doubles is exact.
EXACT = 1 << 22


def whole_vectors(rows: DataFrame, key: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """key and v, floor(scale * x) of each component; vectors of another length, or with a null or non-finite component, go."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = rows.where(x.isNotNull() & (F.size(x) == dim) & finite)
    at_most = float(LARGEST) / scale
    component = lambda c: F.when(F.abs(c) < at_most, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component's squared distance would not fit a long")))
    return held.select(F.col(key).alias("key"), F.transform(x, component).alias("v"))


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(np.int64), centers.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def reassign(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centers: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row, ties to the smaller number, from its owner and distance before `changed` centers moved.

    A row is compared with the changed centers alone. Only where its own center
    moved away from it can one of the others be nearer than its own; such rows
    are compared with all.
    """
    moved = np.flatnonzero(changed)
    if not len(moved):
        return owner, distance
    near = _distances(x, centers[moved])
    column = np.zeros(len(centers), np.int64)
    column[moved] = np.arange(len(moved))
    own = np.where(changed[owner], near[np.arange(len(x)), column[owner]], distance)
    pick = near.argmin(1)
    best = near[np.arange(len(x)), pick]
    other = moved[pick]
    takes = (best < own) | ((best == own) & (other < owner))
    now, far = np.where(takes, other, owner), np.where(takes, best, own)
    lost = np.flatnonzero(changed[owner] & (own > distance))
    if len(lost):
        full = _distances(x[lost], centers)
        now[lost] = full.argmin(1)
        far[lost] = full[np.arange(len(lost)), now[lost]]
    return now, far


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigning(centers: np.ndarray, changed: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with cluster, distance and the cluster that they leave (-1 in the first round)."""
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            if changed is None:
                d = _distances(x, centers)
                was, now = np.full(len(x), -1), d.argmin(1)
                far = d[np.arange(len(x)), now] if len(x) else np.zeros(0, np.int64)
            else:
                was = b.column("cluster").to_numpy(zero_copy_only=False)
                now, far = reassign(x, was, b.column("distance").to_numpy(zero_copy_only=False), centers, changed)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("v"), pa.array(now, pa.int32()), pa.array(far, pa.int64()), pa.array(was, pa.int32())], ["key", "v", "cluster", "distance", "was"]
            )

    return run


def _transfers(k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows that change their cluster: by cluster, how many more it has and the sum that it gains, both signed; one set of rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = _matrix(b.column("v"), dim).astype(np.int64)
            now, was = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "was"))
            np.add.at(count, now, 1)
            np.add.at(total, now, x)
            left = was >= 0
            np.add.at(count, was[left], -1)
            np.add.at(total, was[left], -x[left])
        used = np.flatnonzero((count != 0) | (total != 0).any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(total[used, j]) for j in range(dim))], ["cluster", "n", *(f"s{j}" for j in range(dim))])

    return run


def _hash_order(key: Column, salt: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, salt: int = SALT, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that `whole_vectors` keeps.

    The first k keys by sha256 of `salt:key` give the first centers, equal keys
    by their vectors; fewer vectors than k give fewer clusters, none give no
    rows. A null key hashes as an empty one. Repeated rows are vectors of their
    own. Other columns are ignored. A component of 2 ** 27 or more after scaling
    is an error, as its distances need not fit a long.

    A round writes (key, vector, cluster, distance, previous cluster), without a
    shuffle, and deletes what the round before wrote; sums and counts of the
    clusters change by signed transfers of the vectors that moved, added up in
    each task. The driver holds k centers and sums, whatever the input.
    """
    x = whole_vectors(rows, key, vector, dim, scale)
    seeds = x.withColumn("h", _hash_order(F.col("key"), salt)).orderBy("h", "key", "v").limit(k).select("v").collect()
    out = f"{key} {rows.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return rows.sparkSession.createDataFrame([], out)
    centers = np.array([list(r.v) for r in seeds], np.int64)
    k = len(centers)
    state_schema = f"key {rows.schema[key].dataType.simpleString()}, v array<int>, cluster int, distance long, was int"
    counts, sums = [0] * k, [[0] * dim for _ in range(k)]
    state = saved(x.mapInArrow(_assigning(centers, None), state_schema), "clusters")
    for _ in range(rounds):
        for c, n, total in _sum_transfers(state, k, dim):
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], total, strict=True)]
        moved = np.array([[s // counts[c] for s in sums[c]] if counts[c] else list(centers[c]) for c in range(k)], np.int64)
        changed = (moved != centers).any(1)
        centers, before = moved, state
        state = saved(before.select("key", "v", "cluster", "distance").mapInArrow(_assigning(centers, changed), state_schema), "clusters")
        forget(before)
    inertia = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digests[c]) for c in range(k)]
    of_cluster = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return state.join(F.broadcast(of_cluster), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sum_transfers(state: DataFrame, k: int, dim: int) -> Iterator[tuple[int, int, Sequence[int]]]:
    names = [f"s{j}" for j in range(dim)]
    went = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_transfers(k, dim), "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
    added = went.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ["n", *names]))
    for r in added.collect():
        yield r.cluster, int(r.n), [int(r[c]) for c in names]


def _oracle() -> str:
    near = """{name} AS MATERIALIZED (SELECT id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT x.id, x.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - m.v[i]) * (x.v[i] - m.v[i])))::BIGINT AS d FROM x CROSS JOIN {centers} m) GROUP BY id)"""
    mean = """{name} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM {before} m LEFT JOIN (
  SELECT c, list(f ORDER BY i) AS v FROM (SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS f FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM {near} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)) GROUP BY c) n USING (c))"""
    parts = [
        f"""x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {DIM})""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v)::INT - 1 AS c, v FROM (SELECT *, sha256('{SALT}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM x) ORDER BY h, vec_id, v LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts += [near.format(name=f"a{r}", centers=f"m{r}"), mean.format(name=f"m{r + 1}", before=f"m{r}", near=f"a{r}")]
    parts.append(near.format(name="last", centers=f"m{ROUNDS}"))
    return f"""WITH {", ".join(parts)}
SELECT x.vec_id, last.c::INT AS cluster, last.d AS distance, (sum(last.d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia, (sum(last.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m{ROUNDS}.v, ',')) AS centroid_sha256
FROM last JOIN x USING (id) JOIN m{ROUNDS} ON m{ROUNDS}.c = last.c"""


ORACLE = _oracle()
