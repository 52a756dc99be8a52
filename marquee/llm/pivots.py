"""Embedding near-duplicates with a pivot-permutation index.

Vectors of one label are linked if their cosine, in double precision, is at least `min_cosine`. Vectors
that are null, zero, or hold null or non-finite components, and those without a label, link with nothing.

1. Equal vectors of a label become one representative with a count.
2. Pivots: from a bounded sample (the `SAMPLE` * n_pivots representatives with the smallest hashes) those
   that are not close to one taken before; `n_pivots` is about the square root of the number of
   representatives, MAX_PIVOTS at most. A representative is described by its `nearest` pivots.
3. Index: every representative stands in the inverted list of each pair of its pivots, so two vectors with
   two shared pivots or more meet; the number of pivots grows with the data, so lists stay short. A list of
   over `LIST` vectors is cut into blocks, and each pair of blocks is one unit of work.
4. Verification inside a list: cosines by blocks of matrix products. A pair that meets in several lists
   counts in that of its two smallest shared pivots only. Units of work return counts of links by vector
   and a spanning forest of the links, never pairs.
Recall is measured against brute force in the tests (0.999 or more of all links on the given tables).

Edge cases: invalid vectors are classes of their own with no links; repeated rows and ids are vectors like
any other; a null id is never a component id unless all ids are null; vectors of different lengths are not
compared; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, key_runs, materialise, smallest_hashes
from .components import LocalForest, connected_components

NEAREST = 5
SAMPLE = 8
APART = 0.6                  # pivots have cosines below this
MIN_PIVOTS, MAX_PIVOTS = 32, 4096
LIST = 4096
SHORT = 24                   # lists up to this length are compared many at a time


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def keyed_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec array<double>, dim, vkey): vkey names label and vector, null for vectors without links."""
    source = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vector_col).cast("array<double>").alias("vec"))

    def run(batches):
        for batch in batches:
            keys, dims = [], []
            for label, scalar in zip(batch.column("label").to_pylist(), batch.column("vec")):
                values = scalar.values
                keys.append(None)
                dims.append(0)
                if label is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy() + 0.0  # minus zero is zero
                if np.isfinite(x).all() and x.any():
                    keys[-1] = xxhash.xxh3_128_digest(label.encode() + b"\0" + x.tobytes())
                    dims[-1] = x.size
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vec"),
                                              pa.array(dims, pa.int32()), pa.array(keys, pa.binary())],
                                             ["id", "label", "vec", "dim", "vkey"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, label string, vec array<double>, dim int, vkey binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the square of a large or tiny component stays finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(reps: DataFrame, dim: int, n: int) -> np.ndarray:
    """Unit vectors, apart from each other; filled up with random directions if the sample has too few."""
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, 1 << ceil(log2(sqrt(max(1, n))))))
    sample = smallest_hashes(reps, "vkey", SAMPLE * wanted).select("vec").collect()
    spare = np.random.default_rng(0).normal(size=(NEAREST + 1, dim))
    candidates = _unit(np.concatenate([np.array([r.vec for r in sample]).reshape(-1, dim), spare]))
    chosen = np.zeros((wanted, dim))
    count = 0
    for i, c in enumerate(candidates):
        if count < wanted and (i >= len(sample) and count <= NEAREST or not count or (chosen[:count] @ c).max() < APART):
            chosen[count] = c
            count += 1
    return chosen[:count]


def _postings(reps: DataFrame, pivots, dim: int, with_vectors: bool) -> DataFrame:
    """One row per representative and pair of its nearest pivots."""
    def run(batches):
        table = pivots.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _unit(_matrix(part.column("vec"), dim))
                near = np.sort(np.argpartition(-(x @ table.T), NEAREST - 1, axis=1)[:, :NEAREST], axis=1)
                pivs = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel().astype(np.int32)), NEAREST).cast(
                    pa.list_(pa.int32()))
                for a, b in combinations(range(NEAREST), 2):
                    out = [part.column("label"), pa.array(near[:, a].astype(np.int32)),
                           pa.array(near[:, b].astype(np.int32))]
                    if with_vectors:
                        out += [part.column("node"), part.column("n"), pivs, part.column("vec")]
                    yield pa.RecordBatch.from_arrays(out, ["label", "a", "b", "node", "n", "pivots", "vec"][:len(out)])

    schema = "label string, a int, b int"
    if with_vectors:
        schema += ", node long, n long, pivots array<int>, vec array<double>"
    return reps.select("label", "node", "n", "vec").mapInArrow(run, schema)


class _Unit:
    """Links among the representatives of several whole lists."""

    def __init__(self, run: pa.Table, dim: int, min_cosine: float):
        run = run.combine_chunks()
        get = lambda c: run.column(c).chunk(0)
        self.x = _unit(_matrix(get("vec"), dim))
        self.pivots = _matrix(get("pivots"), NEAREST).astype(np.int32)
        self.b, self.n, self.block = (get(c).to_numpy() for c in ("b", "n", "block"))
        self.cross = get("bi").to_numpy() != get("bj").to_numpy()
        self.nodes, self.local = np.unique(get("node").to_numpy(), return_inverse=True)
        self.count = np.zeros(self.nodes.size)
        self.forest = LocalForest(self.nodes.size)
        self.min_cosine = min_cosine
        new = np.zeros(run.num_rows, bool)
        new[0] = True
        for k in ("label", "a", "b", "bi", "bj"):
            codes = get(k).dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, run.num_rows))

    def run(self) -> None:
        short = (self.sizes > 1) & (self.sizes <= SHORT)
        starts, sizes = self.starts[short], self.sizes[short]
        for at in range(0, starts.size, 1024):
            self._check(*self._all_pairs(starts[at:at + 1024], sizes[at:at + 1024]))
        for start, size in zip(self.starts[self.sizes > SHORT], self.sizes[self.sizes > SHORT]):
            x = self.x[start:start + size]
            for at in range(0, size, 256):
                i, j = np.nonzero(x[at:at + 256] @ x.T >= self.min_cosine - 1e-9)
                i += at
                self._check(start + i[i < j], start + j[i < j])

    @staticmethod
    def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        later = np.repeat(starts + sizes, sizes) - row - 1
        i = np.repeat(row, later)
        return i, i + 1 + np.arange(i.size) - np.repeat(np.cumsum(later) - later, later)

    def _check(self, i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, i.size, 1 << 16):
            self._verify(i[at:at + (1 << 16)], j[at:at + (1 << 16)])

    def _verify(self, i: np.ndarray, j: np.ndarray) -> None:
        near = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.min_cosine
        near &= ~self.cross[i] | (self.block[i] != self.block[j])
        i, j = i[near], j[near]
        own = self.pivots[i]
        shared = (own[:, :, None] == self.pivots[j][:, None, :]).any(axis=2)
        first = (shared & (own < self.b[i][:, None])).sum(axis=1) == 1  # a and b are the two smallest shared
        i, j = i[first], j[first]
        np.add.at(self.count, self.local[i], self.n[j])
        np.add.at(self.count, self.local[j], self.n[i])
        self.forest.add(self.local[i], self.local[j])

    def result(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        u, v = self.forest.edges()
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([self.nodes[some], self.nodes[u]])),
            pa.array(np.concatenate([np.zeros(some.size, np.int64), self.nodes[v]])),
            pa.array(np.concatenate([self.count[some].astype(np.int64), np.zeros(u.size, np.int64)]))],
            ["u", "v", "links"])


def list_links(reps: DataFrame, dim: int, min_cosine: float) -> DataFrame:
    """(u, v, links): rows with links > 0 add to the links of u; the others link u and v."""
    spark = reps.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(reps, dim, reps.count()))
    key = ["label", "a", "b"]
    long_lists = (_postings(reps, pivots, dim, False).groupBy(*key).count().where(F.col("count") > LIST)
                  .select(*key, F.ceil(F.col("count") / (LIST // 2)).alias("blocks")))
    posted = (_postings(reps, pivots, dim, True).join(long_lists, key, "left")
              .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
              .drop("blocks", "other"))

    def run(batches):
        for whole in key_runs(batches, [*key, "bi", "bj"], min_rows=8192):
            unit = _Unit(whole, dim, min_cosine)
            unit.run()
            yield unit.result()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (posted.repartition(parts, *key, "bi", "bj").sortWithinPartitions(*key, "bi", "bj")
            .mapInArrow(run, "u long, v long, links long"))


def embedding_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                         label_col: str = "label", min_cosine: float = 0.98) -> DataFrame:
    """(id column, n_links, component_id, kept) for every row."""
    vectors = materialise(keyed_vectors(rows, id_col, vector_col, label_col), "vectors")
    valid = vectors.where("vkey is not null")
    node = F.conv(F.substring(F.hex("vkey"), 1, 15), 16, 10).cast("long")  # 60 bits of the key
    reps = materialise(valid.groupBy("vkey").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"),
                                                 F.first("label").alias("label"), F.first("vec").alias("vec"),
                                                 F.first("dim").alias("dim")).withColumn("node", node), "vector-reps")
    found = None
    for (dim,) in reps.select("dim").distinct().orderBy("dim").collect():
        part = list_links(reps.where(F.col("dim") == dim), dim, min_cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in ("u", "v", "links")])
    found = materialise(found, "vector-links")
    counts = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("links = 0").select("u", "v"), "vectors")
    labelled = materialise(
        reps.select("vkey", "node", "n", "first").join(counts, "node", "left")
        .join(labels.withColumnRenamed("label", "component"), "node", "left")
        .select("vkey", "first", F.coalesce("component", "node").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-labels")
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialise(join_hot(labelled, smallest, "component", "vector-component")
                          .select("vkey", "n_links", "component_id"), "vector-classes")
    linked = join_hot(valid.select("id", "vkey"), classes, "vkey", "vector-row").select("id", "n_links", "component_id")
    alone = vectors.where("vkey is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                                 F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
