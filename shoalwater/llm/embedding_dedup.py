"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label by the concatenated signs of random projections (a key of
``SIGNS`` bits) and looks at every vector's next ``WINDOW`` neighbours in that order. Only narrow
rows (label, pass, key, number) are sorted, once a pass; a block of them drops neighbours whose
keys differ in too many bits, and vectors are fetched only for those that remain. Verified
pairs of all passes are united to components.

A window cannot hold all partners of a vector in a large group of near copies. What windows leave is
handled exactly: vectors whose keys begin alike in a pass are one bucket, with so many leading
bits that a label of any size has about ``BUCKET`` vectors in each, and so many passes that a
pair at the least cosine shares no bucket at most ``MISS`` of the time. In every bucket longer than a
window that still holds several components, all pairs of different components are compared.
Within each component every two members are compared, so links are counted fully. Long
buckets and components are dealt to spans, and a task compares two spans: no task holds more than
two spans, and a vector is sent once for each span.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import components, pin, repeated_ids, table

#: Fixed value of the contract: least cosine.
COSINE = 0.98
WINDOW = 32
SIGNS = 62
#: Vectors that share a bucket, about, and the chance that a pair at the least cosine shares none.
BUCKET, MISS = 16, 1e-6
#: Bits in which the keys of a pair may differ: at the least cosine 4 of 62 do on average, more than 13 in one of 20,000 passes.
DIFFER = 13
#: Sorted rows of a block, and members of a bucket or component that meet as many others in one task.
BLOCK, SPAN = 8192, 4096


def _planes(dim: int, pass_: int) -> np.ndarray:
    return np.random.default_rng([7919, dim, pass_]).standard_normal((dim, SIGNS))


def marked(rows: DataFrame) -> DataFrame:
    """vec_id, label and v, the vector; label and v null where a row can have no link."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("vec_id", F.when(fine, F.col("label")).alias("label"), F.when(fine, v).alias("v"))


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _united(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component under the pairs of row numbers."""
    low = ids.copy()
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if (new == low).all():
            return low
        low = new


def passes_of(size: Column, cosine: float, miss: float = MISS) -> tuple[Column, Column]:
    """Leading bits of a bucket and number of passes, for a label of ``size`` vectors."""
    agree = 1 - math.acos(cosine) / math.pi  # on one sign, at the least cosine
    bits = F.least(F.lit(SIGNS), F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(float(BUCKET))))))
    once = F.pow(F.lit(agree), bits)
    return bits.cast("int"), F.when(bits == 0, F.lit(1)).otherwise(F.ceil(F.lit(math.log(miss)) / F.log(1 - once))).cast("int")


def keyed(classes: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """cid, label, dim, bits and the keys of all passes of each class of equal vectors."""
    sizes = classes.groupBy(F.col("label").alias("_l"), F.col("dim").alias("_d")).agg(F.count("*").alias("_n"))
    sized = classes.join(sizes, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")))
    bits, passes = passes_of(F.col("_n"), cosine, miss)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (dim, passes), part in b.groupby(["dim", "passes"]):
                for at in range(0, len(part), 2048):
                    some = part.iloc[at : at + 2048]
                    x, keys = _unit(some["v"]), np.zeros((len(some), passes), np.int64)
                    for k in range(passes):
                        keys[:, k] = ((x @ _planes(dim, k) > 0).astype(np.int64) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)).sum(axis=1)
                    yield pd.DataFrame({"cid": some["cid"], "label": some["label"], "dim": dim, "bits": some["bits"], "keys": list(keys)})

    return sized.select("cid", "label", "dim", bits.alias("bits"), passes.alias("passes"), "v").mapInPandas(project, "cid long, label long, dim int, bits int, keys array<long>")


def _fetched(rows: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """The vectors of the rows that remain."""
    return rows.join(classes.select("cid", *more, "v"), "cid")


def neighbours(keys: DataFrame, classes: DataFrame, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """Links (a, b) between ids that join whatever the verified pairs of all windows join.

    A block unites its own verified pairs and sends one link a vector, to the smallest id that it
    is joined with there: a dense group gives links in proportion to its size.
    """

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, np.int32)), pa.array(np.arange(n, n + m))], names=[*b.schema.names, "part", "at"])
            n += m

    by = ["label", "dim", "pass", "key", "cid"]
    rows = keys.select("label", "dim", F.posexplode("keys").alias("pass", "key"), "cid").select(*by)
    order = pin(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(ranked, "label long, dim int, pass int, key long, cid long, part int, at long"), "sorted")
    counts = order.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "start")  # one row a partition
    placed = order.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at"))
    block = F.floor(F.col("rank") / BLOCK)
    ends = F.when((F.col("rank") % BLOCK < window) & (F.col("rank") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = placed.withColumn("block", F.explode(ends)).select("block", "rank", "label", "dim", "pass", "key", "cid")

    def steps(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        """For each step, the rows whose neighbour so many rows on may be a partner."""
        rank, key = pdf["rank"].to_numpy(), pdf["key"].to_numpy()
        group, own = pdf.groupby(["label", "dim", "pass"], sort=False).ngroup().to_numpy(), rank // BLOCK == pdf["block"].iloc[0]
        for step in range(1, min(window, len(pdf) - 1) + 1):
            near = own[:-step] & (group[:-step] == group[step:]) & (rank[step:] - rank[:-step] <= window) & (np.bitwise_count(key[:-step] ^ key[step:]) <= DIFFER)
            yield np.flatnonzero(near), step

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        stays = np.zeros(len(pdf), bool)
        for near, step in steps(pdf):
            stays[near] = stays[near + step] = True
        return pdf[stays]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        ids, pairs, units = pdf["id"].to_numpy(), [], {d: (part.index.to_numpy(), _unit(part["v"])) for d, part in pdf.groupby("dim")}
        place, dims = np.zeros(len(pdf), np.int64), pdf["dim"].to_numpy()
        for at, x in units.values():
            place[at] = np.arange(len(at))
        for near, step in steps(pdf):
            for d, (_, x) in units.items():
                some = near[dims[near] == d]
                good = some[np.einsum("ij,ij->i", x[place[some]], x[place[some + step]]) >= cosine]
                pairs.append(np.stack((good, good + step)))
        low = _united(ids, *np.concatenate(pairs, axis=1)) if pairs else ids
        return pd.DataFrame({"a": low[low != ids], "b": ids[low != ids]}).drop_duplicates()

    fields = "block long, rank long, label long, dim int, pass int, key long, cid long"
    near = _fetched(blocks.groupBy("block").applyInPandas(sift, fields), classes, "id")
    return near.groupBy("block").applyInPandas(compare, "a long, b long").where("a <> b").distinct()


def _cells(rows: DataFrame, group: list[str], size: str, cid: str = "cid") -> DataFrame:
    """``rows`` dealt to cells (cell, i, j) in which two spans of a group meet; short groups share a cell.

    ``size``: column with the rows of a group. A long group's cells are its pairs of spans; a short one
    has its rows in a cell (i = j = 0) that holds about a span of rows of several groups.
    """
    n = rows.count()
    spans = F.ceil(F.col(size) / SPAN).cast("int")
    shared = F.pmod(F.xxhash64(*group), F.lit(max(1, n // SPAN)))
    dealt = rows.withColumn("_spans", spans).withColumn("span", F.pmod(F.xxhash64(cid), F.col("_spans")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_spans") - 1)))
    cell = F.when(F.col("_spans") == 1, F.struct(F.lit(1).alias("short"), shared.alias("at"))).otherwise(F.struct(F.lit(0).alias("short"), F.xxhash64(*group).alias("at")))
    return met.withColumn("cell", cell).withColumn("i", F.least("span", "_other")).withColumn("j", F.greatest("span", "_other")).select(F.col("cell.short").alias("short"), F.col("cell.at").alias("cell"), "i", "j", "span", *[c for c in rows.columns if c != size])


_CELL = ["short", "cell", "i", "j"]


def _blocks(pdf: pd.DataFrame, group: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (left, right) of a cell: groups one by one, left in runs of a few hundred."""
    i, j, span = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["span"].to_numpy()
    for at in pdf.groupby(group, sort=False).indices.values():
        left, right = at[span[at] == i], at[span[at] == j]
        for a in range(0, len(left), 256):
            if len(right):
                yield left[a : a + 256], right


def missed_links(keys: DataFrame, classes: DataFrame, found: DataFrame, window: int = WINDOW, cosine: float = COSINE) -> DataFrame:
    """Links (a, b) between components that share a bucket and have similar members there.

    ``found``: node, component. Buckets no longer than a window were compared by it; of the others
    those count that hold several components. A task keeps the rows whose keys allow a partner of
    another component, their vectors are fetched, and it sends one link a component that it joins.
    """
    bucket = ["label", "dim", "pass", "bucket"]
    own = classes.select("cid", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("cid", F.coalesce("component", "id").alias("component"))
    rows = keys.join(own, "cid").select("label", "dim", "bits", "cid", "component", F.posexplode("keys").alias("pass", "key"))
    rows = rows.select("label", "dim", "pass", F.expr("key >> (62 - bits)").alias("bucket"), "key", "cid", "component")
    long = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where((F.col("n") > window + 1) & (F.col("low") < F.col("high"))).select(*bucket, "n")
    rest = pin(rows.join(long, bucket), "rest")

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        key, component, stays = pdf["key"].to_numpy(), pdf["component"].to_numpy(), np.zeros(len(pdf), bool)
        for left, right in _blocks(pdf, bucket):
            near = (np.bitwise_count(key[left, None] ^ key[right]) <= DIFFER) & (component[left, None] != component[right])
            stays[left] |= near.any(axis=1)
            stays[right] |= near.any(axis=0)
        return pdf[stays]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        component, nodes = pdf["component"].to_numpy(), np.unique(pdf["component"].to_numpy())
        number, low = np.searchsorted(nodes, component), nodes.copy()
        for _, part in pdf.groupby("dim"):
            part = part.reset_index(names="_at")
            at, x = part["_at"].to_numpy(), _unit(part["v"])
            for left, right in _blocks(part, bucket):
                a, b = np.nonzero((x[left] @ x[right].T >= cosine) & (component[at[left], None] != component[at[right]]))
                if len(a):  # joined with the links of the rows before, which low holds
                    held = np.searchsorted(nodes, low)
                    low = _united(nodes, np.concatenate((number[at[left[a]]], held)), np.concatenate((number[at[right[b]]], np.arange(len(nodes)))))
        return pd.DataFrame({"a": low[low != nodes], "b": nodes[low != nodes]})

    fields = "short int, cell long, i int, j int, span int, label long, dim int, pass int, bucket long, key long, cid long, component long"
    near = _cells(rest, bucket, "n").groupBy(*_CELL).applyInPandas(sift, fields)
    return _fetched(near, classes).groupBy(*_CELL).applyInPandas(compare, "a long, b long").distinct()


def count_links(members: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cid, linked): vectors linked with each class, copies counted, by exact comparison.

    ``members``: label, dim, component, cid, copies, v. Members of one component, label and length are
    compared, two spans in a task.
    """
    group = ["label", "dim", "component"]
    size = members.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    cells = _cells(members.join(size, group), group, "n")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        linked, copies, same = np.zeros(len(pdf), np.int64), pdf["copies"].to_numpy(), pdf["i"].iloc[0] == pdf["j"].iloc[0]
        for _, part in pdf.groupby("dim"):
            part = part.reset_index(names="_at")
            at, x = part["_at"].to_numpy(), _unit(part["v"])
            for left, right in _blocks(part, group):
                near = (x[left] @ x[right].T >= cosine) & (left[:, None] != right)
                linked[at[left]] += near @ copies[at[right]]
                if not same:
                    linked[at[right]] += copies[at[left]] @ near
        return pd.DataFrame({"cid": pdf["cid"], "linked": linked})

    return cells.groupBy(*_CELL).applyInPandas(multiply, "cid long, linked long").groupBy("cid").agg(F.sum("linked").alias("linked"))


def dedup(rows: DataFrame, window: int = WINDOW, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Vectors of different length are not compared. A null id, label or vector, a zero vector
    and one with null or non-finite components has no links; rows of equal vec_id are one
    node of the graph but count as vectors. Equal vectors of a label are linked. Vectors may have any length; those that
    are long take more time a comparison. An empty table gives an empty one; other columns are not read. A link is missed at most ``miss`` of the time, all
    others are counted.
    """
    # a class: equal vectors of a label, by two 64-bit hashes
    hashed = marked(rows).select("vec_id", "label", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("c1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("c2"), "v")
    every = pin(hashed.drop("v"), "vectors")
    grouped = hashed.where("v IS NOT NULL").groupBy("label", "c1", "c2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = pin(grouped.select(F.monotonically_increasing_id().alias("cid"), F.col("label").cast("long").alias("label"), F.size("v").alias("dim"), "id", "copies", "c1", "c2", "v"), "classes")
    keys = pin(keyed(classes, cosine, miss), "keys")
    twice = repeated_ids(every.where("c1 IS NOT NULL").join(classes.select("label", "c1", "c2", "id"), ["label", "c1", "c2"]).select(F.col("vec_id").alias("node"), "id"))
    links = pin(neighbours(keys, classes, window, cosine).union(twice), "links")
    found = pin(components(links), "components")
    missed = pin(missed_links(keys, classes, found, window, cosine), "missed")
    if not missed.isEmpty():
        found = pin(components(links.union(missed)), "components")
    placed = classes.join(found.select(F.col("node").alias("id"), "component"), "id")
    counts = count_links(placed.select("label", "dim", "component", "cid", "copies", "v"), cosine)
    per_class = classes.select("cid", "label", "c1", "c2", "id", "copies").join(found.select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "cid", "left")
    per_class = per_class.select("label", "c1", "c2", F.coalesce("component", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"))
    out = every.join(per_class, ["label", "c1", "c2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
