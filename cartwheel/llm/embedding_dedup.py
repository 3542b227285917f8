"""Operator 6: embedding near-duplicates on a robust-pruned flat graph.

Only vectors of one label (and length) are compared.

1. Equal vectors form one class with a count.
2. Cells: a label's classes are split by k-means, again and again, until a cell
   holds at most ``shard_size``; a class goes to its two nearest centres, so
   shards overlap. Centres are fitted on a bounded sample of a cell
   (``SAMPLE_PER_CENTRE`` vectors a centre); every vector is assigned.
3. Each shard gets a flat graph: a node's nearest neighbours, robust-pruned (a
   candidate is dropped if a kept one is ``alpha`` times closer to it than the
   node is), and a medoid to start from.
4. The adjacency lists of a class from all its shards are united. A shard then
   searches for the classes that are first of all its own, on its members and
   on the neighbours that the united lists add: greedy from the medoid with a
   beam, then, within the similarity range, expanding every hit until no new
   one appears.
5. Hits are verified by cosine in double precision. A shard returns link counts
   and a spanning forest, not all pairs; pairs between shards are returned
   once and counted for both sides.
6. Recall is audited label by label: a bounded sample of queries is compared
   with all vectors in blocks. A label passes if ``min_recall`` of the audited
   links were found and ``MIN_QUERY_RECALL`` of the links of each query with ten
   or more. The search is repeated once with a beam four times as wide.
7. The exact way for the rest: labels that still fail, whose cells no centre
   tells apart, or where a bounded sample shows ``DENSE_SHARE`` of all pairs and
   ``DENSE_LINKS`` a class to be links (a graph of bounded degree cannot hold
   them) are compared block by block. Each pair of blocks is a task with one
   matrix product, so a dense group of any size is dealt out and loses no link.

Defined results: a null label or vector, a zero vector, and one with null or
non-finite components link with nothing and are their own component; repeated
rows are copies linked with each other; a null id is its own component with no
links; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cartwheel.llm.common import written
from cartwheel.llm.minhash_dedup import components

THRESHOLD = 0.93
SHARD_SIZE = 1500
MAX_CENTRES = 64
SAMPLE_PER_CENTRE = 40
CHUNK = 4096
DEGREE = 24
CANDIDATES = 96
ALPHA = 1.2
BEAM = 48
AUDIT_QUERIES = 200
MIN_RECALL = 0.95
MIN_QUERY_RECALL = 0.9
#: Density from which a label is compared in blocks, and the sample (classes a
#: label) that it is estimated on.
DENSE_SHARE, DENSE_LINKS = 0.05, 256
DENSITY_SAMPLE = 300
#: Classes of a block: a task compares two blocks.
BLOCK = 2048
#: Splits of a cell after which its label is left to the blocks.
MAX_LEVEL = 12


def unit_rows(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(vec: F.Column) -> F.Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def kmeans(v: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres on the unit sphere; the first are spread by farthest choice."""
    chosen, best = [0], v @ v[0]
    for _ in range(k - 1):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, v @ v[chosen[-1]])
    centres = v[chosen]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = v[near == c].sum(0) if (near == c).any() else centres[c]
            norm = np.sqrt(mean @ mean)
            if norm > 0:
                centres[c] = mean / norm
    return centres


def split_cells(rows: DataFrame, shard_size: int) -> DataFrame:
    """(id, w, vec, own, cell): overlapping shards of at most about
    ``shard_size`` classes; ``own`` marks the one shard that queries a class.
    Cells that ``MAX_LEVEL`` splits do not bring there are left out."""
    done, level = None, 0
    while True:
        rows = written(rows, f"embedding-cells{level}")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        small = rows.join(sizes.where(F.col("n") <= shard_size).select("cell"), "cell", "left_semi")
        done = small if done is None else done.unionByName(small.select(*done.columns))
        large = sizes.where(F.col("n") > shard_size)
        if level > MAX_LEVEL or large.isEmpty():
            return done
        k = F.least(F.lit(MAX_CENTRES), F.ceil(F.col("n") * 4 / shard_size)).cast("int")
        large = large.withColumn("k", k).withColumn("salts", F.ceil(F.col("n") / CHUNK).cast("int"))
        big = rows.join(large, "cell")
        unit = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = big.where(unit < F.col("k") * SAMPLE_PER_CENTRE / F.col("n")).select("cell", "k", "salts", "vec")
        # a cell whose sample came out empty comes back whole
        centres = sample.groupBy("cell").applyInPandas(fit_cell, "cell string, salts int, salt int, centres array<array<double>>")
        chunked = big.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("cell", "salt", "id", "w", "vec", "own")
        rows = chunked.groupBy("cell", "salt").cogroup(centres.groupBy("cell", "salt")).applyInPandas(
            assign, "cell string, id long, w long, vec array<double>, own boolean")
        level += 1


def fit_cell(sample: pd.DataFrame) -> pd.DataFrame:
    centres = kmeans(unit_rows(sample["vec"]), min(int(sample["k"].iloc[0]), len(sample)))
    salts = int(sample["salts"].iloc[0])
    return pd.DataFrame({"cell": sample["cell"].iloc[0], "salts": salts, "salt": np.arange(salts, dtype=np.int32),
                         "centres": [centres.tolist()] * salts})


def assign(key: tuple, rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Two nearest centres of each row; a cell with one centre comes back whole."""
    if not len(rows):
        return pd.DataFrame({"cell": [], "id": [], "w": [], "vec": [], "own": []})
    v = unit_rows(rows["vec"])
    c = np.array([list(map(float, x)) for x in centres["centres"].iloc[0]]) if len(centres) else v[:0]
    if len(c) < 2:
        return pd.DataFrame({"cell": [f"{key[0]}/0"] * len(rows), "id": rows["id"], "w": rows["w"], "vec": rows["vec"], "own": rows["own"]})
    sim = v @ c.T
    first = sim.argmax(1)
    sim[np.arange(len(v)), first] = -2
    second = sim.argmax(1)
    out = [pd.DataFrame({"cell": [f"{key[0]}/{k}" for k in near], "id": rows["id"], "w": rows["w"], "vec": rows["vec"], "own": own})
           for near, own in ((first, rows["own"]), (second, False))]
    # a class that is a guest here stays with the nearer centre only
    return pd.concat([out[0], out[1][rows["own"].to_numpy()]])


def robust_prune(v: np.ndarray, node: int, order: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Neighbours of ``node`` from candidates in falling similarity."""
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    to_node = 2 - 2 * (v[order] @ v[node])
    for i in range(len(order)):
        if not alive[i]:
            continue
        kept.append(int(order[i]))
        if len(kept) == degree:
            break
        alive &= alpha * alpha * (2 - 2 * (v[order] @ v[order[i]])) > to_node
    return kept


def shard_graph(shard: pd.DataFrame) -> pd.DataFrame:
    """(cell, id, neighbours, medoid) of one shard."""
    v, ids = unit_rows(shard["vec"]), shard["id"].to_numpy()
    n = len(v)
    medoid = int((v @ v.sum(0)).argmax())
    lists: list[list[int]] = []
    back: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 256):
        sim = v[at:at + 256] @ v.T
        for r in range(len(sim)):
            node = at + r
            sim[r, node] = -2
            m = min(CANDIDATES, n - 1)
            near = np.argpartition(-sim[r], m - 1)[:m] if m else np.empty(0, np.int64)
            near = near[np.argsort(-sim[r][near], kind="stable")]
            lists.append(robust_prune(v, node, near, DEGREE, ALPHA))
            for x in lists[-1]:
                back[x].add(node)
    out = []
    for node in range(n):  # reverse edges, pruned again where there are too many
        both = np.array(sorted(set(lists[node]) | back[node]), np.int64)
        if len(both) > 2 * DEGREE:
            both = np.array(robust_prune(v, node, both[np.argsort(-(v[both] @ v[node]), kind="stable")], 2 * DEGREE, ALPHA))
        out.append(ids[both].tolist() if len(both) else [])
    # what the pruning left out of reach hangs on the medoid
    seen, todo, place = {medoid}, [medoid], {int(i): k for k, i in enumerate(ids)}
    while todo:
        for x in out[todo.pop()]:
            if place[x] not in seen:
                seen.add(place[x])
                todo.append(place[x])
    out[medoid] = out[medoid] + [int(ids[k]) for k in range(n) if k not in seen]
    return pd.DataFrame({"cell": shard["cell"].to_numpy(), "id": ids, "neighbours": out, "medoid": np.arange(n) == medoid})


def range_search(v: np.ndarray, lists: list[np.ndarray], start: int, query: np.ndarray, beam: int, reach: float) -> list[int]:
    """Greedy search from ``start``; then all hits within ``reach`` expand."""
    seen = np.zeros(len(v), bool)
    seen[start] = True
    first = float(v[start] @ query)
    todo, best, hits, expanded = [(-first, start)], [first], [], set()
    if first >= reach:
        hits.append(start)
    while todo:
        sim, node = heapq.heappop(todo)
        if -sim < reach and len(best) >= beam and -sim < best[0]:
            break  # neither in the beam nor in range
        near = lists[node]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        sims = v[near] @ query
        hits.extend(near[sims >= reach].tolist())
        low = best[0] if len(best) >= beam else -2.0
        for k in np.flatnonzero((sims > low) | (sims >= reach)).tolist():
            s = float(sims[k])
            heapq.heappush(todo, (-s, int(near[k])))
            if len(best) < beam:
                heapq.heappush(best, s)
            elif s > best[0]:
                heapq.heapreplace(best, s)
    return hits


def search_shard(shard: pd.DataFrame, beam: int, threshold: float) -> pd.DataFrame:
    """Rows (kind, a, b, n): 'n' link counts of own classes, 'e' forest edges,
    'x' pairs with classes that another shard queries."""
    shard = shard.sort_values(["member", "own", "id"], ascending=[False, False, True]).drop_duplicates("id").reset_index(drop=True)
    v, ids, w = unit_rows(shard["vec"]), shard["id"].to_numpy(), shard["w"].to_numpy()
    place = {int(i): k for k, i in enumerate(ids)}
    lists = [np.array([place[int(x)] for x in (near if near is not None else ()) if int(x) in place], np.int64) for near in shard["neighbours"]]
    start = np.flatnonzero(shard["medoid"].to_numpy().astype(bool))
    own = np.flatnonzero(shard["own"].to_numpy().astype(bool))
    mine = np.zeros(len(v), bool)
    mine[own] = True
    parent = list(range(len(v)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: dict[int, set[int]] = {int(k): set() for k in own}
    cross: set[tuple[int, int]] = set()
    for k in own.tolist():
        for x in range_search(v, lists, int(start[0]) if len(start) else k, v[k], beam, threshold):
            if x == k:
                continue
            if mine[x]:
                found[k].add(x)
                found[x].add(k)
                a, b = find(k), find(x)
                parent[max(a, b)] = min(a, b)
            else:
                cross.add((min(ids[k], ids[x]), max(ids[k], ids[x])))
    rows = [("n", int(ids[k]), 0, int(w[list(xs)].sum()) if xs else 0) for k, xs in found.items()]
    rows += [("e", int(ids[find(k)]), int(ids[k]), 0) for k in own.tolist() if find(k) != k]
    rows += [("x", int(a), int(b), 0) for a, b in cross]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n"])


def search(shards: DataFrame, beam: int, threshold: float) -> DataFrame:
    """Found links of all shards (kind, a, b, n); ``shards`` is written."""
    graph = written(shards.groupBy("cell").applyInPandas(
        shard_graph, "cell string, id long, neighbours array<long>, medoid boolean"), "embedding-graph")
    united = written(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "embedding-united")
    vectors = shards.where("own").select("id", "w", "vec")
    medoids = graph.select("cell", "id", "medoid")
    members = shards.join(united, "id").join(medoids, ["cell", "id"]).withColumn("member", F.lit(True))
    halo = members.select("cell", F.explode("neighbours").alias("id")).distinct().join(shards.select("cell", "id"), ["cell", "id"], "left_anti")
    guests = halo.join(vectors, "id").join(united, "id").withColumn("own", F.lit(False)).withColumn("medoid", F.lit(False)).withColumn("member", F.lit(False))
    columns = ["cell", "id", "w", "vec", "own", "neighbours", "medoid", "member"]
    return members.select(*columns).unionByName(guests.select(*columns)).groupBy("cell").applyInPandas(
        lambda shard: search_shard(shard, beam, threshold), "kind string, a long, b long, n long")


def link_counts(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n): directly linked vectors of each class, its copies left out."""
    pairs = found.where("kind = 'x'").select("a", "b").distinct()
    weights = classes.select("id", "w")
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = sides.join(weights.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), F.col("w").alias("n"))
    inside = found.where("kind = 'n'").select(F.col("a").alias("id"), "n")
    return across.unionByName(inside).groupBy("id").agg(F.sum("n").alias("n"))


def dense_labels(classes: DataFrame) -> DataFrame:
    """(cell): labels of which a sample shows too many links for a graph."""
    sizes = classes.groupBy("cell").agg(F.count("*").alias("size"))
    unit = F.pmod(F.xxhash64(F.lit("density"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = classes.select("cell", "id", "vec").join(sizes, "cell").where(unit < DENSITY_SAMPLE / F.col("size")).select("cell", "size", "vec")

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        v = unit_rows(rows["vec"])
        share = ((v @ v.T >= THRESHOLD).sum() - len(v)) / max(1, len(v) * (len(v) - 1))
        hit = share >= DENSE_SHARE and share * rows["size"].iloc[0] >= DENSE_LINKS
        return rows[["cell"]].iloc[:int(hit)].astype(object)

    return sample.groupBy("cell").applyInPandas(dense, "cell string")


def block_links(classes: DataFrame, threshold: float) -> DataFrame:
    """All links of the classes (cell, id, w, vec) as rows (kind, a, b, n), by
    comparing every pair of blocks of a cell once."""
    sizes = classes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = classes.select("cell", "id", "w", "vec").join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int"))
    rows = written(rows, "embedding-blocks")
    left = rows.select("cell", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "id", "w", "vec")
    right = rows.select("cell", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), "id", "w", "vec")
    keys = ["cell", "i", "j"]

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return compared_blocks(x, y, key[1] == key[2], threshold)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "kind string, a long, b long, n long")


def compared_blocks(x: pd.DataFrame, y: pd.DataFrame, same: bool, threshold: float) -> pd.DataFrame:
    """Link counts ('n') of both blocks' classes and a spanning forest ('e')."""
    if not len(x) or not len(y):
        return pd.DataFrame({"kind": np.empty(0, object), **{c: np.empty(0, np.int64) for c in "abn"}})
    if same:
        y = x
    ids_x, ids_y = x["id"].to_numpy(), y["id"].to_numpy()
    linked = unit_rows(x["vec"]) @ unit_rows(y["vec"]).T >= threshold
    linked &= ids_x[:, None] != ids_y[None, :]
    low_x, low_y = ids_x.copy(), ids_y.copy()
    while True:  # the smallest id reached, both ways, until it stays
        new_x = np.minimum(low_x, np.where(linked, low_y[None, :], np.iinfo(np.int64).max).min(1))
        new_y = np.minimum(low_y, np.where(linked, new_x[:, None], np.iinfo(np.int64).max).min(0))
        if (new_x == low_x).all() and (new_y == low_y).all():
            break
        low_x, low_y = new_x, new_y
    sides = [(ids_x, low_x, linked @ y["w"].to_numpy().astype(np.int64))]
    if not same:
        sides.append((ids_y, low_y, linked.T @ x["w"].to_numpy().astype(np.int64)))
    kinds, first, second, counts = [], [], [], []
    for ids, low, n in sides:
        some, below = n > 0, low < ids
        kinds += ["n"] * int(some.sum()) + ["e"] * int(below.sum())
        first += [ids[some], low[below]]
        second += [np.zeros(int(some.sum()), np.int64), ids[below]]
        counts += [n[some], np.zeros(int(below.sum()), np.int64)]
    return pd.DataFrame({"kind": kinds, "a": np.concatenate(first), "b": np.concatenate(second), "n": np.concatenate(counts)})


def audit(classes: DataFrame, counts: DataFrame, threshold: float, min_recall: float, queries: int = AUDIT_QUERIES) -> list[str]:
    """Labels (cells) of a bounded sample of queries that fail the audit."""
    total = classes.count()
    if not total:
        return []
    unit = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = classes.where(unit < min(1.0, queries / total)).join(counts, "id", "left").select(
        "id", "cell", "vec", F.coalesce("n", F.lit(0)).alias("n")).limit(2 * queries).toPandas()
    if not len(sample):
        return []
    q, cells, ids = unit_rows_by_cell(sample)
    shared = classes.sparkSession.sparkContext.broadcast((q, cells, ids))  # bounded: 2 * queries vectors

    def compare(batches):
        q, cells, ids = shared.value
        for batch in batches:
            out = []
            for cell, part in batch.groupby("cell"):
                if cell in cells:
                    sim = unit_rows(part["vec"]) @ q[cell].T
                    for k, i in enumerate(ids[cell]):
                        hit = (sim[:, k] >= threshold) & (part["id"].to_numpy() != i)
                        out.append((i, int(part["w"].to_numpy()[hit].sum())))
            yield pd.DataFrame(out, columns=["id", "true"])

    true = classes.select("id", "cell", "w", "vec").mapInPandas(compare, "id long, true long").groupBy("id").agg(F.sum("true").alias("true")).toPandas()
    both = sample.merge(true, on="id")
    both["found"] = np.minimum(both["n"], both["true"])
    label = both.groupby("cell")[["found", "true"]].sum()
    failed = set(label.index[label["found"] < min_recall * label["true"]])
    failed |= set(both.loc[(both["true"] >= 10) & (both["found"] < MIN_QUERY_RECALL * both["true"]), "cell"])
    return sorted(failed)


def unit_rows_by_cell(sample: pd.DataFrame) -> tuple[dict, set, dict]:
    q, ids = {}, {}
    for cell, part in sample.groupby("cell"):
        q[cell], ids[cell] = unit_rows(part["vec"]), part["id"].tolist()
    return q, set(q), ids


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD_SIZE, beam: int = BEAM,
                    min_recall: float = MIN_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept, class_id for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    ok = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vec")), F.lit(False))
    cell = F.concat_ws(":", F.col("label").cast("string"), F.size("vec").cast("string"))
    valid = rows.where(ok).withColumn("cell", cell).withColumn("key", F.xxhash64("vec"))
    classes = written(valid.groupBy("cell", "key", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "embedding-classes")
    spark = vectors.sparkSession
    dense = written(dense_labels(classes), "embedding-dense")
    graphed = written(classes.select("cell", "id", "w", "vec").join(dense, "cell", "left_anti"), "embedding-graphed")
    shards = written(split_cells(graphed.withColumn("own", F.lit(True)), shard_size), "embedding-shards")
    # labels with classes in no shard of their own were not split far enough
    unsplit = graphed.select("cell", "id").join(shards.where("own").select("id"), "id", "left_anti").select("cell").distinct()
    for width in (beam, 4 * beam):
        found = written(search(shards, width, threshold), "embedding-found")
        failed = audit(graphed, link_counts(graphed, found), threshold, min_recall)
        if not failed:
            break
    names = spark.createDataFrame([(x,) for x in failed], "cell string")  # of a bounded sample
    blocked = written(dense.unionByName(unsplit).unionByName(names).distinct(), "embedding-blocked")
    settled = classes.join(blocked, "cell", "left_semi")
    graph_ids = graphed.join(blocked, "cell", "left_anti").select(F.col("id").alias("a"))
    found = written(found.join(graph_ids, "a", "left_semi").select("kind", "a", "b", "n").unionByName(block_links(settled, threshold)), "embedding-links")
    counts = written(link_counts(classes, found), "embedding-counts")
    component = components(found.where("kind != 'n'").select("a", "b"), "embedding-components").withColumnRenamed("id", "_id")
    named = classes.select(F.col("cell").alias("_cell"), F.col("key").alias("_key"), F.col("vec").alias("_vec"), F.col("id").alias("class_id"), "w").join(
        counts.withColumnRenamed("id", "class_id"), "class_id", "left").join(component, F.col("class_id") == F.col("_id"), "left")
    linked = valid.join(named, (F.col("cell") == F.col("_cell")) & (F.col("key") == F.col("_key")) & (F.col("vec") == F.col("_vec")), "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").alias("class_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).select(
        "vec_id", "n_links", "component_id", "kept", "class_id")
