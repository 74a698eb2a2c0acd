"""Embedding near-dedup with a robust-pruned flat graph.

Vectors within the radius of their nearest centre ("close" ones, as in any large group of near vectors) are compared exactly with all vectors that can be within the
radius of them by the triangle inequality, so no number of partners is too large. Only pairs of two other vectors are left to the graph.

These are dealt to overlapping shards: each goes to its three nearest centres and, where a centre has more vectors than a shard holds, to the three nearest
centres among those of its vectors, and so on until no shard is too large. Every shard builds a robust-pruned graph; adjacency lists of a vector
are united over its shards. Then each shard is searched for its own vectors: a greedy search from the medoid reaches the query's
neighbourhood, and the search range is expanded over the graph while vectors within the radius turn up. Pairs found are verified by cosine in
double precision. ``recall`` audits the result against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix
from .shared import components, stash

RADIUS = 0.9
#: Vectors of a shard at most, about; sample (rows) and number of centres at most.
SHARD, SAMPLE, CENTRES = 1200, 20_000, 4096
#: Centres that a vector goes to; of an overfull shard: centres at most, sampled vectors for each, vectors of a task that deals them.
OVERLAP, FINER, EACH, DEALT = 3, 64, 30, 20_000
#: Out-degree of a robust-pruned list, its slack, candidates considered, width of the greedy search.
DEGREE, SLACK, POOL, BEAM = 24, 1.2, 96, 24
#: Numbers of close vectors that one pass of the exact comparison is given as a broadcast (32 MB); more take several passes. Vectors of a comparison at most.
PASS, PIECE = 4_000_000, 1000


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of doubles): vectors without null, NaN or infinite components and not all zero."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and id is not null")
    return rows.where(_fine("v"))


def _fine(v: str) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _unit(block: np.ndarray) -> np.ndarray:
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def centres(points: DataFrame, n: int, sample: int = SAMPLE, most: int = CENTRES) -> np.ndarray:
    """Spherical k-means on a bounded sample (the least hashes); about one centre for each SHARD / 2 of ``n`` vectors, at most ``most``."""
    rows = points.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("v").toArrow()["v"]
    x = _unit(np.stack([np.asarray(r, float) for r in rows.to_pylist()]))
    return _means(x, int(min(most, max(1, round(2 * n / SHARD)), len(x))))


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(8):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(0)
                c[j] /= np.linalg.norm(c[j]) or 1
    return c


def fine_shards(dealt: DataFrame) -> DataFrame:
    """first, shard of ``dealt`` (first, v, shard) with overfull shards divided: their vectors go to the OVERLAP nearest of centres found among a sample of them.

    The sample is by hashes and grows with the centres, not with the shard; vectors of one shard are dealt in tasks of about DEALT. It ends when no shard is overfull or
    dividing makes the largest no smaller (then that one stays large).
    """
    left, done, largest = stash(dealt, "dealt"), None, None
    while True:
        over = stash(left.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * SHARD), "overfull")
        top = over.agg(F.max("n")).first()[0]
        if top is None or (largest is not None and top >= largest):
            return (left if done is None else done.unionByName(left)).select("first", "shard")
        largest = top
        cool = left.join(over, "shard", "left_anti")
        done = cool if done is None else done.unionByName(cool)
        k = F.least(F.lit(FINER), F.greatest(F.lit(2), F.round(2 * F.col("n") / SHARD).cast("int")))
        rows = left.join(over, "shard").withColumn("k", k).withColumn("part", F.pmod(F.xxhash64("first", "shard"), F.ceil(F.col("n") / DEALT)))
        sample = rows.where(F.pmod(F.xxhash64("shard", "first"), F.col("n")) < F.col("k") * EACH)

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("first")
            c = _means(np.stack(group.v.to_numpy()), int(min(group.k.iloc[0], len(group))))
            return pd.DataFrame({"shard": [group["shard"].iloc[0]], "n": [group["n"].iloc[0]], "c": [c.reshape(-1)]})

        found = stash(sample.groupBy("shard").applyInPandas(fit, "shard long, n long, c array<double>"), "centres")
        sent = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / DEALT) - 1))).select("shard", "part", "c")

        def deal(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(group) or not len(own):  # without a sample the shard stays
                return group[["first", "v", "shard"]]
            x = np.stack(group.v.to_numpy())
            c = own.c.iloc[0].reshape(-1, x.shape[1])
            best = np.argsort(-x @ c.T, axis=1, kind="stable")[:, :OVERLAP]
            names = mix(group["shard"].to_numpy().astype(np.int64).view(np.uint64)[:, None] + best.astype(np.uint64) + np.uint64(1)).view(np.int64)
            at = np.repeat(np.arange(len(x)), best.shape[1])
            return pd.DataFrame({"first": group["first"].to_numpy()[at], "v": group.v.to_numpy()[at], "shard": names.reshape(-1)})

        out = rows.select("first", "v", "shard", "part").groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(deal, "first long, v array<double>, shard long")
        left = stash(out, "dealt")


def robust_prune(sim: np.ndarray, point: int, pool: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> list[int]:
    """Neighbours of ``point`` out of ``pool`` (sorted by falling similarity): one stays unless a kept one is nearer to it by the factor ``slack`` than ``point`` is."""
    kept: list[int] = []
    gap = np.sqrt(np.maximum(0, 2 - 2 * sim[point, pool]))
    alive = np.ones(len(pool), bool)
    for k in range(len(pool)):
        if alive[k]:
            kept.append(int(pool[k]))
            if len(kept) == degree:
                break
            alive &= slack * np.sqrt(np.maximum(0, 2 - 2 * sim[pool[k], pool])) > gap
    return kept


def build_graph(x: np.ndarray) -> list[list[int]]:
    """Robust-pruned adjacency of a shard, with the reverse of every edge."""
    sim = x @ x.T
    n = len(x)
    pool = min(POOL, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    if pool < 1:
        return out
    near = np.argpartition(-sim, min(pool, n - 1), axis=1)[:, : pool + 1]
    for i in range(n):
        own = near[i][near[i] != i]
        out[i] = robust_prune(sim, i, own[np.argsort(-sim[i, own], kind="stable")])
    reverse: list[set] = [set(a) for a in out]
    for i, a in enumerate(out):
        for j in a:
            reverse[j].add(i)
    return [sorted(a) for a in reverse]


def range_search(x: np.ndarray, links: list[np.ndarray], start: int, query: np.ndarray, radius: float, beam: int = BEAM) -> np.ndarray:
    """Members within ``radius`` of ``query``: greedy search from ``start`` with a beam, which is then expanded as far as hits lead on."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    ids, sims, done = np.array([start]), np.array([x[start] @ query]), np.zeros(1, bool)
    while True:
        # the open members among the best ``beam``, and all open hits
        order = np.argsort(-sims, kind="stable")
        lead = order[:beam]
        turn = np.union1d(lead[~done[lead]][:4], np.flatnonzero((sims >= radius - 0.05) & ~done))
        if not len(turn):
            break
        done[turn] = True
        new = np.unique(np.concatenate([links[i] for i in ids[turn]])).astype(np.int64)
        new = new[~seen[new]]
        seen[new] = True
        if len(new):
            ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ query]), np.concatenate([done, np.zeros(len(new), bool)])
    return ids[sims >= radius]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]`` in place; ``root`` gives each member's set by its least member."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def exact_links(placed: DataFrame, c: np.ndarray, radius: float) -> DataFrame:
    """first, n, mate: all links with at least one close vector, compared in blocks.

    Passes over ``placed`` with a broadcast of close vectors each. A vector skips a centre's close vectors where the angles show that none is within the radius.
    A vector gets the copies of its close partners; a close vector also those of its other partners. Each task unites the close vectors that its links join.
    """
    close = placed.where("close")
    some = close.select(F.count("*"), F.max(F.size("v"))).first()
    passes = -(-some[0] * (some[1] or 0) // PASS)
    kind = "first long, n long, mate long"
    found = placed.sparkSession.createDataFrame([], kind)
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = np.arccos(np.clip(radius, -1, 1)) + 1e-6
    angles = lambda a, b: np.arccos(np.clip(a @ b.T, -1, 1))

    def compare(k: int) -> DataFrame:
        got = close.where(F.pmod(F.xxhash64("first"), F.lit(passes)) == k).select("first", "copies", "v", F.col("near")[0].alias("home")).toArrow()
        if not len(got):
            return found
        home = got["home"].to_numpy()
        order = np.lexsort((got["first"].to_numpy(), home))
        ids, copies, home = got["first"].to_numpy()[order], got["copies"].to_numpy()[order], home[order]
        x = got["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        start = np.concatenate([np.flatnonzero(np.diff(home, prepend=-1)), [len(home)]])
        pieces = [(a, min(a + PIECE, end)) for begin, end in zip(start[:-1], start[1:]) for a in range(begin, end, PIECE)]
        middle = c[[home[a] for a, _ in pieces]]
        wide = np.array([angles(x[a:b], m[None]).max() for (a, b), m in zip(pieces, middle)])
        sent = placed.sparkSession.sparkContext.broadcast((ids, copies, x, pieces, middle, wide, np.argsort(ids)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, copies, x, pieces, middle, wide, order = sent.value
            root, more = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            for part in parts:
                for at in range(0, len(part), PIECE):
                    own = part[at : at + PIECE]
                    q, first, mine = np.stack(own.v.to_numpy()), own["first"].to_numpy(), own.copies.to_numpy()
                    far, open_ = angles(q, middle) <= reach + wide, ~own.close.to_numpy(bool)
                    n, label = np.zeros(len(q), np.int64), np.full(len(q), -1)
                    place = order[np.minimum(np.searchsorted(ids[order], first), len(ids) - 1)]
                    n -= np.where(ids[place] == first, mine, 0)
                    for j, (a, b) in enumerate(pieces):
                        rows = np.flatnonzero(far[:, j])
                        if not len(rows):
                            continue
                        hits = q[rows] @ x[a:b].T >= radius
                        some = hits.any(1)
                        rows, hits = rows[some], hits[some]
                        if not len(rows):
                            continue
                        n[rows] += np.where(hits, copies[a:b], 0).sum(1)
                        more[a:b] += np.where(hits[open_[rows]], mine[rows][open_[rows], None], 0).sum(0)
                        label[rows] = np.where(label[rows] < 0, a + hits.argmax(1), label[rows])
                        while (apart := hits & (root[label[rows]][:, None] != root[a:b])).any():
                            two = np.flatnonzero(apart.any(1))
                            unite(root, label[rows][two], a + apart[two].argmax(1))
                    yield pd.DataFrame({"first": first, "n": n, "mate": np.where(label < 0, first, ids[root[label]])})
            told = np.flatnonzero((root != np.arange(len(root))) | (more > 0))
            yield pd.DataFrame({"first": ids[told], "n": more[told], "mate": ids[root[told]]})

        return placed.select("first", "copies", "v", "close").repartition(tasks, "first").mapInPandas(run, kind)

    for k in range(passes):
        found = found.union(compare(k))
    return found


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = RADIUS) -> DataFrame:
    """One row per row: id, n_links (other vectors at cosine >= radius), component_id (smallest id reachable), kept.

    Equal vectors are one node, whose number of copies counts in n_links, so a large group of copies costs one search. Null, zero and
    non-finite vectors and those without an id link with nothing: n_links 0, their id as component (null for a null one), kept. Rows of one id are vectors of their own. Vectors
    of another length than the first are an error. Links with a close vector are counted exactly; each other link in one
    shard only: the first shard of the query that also holds the other vector. All links of a shard, not only samples, join components by a local union that gives each member's
    smallest mate. Other columns are ignored.
    """
    spark = rows.sparkSession
    v = F.transform(vector_col, lambda x: x.cast("double"))
    every = rows.select(F.col(id_col).alias("__id"), F.when(F.col(id_col).isNotNull(), v).alias("v"))
    fine = F.col("v").isNotNull() & _fine("v")
    vectors = every.where(fine).withColumn("vid", F.xxhash64("v"))
    # "first" names a node: ids may be repeated
    nodes = vectors.groupBy("vid", "v").agg(F.min(F.col("__id").cast("long")).alias("least"), F.count("*").alias("copies"))
    nodes = stash(nodes.withColumn("first", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    lone = every.where(~F.coalesce(fine, F.lit(False))).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").cast("long").alias("component_id"))
    named_kept = lambda df: df.select(F.col("__id").alias(id_col), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
    if not n:
        return named_kept(lone)
    c = spark.sparkContext.broadcast(centres(nodes, n))

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = _unit(np.stack(part.v.to_numpy()).astype(float))
                sim = x @ c.value.T
                best = np.argsort(-sim, axis=1, kind="stable")[:, :OVERLAP]
                yield pd.DataFrame({"vid": part.vid, "first": part["first"], "copies": part.copies, "v": list(x), "near": list(best.astype(np.int32)), "close": sim.max(axis=1) >= radius})

    placed = stash(nodes.select("vid", "first", "copies", "v").mapInPandas(nearest, "vid long, first long, copies long, v array<double>, near array<int>, close boolean"), "placed")
    home = fine_shards(placed.where("not close").select("first", "v", F.explode(F.col("near").cast("array<bigint>")).alias("shard")))
    home = home.groupBy("first").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    members = stash(placed.join(home, "first").select("first", "copies", "v", "shards"), "members")
    dealt = members.withColumn("shard", F.explode("shards"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["first"].to_numpy()
        graph = build_graph(np.stack(part.v.to_numpy()))
        return pd.DataFrame({"first": ids, "links": [ids[a] for a in graph]})

    graph = dealt.groupBy("shard").applyInPandas(build, "first long, links array<long>")
    graph = stash(graph.groupBy("first").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "graph")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first", ignore_index=True)
        ids, copies, x = part["first"].to_numpy(), part.copies.to_numpy(), np.stack(part.v.to_numpy())
        links = []
        for a in part.links:
            at = np.searchsorted(ids, a)
            at[at == len(ids)] = 0
            links.append(at[ids[at] == a])
        own = part.shard.iloc[0]
        medoid = int(np.argmax(x @ x.mean(0)))
        order = [list(s) for s in part.shards]
        sets = [set(s) for s in order]
        root = np.arange(len(ids))
        counts = np.zeros(len(ids), np.int64)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(ids)):
            hits = range_search(x, links, medoid, x[i], radius)
            before = order[i][: order[i].index(own)]
            for j in hits[hits != i]:
                if not any(s in sets[j] for s in before):
                    counts[i] += copies[j]
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
        return pd.DataFrame({"first": ids, "n": counts, "mate": ids[[find(i) for i in range(len(ids))]]})

    found = stash(dealt.join(graph, "first").groupBy("shard").applyInPandas(search, "first long, n long, mate long").union(exact_links(placed, c.value, radius)), "found")
    totals = found.groupBy("first").agg(F.sum("n").alias("n"))
    groups = components(found.where("first <> mate").select(F.col("first").alias("a"), F.col("mate").alias("b")))
    named = nodes.join(totals, "first", "left").join(groups.withColumnRenamed("node", "first"), "first", "left")
    named = stash(named.select("vid", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = vectors.join(named.join(least, "component").select("vid", "v", "n_links", "component_id"), ["vid", "v"])
    return named_kept(out.select("__id", "n_links", "component_id").unionByName(lone))


def recall(rows: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = RADIUS, every: int = 20) -> float:
    """Links found over links there are, for the vectors whose id ``every`` divides, by brute force in blocks."""
    queries = valid_vectors(rows, id_col, vector_col).where(f"id % {every} = 0").toPandas()
    if not len(queries):
        return 1.0
    q = rows.sparkSession.sparkContext.broadcast((queries.id.to_numpy(), _unit(np.stack(queries.v.to_numpy()))))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, x = q.value
            hits = x @ _unit(np.stack(part.v.to_numpy())).T >= radius
            hits &= ids[:, None] != part.id.to_numpy()[None, :]
            yield pd.DataFrame({"id": ids, "n": hits.sum(1)})

    true = valid_vectors(rows, id_col, vector_col).mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(found.select(F.col(id_col).alias("id"), "n_links"), "id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return 1.0 if not both[1] else both[0] / both[1]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
