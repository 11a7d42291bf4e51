"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Equal vectors of a label are one node that carries their number. The nodes of a
label are dealt to shards of bounded size; each shard gets a hierarchical graph,
which its task writes to a file in the shared folder. Every node then queries every
shard of its label: a cell is one shard's graph and a block of the nodes of one shard,
and what Spark deals out are only the cells' numbers. A task opens a graph once for all
its cells with it and reads each block of vectors from its shard's file, so no vector
or graph is shuffled for a cell.

A search goes on as long as what it meets is near enough to the threshold, so a node
in a large group finds all of it. Each cell answers some of its queries by brute
force, until these have a fixed number of links with other nodes or no query is left.
The search must find all of them: the beam, and what counts as near enough, double
until it does, and if they cannot the cell is scanned. A pair counts only if its cosine
in double precision reaches the threshold. A cell returns a count per query and a
spanning forest of its links, which it joins as it goes; no list of pairs is held.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.components import components
from twinsieve.llm.settings import Graph
from twinsieve.llm.shared import filesystem, fresh_path, settle, single_threaded
from twinsieve.llm.shingles import mix


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors; node = row number.

    Nodes enter in order. The candidates for a node's links are the nearest of all
    nodes before it on the layer, found exactly by products of blocks; of these the
    spread ones are taken. Links back are added and pruned once, when all have entered.
    """

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, s: Graph):
        self.x, self.s, n = vectors, s, len(vectors)
        u = (mix(keys.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(s.degree)), 12).astype(int)
        self.links: list[dict[int, np.ndarray]] = []
        for layer in range(int(level.max(initial=0)) + 1):
            self.links.append(self._layer(np.flatnonzero(level >= layer), s.degree * (2 if layer == 0 else 1)))
        self.top, self.entry = len(self.links) - 1, int(np.flatnonzero(level >= len(self.links) - 1)[0]) if n else -1
        self.seen, self.mark = np.zeros(n, np.int64), 0

    def _layer(self, members: np.ndarray, most: int) -> dict[int, np.ndarray]:
        x, s, n = self.x[members], self.s, len(members)
        taken: list[list[int]] = [[] for _ in range(n)]
        for at in range(0, n, 256):
            end = min(n, at + 256)
            near = x[at:end] @ x[:end].T
            near[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = -4.0
            width = min(s.build_width, end)
            best = np.argpartition(-near, width - 1, axis=1)[:, :width]
            for i in range(at, end):
                ids = best[i - at]
                ids = ids[ids < i]
                for j in self._spread(x, ids, near[i - at, ids], s.degree):
                    taken[i].append(j)
                    taken[j].append(i)
        out, kept = {}, []
        for i, ids in enumerate(taken):
            if len(ids) > most:
                near = np.array(ids)
                ids = self._spread(x, near, x[near] @ x[i], most)
            kept.append(ids)
        # Each link also leads back, so pruning leaves no node that others cannot reach.
        both: list[list[int]] = [list(ids) for ids in kept]
        for i, ids in enumerate(kept):
            for j in ids:
                both[j].append(i)
        for i, ids in enumerate(both):
            out[int(members[i])] = members[np.unique(np.array(ids, np.int64))]
        return out

    @staticmethod
    def _spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
        """Of some nodes the nearest ones that are not nearer to one already taken; then the nearest others."""
        order = np.lexsort((ids, -sims))[: 4 * most]
        ids, sims = ids[order], sims[order]
        if len(ids) <= most:
            return ids.tolist()
        between = x[ids] @ x[ids].T
        nearest = np.full(len(ids), -4.0)
        taken: list[int] = []
        for a, t in enumerate(sims.tolist()):
            if t > nearest[a]:
                taken.append(a)
                if len(taken) == most:
                    break
                np.maximum(nearest, between[a], out=nearest)
        have = set(taken)
        taken += [a for a in range(len(ids)) if a not in have][: most - len(taken)]
        return ids[taken].tolist()

    def search(self, q: np.ndarray, entries: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The best ``width`` nodes found: (similarity, node)."""
        self.mark += 1
        seen, mark, links = self.seen, self.mark, self.links[layer]
        seen[entries] = mark
        first = list(zip((self.x[entries] @ q).tolist(), entries, strict=True))
        todo = [(-s, i) for s, i in first]
        best = first[:]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[i]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            least = best[0][0] if len(best) >= width else -2.0
            for t, j in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if t > least:
                    heapq.heappush(todo, (-t, j))
                    heapq.heappush(best, (t, j))
                    if len(best) > width:
                        heapq.heappop(best)
                    least = best[0][0] if len(best) >= width else -2.0
        return best

    def near(self, q: np.ndarray, width: int, reach: float, own: int = -1) -> np.ndarray:
        """What a beam of ``width`` finds, and all nodes of at least ``reach`` that links lead to from there; own: the query's node, if it is here."""
        at = [self.entry]
        for layer in range(self.top, 0, -1):
            at = [max(self.search(q, at, 1, layer))[1]]
        if own >= 0 and own not in at:
            at.append(own)
        found = self.search(q, at, width, 0)
        out = np.array([j for _, j in found])
        links, met = self.links[0], np.zeros(len(self.x), bool)
        met[out] = True
        wave = out[np.array([t for t, _ in found]) >= reach]
        parts = [out]
        while len(wave):
            more = np.concatenate([links[i] for i in wave.tolist()])
            more = np.unique(more[~met[more]])
            met[more] = True
            wave = more[self.x[more] @ q >= reach] if len(more) else more
            parts.append(wave)
        return np.concatenate(parts)


def unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Joined:
    """Sets of nodes that are joined as links are found."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def top(self, at: np.ndarray) -> np.ndarray:
        r = self.root[at]
        while ((up := self.root[r]) != r).any():
            r = up
        self.root[at] = r
        return r

    def sets(self, at: np.ndarray) -> list[tuple[int, int]]:
        """Of some nodes the first of each set, with the set."""
        sets, first = np.unique(self.top(at), return_index=True)
        return list(zip(at[first].tolist(), sets.tolist(), strict=True))

    def join(self, at: np.ndarray) -> None:
        r = self.top(at)
        self.root[r] = r.min()


def write_shard(folder: str, name: str, rows: pd.DataFrame, s: Graph) -> None:
    """Two files: the graph with its nodes' ids and copies; and the ids and vectors alone, for reading blocks of them.

    They are written under other names and renamed, so a file that exists is whole;
    the same rows give the same files, whichever task writes them.
    """
    rows = rows.sort_values("node")
    x, ids = unit(rows["vec"].tolist()), rows["node"].to_numpy(np.int64)
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    for kind, data in (("graph", pickle.dumps((SmallWorld(x, ids, s), ids, rows["copies"].to_numpy(np.int64)), protocol=5)), ("rows", ids.tobytes() + x.tobytes())):
        temporary = f"{base}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as out:
            out.write(data)
        files.move(temporary, f"{base}/{name}.{kind}")


def read_graph(folder: str, name: str) -> tuple[SmallWorld, np.ndarray, np.ndarray]:
    files, base = filesystem(folder)
    with files.open_input_stream(f"{base}/{name}.graph", compression=None) as f:
        return pickle.loads(f.read())


def read_block(folder: str, name: str, n: int, dim: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of nodes a to z of a shard of n."""
    files, base = filesystem(folder)
    with files.open_input_file(f"{base}/{name}.rows") as f:
        ids = np.frombuffer(f.read_at(8 * (z - a), 8 * a), np.int64)
        return ids, np.frombuffer(f.read_at(8 * dim * (z - a), 8 * n + 8 * dim * a), np.float64).reshape(-1, dim)


def answer(graph: SmallWorld, ids: np.ndarray, copies: np.ndarray, own: np.ndarray, x: np.ndarray, least: float, s: Graph) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A cell: for each query its number of links with other nodes of the shard; and a spanning forest of the links."""
    place = np.searchsorted(ids, own).clip(max=len(ids) - 1)
    here = np.where(ids[place] == own, place, -1).tolist()
    truth: dict[int, np.ndarray] = {}
    tested, order = 0, np.argsort(mix(own.astype(np.uint64)), kind="stable")
    for i in range(0, len(order), s.audited):
        part = order[i : i + s.audited]
        for k, hit in zip(part.tolist(), (x[part] @ graph.x.T) >= least, strict=True):
            truth[k] = np.flatnonzero(hit)
            tested += len(truth[k]) - (here[k] >= 0)
        if tested >= s.tested:
            break
    width, slack, scan = s.width, s.slack, len(truth) == len(own)
    while not scan and any(len(np.setdiff1d(t, graph.near(x[k], width, least - slack, here[k]))) for k, t in truth.items() if len(t) > (here[k] >= 0)):
        scan = width >= len(ids)
        width, slack = 2 * width, 2 * slack
    counts, forest, joined = np.zeros(len(own), np.int64), [], _Joined(len(ids) + len(own))
    for k, node in enumerate(own.tolist()):
        if k in truth or scan:
            at = truth[k] if k in truth else np.flatnonzero(graph.x @ x[k] >= least)
        else:
            at = graph.near(x[k], width, least - slack, here[k])
            at = at[graph.x[at] @ x[k] >= least]
        at = at[ids[at] != node]
        if len(at):
            counts[k] = copies[at].sum()
            me = here[k] if here[k] >= 0 else len(ids) + k
            # One link to each set that it joins; its own set needs none.
            mine = joined.top(np.array([me]))[0]
            forest += [(node, int(ids[j])) for j, r in joined.sets(at) if r != mine]
            joined.join(np.append(at, me))
    return counts, forest


def links(nodes: DataFrame, least: float, s: Graph) -> DataFrame:
    """``nodes(node, label, copies, vec)`` -> (a, b, n): b null: n links of node a in one shard; else a link."""
    spark = nodes.sparkSession
    most = F.greatest(F.lit(1), F.least(F.lit(s.shard), F.floor(F.lit(s.shard_bytes) / (8 * F.col("dim")))))
    sizes = settle(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("shards")), "sizes")
    dealt = nodes.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["label", "dim"])
    dealt = dealt.select("*", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard"))
    folder = fresh_path(spark, "graphs")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        single_threaded()
        first = rows.iloc[0]
        # The least node of a shard is in no other one.
        name = f"shard-{rows['node'].min()}"
        write_shard(folder, name, rows, s)
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "name": [name], "size": [len(rows)]})

    graphs = settle(dealt.groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, name string, size int"), "graphs", narrow=True)
    blocks = graphs.select("label", "dim", F.col("name").alias("of"), F.col("size").alias("of_size"), F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(s.block))).alias("start"))
    # Both sides have a row per shard or block, 16384 or 2048 nodes each; a label's shards meet all its blocks.
    cells = settle(graphs.select("label", "dim", "name").join(blocks, ["label", "dim"]).select("name", "dim", "of", "of_size", "start"), "cells", narrow=True)
    number = cells.count()
    if not number:
        return spark.createDataFrame([], "a long, b long, n long")
    tasks = max(1, min(number, max(int(spark.conf.get("spark.sql.shuffle.partitions")), number // s.cells)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        single_threaded()
        opened, graph = None, None
        for batch in batches:
            for name, dim, of, of_size, start in zip(*(batch[c].tolist() for c in ("name", "dim", "of", "of_size", "start")), strict=True):
                if name != opened:
                    graph, opened = None, None
                    graph, opened = read_graph(folder, name), name
                own, x = read_block(folder, of, of_size, dim, start, min(of_size, start + s.block))
                counts, forest = answer(*graph, own, x, least, s)
                has = np.flatnonzero(counts)
                a = np.concatenate([own[has], np.array([p[0] for p in forest], np.int64)])
                b = [None] * len(has) + [p[1] for p in forest]
                yield pd.DataFrame({"a": a, "b": pd.array(b, dtype="Int64"), "n": np.concatenate([counts[has], np.zeros(len(forest), np.int64)])})

    return cells.repartitionByRange(tasks, "name", "of", "start").sortWithinPartitions("name", "of", "start").mapInPandas(ask, "a long, b long, n long")


def near_vectors(embeddings: DataFrame, least: float = 0.93, settings: Graph = Graph()) -> DataFrame:  # noqa: B008
    """``embeddings(vec_id, embedding, label)`` -> vec_id, n_links, component_id, kept; one row per row.

    Vectors are compared only if their labels are equal and not null (and their
    lengths are equal). A vector that is null, empty, zero or has a null or
    non-finite component links with nothing, and so does a row without vec_id, whose
    component_id is null and which is kept. Equal vectors of a label are links like
    others. Rows that repeat a vec_id are one vector, for which the least of its
    (label, vector) stands; each of them gets its result. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    named = rows.where("vec_id is not null")
    repeated = not named.groupBy("vec_id").count().where("count > 1").isEmpty()
    one = named.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("v")).select("vec_id", "v.label", "v.vec") if repeated else named
    fit = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda v: v != 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = one.where(F.coalesce(fit, F.lit(False)))
    nodes = valid.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = settle(nodes.select("node", "label", F.size("vec").alias("dim"), "copies", "vec"), "nodes")
    found = settle(links(nodes, least, settings), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    per = nodes.select("node", "label", "vec", "copies").join(counts.withColumnRenamed("a", "node"), "node", "left").join(joined, "node", "left")
    per = per.select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    # Rows that can have no match have a key of their own each, so that they are not one group.
    own = F.when(F.coalesce(fit, F.lit(False)), F.lit(0).cast("long")).otherwise(F.xxhash64("vec_id"))
    out = one.withColumn("own", own).join(settle(per.withColumn("own", F.lit(0).cast("long")), "per"), ["label", "vec", "own"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    if repeated:
        out = named.select("vec_id").join(out, "vec_id")
    out = out.unionByName(rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
