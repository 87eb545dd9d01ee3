"""Clusters of mutually similar vectors by density hierarchy.

Equal vectors are one node. Space is cut in tiles small enough for one task each (dense coarse cells are cut finer), with a margin of the search radius,
so every near pair is inside some tile. A tile emits only a minimum spanning forest of its mutual-reachability graph: no pair lists leave a task, and the
union of the forests has the same components as all near pairs at every distance. Boruvka rounds turn that union into the spanning forest of all nodes;
the forest gives connected clusters at the radius, and by its condensed hierarchy the most stable clusters with their most persistent members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import drop_staged, join_hot, python_partitions, stage

#: Points a tile should hold; a coarse cell with more is halved in every dimension until its tiles should hold this many.
TILE_POINTS = 700
#: Side of a coarse cell and least side of a tile, in search radii.
COARSE, LEAST = 16, 1.0
#: With at most this many edges left between components, one task finishes the forest (24 bytes an edge); before, Boruvka rounds do.
FINISH_EDGES = 20_000
#: Vectors of more than one in HOT members are joined by broadcast (HOT of them at most).
HOT = 10_000
_EDGE = "run bigint, u bigint, v bigint, w double"


@dataclass
class Forest:
    """``nodes``: (run, node, id, x, mult), ``edges``: spanning forest (run, u, v, w), ``labels``: (node, comp)."""

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame


def make_nodes(elements: DataFrame, run: Column, element: Column, vec: Column) -> DataFrame:
    """Distinct vectors of a run: ``id`` is the smallest element id, ``mult`` the number of elements. Elements must be distinct and finite."""
    rows = elements.select(run.cast("bigint").alias("run"), element.cast("bigint").alias("id"), vec.cast("array<double>").alias("x")).where("x IS NOT NULL AND size(x) > 0")
    nodes = rows.groupBy("run", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"))
    return stage(nodes.select("run", "id", "x", "mult", F.monotonically_increasing_id().alias("node")), "nodes")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.vstack(x.to_list()) if len(x) else np.zeros((0, 1))


def _copies(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integer cells in the boxes low..high (rows): (row, cell)."""
    rows, cells = np.arange(len(low)), np.zeros((len(low), 0), np.int64)
    for d in range(low.shape[1]):
        n = (high[:, d] - low[:, d] + 1)[rows]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, cells = np.repeat(rows, n), np.repeat(cells, n, axis=0)
        cells = np.hstack((cells, (low[rows, d] + step)[:, None]))
    return rows, cells


def _hash(cells: np.ndarray, seed: int) -> np.ndarray:
    """Two tiles of a run that collide are worked on as one, which is harmless."""
    h = np.full(len(cells), seed, np.uint64)
    with np.errstate(over="ignore"):
        for d in range(cells.shape[1]):
            h = (h ^ cells[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _by_dimension(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in pdf.groupby(pdf["x"].map(len), sort=False):
        yield part.reset_index(drop=True)


def tiles(points: DataFrame, radius: float) -> DataFrame:
    """``points`` (run, node, x, mult, core) copied to every tile whose margin holds them: adds ``tile`` and ``home``."""
    side = COARSE * radius

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _by_dimension(pdf):
                x = _matrix(part["x"])
                rows, cells = _copies(np.floor((x - radius) / side).astype(np.int64), np.floor((x + radius) / side).astype(np.int64))
                home = (cells == np.floor(x / side).astype(np.int64)[rows]).all(axis=1)
                yield part.iloc[rows].assign(cell=list(cells), key=_hash(cells, 1), home=home)

    near = points.mapInPandas(coarse, "run bigint, node bigint, x array<double>, mult bigint, core double, cell array<bigint>, key bigint, home boolean")
    counts = near.where("home").groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"))
    most = int(np.floor(np.log2(COARSE / LEAST)))
    level = F.least(F.greatest(F.ceil(F.log2(F.col("n") / F.lit(TILE_POINTS)) / F.col("d")), F.lit(0)), F.lit(most)).cast("int")
    levels = counts.select(F.col("run").alias("_run"), F.col("key").alias("_key"), level.alias("level"))
    placed = near.join(levels, (F.col("run") == F.col("_run")) & (F.col("key") == F.col("_key"))).select("run", "node", "x", "mult", "core", "cell", "level")

    def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _by_dimension(pdf):
                x, cell = _matrix(part["x"]), np.vstack(part["cell"].to_list())
                split = (1 << part["level"].to_numpy(np.int64))[:, None]
                s = side / split
                own = np.floor(x / s).astype(np.int64)
                low = np.maximum(np.floor((x - radius) / s).astype(np.int64), cell * split)
                high = np.minimum(np.floor((x + radius) / s).astype(np.int64), (cell + 1) * split - 1)
                rows, places = _copies(low, np.maximum(high, low))
                home = (places == own[rows]).all(axis=1)
                tag = np.hstack((places, part["level"].to_numpy(np.int64)[rows][:, None]))
                yield part[["run", "node", "x", "mult", "core"]].iloc[rows].assign(tile=_hash(tag, 2), home=home)

    return placed.mapInPandas(fine, "run bigint, node bigint, x array<double>, mult bigint, core double, tile bigint, home boolean")


def _dims(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for part in _by_dimension(pdf):
        yield part, _matrix(part["x"])


def core_distances(points: DataFrame, radius: float, min_samples: int) -> DataFrame:
    """(node, core): distance to the ``min_samples``-th nearest element, the node's own elements included; nodes where it exceeds the radius are left out."""

    def cores(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, x in _dims(pdf):
            mult, own = part["mult"].to_numpy(np.int64), np.flatnonzero(part["home"].to_numpy())
            found = np.full(len(own), np.inf)
            for a, i in enumerate(own):
                near = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
                keep = np.flatnonzero(near <= radius)
                keep = keep[np.argsort(near[keep])]
                upto = np.cumsum(mult[keep])
                if upto[-1] >= min_samples:
                    found[a] = near[keep[np.searchsorted(upto, min_samples)]]
            good = np.isfinite(found)
            out.append(pd.DataFrame({"node": part["node"].to_numpy()[own[good]], "core": found[good]}))
        return pd.concat(out)

    n = python_partitions(points.sparkSession)
    return tiles(points, radius).repartition(n, "run", "tile").groupBy("run", "tile").applyInPandas(cores, "node bigint, core double")


def _tile_forest(radius: float):
    """Prim's forest of a tile by the order of all tiles (w, smaller node, larger node), so that an edge of the whole forest is in the forest of every tile
    that holds both ends, and a tile may leave those without a home end to others."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, x in _dims(pdf.sort_values("node")):
            n, core, home, node = len(part), part["core"].to_numpy(), part["home"].to_numpy(), part["node"].to_numpy()
            if not home.any():
                continue
            x = np.ascontiguousarray(x.T)
            best, to = np.full(n, np.inf), np.full(n, -1)
            left = np.ones(n, bool)
            edges = []
            i = 0
            for _ in range(n):
                left[i] = False
                if to[i] >= 0 and (home[i] or home[to[i]]):
                    edges.append((node[to[i]], node[i], best[i]))
                best[i] = np.inf
                gap = x - x[:, i : i + 1]
                d = np.sqrt((gap * gap).sum(axis=0))
                w = np.maximum(np.maximum(d, core[i]), core)
                nearer = left & (d <= radius) & ((w < best) | ((w == best) & (i < to)))
                best[nearer], to[nearer] = w[nearer], i
                i = int(np.argmin(best))
                if np.isfinite(best[i]):
                    equal = np.flatnonzero(best == best[i])
                    if len(equal) > 1:
                        i = int(equal[np.lexsort((np.maximum(equal, to[equal]), np.minimum(equal, to[equal])))[0]])
                else:
                    rest = np.flatnonzero(left)
                    if not len(rest):
                        break
                    i = int(rest[0])
                    to[i] = -1
            if edges:
                u, v, w = zip(*edges, strict=True)
                out.append(pd.DataFrame({"run": part["run"].iloc[0], "u": u, "v": v, "w": w}))
        return pd.concat(out) if out else pd.DataFrame({"run": pd.Series(dtype="int64"), "u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "w": pd.Series(dtype=float)})

    return forest


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kruskal on the edges left between components: chosen edges, and the root of each component."""
    pdf = pdf.sort_values(["w", "u", "v"], kind="stable")
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        root = a
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[a] != root:
            parent[a], a = root, parent[a]
        return root

    rows = []
    for run, u, v, w, a, b in zip(*[pdf[c].tolist() for c in ("run", "u", "v", "w", "cu", "cv")], strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            rows.append((run, u, v, w))
    roots = [(c, find(c)) for c in list(parent)]
    chosen = pd.DataFrame(rows, columns=["run", "u", "v", "w"]).assign(comp=-1, root=-1)
    heads = pd.DataFrame(roots, columns=["comp", "root"]).assign(run=-1, u=-1, v=-1, w=0.0)
    return pd.concat([chosen, heads])[["run", "u", "v", "w", "comp", "root"]]


def boruvka(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest (run, u, v, w) of ``edges``, and (node, comp) of every node that has an edge. Ties go by (w, u, v)."""
    first = edges.select("run", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").where("u <> v")
    open_ = stage(first.groupBy("u", "v").agg(F.min("w").alias("w"), F.first("run").alias("run")).select("run", "u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    labels = stage(open_.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    chosen: list[DataFrame] = []
    while True:
        left = open_.count()
        if left == 0:
            break
        if left <= finish_edges:
            done = open_.groupBy().applyInPandas(_finish, _EDGE + ", comp bigint, root bigint")
            done = stage(done, "finish")
            chosen.append(done.where("comp < 0").select("run", "u", "v", "w"))
            drop_staged(open_)
            labels = _relabel(labels, done.where("comp >= 0").select("comp", "root"))
            break
        both = open_.select("run", "u", "v", "w", F.col("cu").alias("c"), F.col("cv").alias("o")).unionByName(open_.select("run", "u", "v", "w", F.col("cv").alias("c"), F.col("cu").alias("o")))
        nearest = stage(both.groupBy("c").agg(F.min(F.struct("w", "u", "v", "o", "run")).alias("e")).select("c", "e.*"), "nearest")
        chosen.append(nearest.select("run", "u", "v", "w").distinct())
        back = nearest.select(F.col("c").alias("_c"), F.col("o").alias("_o"))
        hook = nearest.join(back, F.col("o") == F.col("_c")).select("c", F.when((F.col("_o") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        hook = last = stage(hook, "hooks")
        while True:  # pointer jumping: the depth halves
            up = hook.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
            jumped = stage(hook.join(up, F.col("p") == F.col("_c")).select("c", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")), "hooks")
            drop_staged(last)
            last, hook = jumped, jumped.select("c", "p")
            if jumped.where("moved").limit(1).count() == 0:
                break
        roots = hook.select(F.col("c").alias("comp"), F.col("p").alias("root"))
        relabelled = stage(_relabel(labels, roots), "labels")
        drop_staged(labels)
        labels = relabelled
        a, b = roots.select(F.col("comp").alias("cu"), F.col("root").alias("ru")), roots.select(F.col("comp").alias("cv"), F.col("root").alias("rv"))
        moved = open_.join(a, "cu").join(b, "cv").where("ru <> rv").select("run", "u", "v", "w", F.least("ru", "rv").alias("cu"), F.greatest("ru", "rv").alias("cv"))
        best = moved.groupBy("cu", "cv").agg(F.min(F.struct("w", "u", "v", "run")).alias("e"))
        left_open = stage(best.select("e.run", "e.u", "e.v", "e.w", "cu", "cv"), "edges")
        drop_staged(open_, last)
        open_ = left_open
    forest = None
    for part in chosen:
        forest = part if forest is None else forest.unionByName(part)
    return (forest if forest is not None else first.limit(0)), labels  # a forest of the rounds' nearest edges, each staged


def _relabel(labels: DataFrame, roots: DataFrame) -> DataFrame:
    r = roots.select(F.col("comp").alias("_comp"), F.col("root").alias("_root"))
    return labels.join(r, F.col("comp") == F.col("_comp"), "left").select("node", F.coalesce("_root", "comp").alias("comp"))


def spanning_forest(elements: DataFrame, run: Column, element: Column, vec: Column, radius: float, min_samples: int = 1, finish_edges: int = FINISH_EDGES) -> Forest:
    """Mutual-reachability spanning forest within ``radius``. With ``min_samples`` 1 distances are plain ones."""
    nodes = make_nodes(elements, run, element, vec)
    n = python_partitions(nodes.sparkSession)
    points = nodes.select("run", "node", "x", "mult", F.lit(0.0).alias("core")).repartition(n, "node")
    if min_samples > 1:
        cores = stage(core_distances(points, radius, min_samples), "cores")
        points = points.drop("core").join(cores, "node").select("run", "node", "x", "mult", "core")
    local = tiles(points, radius).repartition(n, "run", "tile").groupBy("run", "tile").applyInPandas(_tile_forest(radius), _EDGE)
    edges, labels = boruvka(local.where(F.col("w") <= radius), finish_edges)
    return Forest(nodes, edges, labels)


def connected(elements: DataFrame, run: Column, element: Column, vec: Column, radius: float, least: int, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(cluster_id, element): largest sets of elements joined by chains of pairs within ``radius``, of at least ``least`` elements.

    ``cluster_id`` is the smallest element id of the cluster. Null or empty vectors must be filtered before; vectors of different length in one run
    are never near. Copies of a vector are elements of their own and count in sizes. Empty input gives an empty result.
    """
    forest = spanning_forest(elements, run, element, vec, radius, 1, finish_edges)
    own = forest.labels.select(F.col("node").alias("_node"), "comp")
    named = forest.nodes.join(own, F.col("node") == F.col("_node"), "left").select("run", "x", "id", "mult", F.coalesce("comp", "node").alias("comp"))
    sizes = named.groupBy("comp").agg(F.min("id").alias("cluster_id"), F.sum("mult").alias("size")).where(F.col("size") >= least)
    members = stage(named.join(sizes, "comp").select(F.col("run").alias("_run"), F.col("x").alias("_x"), "cluster_id", "mult"), "members")
    rows = elements.select(run.cast("bigint").alias("run"), element.alias("element"), vec.cast("array<double>").alias("x"))
    # a vector that more than one in HOT of the members share gathers in no task
    least = members.agg(F.coalesce(F.sum("mult"), F.lit(0)).alias("n")).first()["n"] // HOT
    return join_hot(rows, members, (F.col("run") == F.col("_run")) & (F.col("x") == F.col("_x")), F.col("mult") > least).select("cluster_id", "element")


def condense(u: np.ndarray, v: np.ndarray, w: np.ndarray, size: dict[int, int], least: int, radius: float) -> list[tuple[int, float, list[tuple[int, float]]]]:
    """Clusters of one tree by stability: (number of elements, stability, [(node, density level at which it leaves)])."""
    order = np.lexsort((v, u, w))
    leaf = {n: i for i, n in enumerate(size)}
    names, count = list(size), list(size.values())
    n = len(names)
    top, kids, dist = list(range(n)), [], []

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    for e in order.tolist():
        a, b = find(leaf[int(u[e])]), find(leaf[int(v[e])])
        new = n + len(kids)
        top.append(new)
        top[a] = top[b] = new
        kids.append((a, b))
        dist.append(float(w[e]))
        count.append(count[a] + count[b])
    most = 1000.0 / radius  # copies of a vector never part; their level is bounded so that they don't outweigh all else
    level = [min(1.0 / d, most) if d > 0 else most for d in dist]

    def leaves(a: int) -> list[int]:
        out, todo = [], [a]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x - n]
        return out

    root = n + len(kids) - 1
    born, members, children, parent = [1.0 / radius], [[]], [[]], [-1]
    todo = [(root, 0)]
    while todo:
        a, c = todo.pop()
        if a < n:
            members[c].append((a, most))
            continue
        l, (x, y) = level[a - n], kids[a - n]
        big = [k for k in (x, y) if count[k] >= least]
        if len(big) == 2:
            for k in big:
                born.append(l)
                members.append([])
                children.append([])
                parent.append(c)
                children[c].append(len(born) - 1)
                todo.append((k, len(born) - 1))
        else:
            for k in (x, y):
                if k in big:
                    todo.append((k, c))
                else:
                    members[c] += [(m, l) for m in leaves(k)]
    passed = [0] * len(born)
    for c in range(len(born) - 1, -1, -1):
        passed[c] = sum(count[m] for m, _ in members[c]) + sum(passed[k] for k in children[c])
    stability = [
        sum((l - born[c]) * count[m] for m, l in members[c]) + sum((born[k] - born[c]) * passed[k] for k in children[c]) for c in range(len(born))
    ]
    kept, value = [False] * len(born), list(stability)
    for c in range(len(born) - 1, -1, -1):
        below = sum(value[k] for k in children[c])
        if children[c] and below > stability[c]:
            value[c] = below
        else:
            kept[c] = True
    out, todo = [], [0]
    while todo:
        c = todo.pop()
        if not kept[c]:
            todo += children[c]
            continue
        inside, more = [], [c]
        while more:
            k = more.pop()
            inside += members[k]
            more += children[k]
        out.append((passed[c], stability[c], [(names[m], l) for m, l in inside]))
    return [o for o in out if o[0] >= least]


def stable_clusters(
    elements: DataFrame, run: Column, element: Column, vec: Column, radius: float, min_samples: int, least: int, exemplars: int = 3, finish_edges: int = FINISH_EDGES
) -> DataFrame:
    """(run, cluster_id, size, stability, exemplars) of the most stable clusters of the condensed hierarchy within ``radius``.

    ``cluster_id`` is the smallest element id; ``exemplars`` are the ids of the most persistent vectors (ties by id). Elements of no cluster are noise.
    The hierarchy of one connected component is built in one task: 24 bytes an edge, one edge a distinct vector.
    """
    forest = spanning_forest(elements, run, element, vec, radius, min_samples, finish_edges)
    comps = forest.labels.select(F.col("node").alias("_node"), F.col("comp").alias("tree"))
    edges = forest.edges.join(comps, F.col("u") == F.col("_node")).select("run", "tree", "u", "v", "w")
    owners = forest.labels.select(F.col("node").alias("_node"), F.col("comp").alias("wood"))
    info = forest.nodes.join(owners, F.col("node") == F.col("_node")).select("run", "wood", "node", "id", "mult")

    def tree(es: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        ids = dict(zip(ns["node"].tolist(), ns["id"].tolist(), strict=True))
        size = dict(zip(ns["node"].tolist(), ns["mult"].tolist(), strict=True))
        rows = []
        if len(es):
            for n, s, members in condense(es["u"].to_numpy(), es["v"].to_numpy(), es["w"].to_numpy(), size, least, radius):
                best = sorted(members, key=lambda m: (-m[1], ids[m[0]]))[:exemplars]
                rows.append((int(es["run"].iloc[0]), min(ids[m] for m, _ in members), n, s, [ids[m] for m, _ in best]))
        return pd.DataFrame(rows, columns=["run", "cluster_id", "size", "stability", "exemplars"])

    grouped = edges.groupBy("tree").cogroup(info.groupBy("wood"))
    return grouped.applyInPandas(tree, "run bigint, cluster_id bigint, size bigint, stability double, exemplars array<bigint>")

