"""Random forests over binned splits, grown a level at a time: one aggregation a level for all trees and nodes.

Samples are (sample, label, features ARRAY<DOUBLE>). Node ids number a heap: node i has the children 2i+1 and 2i+2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.scalar import gini, split_quality
from cellwise.operators import bloom as B
from cellwise.session import broadcast_if_small, drop_staged, stage

NODE_SCHEMA = "tree int, node bigint, feature int, split double, label int, bag_size bigint"


def unpivot(samples: DataFrame) -> DataFrame:
    """(sample, label, feature, value), one row a feature."""
    return samples.select("sample", "label", F.posexplode("features").alias("feature", "value"))


def sample_splits(samples: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sample, label, feature, value, candidate): every value with every candidate of its feature; ``candidates`` (feature, candidates) is broadcast if small."""
    return unpivot(samples).join(broadcast_if_small(candidates), "feature").select("sample", "label", "feature", "value", F.explode("candidates").alias("candidate"))


def _split_key(feature: str = "feature", candidate: str = "candidate") -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", F.col("sample").cast("string"), F.col(feature).cast("string"), F.col(candidate).cast("string")), F.lit(")"))


def split_filters(splits: DataFrame, sizing: B.BloomSizing) -> tuple[DataFrame, DataFrame]:
    """Bloom filters of the (sample, feature, candidate) that go left (value <= candidate) and right."""
    left = B.build(splits.where("value <= candidate"), _split_key(), sizing)
    return left, B.build(splits.where("value > candidate"), _split_key(), sizing)


def filtered_sides(splits: DataFrame, left: DataFrame, right: DataFrame, sizing: B.BloomSizing) -> DataFrame:
    """(sample, label, feature, candidate, goes_left, goes_right) by the filters; a false positive sends a sample both ways."""
    keyed = splits.select("sample", "label", "feature", "candidate", _split_key().alias("key")).distinct()
    a = B.contains(left, keyed, sizing, "key", "goes_left")
    return B.contains(right, a, sizing, "key", "goes_right").drop("key")


def node_quality(counts: DataFrame, n_labels: int, corrected: bool = True) -> DataFrame:
    """``counts`` (keys.., label, n_left, n_right) to one row a split with ``quality``: the Gini gain, or the quality from shares of the node total."""
    keys = [c for c in counts.columns if c not in ("label", "n_left", "n_right")]
    labels = F.sequence(F.lit(0), F.lit(n_labels - 1))
    grouped = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct("n_left", "n_right")))).alias("m"), F.sum("n_left").alias("left"), F.sum("n_right").alias("right")
    )
    n = lambda side: F.transform(labels, lambda x: F.coalesce(F.try_element_at(F.col("m"), x)[side], F.lit(0)).cast("double"))
    share = lambda a, total: F.transform(a, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))
    total = F.col("left") + F.col("right")
    if corrected:
        both = F.zip_with(n("n_left"), n("n_right"), lambda x, y: x + y)
        quality = gini(share(both, total)) - F.col("left") / total * gini(share(n("n_left"), F.col("left"))) - F.col("right") / total * gini(share(n("n_right"), F.col("right")))
    else:
        quality = split_quality(share(n("n_left"), total), share(n("n_right"), total))
    return grouped.select(*keys, "left", "right", quality.alias("quality"))


def grow(
    samples: DataFrame, candidates: DataFrame, trees: int, n_features: int, n_labels: int, per_node: int = 5, least: int = 50, max_depth: int = 20, seed: int = 1, corrected: bool = True
) -> DataFrame:
    """Tree nodes (tree, node, feature, split, label, bag_size); label -1 in inner nodes, feature -1 in leaves.

    Every tree starts from all samples. A node looks at ``per_node`` features drawn (seeded) from those not yet used above it that have candidates;
    the best split wins, ties to the smaller feature and candidate. A node is a leaf if a side would hold fewer than ``least`` samples or no feature
    is left; its label is the most frequent, ties to the smallest. Samples with null label or features are left out.
    """
    spark = samples.sparkSession
    base = stage(samples.where("label IS NOT NULL AND features IS NOT NULL").select("sample", "label", "features"), "samples")
    options = candidates.where(F.col("feature") < n_features).select(F.col("feature").cast("int").alias("feature"), F.col("candidates").cast("array<double>").alias("candidates"))
    pool = options.agg(F.sort_array(F.collect_list(F.struct("feature", "candidates"))).alias("pool"))  # one row: n_features times the candidates of one feature, set by parameters
    # the places of samples in trees hold no features, so a tree costs 20 bytes a sample and not a copy of it
    bag = stage(base.select("sample", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).cast("bigint").alias("node")), "bag")
    open_ = spark.range(trees).select(F.col("id").cast("int").alias("tree"), F.lit(0).cast("bigint").alias("node"), F.array().cast("array<int>").alias("used"))
    found = pool.first()["pool"]
    choices = F.array(*[F.struct(F.lit(f).alias("feature"), F.array(*[F.lit(float(c)) for c in cs]).alias("candidates")) for f, cs in found]) if found else F.array()
    choices = choices.cast("array<struct<feature:int,candidates:array<double>>>")
    everyone = F.array(F.struct(F.lit(-1).alias("feature"), F.array(F.lit(None).cast("double")).alias("candidates")))  # counts the node itself
    nodes: list[DataFrame] = []
    for depth in range(max_depth + 1):
        # the draw: features not used above, by a seeded hash
        order = lambda e: F.struct(F.xxhash64(F.lit(seed), F.col("tree"), F.col("node"), e["feature"]).alias("h"), e["feature"].alias("feature"), e["candidates"].alias("candidates"))
        free = F.filter(choices, lambda e: ~F.array_contains("used", e["feature"]))
        drawn = F.transform(F.slice(F.sort_array(F.transform(free, order)), 1, per_node), lambda e: F.struct(e["feature"].alias("feature"), e["candidates"].alias("candidates")))
        draw = (F.concat(everyone, drawn) if depth < max_depth else everyone).alias("draw")
        level = broadcast_if_small(open_.select("tree", "node", draw))
        tried = bag.join(base, "sample").join(level, ["tree", "node"]).select("tree", "node", "label", "features", F.explode("draw").alias("d"))
        tried = tried.select("tree", "node", "label", F.col("d.feature").alias("feature"), F.get("features", F.col("d.feature")).alias("value"), F.explode("d.candidates").alias("candidate"))
        low = (F.col("feature") < 0) | (F.col("value") <= F.col("candidate"))
        kept = tried.where("feature < 0 OR value IS NOT NULL").groupBy("tree", "node", "feature", "candidate", "label")
        counts = stage(kept.agg(F.sum(low.cast("bigint")).alias("n_left"), F.sum((~low).cast("bigint")).alias("n_right")), "counts")
        best_label = F.max_by("label", F.struct("n_left", (-F.col("label")).alias("l"))).alias("major")
        heads = counts.where("feature < 0").groupBy("tree", "node").agg(best_label, F.sum("n_left").alias("bag_size"))
        pick = F.struct("quality", (-F.col("feature")).alias("f"), (-F.col("candidate")).alias("c"))
        quality = node_quality(counts.where("feature >= 0"), n_labels, corrected)
        best = quality.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "candidate", "left", "right"), pick).alias("b")).where(f"b.left >= {least} AND b.right >= {least}")
        best = stage(best.select("tree", "node", "b.feature", "b.candidate"), "best")
        joined = heads.join(best, ["tree", "node"], "left")
        inner = F.col("feature").isNotNull()
        nodes.append(stage(joined.select(
            "tree", "node", F.when(inner, F.col("feature")).otherwise(F.lit(-1)).alias("feature"), F.col("candidate").alias("split"),
            F.when(inner, F.lit(-1)).otherwise(F.col("major")).cast("int").alias("label"), "bag_size",
        ), "nodes"))
        drop_staged(counts)
        if depth == max_depth or best.limit(1).count() == 0:
            break
        down = bag.join(base.select("sample", "features"), "sample").join(broadcast_if_small(best), ["tree", "node"]).where(F.get("features", F.col("feature")).isNotNull())
        right = (F.get("features", F.col("feature")) > F.col("candidate")).cast("bigint")
        moved = stage(down.select("sample", "tree", (F.col("node") * 2 + 1 + right).alias("node")), "bag")
        kids = open_.join(best, ["tree", "node"]).select("tree", F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("node"), F.concat("used", F.array("feature")).alias("used"))
        kids = stage(kids, "open")
        drop_staged(bag, open_, best)
        bag, open_ = moved, kids
    drop_staged(bag, base)
    out = spark.createDataFrame([], NODE_SCHEMA)
    for part in nodes:
        out = out.unionByName(part)
    return out


def predict(samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample, tree, label): every sample walked down every tree, a level at a time. A missing value goes left. ``nodes`` should be staged.

    With nodes that may be broadcast (their number is counted) a walk is a chain of hash lookups without a shuffle; larger forests are joined by (tree, node).
    """
    deepest = nodes.agg(F.max("node").alias("node")).first()["node"]
    if deepest is None:
        return samples.select("sample", F.lit(None).cast("int").alias("tree"), F.lit(None).cast("int").alias("label")).limit(0)
    level = broadcast_if_small(nodes.select("tree", "node", "feature", "split", F.col("label").alias("leaf")))
    trees = nodes.where("node = 0").agg(F.sort_array(F.collect_set("tree")).alias("trees")).first()["trees"]  # the number of trees is a parameter of the forest
    walk = samples.select("sample", "features", F.explode(F.array(*[F.lit(t) for t in trees]).cast("array<int>")).alias("tree"), F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("int").alias("label"))
    for _ in range((int(deepest) + 1).bit_length()):
        at = walk.join(level, ["tree", "node"], "left")
        right = F.coalesce((F.get("features", F.col("feature")) > F.col("split")).cast("bigint"), F.lit(0))
        inner = F.col("feature") >= 0
        walk = at.select("sample", "features", "tree", F.when(inner, F.col("node") * 2 + 1 + right).alias("node"), F.coalesce("label", F.when(~inner, F.col("leaf"))).alias("label"))
    return walk.where("label IS NOT NULL").select("sample", "tree", "label")


def tree_text(nodes: DataFrame) -> DataFrame:
    """One row a tree: its nodes as an array ordered by node id."""
    return nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("node", "feature", "split", "label", "bag_size"))).alias("nodes"))
