"""Mixing sources to target weights, in fixed-length blocks of tokens.

Texts are tokenised and packed, source by source, into blocks of a fixed number of tokens (offsets by prefix sums over partitions). A plan gives each
source its number of output blocks; the source counts of every output shard are multinomial draws, conditioned on the planned totals by splitting
them down a binary tree of shards, so any shard can be drawn by itself. Slot k of a source maps to block permutation(k mod blocks) of epoch k // blocks
by a pseudorandom index permutation; slots and blocks are joined by index.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 512
SHARD_BLOCKS = 256
#: Offsets of (source, partition) up to this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
# Fixed value: the public pre-tokenisation pattern of the vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("blocks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    coder = encoder(path)
    return [np.asarray(t, np.uint16) for t in coder.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def token_counts(docs: DataFrame, keep: dict[str, Column], text: Column, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of every document; a null or empty text has 0 tokens."""
    source = docs.select(*[c.alias(n) for n, c in keep.items()], text.cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    names = list(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoder(path)
            sizes = [len(t) for t in coder.encode_ordinary_batch([t or "" for t in batch.column("_text").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    return spread(source).mapInArrow(count, schema + ", n_tokens bigint")


def source_sizes(counts: DataFrame) -> DataFrame:
    """Tokens a source (null sources form one)."""
    return counts.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))


def capacities(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: size, what it can give, what it should give of the size of all sources, and whether it falls short. A source without documents has size 0."""
    total = sizes.agg(F.sum("size").alias("t")).scalar()
    own = sizes.select(F.col("source").alias("_s"), "size")
    t = targets.select("source", "target_share", "max_repeats").join(own, F.col("source") == F.col("_s"), "left")
    size = F.coalesce("size", F.lit(0))
    return t.select(
        "source", "target_share", "max_repeats", size.alias("size"), (size * F.col("max_repeats")).alias("capacity"),
        (F.col("target_share") * total).alias("wanted"), (size * F.col("max_repeats") < F.col("target_share") * total).alias("short"),
    )


def fill(shares: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """What each source gives of ``total``: its share, at most its cap; what short sources leave is shared by the others in proportion."""
    given, open_ = np.zeros(len(shares)), shares > 0
    left = float(total)
    while open_.any() and left > 1e-9:
        offer = shares[open_] / shares[open_].sum() * left
        over = offer >= caps[open_]
        rows = np.flatnonzero(open_)
        if not over.any():
            given[rows] = offer
            break
        given[rows[over]] = caps[rows[over]]
        left -= caps[rows[over]].sum()
        open_[rows[over]] = False
    return given


def pack(docs: DataFrame, doc_id: Column, source: Column, text: Column, path: str = TOKENIZER, length: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``length`` tokens a source: (source, block, n_tokens, tokens as little-endian 16-bit binary). Only the last block of a source is shorter."""
    base = docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), text.cast("string").alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, upto = TaskContext.get().partitionId(), {}
        for batch in batches:
            tokens = _encode(batch.column("_text").to_pylist(), path)
            sources, starts = batch.column("source").to_pylist(), []
            for s, t in zip(sources, tokens, strict=True):
                starts.append(upto.get(s, 0))
                upto[s] = starts[-1] + len(t)
            arrays = [
                batch.column("source"), pa.array([pid] * len(tokens), pa.int32()), pa.array(starts, pa.int64()),
                pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["source", "pid", "at", "n", "tokens"])

    coded = stage(spread(base).mapInArrow(encode, "source string, pid int, at bigint, n bigint, tokens binary"), "tokens")
    parts = coded.groupBy("source", "pid").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("pid"))
    offsets = stage(parts.select(F.col("source").alias("_s"), F.col("pid").alias("_p"), (upto - F.col("n")).alias("offset")), "token-offsets")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("pid") == F.col("_p"))
    placed = coded.where("n > 0").join(F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets, on)
    placed = placed.select("source", (F.col("offset") + F.col("at")).alias("start"), "n", "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, start, tokens in zip(*[batch.column(n).to_pylist() for n in ("source", "start", "tokens")], strict=True):
                end = start + len(tokens) // 2
                for block in range(start // length, (end - 1) // length + 1):
                    a, b = max(start, block * length), min(end, (block + 1) * length)
                    out.append((s, block, a, tokens[2 * (a - start) : 2 * (b - start)]))
                if len(out) > 10_000:
                    yield _pieces(out)
                    out = []
            if out:
                yield _pieces(out)

    pieces = placed.mapInArrow(cut, "source string, block bigint, begin bigint, piece binary")
    ordered = pieces.repartition("source", "block").sortWithinPartitions("source", "block", "begin")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for s, b, p in zip(batch.column("source").to_pylist(), batch.column("block").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if (s, b) != key:
                    if held:
                        out.append((*key, b"".join(held)))
                    key, held = (s, b), []
                held.append(p)
            if len(out) > 2000:
                yield _blocks(out)
                out = []
        if held:
            out.append((*key, b"".join(held)))
        if out:
            yield _blocks(out)

    return ordered.mapInArrow(join, "source string, block bigint, n_tokens int, tokens binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"source": pa.string(), "block": pa.int64(), "begin": pa.int64(), "piece": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) // 2 for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["source", "block", "n_tokens", "tokens"],
    )


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` items drawn without replacement are good. By inversion at any size: the probabilities follow from the ratios of neighbours, taken over all
    that may happen or 40 standard deviations, beyond which nothing is left in a double."""
    low, high = max(0, draws - bad), min(draws, good)
    whole = good + bad
    sd = (draws * (good / whole) * (bad / whole) * ((whole - draws) / max(whole - 1, 1))) ** 0.5 if whole else 0.0
    mode = min(max((draws + 1) * (good + 1) // (whole + 2), low), high)
    first, last = max(low, int(mode - 40 * sd - 40)), min(high, int(mode + 40 * sd + 40))
    if first >= last:
        return first
    k = np.arange(first, last, dtype=float)
    logs = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))))
    upto = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], "right").clip(0, last - first))


def _split(totals: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots are among the first ``left``: a multinomial draw conditioned on the totals."""
    whole, out = int(totals.sum()), np.zeros(len(totals), np.int64)
    for i, n in enumerate(totals.tolist()):
        if whole <= 0 or left <= 0:
            break
        out[i] = k = hypergeometric(n, whole - n, left, rng)
        whole, left = whole - n, left - k
    return out


def shard_counts(totals: np.ndarray, shards: int, size: int, shard: int, seed: int, known: dict[tuple[int, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each source, number of slots of each source) of one shard, by walking down the tree of shards. ``known`` keeps the draws of the branch walked last."""
    low, high, begin = 0, shards, np.zeros(len(totals), np.int64)
    whole = int(totals.sum())
    while high - low > 1:
        mid = (low + high) // 2
        left = None if known is None else known.get((low, high))
        if left is None:
            left = _split(totals, min(mid * size, whole) - min(low * size, whole), np.random.default_rng([seed, low, high]))
            if known is not None:
                if len(known) > 64:
                    known.clear()
                known[low, high] = left
        if shard < mid:
            totals, high = left, mid
        else:
            begin, totals, low = begin + left, totals - left, mid
    return begin, totals


def permute(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, evaluated at ``index``: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, size]).integers(1, 2**63, 4).astype(np.uint64)
    x = np.asarray(index, np.int64).astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo[todo] = x[todo] >= size
    return x.astype(np.int64)


def plan(blocks: DataFrame, sizes: DataFrame, targets: DataFrame, length: int = BLOCK_TOKENS) -> pd.DataFrame:
    """Per source: blocks, slots (output blocks). The output is as large as all sources together, if the caps allow it. The driver holds one row a source."""
    held = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    rows = capacities(sizes, targets).join(held, "source", "left").select("source", "target_share", "max_repeats", "size", "wanted", "short", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    out = rows.toPandas().sort_values("source", ignore_index=True)
    total = float((out["wanted"] / out["target_share"].where(out["target_share"] > 0)).max()) if len(out) else 0.0
    given = fill(out["target_share"].to_numpy(float), (out["blocks"] * out["max_repeats"]).to_numpy(float), (0.0 if np.isnan(total) else total) / length)
    return out.assign(slots=np.minimum(np.floor(given + 0.5), out["blocks"] * out["max_repeats"]).astype("int64"))


def slots(spark, planned: pd.DataFrame, seed: int, size: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, source, epoch, block) of every output block."""
    totals, names, blocks = planned["slots"].to_numpy(np.int64), planned["source"].tolist(), planned["blocks"].tolist()
    shards = max(1, -(-int(totals.sum()) // size))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for shard in pdf["id"].tolist():
                begin, count = shard_counts(totals, shards, size, shard, seed, known)
                who = np.repeat(np.arange(len(names)), count)
                k = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, count, strict=True)]) if len(who) else np.zeros(0, np.int64)
                epoch, block = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                for i in np.unique(who):
                    rows = np.flatnonzero(who == i)
                    epoch[rows] = k[rows] // blocks[i]
                    for e in np.unique(epoch[rows]):
                        at = rows[epoch[rows] == e]
                        block[at] = permute(k[at] % blocks[i], blocks[i], seed + 1_000_003 * int(i) + int(e))
                if not len(k):
                    continue
                slot = np.random.default_rng([seed, shard]).permutation(len(k))
                yield pd.DataFrame({"shard": shard, "slot": slot.astype("int32"), "source": [names[i] for i in who], "epoch": epoch.astype("int32"), "block": block})

    return spark.range(shards).mapInPandas(draw, "shard bigint, slot int, source string, epoch int, block bigint")


@dataclass
class Mix:
    """``rows``: the mixed blocks (shard, slot, source, epoch, block, n_tokens, tokens); ``plan``: what each target source was to give."""

    rows: DataFrame
    plan: pd.DataFrame


def mix(docs: DataFrame, doc_id: Column, source: Column, text: Column, targets: DataFrame, path: str = TOKENIZER, seed: int = 7) -> Mix:
    """Sources without a target give nothing; null sources count for the total size only."""
    blocks = stage(pack(docs, doc_id, source, text, path), "blocks")
    sizes = blocks.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    planned = plan(blocks, sizes, targets)
    drawn = slots(docs.sparkSession, planned, seed)
    return Mix(drawn.join(blocks.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "n_tokens", "tokens"), planned)


def reached(mixed: Mix) -> DataFrame:
    """Target and actual share of every target source, the most times one of its blocks was taken, and ``short``: it gave all it may, and that is less than its target."""
    used = mixed.rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_blocks"), (F.max("epoch") + 1).alias("repeats"))
    rows = [(p.source, float(p.target_share), int(p.max_repeats), 0.0 if pd.isna(p.wanted) else float(p.wanted), not pd.isna(p.short) and bool(p.short)) for p in mixed.plan.itertuples(index=False)]
    targets = used.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, wanted double, lacks boolean")
    used = stage(used, "used")
    total = used.agg(F.sum("tokens").alias("t")).scalar()
    zero = F.lit(0)
    tokens = F.coalesce("tokens", zero)
    return targets.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce("n_blocks", zero).alias("n_blocks"),
        F.coalesce("repeats", zero).alias("repeats"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"), (F.col("lacks") & (tokens < F.col("wanted"))).alias("short"),
    )
