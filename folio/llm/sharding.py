"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Where each row goes is what a uniformly random permutation of all rows would give, without one task that holds all:
1. the few columns needed are written once, with a part number and a place in the part for each row, so that whatever
   splits a later read or retry has, every row keeps its part;
2. how many rows each partition sends to each block of a shard is drawn exactly (multivariate hypergeometric, row sums
   are the partitions' sizes, column sums the blocks' sizes). Nobody holds the whole matrix: a task draws its own row by
   halving the range of partitions, with the same random numbers as every other task that halves the same range;
3. each partition permutes locally: a random permutation of its blocks' labels, in their drawn numbers, is dealt to
   its rows;
4. the rows are exchanged by block, and each block permutes its rows again.
Shards hold counts at most one apart (the law `rows`). Blocks are pieces of a shard of at most `block_rows` rows or so,
so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def block_sizes(rows: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each block, in order."""
    per = max(1, -(-rows // max(1, shards * block_rows)))
    out = []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        cuts = [n * i // per for i in range(per + 1)]
        out += [(s, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of the draws are good. Where the generator's own method ends, by inversion around the mode: ratios of
    neighbouring probabilities are exact and what lies 12 standard deviations out has less weight than a float holds."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = 12 * int(np.sqrt(draws * (good / total) * (bad / total)) + 2)
    lo, hi = max(0, draws - bad, mode - reach), min(good, draws, mode + reach)
    k = np.arange(lo, hi, dtype=float)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return lo + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def drawn_from(rng, blocks: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` rows, taken at random from all that the blocks hold, come from each block."""
    rest = int(blocks.sum())
    if rest < 10**9:
        return rng.multivariate_hypergeometric(blocks, draws, method="marginals")
    out = np.zeros(len(blocks), np.int64)
    for t, n in enumerate(blocks.tolist()):
        if not draws:
            break
        rest -= n
        out[t] = k = hypergeometric(rng, n, rest, draws)
        draws -= k
    return out


def matrix_row(part: int, ends: np.ndarray, taken: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition `part` sends to each block, as a uniform permutation of all rows gives them.

    ends: rows before each partition, and all rows. The blocks' room is divided between the first and the second half of
    the partitions, then between the halves of the half that holds `part`, and so on.
    """
    lo, hi, room = 0, len(ends) - 1, np.asarray(taken, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = drawn_from(np.random.default_rng([seed, 0, lo, hi]), room, int(ends[mid] - ends[lo]))
        lo, hi, room = (lo, mid, first) if part < mid else (mid, hi, room - first)
    return room


def communication_matrix(sent: list[int], taken: list[int], seed: int) -> np.ndarray:
    """Counts [partition, block]: all rows of the matrix, to look at a small one."""
    ends = np.concatenate([[0], np.cumsum(sent)])
    return np.stack([matrix_row(p, ends, np.array(taken), seed) for p in range(len(sent))])


def _deal(ends: np.ndarray, taken: np.ndarray, seed: int):
    """Local permutation: the labels of a part's blocks in random order, dealt to its rows by their written places."""

    def labels_of(part: int) -> np.ndarray:
        row = matrix_row(part, ends, taken, seed)
        return np.random.default_rng([seed, 1, part]).permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))

    def run(batches):
        last, labels = None, None
        for pdf in batches:
            for part, rows in pdf.groupby("part", sort=False):
                if part != last:
                    last, labels = part, labels_of(int(part))
                yield rows.assign(block=labels[rows["position"].to_numpy()])

    return run


def _settle(blocks: list[tuple[int, int, int]], seed: int):
    """Second permutation, within a block; rows are put in their order of origin first, so a retry gives the same."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "position"])
        block = int(pdf["block"].iloc[0])
        shard_no, first, _ = blocks[block]
        slot = first + np.random.default_rng([seed, 2, block]).permutation(len(pdf)).astype(np.int64)
        return pd.DataFrame({"id": pdf["id"], "size": pdf["size"], "text_crc32": pdf["text_crc32"], "law": "rows", "shard": np.int32(shard_no), "slot": slot})

    return run


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 500_000) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    size is the UTF-8 bytes of the text plus 1, text_crc32 its unsigned checksum; a null text counts as empty. slot runs
    from 0 without gaps in each shard. grown_shard is null under the law `rows`. Null and repeated ids are rows like
    any other. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).cast("string").alias("id"),  # as text: pandas would turn a null integer into a float
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    serial = F.monotonically_increasing_id()
    placed = materialize(small.select("*", F.shiftright(serial, 33).cast("int").alias("part"), serial.bitwiseAND(F.lit((1 << 33) - 1)).alias("position")))
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sent = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    blocks = block_sizes(sum(sent), shards, block_rows)
    deal = _deal(np.concatenate([[0], np.cumsum(sent, dtype=np.int64)]), np.array([n for _, _, n in blocks]), seed)
    dealt = placed.mapInPandas(deal, "id string, size long, text_crc32 long, part int, position long, block int")
    settled = dealt.groupBy("block").applyInPandas(_settle(blocks, seed), "id string, size long, text_crc32 long, law string, shard int, slot long")
    return settled.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
