"""Sharding by minimum-cost flow: from old shard sizes and new capacities to block moves.

Rows lie in old shards, each cut by a hash of the text into a fixed number of blocks, so
that equal texts lie in one block and stay together. Only a text whose copies hold more
than ``HEAVY`` of an even shard is cut by a hash of the row too (those are fewer than
``NEW_SHARDS / HEAVY``). Block sizes are summed map-side; the table of blocks has as many
rows as the parameters say, at any size of the data. On the driver a minimum-cost flow from old shards (supply) to new
shards (capacity) finds how many bytes must go where so that the fewest bytes move:
what stays in its shard is free. The flow is then filled with whole blocks, and a few
small blocks level what the filling left.

The law here is ``bytes``: capacities are equal, so the new shards' sizes are. The old
shard of a document is a hash of its text too. Rows that are equal in doc_id and text are
never told apart.

A row's slot is its block's offset in the shard plus its number within the block, so no
task ever sorts a whole shard. ``reshard`` only places rows; ``rewrite_affected`` rewrites
the files of blocks that move, and is not part of it.

Size is the text's UTF-8 bytes plus 16; a null text has none (its checksum is that of no
bytes, 0). Repeated rows each get a slot. Very long texts are rows like others: a shard
that holds one larger than it should be stays larger. An empty table has no blocks. Other
columns are kept, whatever their names; only those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescast.llm.scratch import stored

OLD_SHARDS = 32
NEW_SHARDS = 40
BLOCKS = 256
ROW_BYTES = 16
HEAVY = 0.25
LEVEL_MOVES = 20_000
EVEN = 0.0005
_MANIFEST = "old_shard int, block int, shard int, offset long, bytes long"


def text_crc32(text: str = "text"):
    return F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def text_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES).cast("long")


def minimum_cost_flow(supply: np.ndarray, capacity: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Flow from each supply to each capacity with the least total cost.

    The capacities must hold all supplies. Shortest augmenting paths in the residual
    graph (Bellman-Ford over all edges at once); the graph has one node per shard.
    """
    rows, columns = cost.shape
    flow = np.zeros((rows, columns), dtype=np.int64)
    supply, capacity = supply.astype(np.int64).copy(), capacity.astype(np.int64).copy()
    if capacity.sum() < supply.sum():
        raise ValueError("the new shards can't hold the old ones")
    far = np.inf
    while supply.any():
        to_row = np.where(supply > 0, 0.0, far)
        to_column = np.full(columns, far)
        row_from = np.full(rows, -1)
        column_from = np.full(columns, -1)
        back = np.where(flow > 0, -cost, far)
        while True:
            through = to_row[:, None] + cost
            best = through.argmin(axis=0)
            shorter = through[best, np.arange(columns)] < to_column - 1e-12
            to_column[shorter] = through[best, np.arange(columns)][shorter]
            column_from[shorter] = best[shorter]
            through = to_column[None, :] + back
            best = through.argmin(axis=1)
            nearer = through[np.arange(rows), best] < to_row - 1e-12
            to_row[nearer] = through[np.arange(rows), best][nearer]
            row_from[nearer] = best[nearer]
            if not (shorter.any() or nearer.any()):
                break
        end = int(np.where(capacity > 0, to_column, far).argmin())
        path, column = [], end
        amount = capacity[end]
        while True:
            row = int(column_from[column])
            path.append((row, column, 1))
            if row_from[row] < 0:
                amount = min(amount, supply[row])
                break
            column = int(row_from[row])
            path.append((row, column, -1))
            amount = min(amount, flow[row, column])
        for r, c, sign in path:
            flow[r, c] += sign * amount
        supply[row] -= amount
        capacity[end] -= amount
    return flow


@dataclass
class Plan:
    """Where each block goes: parallel arrays over blocks, and bytes per new shard."""

    shard: np.ndarray
    sizes: np.ndarray
    moved_bytes: int


def fill_flow(old: np.ndarray, size: np.ndarray, flow: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """New shard of each block: the flow between shards, filled with whole blocks, largest first."""
    new_shards = flow.shape[1]
    shard = np.full(len(old), -1)
    load = np.zeros(new_shards, dtype=np.int64)
    rest = []
    for source in range(flow.shape[0]):
        blocks = np.flatnonzero(old == source)
        blocks = blocks[np.argsort(-size[blocks], kind="stable")].tolist()
        wanted = flow[source].copy()
        if source < new_shards:
            wanted[source] = 0
        for target in np.argsort(-wanted, kind="stable").tolist():
            left, kept = int(wanted[target]), []
            for block in blocks:
                if 0 < size[block] <= left:
                    shard[block] = target
                    load[target] += size[block]
                    left -= int(size[block])
                else:
                    kept.append(block)
            blocks = kept
        if source < new_shards:
            shard[blocks] = source
            load[source] += int(size[blocks].sum())
        else:
            rest += blocks
    for block in sorted(rest, key=lambda b: -size[b]):
        target = int((capacity - load).argmax())
        shard[block] = target
        load[target] += size[block]
    return shard


def level(shard: np.ndarray, size: np.ndarray, capacity: np.ndarray, moves: int = LEVEL_MOVES) -> None:
    """Move single blocks from full shards to the emptiest, while it brings the sizes nearer each other.

    A shard that is full of one block larger than any room is passed over. Differences
    of less than ``EVEN`` of a shard are left.
    """
    load = np.bincount(shard, weights=size, minlength=len(capacity)).astype(np.int64)
    for _ in range(moves):
        over = load - capacity
        target = int(over.argmin())
        for source in np.argsort(-over, kind="stable").tolist():
            gap = over[source] - over[target]
            if gap <= EVEN * capacity[target]:
                return
            mine = np.flatnonzero((shard == source) & (size > 0) & (size < gap))
            if len(mine):
                break
        block = mine[np.abs(size[mine] * 2 - gap).argmin()]
        shard[block] = target
        load[source] -= size[block]
        load[target] += size[block]


def plan_moves(old: np.ndarray, size: np.ndarray, old_shards: int, new_shards: int) -> Plan:
    """Blocks (old shard and bytes) to new shards of equal size, moving as few bytes as whole blocks allow."""
    total = int(size.sum())
    capacity = np.full(new_shards, total // new_shards, dtype=np.int64)
    capacity[: total % new_shards] += 1
    supply = np.bincount(old, weights=size, minlength=old_shards).astype(np.int64)
    cost = np.ones((old_shards, new_shards))
    stays = np.arange(min(old_shards, new_shards))
    cost[stays, stays] = 0
    shard = fill_flow(old, size, minimum_cost_flow(supply, capacity, cost), capacity)
    level(shard, size, capacity)
    load = np.bincount(shard, weights=size, minlength=new_shards).astype(np.int64)
    return Plan(shard, load, int(size[shard != old].sum()))


def text_key(text: str = "text"):
    return F.xxhash64(text)


def heavy_texts(docs: DataFrame, new_shards: int = NEW_SHARDS, heavy: float = HEAVY) -> list[int]:
    """Keys of the texts whose copies hold more than ``heavy`` of an even shard: less than ``new_shards / heavy`` of them."""
    sums = docs.select(text_key().alias("key"), text_size().alias("size")).groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    sums = stored(sums, "reshard-texts")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    limit = heavy * total / new_shards
    return [row["key"] for row in sums.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("key").collect()]


def with_blocks(docs: DataFrame, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS, heavy: Sequence[int] = ()) -> DataFrame:
    """Add size, text_crc32, old_shard and block. Rows of the ``heavy`` texts are spread over blocks."""
    sized = docs.withColumns({"size": text_size(), "text_crc32": text_crc32()})
    key = text_key()
    spread = F.when(key.isin(list(heavy)), F.xxhash64("doc_id", "text_crc32")).otherwise(key) if heavy else key
    return sized.withColumns(
        {
            "old_shard": F.pmod("text_crc32", F.lit(old_shards)).cast("int"),
            "block": F.pmod(spread, F.lit(blocks)).cast("int"),
        }
    )


def block_plan(blocked: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """One row per block: its old and new shard, and the slot at which it begins there.

    At most ``old_shards * blocks`` rows pass the driver.
    """
    found = blocked.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    blocks = found.toPandas().sort_values(["old_shard", "block"], ignore_index=True)
    old, size = blocks["old_shard"].to_numpy(dtype=np.int64), blocks["bytes"].to_numpy(dtype=np.int64)
    plan = plan_moves(old, size, old_shards, new_shards)
    blocks["shard"] = plan.shard
    blocks["offset"] = blocks.groupby("shard")["rows"].cumsum() - blocks["rows"]
    rows = blocks[["old_shard", "block", "shard", "offset", "bytes"]].astype("int64")
    return blocked.sparkSession.createDataFrame(list(rows.itertuples(index=False, name=None)), _MANIFEST)


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot, grown_shard, and the old_shard and block they came from."""
    mine = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "block"]
    kept = F.struct(*[c for c in docs.columns if c not in mine]).alias("row")
    rows = docs.select("doc_id", "text", kept)
    heavy = heavy_texts(rows, new_shards)
    # Bounded by old_shards * blocks rows, so it may always be broadcast.
    plan = block_plan(with_blocks(rows.select("doc_id", "text"), old_shards, blocks, heavy), old_shards, new_shards)
    blocked = with_blocks(rows, old_shards, blocks, heavy).drop("text")
    placed = blocked.join(F.broadcast(plan.drop("bytes")), ["old_shard", "block"])
    within = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    placed = placed.withColumn("slot", (F.col("offset") + F.row_number().over(within) - 1).cast("long"))
    placed = placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return placed.select("row.*", *mine)


def write_blocks(rows: DataFrame, path: str) -> DataFrame:
    """Write rows that have shard and block, one folder per block; returns the manifest (shard, block, path)."""
    rows.write.partitionBy("shard", "block").parquet(path)
    at = F.concat(F.lit(f"{path}/shard="), F.col("shard"), F.lit("/block="), F.col("block"))
    found = rows.sparkSession.read.parquet(path).select("shard", "block").distinct()
    return found.select(F.col("shard").cast("int"), F.col("block").cast("int"), at.alias("path"))


def rewrite_affected(spark: SparkSession, manifest: DataFrame, plan: DataFrame, out: str) -> DataFrame:
    """Rewrite the blocks that change shard under ``out``; the manifest of the new layout.

    ``manifest`` has shard, block and path of the old layout, ``plan`` comes from
    ``block_plan``. Files of blocks that stay are neither read nor written. The list of
    moved files is as long as the plan at most.
    """
    old = manifest.withColumnRenamed("shard", "old_shard")
    located = old.join(plan.select("old_shard", "block", "shard"), ["old_shard", "block"])
    moved = located.where("old_shard != shard")
    name = F.concat_ws("-", "old_shard", "block")
    paths = [row["path"] for row in moved.select("path").collect()]
    if not paths:
        return located.select("shard", "old_shard", "block", "path")
    moves = F.broadcast(moved.select("path", "shard", name.alias("moved_block")))
    rows = spark.read.parquet(*paths).withColumn("path", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    rows = rows.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    short = F.regexp_replace("path", "^file:/+", "/")
    rows.join(moves.withColumn("path", short), "path").drop("path").write.partitionBy("shard", "moved_block").parquet(out)
    target = F.concat(F.lit(f"{out}/shard="), F.col("shard"), F.lit("/moved_block="), name)
    path = F.when(F.col("old_shard") != F.col("shard"), target).otherwise(F.col("path"))
    return located.select("shard", "old_shard", "block", path.alias("path"))
