"""Sharding: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import local_table

SHARDS = 24
VNODES = 64
CELLS = 1 << 14


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order. A shard's nodes do not depend on how many shards there are."""
    out = []
    for shard in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            out.append((int.from_bytes(h, "big") % cells, h, shard))
    return [(cell, shard) for cell, _, shard in sorted(out)]


def fill(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Walk the ring and give each cell's rows to the next virtual node clockwise whose shard has room.

    Capacities are the total divided by the shards, rounded up for the first shards and down for the rest, so that the
    sum is the total: every shard ends full and counts differ by one at most. Returns ranges (cell, first rank, end
    rank, shard, slot of the first rank); at most one range for each cell plus one for each time a shard fills up.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    nodes = ring(shards, vnodes, cells)
    following, at = [], 0
    for cell in range(cells):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        following.append(at % len(nodes))
    skip = list(range(1, len(nodes))) + [0]

    def open_node(i: int) -> int:
        path = []
        while used[nodes[i][1]] >= room[nodes[i][1]]:
            path.append(i)
            i = skip[i]
        for p in path:
            skip[p] = i
        return i

    out = []
    for cell in sorted(counts):
        rank, left, node = 0, counts[cell], following[cell]
        while left:
            node = open_node(node)
            shard = nodes[node][1]
            n = min(left, room[shard] - used[shard])
            out.append((cell, rank, rank + n, shard, used[shard]))
            used[shard] += n
            rank, left = rank + n, left - n
    return out


def shard_rows(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """Every row of `df` with its shard; law `rows`: shard sizes differ by one row at most.

    A row's place on the ring is the hash of its key. The ring is cut into a fixed number of cells (`cells`), counted by
    one pass over the key column alone; only those counts come to the driver, where rows overflowing a full shard go on
    clockwise. Within a cell rows are ranked by (hash, key, crc32), and a broadcast of at most cells + shards ranges
    turns ranks into shards and slots. Texts are shuffled only if `carry` names them.

    Returns the key, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (gapless from 0 in each shard),
    grown_shard (null under this law), then the columns named by `carry` (which must not clash with those).
    Null key: hashed as null, ranked first. Null text: no bytes, crc32 of the empty text. Repeated rows: each is placed.
    Empty table: no rows. Very long texts: only their size and crc32 are used. Other columns are ignored.
    """
    spark = df.sparkSession
    place = F.xxhash64(F.col(key))
    cell = F.shiftrightunsigned(place, 64 - (cells.bit_length() - 1)).cast("int")
    counts = {r[0]: r[1] for r in df.select(cell.alias("c")).groupBy("c").count().collect()}
    ranges = fill(counts, shards, vnodes, cells)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("__key"), (F.octet_length(body).cast("long") + 8).alias("__size"), F.crc32(body).alias("__crc"), place.alias("__place"), cell.alias("__cell"), *carry)
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy("__place", "__key", "__crc", "__size")) - 1)
    table = local_table(spark, ranges, "__cell int, __from long, __to long, __shard int, __slot long")
    by_cell = table.groupBy("__cell").agg(F.sort_array(F.collect_list(F.struct("__from", "__to", "__shard", "__slot"))).alias("__ranges"))
    found = F.filter("__ranges", lambda x: (x["__from"] <= F.col("__rank")) & (F.col("__rank") < x["__to"]))[0]
    rows = rows.join(F.broadcast(by_cell), "__cell").withColumn("__found", found)
    return rows.select(
        F.col("__key").alias(key),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__found.__shard").alias("shard"),
        (F.col("__found.__slot") + F.col("__rank") - F.col("__found.__from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_rows(docs)
