"""Sharding by extendible hashing, with DataFrame operations only.

Rows hash by their id. A shard is a hash prefix; a bucket over the byte limit splits on one more bit, and only such buckets do, so
shards have prefixes of different lengths. The directory is built from sums: bytes are summed once for each
prefix of a round's deepest level, its cells are folded upwards, and a shard is the shortest prefix that
fits while its parent doesn't. Cells still too large go into another round with further bits. After the last of ``BITS`` bits
only rows with one and the same id are left together: they are written down once and dealt into overflow pages
of the bucket by sums of bytes, first over the parts they lie in, then within each part, so even a hot id is never in one task. Each page
begins in another half of the limit, so pages of rows under half the limit keep to it; larger rows have pages of their
own. A row that alone exceeds the limit is marked in ``oversized``.

Null ids hash as empty text, null texts have 0 bytes; very long texts count whole; repeated rows are kept, each in its page; an empty table
gives an empty result; columns of any other name go along untouched where whole rows are dealt (write_shards).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.materialise import materialise
from .common import fresh

#: Bits of the hash: 15 hexadecimal digits of MD5, so a non-negative long.
BITS = 60
#: A loader fetches a shard with one ranged read.
SHARD_BYTES = 1 << 20
#: Cells of one round at most this many for each shard that the bytes ask for, as a power of two.
SPARE_BITS = 3
#: A directory of at most this many rows is broadcast (some MB); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def hash_bits(id_col: Column) -> Column:
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _leaves(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """For cells (cell, n_bytes, n_docs) of ``depth`` bits under roots of ``top`` bits: the shard of each (cell, depth, fits)."""
    levels = F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("d")
    tree = cells.select("cell", "n_bytes", "n_docs", levels).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    sums = tree.groupBy("d", "prefix").agg(F.sum("n_bytes").alias("b"), F.sum("n_docs").alias("n"))
    # a prefix is fit if it keeps to the limit or holds a single row; the shard of a cell is its shortest fit prefix
    fit = sums.where((F.col("b") <= limit) | (F.col("n") <= 1))
    return tree.join(fit, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("depth"))


@dataclass
class Directory:
    """levels: (bits, table of cell and depth, is it small) for each round; overflow: is there an id whose rows exceed the limit?"""

    levels: list[tuple[int, DataFrame, bool]]
    overflow: bool


def build_directory(rows: DataFrame, limit: int = SHARD_BYTES) -> Directory:
    """rows: the hash h and n_bytes of every row, in a table that can be read again and again."""
    rest, levels, top, overflow = rows, [], 0, False
    while True:
        total = rest.agg(F.sum("n_bytes").alias("b")).first()["b"]
        if total is None:
            break
        deep = min(BITS, top + max(1, math.ceil(math.log2(max(total / limit, 1)))) + SPARE_BITS)
        cell = F.shiftright("h", BITS - deep)
        cells = materialise(rest.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")))
        leaves = materialise(cells.join(_leaves(cells, top, deep, limit), "cell", "left").select("cell", F.col("depth").cast("int")))
        small = leaves.count() <= BROADCAST_ROWS
        levels.append((deep, leaves, small))
        over = leaves.where("depth is null")
        overflow = not over.isEmpty()
        if not overflow or deep == BITS:
            break
        rest = materialise(rest.withColumn("cell", cell).join(F.broadcast(over) if small else over, "cell", "left_semi").select("h", "n_bytes"))
        top = deep
    return Directory(levels, overflow)


def deal(rows: DataFrame, directory: Directory, limit: int, h: str, n_bytes: str, shard: str, depth: str) -> DataFrame:
    """Any rows with a hash and a size, all their columns as they are, and their shard and depth."""
    out, found, names = rows, [], rows.columns
    for k, (deep, leaves, small) in enumerate(directory.levels):
        cell, own = (fresh(out, f"{x}_{k}") for x in ("_cell", "_depth"))
        table = leaves.select(F.col("cell").alias(cell), F.col("depth").alias(own))
        out = out.join(F.broadcast(table) if small else table, F.shiftright(h, BITS - deep) == F.col(cell), "left").drop(cell)
        found.append(F.col(own))
    out = out.select(*names, (F.coalesce(*found) if found else F.lit(0)).alias(depth))
    prefix = lambda d: F.substring(F.lpad(F.conv(F.col(h).cast("string"), 10, 2), BITS, "0"), F.lit(1), d)
    settled = out.where(F.col(depth).isNotNull()).withColumn(shard, prefix(F.col(depth)))
    if not directory.overflow:
        return settled
    page = _pages(out.where(F.col(depth).isNull()).drop(depth), limit, h, n_bytes, fresh(out, "_page"))
    named = page.withColumn(depth, F.lit(BITS)).withColumn(shard, F.concat(prefix(F.lit(BITS)), F.lit("/"), F.col(page.columns[-1]).cast("string")))
    return settled.unionByName(named.select(settled.columns))


def _pages(over: DataFrame, limit: int, h: str, n_bytes: str, name: str) -> DataFrame:
    """Rows of ids that exceed the limit, and the page of each: by where it begins in the sums of its id's bytes. The table is written once, so that its parts hold still."""
    part, place, before, within = (fresh(over, f"{name}_{x}") for x in ("part", "place", "before", "within"))
    held = materialise(over.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()))
    sums = held.groupBy(h, part).agg(F.sum(n_bytes).alias(within))
    earlier = Window.partitionBy(h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    sums = sums.withColumn(before, F.coalesce(F.sum(within).over(earlier), F.lit(0))).drop(within)
    own = Window.partitionBy(h, part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col(before) + F.coalesce(F.sum(n_bytes).over(own), F.lit(0))
    page = F.when(F.col(n_bytes) > limit / 2, -1 - begin.cast("long")).otherwise(F.floor(begin / F.lit(limit / 2))).cast("long")
    return held.join(sums, [h, part]).withColumn(name, page).select(*over.columns, name)


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its prefix in bits, then /page in an overflowing bucket), depth, oversized."""
    rows = df.select(F.col(id_col).alias("doc_id"), _bytes_of(text_col).alias("n_bytes"), hash_bits(F.col(id_col)).alias("h"))
    rows = materialise(rows)  # ids and sizes only: texts are read once
    out = deal(rows, build_directory(rows, limit), limit, "h", "n_bytes", "shard", "depth")
    return out.select("doc_id", "n_bytes", "shard", "depth", (F.col("n_bytes") > limit).alias("oversized"))


def _bytes_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")


def shard_report(assigned: DataFrame) -> DataFrame:
    """The directory as it is used: shard, depth, n_docs, n_bytes."""
    return assigned.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> str:
    """Write every row of df, all columns, as Parquet, one folder for each shard; returns the name of the folders' column.

    Rows carry their shard along (none is joined by id), so repeated and null ids stay as they are. The column is called shard, or shard_ where df has one.
    Its value is "b" and the shard, so that readers don't take bits for a number. Of a text exactly once is read for sizes and once for writing.
    """
    h, n_bytes, depth = (fresh(df, x) for x in ("_h", "_n_bytes", "_depth"))
    shard = fresh(df, "shard")
    sizes = materialise(df.select(hash_bits(F.col(id_col)).alias("h"), _bytes_of(text_col).alias("n_bytes")))
    rows = df.withColumn(h, hash_bits(F.col(id_col))).withColumn(n_bytes, _bytes_of(text_col))
    dealt = deal(rows, build_directory(sizes, limit), limit, h, n_bytes, shard, depth)
    dealt.select(*df.columns, F.concat(F.lit("b"), F.col(shard)).alias(shard)).repartition(shard).write.partitionBy(shard).parquet(path)
    return shard


#: The same shards by DuckDB, up to 32 bits (enough for its tables).
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (SELECT doc_id, n_bytes, h, k::INTEGER AS k, h >> ({BITS} - k::INTEGER) AS prefix FROM d, generate_series(0, 32) AS s(k)),
f AS (SELECT k, prefix FROM p GROUP BY k, prefix HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) <= 1),
l AS (SELECT p.doc_id, p.n_bytes, p.h, min(p.k)::INTEGER AS depth FROM p JOIN f ON p.k = f.k AND p.prefix = f.prefix GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(to_binary(h), {BITS}, '0'), 1, depth) AS shard, depth, n_bytes > {SHARD_BYTES} AS oversized FROM l
"""
