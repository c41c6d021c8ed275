"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. Bytes are summed per slot, and a stored, versioned table maps
slots to shards: its first version deals the slots out evenly, and ``rebalance`` measures the shards and, where they
are uneven, stores an edited version instead of rehashing records. Everything is DataFrame
code: the slot table has a fixed number of rows, so ordering and packing it never depends on the
corpus. Defined cases: a null text has size 1 and a null checksum; a null id hashes by its text;
repeated rows share a slot; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder

N_SLOTS = 4096
#: Each slot is counted and numbered in so many cells, which bounds the rows a single task orders.
CELLS = 16


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, cell) of every row."""
    text, key = F.col(text_col), F.col(id_col)
    hashed: Column = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    return df.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(hashed, F.lit(n_slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftright(hashed, 40), F.lit(CELLS)).cast("int").alias("cell"),
    )


def slot_bytes(recs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(virtual_slot, bytes) for every slot, empty ones too."""
    summed = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    every = recs.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(F.broadcast(summed), "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes")
    )


def _pack(slots: DataFrame, loads: str) -> DataFrame:
    """Largest first, each to the least loaded shard. ``slots``: one row with ``items`` (and ``loads``)."""
    least = "array_position(s.loads, array_min(s.loads)) - 1"
    packed = F.expr(f"""
        aggregate(items,
            named_struct('loads', {loads}, 'shards', cast(array() as array<int>)),
            (s, x) -> named_struct(
                'loads', transform(s.loads, (v, i) -> if(i = {least}, v + x.bytes + 1, v)),
                'shards', concat(s.shards, array(cast({least} as int)))),
            s -> transform(s.shards, (shard, i) -> named_struct('virtual_slot', items[i].virtual_slot, 'shard', shard)))
    """)
    return slots.select(F.inline(packed))


def _items() -> Column:
    return F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "virtual_slot")))).alias("items")


def build_slot_map(sizes: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard): shards near equal in bytes."""
    one = sizes.agg(_items())
    return _pack(one, f"array_repeat(0L, {int(n_shards)})").select(F.lit(version).alias("version"), "virtual_slot", "shard")


def edit_slot_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of ``slot_map`` for new sizes or a new number of shards.

    A shard keeps its largest slots while they fit an equal part of all bytes (plus ``slack``); what it
    gives up, and slots of shards beyond ``n_shards``, go to the least loaded shards. All else stays.
    """
    known = slot_map.join(sizes, "virtual_slot").select("version", "virtual_slot", "shard", "bytes")
    total = known.agg((F.sum("bytes") / F.lit(float(n_shards)) * (1 + slack)).alias("part"))
    run = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    marked = (
        known.withColumn("filled", F.sum("bytes").over(run))
        .withColumn("part", total.scalar())
        .withColumn("stays", (F.col("shard") < n_shards) & (F.col("filled") <= F.col("part")))
    )
    kept = marked.where("stays").select("version", "virtual_slot", "shard", "bytes")
    load = kept.groupBy("shard").agg(F.sum(F.col("bytes") + 1).alias("load"))
    every = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(load, "shard", "left").agg(
        F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))).alias("l")
    )
    moved = marked.where(~F.col("stays")).agg(_items()).withColumn("l", loads.scalar())
    placed = _pack(moved.withColumn("loads", F.col("l.load")), "loads")
    return (
        kept.select("virtual_slot", "shard")
        .unionByName(placed)
        .withColumn("version", slot_map.agg(F.max("version") + 1).scalar())
        .select("version", "virtual_slot", "shard")
    )


def write_slot_map(slot_map: DataFrame, path: str) -> None:
    """Append one version; versions already stored stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_slot_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    stored = spark.read.parquet(path)
    wanted = stored.agg(F.max("version")).scalar() if version is None else F.lit(version)
    return stored.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def first_slot_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1 before anything is known of the records: the slots dealt out evenly."""
    return spark.range(n_slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard")
    )


def rebalance(spark: SparkSession, path: str, sizes: DataFrame, n_shards: int, slack: float = 0.0, room: float = 0.05) -> int:
    """The version in force after storing an edited map at ``path``, if one is due.

    It is due if a shard is fuller than an equal part (plus ``slack``) or the number of shards differs. Shards then keep
    what fits an equal part less ``room``, so that enough small slots are left to even them out.
    """
    now = read_slot_map(spark, path)
    loads = now.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("load"))
    seen = loads.agg(F.max("load").alias("most"), F.sum("load").alias("all"), F.max("shard").alias("last")).first()
    version = now.agg(F.max("version")).first()[0]
    if seen["last"] + 1 == n_shards and seen["most"] * n_shards <= seen["all"] * (1 + slack):
        return version
    write_slot_map(edit_slot_map(now, sizes, n_shards, -room), path)
    return version + 1


def place(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its place in it (gapless from 0), without ordering a whole shard anywhere.

    Places start from the number of rows in earlier cells of the shard. The table of cells is broadcast:
    it has N_SLOTS * CELLS rows at most, whatever the corpus.
    """
    counted = recs.groupBy("virtual_slot", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.join(F.broadcast(slot_map), "virtual_slot").select(
        "virtual_slot", "cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start")
    )
    own = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("place", F.row_number().over(own))
        .join(F.broadcast(cells), ["virtual_slot", "cell"])
        .withColumn("slot", F.col("start") + F.col("place") - 1)
    )


def shard(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """All rows of ``df`` in ``n_shards`` shards of near equal bytes, by the slot map stored at ``map_path``.

    The map is made there if there is none yet (by default in a new place of the shared folder), and rebalanced.
    """
    spark = df.sparkSession
    recs = records(df, id_col, text_col)
    if map_path is None:
        map_path = new_folder(spark)
        write_slot_map(first_slot_map(spark, n_shards), map_path)
    rebalance(spark, map_path, slot_bytes(recs), n_shards)
    return place(recs, read_slot_map(spark, map_path)).select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot")
