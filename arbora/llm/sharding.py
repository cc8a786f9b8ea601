"""Shard placement by a permutation-filled lookup table.

Each shard has a permutation of the slots of a prime-sized table, given by an
offset and a skip from its name's MD5. The shards take turns; at its turn a
shard claims the first slot of its permutation that is still free, until the
table is full. A row's key hashes to a slot, and the broadcast table (``size``
rows, whatever the input) gives its shard in constant time. Taking a shard
away moves few of the other shards' rows.

Everything is DataFrame or SQL work: the fill is a fold over the slots in one
row of ``size`` steps, and rows are placed by a map-side lookup join, so there
is no shuffle and no key can be hot.

A null key is placed as the text ``\\N``. An empty table gives no rows.
Repeated rows are placed alike; other columns pass through, and columns of the
input named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: the size is the first prime over 100 times the shards.
SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
TABLE_SIZE = 1601


def _digest(text: Column, first: int) -> Column:
    """Eight hex digits of the MD5 from ``first`` on, as a number."""
    return F.conv(F.substring(F.md5(text), first, 8), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Columns ``slot`` and ``shard``: every slot of the table once."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < len(shards) or size < 3 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime that is no less than the number of shards")
    orders = F.transform(
        F.array(*[F.lit(s) for s in shards]),
        lambda name: F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)),
            lambda j: ((_digest(name, 1) % size + j.cast("bigint") * (_digest(name, 9) % (size - 1) + 1)) % size).cast("int"),
        ),
    )
    row = spark.range(1, numPartitions=1).select(F.array(*[F.lit(s) for s in shards]).alias("names"), orders.alias("orders"))
    turn = f"step % {len(shards)}"
    filled = F.expr(
        f"""aggregate(sequence(0, {size - 1}), array_repeat(-1, {size}), (owner, step) ->
              transform(array(filter(element_at(orders, {turn} + 1), p -> element_at(owner, p + 1) < 0)[0]),
                        claimed -> transform(owner, (o, k) -> if(k = claimed, {turn}, o)))[0])"""
    )
    return row.select("names", F.posexplode(filled).alias("slot", "turn")).select("slot", F.expr("element_at(names, turn + 1)").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("\\N"))
    slots = df.drop("shard").withColumn("slot", (_digest(text, 1) % size).cast("int"))
    table = lookup_table(df.sparkSession, shards, size)
    return slots.join(F.broadcast(table), "slot").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> None:
    """Writes ``df`` as Parquet, a folder for each shard, without a shuffle."""
    place(df, key, shards, size).drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)
