"""Sharding: a permutation-filled lookup table.

Every shard has a preference order over the slots of a table whose size is a prime: its
offset and step, both hashes of its name, visit every slot once. The shards take turns; each
claims the first slot of its order that is still free, until all are taken. Shards so get
equal numbers of slots within one, and a shard that leaves or joins moves few others' slots.
A row's slot is the hash of its key modulo the prime; the table (``prime`` rows, a
parameter) is broadcast, so placing a row takes one lookup whatever the number of shards.

The table is filled by a fold over probes in one row of SQL: its state is the table (two
bytes a slot), the next preference of each shard and whose turn it is. Probes go on in
rounds of a fixed length until no slot is free.

Defined results: null keys share one slot; equal keys share a shard; an empty table of
documents gives an empty result; one shard takes everything; columns of the documents named
slot, shard or shard_name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.session import stage

PRIME = 16381
FREE = "FFFF"
#: Probes of one round of the fold, in tables.
ROUND = 4


def preferences(spark: SparkSession, shards: list[str], prime: int) -> DataFrame:
    """Columns shard (its number), name, offset, step."""
    names = F.array(*[F.lit(s) for s in shards])
    one = spark.range(1).select(F.posexplode(names).alias("shard", "name"))
    return one.select(
        "shard", "name",
        F.pmod(F.xxhash64("name", F.lit("offset")), F.lit(prime)).cast("int").alias("offset"),
        (F.pmod(F.xxhash64("name", F.lit("step")), F.lit(prime - 1)) + 1).cast("int").alias("step"),
    )


def lookup_table(spark: SparkSession, shards: list[str], prime: int = PRIME) -> DataFrame:
    """Columns slot, shard, name: ``prime`` rows."""
    if not 0 < len(shards) < min(prime, 0xFFFF) or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, and fewer of them than slots")
    if prime < 3 or any(prime % k == 0 for k in range(2, int(prime**0.5) + 1)):
        raise ValueError("the size of the table must be a prime")
    n, wanted = len(shards), preferences(spark, shards, prime)
    ordered = F.sort_array(F.collect_list(F.struct("shard", "offset", "step")))
    state = stage(wanted.agg(ordered.alias("p")).select(
        F.col("p.offset").alias("offsets"), F.col("p.step").alias("steps"),
        F.struct(
            F.unhex(F.repeat(F.lit(FREE), prime)).alias("slots"), F.transform("p", lambda _: F.lit(0)).alias("next"),
            F.lit(0).alias("turn"), F.lit(0).alias("taken"),
        ).alias("state"),
    ))
    # one probe: the shard whose turn it is looks at its next preference
    probe = f"""aggregate(sequence(1, {ROUND * prime}), state, (s, _) ->
        CASE WHEN s.taken = {prime} THEN s ELSE transform(array(
            cast((offsets[s.turn] + cast(s.next[s.turn] AS bigint) * steps[s.turn]) % {prime} AS int)
        ), slot -> CASE WHEN substring(s.slots, 2 * slot + 1, 2) = unhex('{FREE}')
            THEN named_struct(
                'slots', overlay(s.slots PLACING unhex(lpad(hex(s.turn), 4, '0')) FROM 2 * slot + 1 FOR 2),
                'next', transform(s.next, (x, i) -> CASE WHEN i = s.turn THEN x + 1 ELSE x END),
                'turn', (s.turn + 1) % {n}, 'taken', s.taken + 1)
            ELSE named_struct(
                'slots', s.slots, 'next', transform(s.next, (x, i) -> CASE WHEN i = s.turn THEN x + 1 ELSE x END),
                'turn', s.turn, 'taken', s.taken)
        END)[0] END)"""
    while True:
        state = stage(state.select("offsets", "steps", F.expr(probe).alias("state")))
        if state.select("state.taken").head()[0] == prime:
            break
    slots = state.select(F.explode(F.sequence(F.lit(0), F.lit(prime - 1))).alias("slot"), "state.slots")
    numbers = slots.select("slot", F.conv(F.hex(F.expr("substring(slots, 2 * slot + 1, 2)")), 16, 10).cast("int").alias("shard"))
    return stage(numbers.join(F.broadcast(wanted.select("shard", "name")), "shard").select("slot", "shard", "name"))


def assign_shards(docs: DataFrame, shards: list[str], key_cols: list[str], prime: int = PRIME) -> DataFrame:
    """docs with the new columns slot, shard and shard_name."""
    table = lookup_table(docs.sparkSession, shards, prime).select(
        F.col("slot").alias("table_slot"), F.struct("shard", "name").alias("table_row")
    )
    slot = F.pmod(F.xxhash64(*[docs[c] for c in key_cols]), F.lit(prime)).cast("int")
    placed = docs.select(F.struct(*docs.columns).alias("row"), slot.alias("slot"))
    # the table has as many rows as its size says
    found = placed.join(F.broadcast(table), F.col("slot") == F.col("table_slot"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("slot", "shard", "shard_name")]
    return found.select(*own, "slot", F.col("table_row.shard").alias("shard"), F.col("table_row.name").alias("shard_name"))


def write_shards(docs: DataFrame, path: str, shards: list[str], key_cols: list[str], prime: int = PRIME) -> None:
    """Parquet with one folder per shard."""
    assign_shards(docs, shards, key_cols, prime).write.partitionBy("shard_name").parquet(path)
