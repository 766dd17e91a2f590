"""Bloom filters from DataFrame functions alone: bits are gathered into arrays, membership is an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import shared

CHUNK = 1 << 10  # words of 64 bits in each inner array


class Bloom:
    """A filter over a key column. Its size is n_bits, whatever the keys; more keys only make it let more others through."""

    def __init__(self, keys: DataFrame, key: str, n_bits: int, hashes: int, seed: int = 0):
        self.n_bits, self.hashes, self.seed = max(64, n_bits), hashes, seed
        n_words = -(-self.n_bits // 64)
        set_bits = keys.select(F.explode(F.array(*self._places(F.col(key)))).alias("place"))
        words = set_bits.groupBy(F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
        clear = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        whole = words.union(clear).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
        chunks = whole.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("held"))
        gathered = chunks.select("chunk", F.col("held.bits").alias("bits")).agg(F.array_sort(F.collect_list(F.struct("chunk", "bits"))).alias("held"))
        self.held = shared.stored(gathered.select(F.col("held.bits").alias("held")), "bloom")

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(k)), F.lit(self.n_bits).cast("long")) for k in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        """True if the key was put in, and for a share of other keys."""
        held = self.held.scalar()
        found = F.lit(True)
        for place in self._places(key):
            word = F.shiftright(place, 6)
            bits = F.get(F.get(held, F.floor(word / CHUNK).cast("int")), (word % CHUNK).cast("int"))
            one = F.call_function("shiftrightunsigned", bits, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
            found = found & (one == 1)
        return found
