"""Rows that cannot meet any of the keys of a join, left out before they are shuffled.

A sieve is a table of bits of bounded size: two bits of one word stand for a key. A row whose
key is in the table always passes; of the others a share passes that depends on the number of
keys alone, so what passes still has to be joined. More keys than one sieve holds are cut
into parts by their hash, and each part is held against the rows in turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.plans import durable

MOST_BITS = 22  # a sieve has up to 2^22 words of 64 bits: 32 MB, whatever the input
LINE_BITS = 10  # words in one row of the table, as a power of two
KEYS = 1 << 26  # keys in a sieve: 16 a word, so that about one in six other rows passes


def parts(count: int) -> int:
    """How many sieves ``count`` keys need."""
    return max(1, -(-count // KEYS))


def _columns(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def _hash(key: str | list[str]) -> Column:
    return F.xxhash64(*_columns(key))


def part(rows: DataFrame, key: str | list[str], at: int, of: int) -> DataFrame:
    """The rows whose keys are in part ``at`` of ``of``."""
    if of == 1:
        return rows
    return rows.filter(F.pmod(F.shiftrightunsigned(_hash(key), 12).bitwiseAND(F.lit(0xFFFFFF)), F.lit(of)) == at)


def _mask(hashed: Column) -> Column:
    def bit(at: int) -> Column:
        place = F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    return bit(0).bitwiseOR(bit(6))


def made(keys: DataFrame, key: str | list[str], count: int) -> tuple[DataFrame, int]:
    """The sieve of about ``count`` keys, written, and its number of words as a power of two."""
    bits = min(MOST_BITS, max(LINE_BITS, (count // 8).bit_length()))
    hashed = _hash(key)
    words = keys.select(F.shiftrightunsigned(hashed, 64 - bits).alias("word"), _mask(hashed).alias("bits"))
    blank = keys.sparkSession.range(1 << bits).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = words.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    at = F.col("word").bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    lines = words.groupBy(F.shiftrightunsigned("word", LINE_BITS).alias("_line")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "bits"))).alias("_w"))
    return durable.written(lines.select("_line", F.col("_w.bits").alias("_bits")), "sieve", lean=True), bits


def passed(rows: DataFrame, key: str | list[str], sieve: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key may be one of the sieve's; rows without a key are left out."""
    lines, bits = sieve
    there = reduce(Column.__and__, [F.col(k).isNotNull() for k in _columns(key)])
    hashed = rows.filter(there).withColumn("_hash", _hash(key))
    word = F.shiftrightunsigned("_hash", 64 - bits)
    met = hashed.join(F.broadcast(lines), F.shiftrightunsigned(word, LINE_BITS) == F.col("_line"))
    found = F.get("_bits", word.bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int"))
    mask = _mask(F.col("_hash"))
    return met.filter(found.bitwiseAND(mask) == mask).select(*rows.columns)


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be in the written table ``keys``; with many keys, the rows of each part are written."""
    count = keys.count()
    of = parts(count)
    found = []
    for at in range(of):
        sieve = made(part(keys, key, at, of), key, count // of)
        met = passed(part(rows, key, at, of), key, sieve)
        found.append(met if of == 1 else durable.written(met, "sifted", lean=True))
    return reduce(DataFrame.unionByName, found)
