"""Native building blocks shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the byte path of ``lower``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that a column of ``docs`` has already."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: log2 of the bits of a membership filter, by default and at most: 2**26 bits are 2048 bitmaps of 4 KiB, a broadcast of 8 MiB.
FILTER_BITS, MOST_BITS = 23, 26


def filter_bits(n: int) -> int:
    """log2 of the bits for ``n`` keys: sixteen bits a key while that stays within the most that is broadcast."""
    return min(MOST_BITS, max(15, (16 * n).bit_length()))


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def build_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmap filter of the values of ``key``: rows (bucket, bitmap), at most ``2**bits / 2**15`` of them.

    A filter of bounded size: with more keys it lets more rows through, and never loses one.
    """
    return (
        keys.select(_slot(F.col(key), bits).alias("_slot"))
        .groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bitmap"))
    )


def _flagged(df: DataFrame, key: Column, bitmaps: DataFrame, bits: int, how: str) -> tuple[DataFrame, str]:
    """``df`` with a flag column: whether the row's key may be in the filter."""
    slot, bucket, bitmap, flag = fresh(df, "_slot", "_bucket", "_bitmap", "_maybe")
    joined = df.withColumn(slot, _slot(key, bits)).join(
        F.broadcast(bitmaps.select(F.col("_bucket").alias(bucket), F.col("_bitmap").alias(bitmap))), F.bitmap_bucket_number(slot) == F.col(bucket), how
    )
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(at, F.lit(8)).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), bit).cast("int")) != 0
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(slot, bucket, bitmap), flag


def apply_filter(df: DataFrame, key: Column, bitmaps: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter (no false negatives)."""
    flagged, flag = _flagged(df, key, bitmaps, bits, "inner")
    return flagged.where(flag).drop(flag)


def probe(df: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among ``keys`` (a written table), and the rows whose key isn't: a filter sized by a count.

    The second part needs no join any more, so wide rows of it aren't shuffled. With more
    than about 2**26 keys the filter lets most rows through: the join then sees them all.
    """
    n = keys.count()
    if not n:
        return df.where(F.lit(False)), df
    bits = filter_bits(n)
    flagged, flag = _flagged(df, key, build_filter(keys, column, bits), bits, "left")
    return flagged.where(flag).drop(flag), flagged.where(~F.col(flag)).drop(flag)
