"""Samples that are the same in every run and on any engine with MD5: splits, down-sampling, orders with a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pepspark.operators.windows import running_total


def hash_number(seed: int, *ids: Column | str) -> Column:
    """A number below 2^32 for the seed and the ids, from the MD5 of their texts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(i) if isinstance(i, str) else i for i in ids))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def split_decoys(df: DataFrame, ident: str, decoy: str, percent: int = 50, seed: int = 928) -> tuple[DataFrame, DataFrame]:
    """(train, test): targets are in both, decoys in one, by a hash of the id."""
    in_train = hash_number(seed, ident) % 100 < percent
    return df.where(~F.col(decoy) | in_train), df.where(~F.col(decoy) | ~in_train)


def down_sample(df: DataFrame, ident: str, n: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """``n`` rows, or all if they are fewer, others in every epoch: the least hashes.  Each task sends its n least alone."""
    return df.orderBy(hash_number(seed + epoch, ident), ident).limit(n)


def until_enough(df: DataFrame, ident: str, amount: str, most: int = 500_000, seed: int = 1226) -> DataFrame:
    """Rows in a seeded order, up to the first with which their amounts are more than ``most`` together."""
    total = running_total(df.withColumn("_hash", hash_number(seed, ident)), ["_hash", ident], amount, "_total")
    return total.where(F.col("_total") - F.col(amount) <= most).drop("_hash", "_total")
