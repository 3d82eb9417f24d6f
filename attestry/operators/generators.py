"""Injected attacks and shifts over vectors, each a function of a DataFrame for ``transform`` and fixed by its seed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Attack = Callable[[DataFrame], DataFrame]


def _number(seed: int, *more: Column | str) -> Column:
    """A number in [0, 1) fixed by the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *more), F.lit(1 << 30)) / F.lit(float(1 << 30))


def chosen(share: float, seed: int = 42) -> Column:
    return _number(seed, "sample_id") < share


def label_flip(classes: int, seed: int = 42) -> Attack:
    """Another class, each as likely as any."""
    step = 1 + F.floor(_number(seed, "sample_id", F.lit("flip")) * (classes - 1))
    return lambda df: df.withColumn("label", ((F.col("label") + step) % classes).cast("int"))


def systematic_mislabel(confusions: dict[int, int], classes: int) -> Attack:
    """The class that the map names, else the next one."""
    table = F.create_map(*(F.lit(x) for kv in confusions.items() for x in kv)) if confusions else F.create_map().cast("map<int,int>")
    return lambda df: df.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), ((F.col("label") + 1) % classes).cast("int")))


def near_duplicate(copies: int, seed: int = 42) -> Attack:
    """Each sample with some scaled and offset copies of itself, under new ids."""

    def apply(df: DataFrame) -> DataFrame:
        scale = 0.85 + 0.30 * _number(seed, "sample_id", "copy", F.lit("scale"))
        offset = 0.02 * (_number(seed, "sample_id", "copy", F.lit("offset")) - 0.5)
        many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
        moved = F.when(F.col("copy") == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x * scale + offset))
        return many.withColumn("vector", moved).withColumn("sample_id", F.col("sample_id") * (copies + 1) + F.col("copy")).drop("copy")

    return apply


def ood_insertion(seed: int = 42) -> Attack:
    """The vector replaced by uniform noise, the label by -1."""

    def apply(df: DataFrame) -> DataFrame:
        noise = F.transform("vector", lambda x, i: _number(seed, F.col("sample_id"), i) * 2 - 1)
        return df.withColumn("vector", noise).withColumn("label", F.lit(-1))

    return apply


def corner_trigger(size: int = 3, side: int = 8, opacity: float = 1.0) -> Attack:
    """A checker of +1 and -1 in the last corner."""

    def apply(df: DataFrame) -> DataFrame:
        def cell(x: Column, i: Column) -> Column:
            r, c = F.floor(i / side), i % side
            mark = F.when((r + c) % 2 == 0, 1.0).otherwise(-1.0)
            return F.when((r >= side - size) & (c >= side - size), opacity * mark + (1 - opacity) * x).otherwise(x)

        return df.withColumn("vector", F.transform("vector", cell))

    return apply


def blended_trigger(alpha: float = 0.3, side: int = 8) -> Attack:
    """A cross of both diagonals blended over the whole grid."""

    def apply(df: DataFrame) -> DataFrame:
        def cell(x: Column, i: Column) -> Column:
            r, c = F.floor(i / side), i % side
            return alpha * F.when((r == c) | (r + c == side - 1), 1.0).otherwise(0.0) + (1 - alpha) * x

        return df.withColumn("vector", F.transform("vector", cell))

    return apply


def spectral_trigger(strength: float = 0.5, frequency: float = 0.35, side: int = 8) -> Attack:
    """Two plane waves added to the grid."""

    def apply(df: DataFrame) -> DataFrame:
        def cell(x: Column, i: Column) -> Column:
            r, c = F.floor(i / side), i % side
            return x + strength * (F.sin(2 * math.pi * frequency * (c + r)) + F.cos(2 * math.pi * frequency * (c - r)))

        return df.withColumn("vector", F.transform("vector", cell))

    return apply


def operational_shift(kind: str, amount: float = 0.5, seed: int = 42) -> Attack:
    """illumination scales, blur averages neighbours, noise adds noise, weather fades to a constant, compression keeps coarse steps."""
    v = F.col("vector")
    forms = {
        "illumination": F.transform(v, lambda x: x * (1 - amount)),
        "blur": F.transform(v, lambda x, i: (x + F.coalesce(F.get(v, i - 1), x) + F.coalesce(F.get(v, i + 1), x)) / 3),
        "noise": F.transform(v, lambda x, i: x + amount * (_number(seed, F.col("sample_id"), i) - 0.5)),
        "weather": F.transform(v, lambda x: x * (1 - amount) + amount * 0.1),
        "compression": F.transform(v, lambda x: F.round(x / (amount / 10)) * (amount / 10)),
    }
    return lambda df: df.withColumn("vector", forms[kind])


def inject(samples: DataFrame, attack: Attack, name: str, share: float, seed: int = 42) -> DataFrame:
    """samples with an attack on a chosen share of them, and the ground truth in is_attacked and attack_type."""
    hit = attack(samples.filter(chosen(share, seed))).withColumn("is_attacked", F.lit(True)).withColumn("attack_type", F.lit(name))
    rest = samples.filter(~chosen(share, seed)).withColumn("is_attacked", F.lit(False)).withColumn("attack_type", F.lit(None).cast("string"))
    return rest.unionByName(hit)
