"""Binary Merkle trees over hex digests, as column expressions.

An odd level repeats its last node; no leaves give the empty string, one leaf is its own root. Nodes hash the raw bytes of
their two children.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def _depth(leaves: Column) -> Column:
    return F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)).cast("double"))).cast("int")


def _up(level: Column) -> Column:
    half = F.floor((F.size(level) + 1) / 2).cast("int")
    pair = lambda i: hash_pair(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.get(level, 2 * i)))
    return F.when(F.size(level) <= 1, level).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), pair))


def merkle_root(leaves: Column) -> Column:
    """Root of an array of hex digests in leaf order; null digests or a null array give null."""
    steps = F.sequence(F.lit(1), F.greatest(_depth(leaves), F.lit(1)))
    top = F.reduce(steps, leaves, lambda level, _: _up(level))
    return F.when(leaves.isNull(), None).otherwise(F.coalesce(F.get(top, 0), F.lit("")))


def inclusion_proof(leaves: Column, index: Column) -> Column:
    """Array of (position, hash), from the leaf up; null where the index is none of the leaves.

    position says on which side the sibling stands.
    """
    start = F.struct(leaves.alias("level"), index.cast("int").alias("at"), F.array().cast("array<struct<position:string,hash:string>>").alias("proof"))

    def step(acc: Column, _: Column) -> Column:
        level, at = acc["level"], acc["at"]
        right = at % 2 == 0
        other = F.when(right, F.coalesce(F.get(level, at + 1), F.get(level, at))).otherwise(F.get(level, at - 1))
        node = F.struct(F.when(right, "right").otherwise("left").alias("position"), other.alias("hash"))
        return F.struct(_up(level).alias("level"), F.floor(at / 2).cast("int").alias("at"), F.concat(acc["proof"], F.array(node)).alias("proof"))

    steps = F.filter(F.sequence(F.lit(0), _depth(leaves)), lambda k: k > 0)
    found = F.aggregate(steps, start, step, lambda acc: acc["proof"])
    return F.when((index >= 0) & (index < F.size(leaves)), found)


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether folding a proof over a leaf gives the root, whatever the case of their digits."""
    step = lambda acc, p: F.when(p["position"] == "right", hash_pair(acc, p["hash"])).otherwise(hash_pair(p["hash"], acc))
    return F.lower(F.aggregate(proof, leaf, step)) == F.lower(root)


def root_of(leaves: list[str]) -> str:
    """The same on the driver, for writers."""
    level = list(leaves)
    if not level:
        return ""
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest() for a, b in zip(level[::2], level[1::2])]
    return level[0]
