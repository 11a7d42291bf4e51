"""Distances among codes: buckets, pairs within a distance, histograms."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.vectors import hamming, hamming_sum

#: Codes of a block; a task holds two blocks.
BLOCK = 8192
#: Bits that bands must have for a join on them; narrower ones leave so many candidates that comparing all codes in blocks is less work.
SELECTIVE = 10
#: Most tasks that pairs of blocks are dealt to.
MOST_TASKS = 1024


def buckets(codes: DataFrame, key: str = "id", code: str = "code") -> DataFrame:
    """(code, first_id, n): one row per code, in first-seen order by ``first_id``. Members stay in ``codes``."""
    return codes.groupBy(F.col(code).alias("code")).agg(F.min(key).alias("first_id"), F.count("*").alias("n"))


def bands_of(bits: int, within: int) -> list[tuple[int, int]]:
    """(shift, width) of ``within + 1`` bands over ``bits`` bits."""
    parts = within + 1
    cuts = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def selective(bits: int, within: int) -> bool:
    """Whether bands for this distance are wide enough for a join on them."""
    return min(w for _, w in bands_of(bits, within)) >= SELECTIVE


def hamming_pairs(b: DataFrame, within: int, bits: int) -> DataFrame:
    """``b(code, first_id)`` -> (a, b, d) with a < b and d <= within.

    Two codes at that distance agree in one of ``within + 1`` bands, so candidates
    come from an equi-join on bands, and a pair counts in the first band it shares.
    Where bands would be narrower than ``SELECTIVE`` bits, all codes are compared in
    blocks.
    """
    cuts = bands_of(bits, within)
    if not selective(bits, within):
        return _in_blocks(b, lambda *cell: _near_of(*cell, within), "a long, b long, d int")
    x, y = b.select(F.col("first_id").alias("a"), F.col("code").alias("ca")), b.select(F.col("first_id").alias("b"), F.col("code").alias("cb"))
    d = hamming(F.col("ca"), F.col("cb"))
    part = lambda c, s, w: F.shiftright(c, s).bitwiseAND(F.lit((1 << w) - 1)) if w < 64 else c
    keys = lambda c: F.array(*[F.struct(F.lit(i).alias("i"), part(F.col(c), s, w).alias("v")) for i, (s, w) in enumerate(cuts)])
    left, right = x.withColumn("k", F.explode(keys("ca"))), y.withColumn("k", F.explode(keys("cb")))
    diff = F.col("ca").bitwiseXOR(F.col("cb"))
    earlier = F.lit(False)
    for i, (s, w) in enumerate(cuts):
        earlier = earlier | ((F.col("band") > i) & (part(diff, s, w) == 0))
    met = left.select("a", "ca", F.col("k.i").alias("band"), F.col("k.v").alias("v")).join(right.select("b", "cb", F.col("k.i").alias("band"), F.col("k.v").alias("v")), ["band", "v"])
    return met.where((F.col("a") < F.col("b")) & (d <= within) & ~earlier).select("a", "b", d.alias("d"))


def banded_pairs(codes: DataFrame, within: int, key: str = "id", parts: str = "codes") -> DataFrame:
    """Pairs that share any sub-code, whatever its band, at a summed distance of at most ``within``: (a, b, d)."""
    one = codes.select(F.col(key).alias("id"), F.col(parts).alias("codes"))
    keyed = one.select("id", F.explode(F.array_distinct("codes")).alias("k"))
    met = keyed.select(F.col("id").alias("a"), "k").join(keyed.select(F.col("id").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    full = met.join(one.select(F.col("id").alias("a"), F.col("codes").alias("ca")), "a").join(one.select(F.col("id").alias("b"), F.col("codes").alias("cb")), "b")
    return full.select("a", "b", hamming_sum(F.col("ca"), F.col("cb")).alias("d")).where(F.col("d") <= within)


def _nothing(schema: str) -> pd.DataFrame:
    kinds = {"long": np.int64, "int": np.int32}
    return pd.DataFrame({name: np.zeros(0, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))})


def _in_blocks(b: DataFrame, f: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """Applies ``f(codes, ids, counts, codes, ids, counts, same)`` to all pairs of blocks of ``b(code, first_id[, n])``, each pair in one task."""
    blocks = max(1, -(-b.count() // block))
    v = b.select("code", "first_id", (F.col("n") if "n" in b.columns else F.lit(1)).cast("long").alias("n"), F.pmod(F.xxhash64("first_id"), F.lit(blocks)).cast("int").alias("own"))
    left = v.withColumn("j", F.explode(F.sequence("own", F.lit(blocks - 1)))).withColumnRenamed("own", "i")
    right = v.withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).select("i", F.col("own").alias("j"), *[F.col(c).alias(c) for c in v.columns if c != "own"])
    # The work of a cell is far more than its bytes show, so cells are dealt by number and not merged by size.
    tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
    left, right = left.repartition(tasks, "i", "j"), right.repartition(tasks, "i", "j")

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return _nothing(schema)
        parts = [[t["code"].to_numpy(np.int64).view(np.uint64), t["first_id"].to_numpy(np.int64), t["n"].to_numpy(np.int64)] for t in (x, y)]
        return f(*parts[0], *parts[1], key[0] == key[1])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)


def _near_of(ca, ia, na, cb, ib, nb, same: bool, within: int) -> pd.DataFrame:
    out = [np.zeros((0, 3), np.int64)]
    if not (ca >> np.uint64(32)).any() and not (cb >> np.uint64(32)).any():
        ca, cb = ca.astype(np.uint32), cb.astype(np.uint32)
    diff, count, close = (np.empty((32, len(cb)), kind) for kind in (ca.dtype, np.uint8, bool))
    for at in range(0, len(ca), 32):
        n = min(32, len(ca) - at)
        np.bitwise_xor(ca[at : at + n, None], cb[None, :], out=diff[:n])
        d = np.bitwise_count(diff[:n], out=count[:n])
        near = np.flatnonzero(np.less_equal(d, within, out=close[:n]))
        i, j = np.divmod(near, len(cb))
        a, b = ia[at + i], ib[j]
        on = a < b if same else a != b
        out.append(np.stack([np.minimum(a, b)[on], np.maximum(a, b)[on], d.ravel()[near][on]], axis=1).astype(np.int64))
    found = np.concatenate(out)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "d": found[:, 2].astype(np.int32)})


def _distances_of(ca, ia, na, cb, ib, nb, same: bool) -> pd.DataFrame:
    total = np.zeros(65, np.int64)
    for at in range(0, len(ca), 512):
        d = np.bitwise_count(ca[at : at + 512, None] ^ cb[None, :]).astype(np.int64)
        on = ia[at : at + 512, None] < ib[None, :] if same else np.ones(d.shape, bool)
        rows = np.repeat(np.arange(len(d)), d.shape[1]).reshape(d.shape)
        per = np.bincount((65 * rows + d)[on], np.broadcast_to(nb, d.shape)[on], 65 * len(d)).reshape(-1, 65).astype(np.int64)
        total += na[at : at + 512] @ per
    at = np.flatnonzero(total)
    return pd.DataFrame({"distance": at.astype(np.int32), "cnt": total[at]})


def histogram(b: DataFrame) -> DataFrame:
    """``b(code, first_id, n)`` -> (distance, cnt) over all pairs of items, gaps filled with 0.

    Pairs of buckets count with the product of their sizes, pairs within one at distance
    0. Codes are compared in blocks; what leaves a pair of blocks is a count per distance.
    """
    apart = _in_blocks(b, _distances_of, "distance int, cnt long").groupBy("distance").agg(F.sum("cnt").alias("cnt"))
    return _filled(b, apart)


def _sums_in_blocks(b: DataFrame, f: Callable, schema: str) -> DataFrame:
    """As ``_in_blocks`` for ``b(codes, first_id[, n])`` whose code is a list of words: ``f(d, id, n, ids, counts)`` of each code against a block."""
    blocks = max(1, -(-b.count() // BLOCK))
    v = b.select("codes", "first_id", (F.col("n") if "n" in b.columns else F.lit(1)).cast("long").alias("n"), F.pmod(F.xxhash64("first_id"), F.lit(blocks)).cast("int").alias("own"))
    left = v.withColumn("j", F.explode(F.sequence("own", F.lit(blocks - 1)))).withColumnRenamed("own", "i")
    right = v.withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).select("i", F.col("own").alias("j"), *[F.col(c).alias(c) for c in v.columns if c != "own"])

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return _nothing(schema)
        (ca, ia, na), (cb, ib, nb) = [(np.stack(t["codes"].to_numpy()).astype(np.int64).view(np.uint64), t["first_id"].to_numpy(np.int64), t["n"].to_numpy(np.int64)) for t in (x, y)]
        found = []
        for c, i, n in zip(ca, ia.tolist(), na.tolist(), strict=True):
            on = ib > i if key[0] == key[1] else np.ones(len(ib), bool)
            found.append(f(np.bitwise_count(cb[on] ^ c).sum(axis=1, dtype=np.int64), i, n, ib[on], nb[on]))
        return pd.concat([_nothing(schema), *found])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, schema)


def near_sums(b: DataFrame, within: int) -> DataFrame:
    """``b(codes, first_id)`` -> (a, b, d): all pairs at a summed distance of at most ``within``."""

    def near(d, i, n, ids, counts) -> pd.DataFrame:
        on = np.flatnonzero(d <= within)
        return pd.DataFrame({"a": np.minimum(ids[on], i), "b": np.maximum(ids[on], i), "d": d[on].astype(np.int32)})

    return _sums_in_blocks(b, near, "a long, b long, d int")


def histogram_of_sums(b: DataFrame) -> DataFrame:
    """As ``histogram``, for ``b(codes, first_id, n)`` whose code is a list of words; distances of the words are summed."""

    def count(d, i, n, ids, counts) -> pd.DataFrame:
        per = np.bincount(d, counts).astype(np.int64) * n
        at = np.flatnonzero(per)
        return pd.DataFrame({"distance": at.astype(np.int32), "cnt": per[at]})

    apart = _sums_in_blocks(b, count, "distance int, cnt long").groupBy("distance").agg(F.sum("cnt").alias("cnt"))
    return _filled(b, apart)


def _filled(b: DataFrame, apart: DataFrame) -> DataFrame:
    same = b.where("n > 1").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("cnt")).where("cnt > 0").select(F.lit(0).alias("distance"), "cnt")
    counts = apart.unionByName(same).groupBy("distance").agg(F.sum("cnt").alias("cnt"))
    span = counts.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).where("lo is not null")
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("distance"))
    return grid.join(F.broadcast(counts), "distance", "left").select("distance", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of the key, so that the same rows come each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
