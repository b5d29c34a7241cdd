"""Operator 6: SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .sampling import slices
from .store import fresh, written
from .words import lower_words, shingle_hashes

SHINGLE, RADIUS = 3, 3
TILE = 8192  # fingerprints of a unit of work, at most
CELL = 1024  # fingerprints of a tile: two tiles are compared as a whole, or not at all
BATCH = 1 << 16  # rows of tiles looked at together
STEP = 1 << 21  # cells of a tile pair compared at once


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's n-word shingles."""
    h = shingle_hashes(lower_words(text), n)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in slices(parts):
        fp = np.array([fingerprint(t) for t in p.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("same"), pa.array(fp)], ["doc_id", "same", "fp"])


def forest(fp: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (pairs of ids) that connect all fingerprints which lie within the radius of each other, at most one
    for each fingerprint: from each one reached, only those not reached yet are compared, by exclusive-or and bit
    count over blocks of a bounded size."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, STEP // len(left))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(fp[part][:, None] ^ fp[left][None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                frm = part[near[:, hit].argmax(axis=0)]
                new = left[hit]
                out += zip(ids[frm].tolist(), ids[new].tolist())
                front, left = np.concatenate([front, new]), left[~hit]
    return out


def across(fa: np.ndarray, ia: np.ndarray, fb: np.ndarray, ib: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between two tiles that connect what lies within the radius across them, fewer than fingerprints: from
    each one reached, only those of the other tile that are not reached yet are looked at."""
    near = np.bitwise_count(fa[:, None] ^ fb[None, :]) <= radius
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, out = near[np.ix_(rows, cols)], []
    left, right = np.ones(len(rows), bool), np.ones(len(cols), bool)
    for first in range(len(rows)):
        front, here = (np.array([first]) if left[first] else np.zeros(0, np.int64)), True
        left[first] = False
        while len(front):
            part, free = (near[front], right) if here else (near[:, front].T, left)
            hit = np.flatnonzero(part.any(axis=0) & free)
            if len(hit):
                frm = front[part[:, hit].argmax(axis=0)]
                a, b = (frm, hit) if here else (hit, frm)
                out += zip(ia[rows[a]].tolist(), ib[cols[b]].tolist())
                free[hit] = False
            front, here = hit, not here
    return out


def _tiles(fp: np.ndarray) -> list[tuple[slice, int, int]]:
    """Fingerprints in order of bit count as tiles: where each lies, and its least and largest bit count."""
    count = np.bitwise_count(fp)
    return [(slice(i, i + CELL), int(count[i]), int(count[min(i + CELL, len(fp)) - 1])) for i in range(0, len(fp), CELL)]


def tiled(fa: np.ndarray, ia: np.ndarray, fb: np.ndarray, ib: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links between two sides in order of bit count, a tile of each at a time; tiles whose bit counts differ by
    more than the radius are skipped."""
    return [x for a, la, ha in _tiles(fa) for b, lb, hb in _tiles(fb) if lb - ha <= radius and la - hb <= radius for x in across(fa[a], ia[a], fb[b], ib[b], radius)]


def tiled_within(fp: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within one side in order of bit count, as tiled()."""
    tiles, out = _tiles(fp), []
    for i, (a, _, high) in enumerate(tiles):
        out += forest(fp[a], ids[a], radius)
        for b, low, _ in tiles[i + 1 :]:
            if low - high > radius:
                break
            out += across(fp[a], ids[a], fp[b], ids[b], radius)
    return out


def _runs(key: np.ndarray, fp: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within runs of equal keys (the rows in order of key and bit count): offset by offset over all runs at
    once for short runs, tile by tile for long ones. An offset's pairs whose bit counts differ by more than the
    radius are skipped."""
    out: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    for a, n in zip(edge[size > 64].tolist(), size[size > 64].tolist()):
        out += tiled_within(fp[a : a + n], ids[a : a + n], radius)
    short = np.repeat(size <= 64, size)
    key, fp, ids = key[short], fp[short], ids[short]
    count = np.bitwise_count(fp).astype(np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for d in range(1, 64):
        near = np.flatnonzero((key[d:] == key[:-d]) & (count[d:] - count[:-d] <= radius))
        if not len(near):
            break
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
        for a, b in zip(ids[near].tolist(), ids[near + d].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[y] = x
                out.append((a, b))
    return out


def _compare(radius: int):
    def tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a partition in order of unit and bit count; a unit never ends before all its rows came."""
        kept: list[pd.DataFrame] = []
        for p in parts:
            kept.append(p)
            if sum(map(len, kept)) >= BATCH:
                rows = pd.concat(kept, ignore_index=True)
                whole = int((rows["unit"] == rows["unit"].iloc[-1]).to_numpy().argmax())
                if whole:
                    yield _links(rows.iloc[:whole], radius)
                kept = [rows.iloc[whole:]]
        if kept:
            yield _links(pd.concat(kept, ignore_index=True), radius)

    return tiles


def _links(p: pd.DataFrame, radius: int) -> pd.DataFrame:
    out: list[tuple[int, int]] = []
    side = p["side"].to_numpy()
    one = side < 0
    fp, ids, unit = p["fp"].to_numpy(np.int64).view(np.uint64), p["rep"].to_numpy(np.int64), p["unit"].to_numpy(np.int64)
    if one.any():
        out += _runs(unit[one], fp[one], ids[one], radius)
    two = np.flatnonzero(~one)
    if len(two):
        cut = np.flatnonzero(np.diff(unit[two])) + 1
        for x in np.split(two, cut):
            a, b = x[side[x] == 0], x[side[x] == 1]
            out += tiled(fp[a], ids[a], fp[b], ids[b], radius)
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b: rep) that connect all different fingerprints of prints (fp, rep: long, fp unique) within the
    radius.

    Two fingerprints that differ in at most radius bits agree in one of radius + 1 blocks of bits, so the pairs
    of each block's equal values are all that must be compared. Such a group is one unit of work. The rows of a
    group that is too large for that differ in the other bits alone, so they agree in one of radius + 1 blocks of
    those, which splits the group again. What is still too large is cut into units by bit count; pairs of them
    whose bit counts differ by more than the radius are never made. Groups are numbered by block and value, 2^16
    values a block at most, so the table of large groups that is broadcast has at most (radius + 1) * 2^16 rows.
    """
    blocks = radius + 1
    width = -(-64 // blocks)
    if width > 16:
        raise ValueError("a radius under 3 needs a wider table of groups")
    keys = F.array(*[F.lit(i << 16) + F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(blocks)])
    rows = prints.select("fp", "rep", F.explode(keys).alias("key")).withColumn("pc", F.bit_count("fp").cast("int"))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select(F.col("key").alias("large"))
    columns = ["unit", "side", "fp", "rep", "pc"]
    units = rows.join(F.broadcast(large), F.col("key") == F.col("large"), "left")
    small = units.filter("large is null").select(F.col("key").cast("long").alias("unit"), F.lit(-1).alias("side"), "fp", "rep", "pc")
    if not large.isEmpty():
        part = -(-(64 - width) // blocks)
        turned = [F.shiftrightunsigned("fp", i * width).bitwiseOR(F.shiftleft("fp", (64 - i * width) % 64)) for i in range(blocks)]
        other = F.element_at(F.array(*turned), F.shiftright("key", 16) + 1)  # the group's own block lowest
        rest = [F.xxhash64("key", F.lit(j), F.shiftrightunsigned(other, width + j * part).bitwiseAND(F.lit((1 << part) - 1))) for j in range(blocks)]
        again = units.filter("large is not null").select("fp", "rep", "pc", F.explode(F.array(*rest)).alias("unit"))
        again = again.join(again.groupBy("unit").agg(F.count("*").alias("n")), "unit")
        cuts = F.ceil(F.col("n") / tile).cast("int")
        small = small.unionByName(again.filter(F.col("n") <= tile).select("unit", F.lit(-1).alias("side"), "fp", "rep", "pc"))
        big = again.filter(F.col("n") > tile).withColumn("cuts", cuts).withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
        me = F.col("pc") * F.col("cuts") + F.col("cut")
        mates = F.flatten(F.transform(F.sequence(F.col("pc") - radius, F.col("pc") + radius), lambda pc: F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: pc * F.col("cuts") + c)))
        big = big.withColumn("me", me).withColumn("mate", F.explode(mates)).filter("mate >= 0")
        pair = F.xxhash64("unit", F.least("me", "mate"), F.greatest("me", "mate"))
        side = F.when(F.col("me") == F.col("mate"), -1).when(F.col("me") < F.col("mate"), 0).otherwise(1)
        small = small.unionByName(big.select(pair.alias("unit"), side.alias("side"), "fp", "rep", "pc"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.select(*columns).repartition(parts, "unit").sortWithinPartitions("unit", "pc", "fp")
    return dealt.mapInPandas(_compare(radius), "a long, b long").distinct()


def _components(docs: DataFrame) -> DataFrame:
    """doc_id, same (a hash of the text), fp, root (names the component) and component_id for every row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    prints = written(rows.mapInArrow(_fingerprints, "doc_id long, same long, fp long"), "simhash")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    comps = connected_components(links(reps.select("fp", F.col("fp").alias("rep"))))
    roots = written(reps.join(comps, reps["fp"] == comps["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    least = written(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-components")
    return prints.join(roots.join(least, "root").drop("rep"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    component_id is the smallest doc_id that is reached over links between fingerprints with at most 3 differing
    bits. Null and empty texts have fingerprint 0, which links like any other; texts of fewer than 3 words are
    one shingle; equal texts share a fingerprint and so a component; repeated rows stay; rows without doc_id link
    like others, and component_id is null where a component has no doc_id at all. Rows of one doc_id whose texts
    differ are rows of their own. An empty table gives an empty result; other columns are left alone.
    """
    return _components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (rows without one come last), of those with that
    doc_id the one with the smallest fingerprint, then by a hash of the text; of rows that are equal in doc_id and
    text any one, since they differ in other columns alone. Null texts are a component with the empty ones; other
    columns may have any names; an empty table gives an empty result."""
    ident, same, mine = (fresh(docs.columns, c) for c in ("_id", "_kept", "_same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "same")).alias("first")
    kept = _components(docs).groupBy("root").agg(first).select(F.col("first.doc_id").alias(ident), F.col("first.same").alias(same))
    rows = docs.withColumn(mine, F.xxhash64("text"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(mine) == F.col(same)), "left_semi").dropDuplicates(["doc_id", mine]).drop(mine)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
