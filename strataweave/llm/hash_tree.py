"""Sharding by a hierarchical weighted hash tree.

Shards are below racks, racks below regions; an inner node weighs what its shards weigh together.  A row descends from
the root: among a node's children each draws -ln(u) / weight, u being a hash of the row's key and the child's path, and
the smallest draw is taken, so a child wins with its share of the weight.  A level costs a draw for each child of one
node; shards elsewhere are never looked at.

A child's draw depends on its own weight alone.  Where weights change in one subtree only, rows move into it, out of it
or inside it, and all others stay: at each level only draws on the changed path differ.

Regions have a fixed size, and the last one's places may be vacant.  A vacant place weighs what its shard will, so no
weight changes when it is filled.  A region's draw is the least of its places' draws, and the descent says whose it is;
if that place is vacant, each of the others waits for its own draw beyond it, and the shortest wait counts (what is left
of an exponential time is distributed like the whole).  So each shard has its share, and one more shard takes rows only
into itself, at any number of shards (the law `key`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column as _column

#: Rows that one block of a shard's numbering holds on average.
BLOCK_ROWS = 1 << 18
#: What is added to the seed for draws beyond a vacant place.
WAIT = 1 << 20


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    vacant: bool = False


def layout(shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> list[Shard]:
    """Places in order: per_rack to a rack, racks to a region; those of the last region beyond the shards are vacant."""
    size = per_rack * racks
    return [Shard(i, i // size, i // per_rack % racks, (weights or {}).get(i, 1.0), i >= shards) for i in range(-(-shards // size) * size)]


def with_one_more(tree: list[Shard], per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """The tree with its first vacant place filled; without one, with a further region of which the first place is."""
    if not any(x.vacant for x in tree):
        shard, region = max(x.shard for x in tree) + 1, max(x.region for x in tree) + 1
        tree = [*tree, *(Shard(shard + i, region, i // per_rack, vacant=True) for i in range(per_rack * racks))]
    first = min(x.shard for x in tree if x.vacant)
    return [replace(x, vacant=False) if x.shard == first else x for x in tree]


def draw(key: Column, path: list[Column], weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, *path, F.lit(seed).cast("long")), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def place(key: Column, tree: list[Shard], seed: int = 7) -> Column:
    """A struct of region, rack and shard: the descent from the root.  Shards of weight 0 get nothing; equal draws go to the smaller node."""
    tree = [x for x in tree if x.weight > 0]
    if all(x.vacant for x in tree):
        raise ValueError("no shard has a weight")

    def grouped(shards: list[Shard], by: Callable[[Shard], int]) -> list[tuple[int, list[Shard]]]:
        return [(i, [x for x in shards if by(x) == i]) for i in sorted({by(x) for x in shards})]

    def node(i: int, weight: float, below: Column | None) -> Column:
        fields = [F.lit(i).cast("long").alias("id"), F.lit(float(weight)).alias("weight")]
        return F.struct(*fields, *([] if below is None else [below.alias("below")]))

    def level(children: list[Column]) -> Column:
        return F.array(*children)

    def total(shards: list[Shard]) -> float:
        return sum(x.weight for x in shards)

    def region_node(region: int, inside: list[Shard]) -> Column:
        racks = [node(rack, total(leaves), level([node(x.shard, x.weight, None) for x in leaves])) for rack, leaves in grouped(inside, lambda x: x.rack)]
        return node(region, total(inside), level(racks))

    def choose(children: Column, path: list[Column]) -> Column:
        """The child with the smallest draw."""
        drawn = F.transform(children, lambda c, i: F.struct(draw(key, [*path, c["id"]], c["weight"], seed).alias("draw"), c["id"].alias("id"), i.alias("i")))
        return F.element_at(children, (F.array_min(drawn)["i"] + 1).cast("int"))

    # each level's choice is bound to a name, so that the next ones read it instead of computing it again
    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def at_region(region: Column) -> Column:
        return bound(choose(region["below"], [region["id"]]), lambda rack: at_rack(region, rack))

    def at_rack(region: Column, rack: Column) -> Column:
        return leaf(region["id"], rack["id"], choose(rack["below"], [region["id"], rack["id"]])["id"])

    def leaf(region: Column, rack: Column, shard: Column) -> Column:
        return F.struct(region.alias("region"), rack.alias("rack"), shard.alias("shard"))

    def arrival(at: Column, region: Column, place: Column) -> Column:
        return F.struct(at.alias("draw"), region.alias("id"), place.alias("place"))

    def number(i: int) -> Column:
        return F.lit(i).cast("long")

    def open_region(region: int, inside: list[Shard]) -> Column:
        """The arrival of a region with vacant places, its shard chosen."""
        first = draw(key, [number(region)], F.lit(float(total(inside))), seed)
        shards = [x for x in inside if not x.vacant]

        def waiting(at: Column) -> Column:
            waits = [arrival(at + draw(key, [number(region), number(x.rack), number(x.shard)], F.lit(float(x.weight)), seed + WAIT), number(region), leaf(number(region), number(x.rack), number(x.shard))) for x in shards]
            return F.array_min(F.array(*waits))

        def settled(at: Column) -> Column:
            taken = bound(region_node(region, inside), at_region)
            return bound(taken, lambda to: F.when(to["shard"].isin([x.shard for x in shards]), arrival(at, number(region), to)).otherwise(waiting(at)))

        return bound(first, settled)

    regions = [(i, inside) for i, inside in grouped(tree, lambda x: x.region) if any(not x.vacant for x in inside)]
    whole = [(i, inside) for i, inside in regions if all(not x.vacant for x in inside)]
    arrivals = [open_region(i, inside) for i, inside in regions if any(x.vacant for x in inside)]
    if not whole:
        return F.array_min(F.array(*arrivals))["place"]
    root = level([region_node(i, inside) for i, inside in whole])
    if not arrivals:
        return bound(choose(root, []), at_region)

    def at_root(best: Column) -> Column:
        reached = arrival(draw(key, [best["id"]], best["weight"], seed), best["id"], at_region(best))
        return F.array_min(F.array(reached, *arrivals))["place"]

    return bound(choose(root, []), at_root)


def shard_rows(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 7, weights: dict[int, float] | None = None, blocks: int | None = None) -> DataFrame:
    """df's columns with size, text_crc32, law, region, rack, shard, slot and grown_shard (the shard after one more is added).

    size is the text's UTF-8 bytes plus 8.  slot numbers a shard's rows from 0 without gaps, in `blocks` blocks of hashed
    keys and texts whose sizes then shift the numbers, so no task holds a whole shard; by default a block has about
    BLOCK_ROWS rows whatever the table's size.  A null key draws like any other value; a null text has size 8 and the
    checksum of the empty text; repeated rows stay as often as they came, and which of them has the smaller slot makes
    no difference.  A long text is only measured.  An empty table gives an empty one.  Columns of df with the names of
    results are replaced, others are carried whatever their names.
    """
    tree = layout(shards, weights=weights)
    blocks = blocks or max(16, df.count() // (shards * BLOCK_ROWS) + 1)
    column, body = _column(key), F.coalesce(_column(text).cast("string"), F.lit(""))
    carried = [c for c in df.columns if c not in RESULTS]
    names = dict(zip(("block", "number", "before", "of"), (_unused(df, x) for x in ("block", "number", "before", "of")), strict=True))
    crc = F.crc32(body.cast("binary"))
    block = F.pmod(F.xxhash64(column, crc, F.lit(seed + 1)), F.lit(blocks)).cast("int")
    at = place(column, tree, seed)
    rows = df.select(
        *[_column(c) for c in carried],
        (F.octet_length(body) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        at.alias(names["of"]),
        place(column, with_one_more(tree), seed)["shard"].cast("int").alias("grown_shard"),
        block.alias(names["block"]),
    )
    rows = rows.select("*", *[F.col(names["of"])[c].cast("int").alias(c) for c in ("region", "rack", "shard")]).drop(names["of"])
    sizes = df.select(at["shard"].cast("int").alias("shard"), block.alias(names["block"])).groupBy("shard", names["block"]).count()
    # a row for each block; its rows are already together when they are joined with it
    shift = sizes.select("shard", names["block"], F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy(names["block"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(names["before"]))
    numbered = rows.withColumn(names["number"], F.row_number().over(W.partitionBy("shard", names["block"]).orderBy(_column(key) if key in carried else F.lit(0), "text_crc32", "size")))
    placed = numbered.join(shift, ["shard", names["block"]])
    return placed.select(*[_column(c) for c in carried], "size", "text_crc32", "law", "region", "rack", "shard", (F.col(names["before"]) + F.col(names["number"]) - 1).cast("long").alias("slot"), "grown_shard")


RESULTS = ("size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def _unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; files hold one shard each."""
    placed.repartition("shard", F.pmod(F.col("slot"), F.lit(16))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
