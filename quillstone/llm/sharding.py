"""Sharding by a k-d tree over metadata with distributed weighted medians, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import if_small, written

#: A place on a dimension: VALUE_BITS of the value, then HASH_BITS of the text's hash to part equal values.
VALUE_BITS, HASH_BITS = 20, 40
#: Bits settled by one histogram pass: VALUE_BITS + HASH_BITS is a multiple.
BIN_BITS = 15
#: A median is fine enough when its bin holds at most this share of the node's weight.
TOLERANCE = 1e-5
#: Rows that one sort for slots handles, about.
SLOT_ROWS = 20_000


def _places(units: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Columns k0, k1, ...: each dimension's value on its global range in VALUE_BITS bits, with the hash below."""
    units = units.withColumns({f"v{i}": F.coalesce(d.cast("double"), F.lit(0.0)) for i, d in enumerate(dims.values())})
    bounds = units.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(dims)) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    tie = F.shiftrightunsigned(F.xxhash64("digest"), 64 - HASH_BITS)
    for i in range(len(dims)):
        lo, hi = bounds[f"lo{i}"] or 0.0, bounds[f"hi{i}"] or 0.0
        scaled = F.floor((F.col(f"v{i}") - lo) / (hi - lo) * ((1 << VALUE_BITS) - 1)) if hi > lo else F.lit(0)
        units = units.withColumn(f"k{i}", scaled.cast("long") * (1 << HASH_BITS) + tie)
    return units.drop(*[f"v{i}" for i in range(len(dims))])


def _key(n_dims: int) -> Column:
    """A unit's place on its node's dimension ``d``."""
    return F.element_at(F.array(*[F.col(f"k{i}") for i in range(n_dims)]), F.col("d") + 1)


def _cuts(units: DataFrame, nodes: DataFrame, n_dims: int) -> DataFrame:
    """(node, d, place, k, first) for each of the nodes (node, k shards of which the first is ``first``) that has units: its widest
    dimension and the place below which the left half's share of the weight lies.

    Histograms are refined BIN_BITS at a time, of all nodes at once; what is known of a node is a row of a table, as there
    may be many nodes.
    """
    inside = units.join(if_small(nodes), "node")
    spread = [F.struct(F.shiftright(F.max(f"k{i}") - F.min(f"k{i}"), HASH_BITS).alias("s"), F.lit(-i).alias("i")) for i in range(n_dims)]
    spans = inside.groupBy("node", "k", "first").agg(F.sum("weight").alias("w"), F.greatest(*spread).alias("widest"))
    goal = F.col("w") * F.floor(F.col("k") / 2) / F.col("k")
    state = spans.select("node", "k", "first", "w", (-F.col("widest.i")).alias("d"), goal.alias("goal"), F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("done"))
    state = written(state, "spans")
    for shift in range(VALUE_BITS + HASH_BITS - BIN_BITS, -1, -BIN_BITS):
        open_nodes = state.where("NOT done")
        if shift < VALUE_BITS + HASH_BITS - BIN_BITS and open_nodes.isEmpty():
            break
        rows = units.join(if_small(open_nodes), "node").withColumn("at", _key(n_dims)).where(F.shiftright("at", shift + BIN_BITS) == F.col("place"))
        keep = ["node", "k", "first", "w", "d", "goal", "below"]
        bins = rows.groupBy(*keep, F.shiftright("at", shift).alias("bin")).agg(F.sum("weight").alias("in_bin"))
        upto = F.col("below") + F.sum("in_bin").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        one = F.struct("bin", "in_bin", "upto")
        picked = bins.withColumn("upto", upto).groupBy(*keep).agg(F.min(F.when(F.col("upto") > F.col("goal"), one)).alias("crossed"), F.max(one).alias("last"))
        picked = picked.select(*keep, F.coalesce("crossed", "last").alias("b")).select(*keep, "b.*")
        before = F.col("upto") - F.col("in_bin")
        done = (F.col("in_bin") <= TOLERANCE * F.col("w")) | F.lit(shift == 0)
        after = (F.col("upto") - F.col("goal") < F.col("goal") - before).cast("long")  # the nearer side of the last bin
        place = F.when(done, F.shiftleft(F.col("bin") + after, shift)).otherwise(F.col("bin"))
        picked = picked.select("node", "k", "first", "w", "d", "goal", before.alias("below"), place.alias("place"), done.alias("done"))
        state = written(state.where("done").unionByName(picked), "cuts")
    return state.select("node", "d", "place", "k", "first")


def kd_shards(units: DataFrame, dims: dict[str, Column], n_shards: int) -> DataFrame:
    """(digest, shard) for units (digest, weight, ...): a tree of weighted cuts, each along its node's widest dimension.

    A node with k shards is cut where its left part holds k // 2 shards' share of its weight. Node n's halves are 2n and
    2n + 1. Nodes and histograms are tables, broadcast while small; nothing of them reaches the driver, and a level's plan is
    the same for any number of shards.
    """
    spark = units.sparkSession
    units = written(_places(units, dims).withColumn("node", F.lit(1).cast("long")), "places")
    nodes = written(spark.createDataFrame([(1, n_shards, 0)], "node long, k int, first int"), "nodes")
    for _ in range(max(0, n_shards - 1).bit_length()):
        cuts = if_small(_cuts(units, nodes.where("k > 1"), len(dims)))
        at = units.join(cuts.drop("k", "first"), "node", "left")
        side = F.when(F.col("d").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_key(len(dims)) >= F.col("place")).cast("long"))
        units = written(at.withColumn("node", side).drop("d", "place"), "nodes-of-units")
        half = F.floor(F.col("k") / 2).cast("int")
        left = F.struct((2 * F.col("node")).alias("node"), half.alias("k"), F.col("first"))
        right = F.struct((2 * F.col("node") + 1).alias("node"), (F.col("k") - half).alias("k"), (F.col("first") + half).alias("first"))
        parts = nodes.where("k > 1").select(F.explode(F.array(left, right)).alias("n")).select("n.*")
        nodes = written(nodes.where("k = 1").unionByName(parts), "nodes")
    return units.join(if_small(nodes), "node").select("digest", F.col("first").alias("shard"))


def shard_documents(df: DataFrame, *, target_bytes: int | None = None, n_shards: int | None = None) -> DataFrame:
    """Put the rows of a table with doc_id, text, lang and source into shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law (``bytes``), shard, slot (gapless from 0 in its
    shard, by hash range and doc_id) and grown_shard (null). Equal texts share a shard: the tree is built over distinct
    texts weighted by their rows' bytes, with length, source and language as dimensions. The shard count is given, or the
    total over ``target_bytes``.

    Edge cases: a null text has size 1 and forms one group; null doc_id, lang and source are values like others; repeated
    rows get slots of their own; an empty table gives an empty result; other columns are ignored.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    code = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) / float(1 << 32)
    rows = written(
        df.select(
            "doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("digest"), code("lang").alias("c_lang"), code("source").alias("c_source"),
        ),
        "rows",
    )
    units = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("c_lang").alias("c_lang"), F.min("c_source").alias("c_source"))
    dims = {"length": F.log2(F.col("size")), "source": F.col("c_source"), "lang": F.col("c_lang")}
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    by_text = written(kd_shards(units, dims, n_shards), "shards")
    placed = rows.select("doc_id", "size", "text_crc32", "digest").join(by_text, "digest")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, count // SLOT_ROWS))))
    placed = written(placed, "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "digest")
    placed = placed.withColumn("at", F.row_number().over(inside)).join(starts.drop("n"), ["shard", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
