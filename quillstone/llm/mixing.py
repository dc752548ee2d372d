"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import own_names, written

WORD = r"[^\x20\x09-\x0D]+"
#: Word masses (probability times size) are integers in this part of a word, so that transfers lose nothing.
PART_BITS = 20
#: Units of one fold; 1 << FAN_BITS blocks of a level meet in one of the next.
BLOCK, FAN_BITS = 64, 6
#: Documents of over one LARGE-th of a source's words are rounded first, so that the last open unit is a small one.
LARGE = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target): the total, shared by weight; no target beyond ``cap`` times its source's size.

    Sources by code point, null last, take the weights in turn. What a cap cuts off is shared again by weight until no
    target is above its cap: the level at which capped and uncapped targets add up to the total, found with running sums.
    One row a source passes through one window; the mix is configured by source, so their number is small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.lit(cap) * F.col("source_size"))
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(everything))  # the first that fits: capping one more only lowers it
    target = F.least(F.col("limit"), F.col("level") * F.col("w"))
    return per.select("source", "source_size", F.coalesce(target, F.col("limit")).alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _fold(units: Column, seed: int) -> Column:
    """Pair the carried unit with the next one and transfer word mass at random until one of the two has none or is full.

    The transfer goes either way with the odds that leave both expectations as they are, and what one unit loses the other
    gains, so a source's expected words stay exactly what they were until its last unit.
    """

    def step(state: Column, unit: Column) -> Column:
        cur, done = state["cur"], state["done"]
        a, b = cur["mass"], unit["mass"]
        full_a, full_b = F.shiftleft(cur["size"], PART_BITS), F.shiftleft(unit["size"], PART_BITS)
        up, down = F.least(full_a - a, b), F.least(a, full_b - b)
        rises = _uniform(cur["h"], unit["h"], F.lit(seed)) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        first, second = cur.withField("mass", a + moved), unit.withField("mass", b - moved)
        open_first = (a + moved > 0) & (a + moved < full_a)
        keeps, leaves = F.when(open_first, first).otherwise(second), F.when(open_first, second).otherwise(first)
        return F.struct(keeps.alias("cur"), F.concat(done, F.array(leaves)).alias("done"))

    start = F.struct(units[0].alias("cur"), F.filter(units, lambda x: F.lit(False)).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def pivotal_copies(units: DataFrame, seed: int) -> DataFrame:
    """(source, unit, size, extra): 0 or 1 for each unit (source, unit, size, mass), whose words add up to the mass of all.

    Level 0 groups a source's units into blocks of about BLOCK by hash; a fold, large units first, settles all but one unit
    of a block, a small one as a rule, whose residual mass meets those of 2**FAN_BITS blocks on the next level: a reduction
    tree whose levels shrink by BLOCK. No block grows with the data, however hot a source.
    """
    units = written(
        units.select("source", "unit", "size", "mass", F.xxhash64("source", "unit", F.lit(seed)).alias("h")), "units"
    )
    bits = max(0, math.ceil(math.log2(max(1, units.count()) / BLOCK)))
    full = F.shiftleft("size", PART_BITS)
    settled, current = [], units
    for b in [*range(bits, 0, -FAN_BITS), 0]:
        packed = F.sort_array(F.collect_list(F.struct("size", "h", "unit", "source", "mass")), asc=False)
        level = written(current.groupBy("source", F.col("h").bitwiseAND(F.lit((1 << b) - 1)).alias("block")).agg(packed.alias("units")).select(_fold(F.col("units"), seed).alias("s")), "level")
        settled.append(level.select(F.explode("s.done").alias("u")).select("u.*").select("source", "unit", "size", (F.col("mass") >= full).cast("int").alias("extra")))
        current = level.select("s.cur.*")
    last = 2 * F.col("mass") >= full  # one unit a source: rounded, so that the source misses by half a document at most
    settled.append(current.select("source", "unit", "size", last.cast("int").alias("extra")))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def _evened(extra: DataFrame, due: DataFrame) -> DataFrame:
    """``extra`` with few units changed so that each source's words come closest to what is ``due`` (source, words).

    A source's last open unit was rounded, and may be a large one. Of its units of each power of two of size one without and
    one with an extra copy are candidates, chosen by hash; from large to small, one is changed where that brings the words
    nearer. What is left is about half the smallest unit; a source has at most two candidates a power, whatever its size.
    """
    short = extra.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("got"))
    short = short.join(due, short["source"].eqNullSafe(due["source"])).select(due["source"], (F.col("words") - F.col("got")).alias("rest"))
    one = F.min(F.struct(F.xxhash64("unit"), F.col("unit"), F.col("size")))
    each = extra.groupBy("source", F.length(F.bin("size")).alias("power"), "extra").agg(one.alias("u"))
    listed = each.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("power", "extra", "u.size", "u.unit")), asc=False).alias("units"))
    listed = listed.join(short.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))

    def step(state: Column, u: Column) -> Column:
        words = F.when(u["extra"] == 0, u["size"]).otherwise(-u["size"]).cast("double")
        nearer = F.abs(state["rest"] - words) < F.abs(state["rest"])
        changed = F.concat(state["changed"], F.array(u["unit"]))
        return F.struct(F.when(nearer, state["rest"] - words).otherwise(state["rest"]).alias("rest"), F.when(nearer, changed).otherwise(state["changed"]).alias("changed"))

    start = F.struct(F.col("rest"), F.array().cast("array<bigint>").alias("changed"))
    changed = listed.select("source", F.explode(F.aggregate("units", start, step, lambda x: x["changed"])).alias("unit"))
    changed = changed.select(F.col("source").alias("__s"), F.col("unit").alias("__u"))
    found = extra.join(changed, F.col("source").eqNullSafe(F.col("__s")) & (F.col("unit") == F.col("__u")), "left")
    return found.select("source", "unit", F.when(F.col("__u").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra")).alias("extra"))


@own_names
def mix_sources(df: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` to the rows of a table with doc_id, text and source.

    Every document of a source is due target / source_size copies: the whole part for sure, the fraction by pivotal
    dependent rounding, a source's few large documents before the others, after which few documents are changed where that brings a source's words nearer to its target, and no
    document has more than ceil(cap) copies. The draws are hashes of ids, texts and ``seed``: reruns agree on any cluster.

    Edge cases: null text and texts without words have size 0 and get the whole part only; a null source is a source (last in
    order); rows without doc_id are told apart by their texts; rows repeating doc_id and text within a source share one draw;
    sources without words have target 0; an empty table gives an empty one; columns named like a result are replaced, others
    pass through.
    """
    keep = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    unit = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    sized = df.select(*keep, word_count(F.col("text")).alias("size"), unit.alias("__unit"))
    narrow = written(sized.select("source", F.col("__unit").alias("unit"), "size"), "sizes")
    targets = written(source_targets(narrow, weights, cap), "targets")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by_source = targets.select(F.col("source").alias("__source"), "source_size", "target", F.floor(due).cast("int").alias("__whole"), due.alias("__due"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    fraction = F.col("__due") - F.col("__whole")
    units = narrow.where("size > 0").groupBy("source", "unit").agg(F.sum("size").alias("size"))
    mass = lambda share: F.floor(share * F.col("size") * (1 << PART_BITS)).cast("long").alias("mass")
    units = units.join(by_source, same).select("source", "unit", "size", "source_size", fraction.alias("share"), (F.col("size") * LARGE > F.col("source_size")).alias("large"))
    units = written(units, "shares")
    first = written(pivotal_copies(units.where("large").select("source", "unit", "size", mass(F.col("share"))), seed), "large")
    taken = first.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("words"))
    rest = units.groupBy("source").agg(F.sum(F.expr("if(large, 0, size)")).alias("rest"), F.max(F.col("share") * F.col("source_size")).alias("all"))
    rest = rest.join(taken.select(F.col("source").alias("s"), "words"), F.col("source").eqNullSafe(F.col("s")), "left")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("all") - F.coalesce(F.col("words"), F.lit(0))) / F.col("rest")))
    rest = rest.where("rest > 0").select(F.col("source").alias("s"), share.alias("left"))
    small = units.where("not large").join(rest, F.col("source").eqNullSafe(F.col("s"))).select("source", "unit", "size", mass(F.col("left")))
    extra = written(first.unionByName(pivotal_copies(small, seed)), "extra")
    # a source that is due whole copies only stays as it is, to the last bit
    words = F.when(fraction * F.col("source_size") >= 0.5, fraction * F.col("source_size"))
    extra = _evened(extra, by_source.select(F.col("__source").alias("source"), words.alias("words")).where("words IS NOT NULL"))
    extra = extra.select(F.col("source").alias("__unit_source"), F.col("unit").alias("__unit_of"), F.col("extra").alias("__extra"))
    out = sized.join(by_source, same)
    out = out.join(extra, F.col("source").eqNullSafe(F.col("__unit_source")) & (F.col("__unit") == F.col("__unit_of")), "left")
    copies = F.col("__whole") + F.when(F.col("size") > 0, F.coalesce(F.col("__extra"), F.lit(0))).otherwise(F.lit(0))
    return out.select(*keep, "size", "source_size", "target", copies.cast("int").alias("copies"))
