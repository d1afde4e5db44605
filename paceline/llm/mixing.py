"""Mixing sources to target weights, with DataFrame functions alone.

The words of each source form one sequence (documents in the order of the MD5 of
their id) that is cut into blocks of ``block`` words, shorter where a source has
fewer than ``least_blocks`` of those, so that targets are met closely.

Each output shard draws the source of each of its slots from a hash of (shard, slot),
at the sources' shares of all slots: its source counts are a multinomial draw.  The
draws of a source, in the order of shards, are numbered and sent through a
pseudorandom permutation.  Numbers within the source's slots stand; what a source has
drawn too often (about the square root of its slots) is spread over the shards by the
permutation, and goes to the sources that were drawn too seldom.  So totals hold
exactly: a source meets its target and a block never exceeds ``passes`` uses.
A slot's number gives the pass over its source and, by one more permutation for each
(source, pass), the block; blocks are joined to the slots by that index.

Permutations are Feistel networks over two factors of just above n, walked until they
fall below n: bijections for every n, at the cost of arithmetic.  Counts before a
shard and words before a document are prefix sums in two or three steps, so no source
meets in one task.  Only the table of sources (a row for each) is ordered as a whole.

Defined results: a null source is a source of its own, last in order; null or empty
texts have size 0 and take nothing; repeated rows are documents of their own; columns
of the input may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stash, unused

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)  # of the sources in order, repeated
    percent: int = 150  # of all words, the size of the mix
    passes: int = 2  # a source gives at most this many times its words
    block: int = 256  # words, at most
    least_blocks: int = 512  # a source has that many blocks, or blocks of one word
    shard_slots: int = 1024  # blocks of an output shard
    task_slots: int = 1 << 20  # slots that one task makes, at most about
    seed: int = 5


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    """Words of each text: the ends of runs outside the white space set, null 0."""
    return F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, p: Mix) -> DataFrame:
    """``by_source`` (source, source_size) with weight and target.

    The water level: with sources by ascending cap / weight, the first whose share of
    what the earlier ones leave is within its cap fixes the level for all later ones.
    The windows hold a row for each source, in one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (F.col("rank") % len(p.weights) + 1).cast("int"))
    cap = F.col("source_size") * float(p.passes)
    s = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * p.percent / 100.0
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    whole = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole))
    return s.withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight")))


def permuted(x: Column, n: Column, *key: Column, rounds: int = 6, walk: int = 24) -> Column:
    """A bijection of 0 .. n - 1 for each ``key``, at ``x``.

    A Feistel network over pairs (l, r) with l < a, r < b, a = ceil(sqrt(n)) and
    b = ceil(n / a) permutes a * b >= n numbers; it is applied again until the result is
    below n.  Fewer than a numbers lie above, so ``walk`` steps always do for n < 256, and
    miss with a chance below 16 ** -walk for larger ones.
    """

    def within(t: Column) -> Column:
        a, b = t["a"], t["b"]

        def once(x: Column) -> Column:
            start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))

            def step(s: Column, i: Column) -> Column:
                moved = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, *key), t["m"]), F.when(i % 2 == 0, a).otherwise(b))
                return F.struct(s["r"].alias("l"), moved.alias("r"))

            ends = F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, step)
            return F.transform(F.array(ends), lambda s: s["r"] * a + s["l"])[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(t["x"]), lambda y, _: F.when(y < t["n"], y).otherwise(once(y)))

    # Arrays of one element name what is used more than once.
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    one = F.transform(F.array(F.struct(x.alias("x"), n.alias("n"), side.alias("a"))), lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), s["a"].alias("a"), F.ceil(s["n"] / s["a"]).cast("long").alias("b")))
    one = F.transform(one, lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), s["a"].alias("a"), s["b"].alias("b"), (s["a"] * s["b"]).alias("m")))
    return F.transform(one, within)[0]


def _ahead(size: str, order: str, *by: str) -> Column:
    """Sum of ``size`` over the rows of the group before this one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0))


def plan(docs: DataFrame, text_col: str, id_col: str, source_col: str, p: Mix) -> tuple[DataFrame, DataFrame]:
    """(documents with their word ranges, sources with targets, block lengths and slots)."""
    h = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    key = F.md5(F.coalesce(docs[id_col].cast("string"), h.cast("string")))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), sizes(docs, text_col).alias("size"), h.alias("h"), key.alias("k"))
    rows = rows.withColumn("bin", F.conv(F.substring("k", 1, 4), 16, 10).cast("int"))
    rows = stash(rows, "sizes")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).withColumn("upper", F.shiftright("bin", 8))
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), p)
    sources = sources.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(p.block), F.floor(F.col("source_size") / p.least_blocks))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long"))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))), F.col("blocks") * p.passes).cast("long")
    sources = stash(sources.select("source", "source_size", "target", "rank", "length", "blocks", slots.alias("slots")), "sources")
    upper = bins.groupBy("source", "upper").agg(F.sum("bin_size").alias("upper_size"))
    upper = upper.select("source", "upper", _ahead("upper_size", "upper", "source").alias("upper_start"))
    bins = bins.select("source", "upper", "bin", _ahead("bin_size", "bin", "source", "upper").alias("within"))
    bins = bins.alias("b").join(upper.alias("u"), F.col("b.source").eqNullSafe(F.col("u.source")) & (F.col("b.upper") == F.col("u.upper")))
    bins = bins.select("b.source", "bin", (F.col("upper_start") + F.col("within")).alias("bin_start"))
    inside = Window.partitionBy("source", "bin").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).alias("r")
    rows = rows.join(bins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
    end = F.col("bin_start") + F.col("upto")
    rows = rows.select("doc_id", F.col("r.source").alias("source"), "size", "h", (end - F.col("size")).alias("start"), end.alias("end"))
    return rows, sources


CELLS = 4096


def _draws(spark: SparkSession, sources: DataFrame, all_slots: int, p: Mix) -> DataFrame:
    """(shard, slot, rank, blocks, slots, j): the source that each output slot draws, and the number of that draw.

    j counts the draws of a source from shard to shard.  A drawn number in 0 .. all_slots - 1
    finds its source by the cells of that range that the source's slots touch.
    """
    s = sources.where("slots > 0").withColumn("last", F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select("rank", "blocks", "slots", (F.col("last") - F.col("slots")).alias("first"), "last")
    cell = lambda x: F.floor(x.cast("decimal(38,0)") * CELLS / all_slots).cast("long")
    s = s.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("last") - 1))))

    shards = -(-all_slots // p.shard_slots)
    tasks = max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-all_slots // p.task_slots))
    slots = spark.range(shards).select(F.col("id").alias("shard")).repartition(tasks, "shard")
    inside = F.least(F.lit(p.shard_slots), all_slots - F.col("shard") * p.shard_slots) - 1
    slots = slots.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), inside)).alias("slot"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64(F.lit(p.seed), F.lit("draw"), "shard", "slot"), F.lit(all_slots))).withColumn("cell", cell(F.col("u")))
    drawn = slots.join(s, "cell").where("first <= u and u < last").select("shard", "slot", "rank", "blocks", "slots")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")) - 1)
    counts = drawn.groupBy("shard", "rank").agg(F.count("*").alias("k")).withColumn("upper", F.floor(F.col("shard") / 1024))
    upper = counts.groupBy("rank", "upper").agg(F.sum("k").alias("k"))
    upper = upper.select("rank", "upper", _ahead("k", "upper", "rank").alias("before_upper"))
    counts = counts.select("shard", "rank", "upper", _ahead("k", "shard", "rank", "upper").alias("before"))
    counts = counts.join(upper, ["rank", "upper"]).select("shard", "rank", (F.col("before") + F.col("before_upper")).alias("before"))
    return drawn.join(counts, ["shard", "rank"]).withColumn("j", F.col("before") + F.col("nth")).drop("before", "nth")


def slot_blocks(sources: DataFrame, p: Mix) -> DataFrame:
    """(shard, slot, rank, turn, block): the block of its source that each output slot takes, in which pass over it.

    Statistics of the few source rows say nothing of the slots: joins with slots carry a
    merge hint, or they would be broadcast.
    """
    spark = sources.sparkSession
    all_slots = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    if not all_slots:
        return spark.createDataFrame([], "shard long, slot long, rank int, turn long, block long")
    drawn = stash(_draws(spark, sources, all_slots, p), "draws")
    took = drawn.groupBy("rank").agg(F.count("*").alias("drawn"))
    s = sources.where("slots > 0").select("rank", "blocks", "slots").join(took, "rank", "left").fillna(0, ["drawn"])
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    s = s.withColumn("over_to", F.sum(over).over(up)).withColumn("under_to", F.sum(under).over(up)).withColumn("over_from", F.col("over_to") - over).withColumn("under_from", F.col("under_to") - under)
    s = stash(s, "drawn")

    own = drawn.join(s.select("rank", "drawn", "over_from"), "rank").withColumn("i", permuted(F.col("j"), F.col("drawn"), F.lit(p.seed), F.col("rank"), F.lit(-1)))
    # What a source has drawn too often goes to those drawn too seldom, by their places in line.
    wide = 4096
    spare = F.when(F.col("i") >= F.col("slots"), F.col("over_from") + F.col("i") - F.col("slots"))
    own = own.withColumn("at", spare).withColumn("part", F.floor(F.col("at") / wide)).alias("o")
    short = s.where("under_to > under_from").select("rank", "blocks", "drawn", "under_from", "under_to")
    short = short.withColumn("part", F.explode(F.sequence(F.floor(F.col("under_from") / wide), F.floor((F.col("under_to") - 1) / wide)))).alias("s")
    both = own.join(short, (F.col("o.part") == F.col("s.part")) & (F.col("s.under_from") <= F.col("o.at")) & (F.col("o.at") < F.col("s.under_to")), "left")
    i = F.coalesce(F.col("s.drawn") + F.col("o.at") - F.col("s.under_from"), F.col("o.i"))
    taken = both.select("shard", "slot", F.coalesce("s.rank", "o.rank").alias("rank"), F.coalesce("s.blocks", "o.blocks").alias("blocks"), i.alias("i"))
    taken = taken.withColumn("turn", F.floor(F.col("i") / F.col("blocks")))
    block = permuted(F.col("i") % F.col("blocks"), F.col("blocks"), F.lit(p.seed), F.col("rank"), F.col("turn"))
    return taken.select("shard", "slot", "rank", "turn", block.alias("block"))


def _pieces(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, one row for each block that holds some of them."""
    found = rows.alias("r").join(sources.select("source", "rank", "length").alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).where("size > 0")
    n = F.col("length")
    found = found.select("r.*", "rank", "length", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("end") - 1) / n))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * n)
    hi = F.least(F.col("end"), (F.col("block") + 1) * n)
    return found.withColumn("from_word", lo - F.col("start")).withColumn("words", hi - lo)


def _mixed(rows: DataFrame, sources: DataFrame, p: Mix) -> DataFrame:
    """(shard, slot, turn) beside each piece of the block that stands there."""
    return _pieces(rows, sources).join(slot_blocks(sources, p).hint("merge"), ["rank", "block"])


def mix_digest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", params: Mix = Mix()) -> DataFrame:
    """id, size, source_size, target and taken (words that the shards take, repeats counted) of every row."""
    rows, sources = plan(docs, text_col, id_col, source_col, params)
    taken = _mixed(rows, sources, params).groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    full = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", "start", "rank", "source_size", "target")
    full = full.join(taken, (full["rank"] == taken["rank"]) & (full["start"] == taken["start"]) & (full["size"] > 0), "left")
    return full.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_pieces(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", params: Mix = Mix()) -> DataFrame:
    """The mix itself: shard, slot, and the id, source and word range of each piece of the block there."""
    rows, sources = plan(docs, text_col, id_col, source_col, params)
    out = _mixed(rows, sources, params)
    return out.select("shard", "slot", F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "from_word", "words")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", params: Mix = Mix()) -> DataFrame:
    """``docs`` as the shards take them: the columns stay, and the texts are the words that each pass takes.

    A document that both passes take gives two rows; in each it has the words of those of
    its blocks that the shards take in that pass.  A document of which nothing is taken
    gives no row.
    """
    rows, sources = plan(docs, text_col, id_col, source_col, params)
    taken = _mixed(rows, sources, params)
    taken = taken.groupBy("rank", "start", "turn", "doc_id", "source", "size", "h").agg(F.sort_array(F.collect_list(F.struct(F.col("from_word").cast("int").alias("from_word"), F.col("words").cast("int").alias("words")))).alias("spans"))
    # Equal rows are told apart by their places alone, so each meets one range.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "h", "turn").orderBy("start"))
    taken = taken.withColumn("nth", nth).select("doc_id", "source", "h", "size", "nth", "turn", "spans").alias("t")
    h, n = unused(docs.columns, "_h"), unused(docs.columns, "_nth")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    keyed = keyed.withColumn(n, F.row_number().over(Window.partitionBy(docs[id_col], docs[source_col], F.col(h)).orderBy(F.lit(0)))).alias("d")
    of = lambda c: F.col(f"d.`{c}`")
    same = of(id_col).eqNullSafe(F.col("t.doc_id")) & of(source_col).eqNullSafe(F.col("t.source")) & (of(h) == F.col("t.h")) & (of(n) == F.col("t.nth"))
    out = keyed.join(taken, same)
    words = F.regexp_extract_all(of(text_col), F.lit(WORD), F.lit(0))
    whole = F.aggregate("t.spans", F.lit(0), lambda n, x: n + x["words"]) == F.col("t.size")
    some = F.array_join(F.flatten(F.transform("t.spans", lambda x: F.slice(words, x["from_word"] + 1, x["words"]))), " ")
    text = F.when(whole, of(text_col)).otherwise(some)
    return out.select(*[text.alias(c) if c == text_col else of(c) for c in docs.columns])
