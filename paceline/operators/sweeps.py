"""All thresholds of a linker at once: the components under each come from one minimum spanning forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import _heaviest_totals, _kept, components


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): the minimum spanning forest of ``edges`` (a, b, w), by Borůvka rounds; ties go by (a, b).

    In each round every tree takes its shortest edge to another one, and trees that meet become
    one; of the edges between two trees only the shortest stays.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    e = _kept(e.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.struct("w", "a", "b").alias("e")))
    taken = []
    while not e.isEmpty():
        ends = e.select(F.col("ta").alias("t"), "e", "ta", "tb").unionByName(e.select(F.col("tb").alias("t"), "e", "ta", "tb"))
        least = _kept(ends.groupBy("t").agg(F.min(F.struct("e", "ta", "tb")).alias("m")).select("m.*").distinct())
        taken.append(least.select("e.a", "e.b", "e.w"))
        tree = components(least.select(F.col("ta").alias("a"), F.col("tb").alias("b")))
        a, b = tree.toDF("ta", "na"), tree.toDF("tb", "nb")
        e = e.join(a, "ta").join(b, "tb").where("na <> nb")
        e = _kept(e.groupBy(F.least("na", "nb").alias("ta"), F.greatest("na", "nb").alias("tb")).agg(F.min("e").alias("e")))
    out = edges.select("a", "b", "w").limit(0)
    for one in taken:
        out = out.unionByName(one)
    return out


def _settings(thresholds: list[float]):
    return F.explode(F.array(*(F.struct(F.lit(k).alias("setting"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds)))).alias("s")


def linked_at(forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(setting, node, global_id): the component of each node that the edges up to a threshold link; the id is its smallest node.

    Other nodes stay alone.  The forest's edges up to a threshold have the components of all
    edges up to it, so no other edge is looked at again.
    """
    e = _kept(forest.select("a", "b", "w", _settings(thresholds)).where("w <= s.threshold").select("s.setting", "a", "b"))
    ends = e.select("setting", F.col("a").alias("node")).unionByName(e.select("setting", F.col("b").alias("node"))).distinct()
    key = lambda c: F.xxhash64("setting", c)
    of = components(e.select(key("a").alias("a"), key("b").alias("b")))
    named = ends.withColumn("key", key("node")).join(of.toDF("key", "component"), "key")
    first = named.groupBy("setting", "component").agg(F.min("node").alias("global_id"))
    return named.join(first, ["setting", "component"]).select("setting", "node", "global_id")


def threshold_scores(distances: DataFrame, hits: DataFrame, nodes: DataFrame, n_gt: DataFrame, n_pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """(setting, threshold, ids, idtp, idf1) of linking all pairs up to each threshold, best IDF1 first.

    distances: a, b, distance; hits: person_id, node, n (frames in which a node's boxes match a
    person); nodes: node; n_gt, n_pred: a row ``n`` each.  Hits of merged nodes add up, and each
    setting's one-to-one choice of persons and ids is made from them: the frames and the pairs
    are not gone through again.
    """
    at = _kept(linked_at(spanning_forest(distances.select("a", "b", F.col("distance").alias("w"))), thresholds))

    def merged(rows: DataFrame) -> DataFrame:
        r = rows.select("*", _settings(thresholds)).select(*rows.columns, "s.setting")
        return r.join(at, ["setting", "node"], "left").withColumn("global_id", F.coalesce("global_id", "node"))

    sums = merged(hits).groupBy("setting", "person_id", "global_id").agg(F.sum("n").alias("n"))
    idtp = _heaviest_totals(sums, ["setting"]).groupBy("setting").agg(F.sum("idtp").alias("idtp"))
    ids = merged(nodes.select("node").distinct()).groupBy("setting").agg(F.countDistinct("global_id").alias("ids"))
    each = ids.join(idtp, "setting", "left").join(F.broadcast(n_gt.select(F.col("n").alias("n_gt")))).join(F.broadcast(n_pred.select(F.col("n").alias("n_pred"))))
    steps = F.array(*(F.lit(float(t)) for t in thresholds))
    tp = F.coalesce("idtp", F.lit(0))
    idf1 = F.round(2 * tp / F.greatest(F.lit(1), F.col("n_gt") + F.col("n_pred")), 6)
    return each.select("setting", F.element_at(steps, F.col("setting") + 1).alias("threshold"), "ids", tp.alias("idtp"), idf1.alias("idf1")).orderBy(F.desc("idf1"), "setting")
