"""Jaccard join of shingle sets by token-combination prefixes.

Tokens are shingles.  Two sets link if 100 * |A and B| >= percent * |A or B|, so at
most u = n - ceil(percent * n / 100) tokens of either can be missing from the other.

* A first pass orders tokens by hash.  Of the 2 u + 1 first tokens of a set, u + 1 or
  more are among those of any partner (u of the smallest partner's size, to be exact),
  so a set that shares fewer of them with all others has no partner and leaves.
* The survivors' tokens are ordered by frequency, rarest first; a token that only one
  set has needs no index entry.  Frequent tokens are dealt to classes of which k tokens
  have to agree at once: one for rare tokens, pairs and triples for frequent ones.  A
  class with c tokens in a prefix covers c - k + 1 of them, and a prefix is extended
  until its classes cover u + 1 tokens.  By the pigeonhole principle two linked sets
  then share k tokens of one class in their prefixes, so the k-combinations of each
  class, and single rare tokens, find every link.
* Classes hold a few tokens of a prefix each, so the combinations of a set stay in
  proportion to its size; how many classes there are goes by bands of set sizes, and a
  set is listed in the band of its largest partner too.
* A sketch of 512 parity bits stands for each set: every token that only one of two sets has
  turns one bit over, so bits that differ are at most the differences, and candidates with
  more of them than a link allows are left out before their texts are fetched.
* Candidates are confirmed on full sets: each member with the smallest set of a key,
  then a pivot for keys whose members are still in different components.
* Last come pairs of unlike components.  A key of a rare token has few members.  Sets that
  meet at frequent tokens alone share no rare token at all, and all their rare tokens are
  missing from the other: that leaves for their frequent tokens a budget d of differences,
  most often a small one.  Then the combinations are as long as can be: frequent tokens are
  dealt to more than d classes, and of a linked pair all classes but d agree as a whole.
  So texts of one template that are just too far apart are not paired with one another.

Sets that are equal are one node from the start.  Defined results: a null or empty text
has no tokens and links with nothing; a text shorter than the shingle is one token;
rows with a null id take part in no link; rows that repeat an id are judged each by its
own text; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import NearDup, _confirmed, _shingle_rows, shingle_sets
from .shared import binary_list, column, components, stash
from .textkit import chunks, mix, signed


def class_levels() -> list[tuple[int, int, int]]:
    """(d, classes, together): what is asked of sets with d differences or fewer, for rising d.

    Of ``classes`` classes at most d differ, so classes - d agree, and so many are keyed together:
    three or two where d is small, else one.
    """
    few = [(0, 1, 1), *((d, d + 3, 3) for d in range(1, 5)), *((d, d + 2, 2) for d in range(5, 13))]
    return few + [(x - 1, x, 1) for k in range(3, 30) for x in (2**k * m // 4 for m in (5, 6, 7, 8)) if x > 13]


LEVELS = class_levels()


@dataclass(frozen=True)
class JaccardJoin:
    shingle: int = 3
    percent: int = 90  # links need 100 * |A and B| >= percent * |A or B|
    pairs_above: int = 16  # tokens of more sets than this are indexed by pairs
    triples_above: int = 256  # and of more sets than this by triples

    @property
    def near(self) -> NearDup:
        return NearDup(shingle=self.shingle, percent=self.percent)

    def needed(self, n: int) -> int:
        """Tokens that a set of n shares with a partner, at least."""
        return -(-self.percent * n // 100)

    def spare(self, n: int) -> int:
        return n - self.needed(n)

    def classes(self, band: int) -> tuple[int, int]:
        """How many classes of pairs and of triples sets of 2**band to 2**(band + 1) - 1 tokens get.

        About four tokens of a prefix go to a class of pairs and six to one of triples.
        None, if the smallest set of the band might not cover its prefix then.
        """
        low = max(1, self.needed(2**band))
        prefix = 3 * (self.spare(2**band) + 1) // 2
        pairs, triples = max(1, prefix // 4), max(1, prefix // 6)
        return (pairs, triples) if self.needed(low) > pairs + 2 * triples else (0, 0)


def _needed(p: JaccardJoin, n: str | Column) -> Column:
    return F.ceil(F.col(n) * p.percent / 100) if isinstance(n, str) else F.ceil(n * p.percent / 100)


_SIG = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *((f"s{k}", pa.int64()) for k in range(8)), ("low", pa.list_(pa.int64()))])
SKETCH = [f"s{k}" for k in range(8)]


def _signatures(p: JaccardJoin):
    """Size, fingerprint and the 2 u + 1 first tokens by hash of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = column(batch, "id"), column(batch, "th")
            for c in chunks(binary_list(batch, "text")):
                bound, h = shingle_sets(c, p.shingle)
                n = np.diff(bound)
                full = np.flatnonzero(n)
                prints = np.zeros((c.n_docs, 2), np.uint64)
                if len(full):
                    prints[full, 0] = np.add.reduceat(mix(h + np.uint64(1)), bound[full])
                    prints[full, 1] = np.add.reduceat(mix(h + np.uint64(2)), bound[full])
                token = mix(h + np.uint64(3))
                of_doc = np.repeat(np.arange(c.n_docs), n)
                sketch = np.zeros((c.n_docs, 8), np.uint64)
                np.bitwise_xor.at(sketch, (of_doc, (token >> np.uint64(6) & np.uint64(7)).astype(np.int64)), np.uint64(1) << (token & np.uint64(63)))
                spare = n - -(-p.percent * n // 100)
                first = np.arange(len(h)) - np.repeat(bound[:-1], n) <= np.repeat(2 * spare, n)
                ends = np.concatenate([[0], np.cumsum(np.minimum(n, 2 * spare + 1))]).astype(np.int32)
                low = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(h[first])))
                f1, f2 = (pa.array(signed(np.ascontiguousarray(prints[:, k]))) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n_docs), th.slice(c.first, c.n_docs), pa.array(n, pa.int64()), f1, f2, *(pa.array(signed(np.ascontiguousarray(sketch[:, k]))) for k in range(8)), low], schema=_SIG)

    return run


def _with_partners(nodes: DataFrame, p: JaccardJoin) -> DataFrame:
    """Ids of the nodes that share enough of their first tokens by hash with others."""
    large = F.col("n") * 100 >= (F.col("n") + 1) * p.percent  # smaller sets link with none that differs
    rows = nodes.where(large).select("id", F.explode("low").alias("h"))
    several = rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    shared = rows.join(several, "h").groupBy("id").agg(F.count("*").alias("shared")).join(nodes.select("id", "n"), "id")
    least = _needed(p, "n")  # the smallest partner's size
    return shared.where(F.col("shared") > least - _needed(p, least)).select("id")


def _keys(rows: DataFrame, p: JaccardJoin) -> DataFrame:
    """(key, frequent, id, n, common) for each token combination of a prefix.

    rows: id, n, h, k (sets that have the token, two or more), common (such tokens of the set).
    """
    top = 40
    dealt = [p.classes(b) for b in range(top)]
    pairs, triples = (F.element_at(F.array(*(F.lit(x[i]) for x in dealt)), F.col("band") + 1) for i in (0, 1))
    band = F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")  # exact: n + 1/2 is no power of two
    above = F.floor(F.log2(F.floor(F.col("n") * 100 / p.percent) + F.lit(0.5))).cast("int")
    rows = rows.withColumn("band", F.explode(F.sequence(band, above)))
    by = F.when((pairs == 0) | (F.col("k") <= p.pairs_above), 1).when(F.col("k") <= p.triples_above, 2).otherwise(3)
    rows = rows.withColumn("by", by)
    # Rare tokens are classes of their own, frequent ones are dealt by their hash.
    slot = F.pmod(F.xxhash64("h", F.lit(12)), F.when(F.col("by") == 2, pairs).otherwise(triples).cast("long"))
    rows = rows.withColumn("slot", F.when(F.col("by") > 1, slot))
    own = Window.partitionBy("id", "band").orderBy("k", "h")
    covers = F.when(F.col("by") == 1, 1).otherwise((F.row_number().over(Window.partitionBy("id", "band", "by", "slot").orderBy("k", "h")) >= F.col("by")).cast("int"))
    rows = rows.withColumn("covers", covers)
    before = F.sum("covers").over(own) - F.col("covers") + F.col("n") - F.col("common")  # tokens of this set alone come first
    rows = rows.withColumn("before", before).where(F.col("before") <= F.col("n") - _needed(p, "n"))
    rows = stash(rows.select("id", "n", "h", "k", "common", "band", "by", "slot"), "prefix")
    single = rows.where("by = 1").select(F.xxhash64("band", "h").alias("key"), (F.col("k") > p.pairs_above).alias("frequent"), "id", "n", "common")
    of_class = rows.where("by > 1").groupBy("id", "n", "common", "band", "by", "slot").agg(F.sort_array(F.collect_list("h")).alias("hs")).where(F.size("hs") >= F.col("by"))
    two = of_class.select("id", "n", "common", "band", "by", "hs", F.posexplode("hs").alias("i", "x")).where("i > 0")
    two = two.select("id", "n", "common", "band", "by", "hs", "x", F.posexplode(F.expr("slice(hs, 1, i)")).alias("j", "y"))
    pair = two.where("by = 2").select(F.xxhash64("band", "x", "y").alias("key"), F.lit(True).alias("frequent"), "id", "n", "common")
    three = two.where("by = 3 and j > 0").select("id", "n", "common", "band", "x", "y", F.explode(F.expr("slice(hs, 1, j)")).alias("z"))
    triple = three.select(F.xxhash64("band", "x", "y", "z").alias("key"), F.lit(True).alias("frequent"), "id", "n", "common")
    return single.unionByName(pair).unionByName(triple)


def _reach(p: JaccardJoin) -> Column:
    """Whether the sizes of two sets, and how many tokens of each can be common, allow a link."""
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * p.percent / (100 + p.percent))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent) & (F.least("common_a", "common_b") >= overlap)


def _within_sketch(p: JaccardJoin) -> Column:
    """Whether the sketches of sets a and b differ by no more bits than a link allows tokens."""
    bits = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in SKETCH), F.lit(0))
    return bits <= (F.col("n_a") + F.col("n_b")) * ((100 - p.percent) / (100 + p.percent)) + 1e-9


def _plausible(pairs: DataFrame, sketches: DataFrame, p: JaccardJoin) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow a link."""
    for t in "ab":
        pairs = pairs.join(sketches.select(F.col("id").alias(t), *(F.col(c).alias(f"{c}_{t}") for c in ("n", *SKETCH))), t)
    return pairs.where(_within_sketch(p)).select("a", "b")


def _unlike(member: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Pairs (a, b) of a key's members in unlike components; one side is outside the key's first component.

    member: key, id, component and what ``allowed`` asks of either side, as n_a, n_b and so on.
    """
    more = [c for c in member.columns if c not in (key, "id", "component")]
    low = member.groupBy(key).agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select(key, "first")
    rows = member.join(low, key)
    x, y = (rows.select(key, F.col("id").alias(f"id_{t}"), F.col("component").alias(f"of_{t}"), (F.col("component") == F.col("first")).alias(f"first_{t}"), *(F.col(c).alias(f"{c}_{t}") for c in more)) for t in "ab")
    pairs = x.join(y.where("not first_b"), key).where("of_a <> of_b").where("first_a or id_a < id_b").where(allowed)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


_CLASSES = pa.schema([("key", pa.int64()), ("level", pa.int32()), ("id", pa.int64()), ("budget", pa.float64()), ("n", pa.int64()), ("common", pa.int64()), ("component", pa.int64()), *((s, pa.int64()) for s in SKETCH)])


def _class_keys(h: np.ndarray, classes: int, together: int) -> np.ndarray:
    """A key for each choice of ``together`` classes of the tokens, of all that they hold."""
    total = np.zeros(classes, np.uint64)
    np.add.at(total, (mix(h ^ np.uint64(classes)) % np.uint64(classes)).astype(np.int64), mix(h + np.uint64(0x51)))
    total = mix(total + mix(np.arange(classes, dtype=np.uint64) + np.uint64(classes << 32)))
    chosen = np.array(list(itertools.combinations(range(classes), together))).T
    key = np.zeros(chosen.shape[1], np.uint64)
    for one in chosen:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + total[one])
    return key


def _whole_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a set's frequent tokens by classes, at every level that a partner may ask for (least to most differences)."""
    for batch in batches:
        names = ("id", "budget", "n", "component", "least", "most", *SKETCH)
        tokens = column(batch, "hs")
        for i, (node, budget, n, component, least, most, *sketch) in enumerate(zip(*(column(batch, c).to_pylist() for c in names), strict=True)):
            h = tokens[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            keys, level = [], []
            for d, classes, together in LEVELS:
                if d >= int(max(0.0, least) + 1e-9):
                    keys.append(_class_keys(h, classes, together))
                    level.append(np.full(len(keys[-1]), d, np.int32))
                    if d >= int(most + 1e-9):
                        break
            keys, level = np.concatenate(keys), np.concatenate(level)
            rest = [np.full(len(keys), x) for x in (node, budget, n, len(h), component, *sketch)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(level), *(pa.array(x, f.type) for x, f in zip(rest, list(_CLASSES)[2:], strict=True))], schema=_CLASSES)


def _by_whole_classes(member: DataFrame, texts: DataFrame, frequent: DataFrame, sketches: DataFrame, p: JaccardJoin) -> DataFrame:
    """Pairs of unlike components that meet at frequent tokens and share no rare one, by classes of frequent tokens that agree.

    A set of n tokens brings a budget of n * (100 - percent) / (100 + percent) differences less its
    rare tokens; two sets that link differ by the sum of their budgets or less.
    """
    sets = member.select("id", "n", "component").distinct()
    rows = texts.join(sets.select("id"), "id", "left_semi").mapInArrow(_shingle_rows(p.near), "id long, h long")
    held = rows.join(frequent, "h").groupBy("id").agg(F.sort_array(F.collect_list("h")).alias("hs")).join(sets, "id")
    held = held.withColumn("budget", F.col("n") * ((100 - p.percent) / (100 + p.percent)) - F.col("n") + F.size("hs"))
    held = stash(held, "held")
    # What the partners that a set meets at some key bring.
    met = member.select("key", "id").join(held.select("id", "budget"), "id")
    span = met.groupBy("key").agg(F.min("budget").alias("lo"), F.max("budget").alias("hi"))
    partners = met.join(span, "key").groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = held.join(partners, "id").select("*", (F.col("budget") + F.col("lo")).alias("least"), (F.col("budget") + F.col("hi")).alias("most")).where("most >= -1e-9").join(sketches.drop("n"), "id")
    listed = asked.select("id", "budget", "n", "component", "least", "most", "hs", *SKETCH).mapInArrow(_whole_classes, "key long, level int, id long, budget double, n long, common long, component long, " + ", ".join(f"{s} long" for s in SKETCH))
    listed = stash(listed, "classes")
    budget = F.col("budget_a") + F.col("budget_b") + 1e-9
    steps = F.array(*(F.lit(d) for d, _, _ in LEVELS))
    level = F.element_at(F.filter(steps, lambda d: d >= F.floor(budget)), 1)
    allowed = (budget >= 0) & (F.abs(F.col("common_a") - F.col("common_b")) <= budget) & _reach(p) & _within_sketch(p) & (F.col("level_a") == level)
    return _unlike(listed, "key", allowed)


def _by_pivot(member: DataFrame) -> DataFrame:
    """Every member of a mixed key with one of its first component, the same in most keys."""
    pivot = member.groupBy("key", "component").agg(F.min_by(F.struct("id", "n", "common"), F.xxhash64("id")).alias("p"))
    pivot = pivot.groupBy("key").agg(F.min_by("p", "component").alias("p"), F.min("component").alias("other"))
    pairs = member.join(pivot, "key").where("component <> other")
    first = F.col("id") < F.col("p.id")
    pairs = pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), *(F.when(first if t == "a" else ~first, F.col(c)).otherwise(F.col(f"p.{c}")).alias(f"{c}_{t}") for c in ("n", "common") for t in "ab"))
    return pairs.distinct()


def _links(texts: DataFrame, keys: DataFrame, frequent: DataFrame, sketches: DataFrame, p: JaccardJoin) -> DataFrame:
    """Confirmed links (a, b) whose components are those of all links."""
    low = keys.groupBy("key").agg(F.min(F.struct("id", "n", "common")).alias("p"))
    pairs = keys.join(low, "key").where("p.id < id").select(F.col("p.id").alias("a"), F.col("id").alias("b"), *(F.col(f"{q}{c}").alias(f"{c}_{t}") for c in ("n", "common") for t, q in (("a", "p."), ("b", ""))))
    pairs = _plausible(pairs.where(_reach(p)).select("a", "b").distinct(), sketches, p)
    pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    done = stash(pairs, "pairs")
    links = stash(_confirmed(done, texts, p.near), "links")
    for last in (False, True):
        label = components(links)
        member = keys.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        member = stash(member.join(mixed, "key"), "mixed")
        if last:
            rare = _plausible(_unlike(member.where("not frequent").drop("frequent"), "key", _reach(p)), sketches, p)
            pairs = rare.unionByName(_by_whole_classes(member.where("frequent"), texts, frequent, sketches, p)).distinct()
        else:
            pairs = _plausible(_by_pivot(member.drop("frequent")).where(_reach(p)).select("a", "b"), sketches, p)
        fresh = stash(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        links, done = _confirmed_links(fresh, links, texts, p, 2 if last else 0), done.unionByName(fresh)
    return links


def _confirmed_links(fresh: DataFrame, links: DataFrame, texts: DataFrame, p: JaccardJoin, rounds: int) -> DataFrame:
    """``links`` and those of the ``fresh`` pairs that link, as far as components ask for them.

    In each of the first ``rounds`` only one pair of a set is confirmed; pairs that are in one
    component then need no texts any more, which leaves few in large groups of near copies.
    """
    for _ in range(rounds):
        one = stash(fresh.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
        links = stash(links.unionByName(_confirmed(one, texts, p.near)), "links")
        label = stash(components(links), "labels")
        rest = fresh.join(one, ["a", "b"], "left_anti").join(label.toDF("a", "of_a"), "a", "left").join(label.toDF("b", "of_b"), "b", "left")
        fresh = stash(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "pairs")
    return stash(links.unionByName(_confirmed(fresh, texts, p.near)), "links")


def candidate_keys(texts: DataFrame, p: JaccardJoin) -> tuple[DataFrame, DataFrame]:
    """(key, frequent, id, n, common) of the combinations that two sets or more have, and frequent tokens (h). texts: id, text."""
    rows = texts.mapInArrow(_shingle_rows(p.near), "id long, h long")
    rows = stash(rows, "tokens")
    several = rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    of_id = rows.groupBy("id").agg(F.count("*").alias("n"))
    own = Window.partitionBy("id")
    rows = rows.join(several, "h").withColumn("common", F.count("*").over(own)).join(of_id, "id").where(F.col("common") >= _needed(p, "n"))
    keys = stash(_keys(rows, p), "keys")
    again = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    return stash(keys.join(again, "key"), "keys"), stash(several.where(F.col("k") > p.pairs_above).select("h"), "frequent")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    p = params
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    sig = stash(base.mapInArrow(_signatures(p), "id long, th long, n long, f1 long, f2 long, " + ", ".join(f"{s} long" for s in SKETCH) + ", low array<long>"), "sig")
    # A node for each distinct set; its text is that of its smallest id.
    sets = sig.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min(F.struct("id", "th")).alias("d"), F.min(F.struct("n", *SKETCH)).alias("s"), F.min("low").alias("low"))
    nodes = stash(sets.select(F.xxhash64("f1", "f2").alias("id"), "f1", "f2", F.col("d.id").alias("doc"), F.col("d.th").alias("th"), "s.*", "low"), "nodes")
    live = stash(nodes.select("id", "doc", "th", "n", *SKETCH).join(_with_partners(nodes, p), "id"), "live")
    texts = base.select(F.col("id").alias("doc"), "th", "text").join(live.select("id", "doc", "th"), ["doc", "th"]).dropDuplicates(["doc", "th"])
    texts = stash(texts.select("id", "text"), "texts")
    found = components(_links(texts, *candidate_keys(texts, p), live.select("id", "n", *SKETCH), p))
    linked = nodes.select("f1", "f2", "id", "doc").join(found, nodes.id == found.node).select("f1", "f2", "doc", "component")
    first = linked.groupBy("component").agg(F.min("doc").alias("first"))
    smallest = linked.join(first, "component").select("f1", "f2", "first").unionByName(nodes.join(found, nodes.id == found.node, "left_anti").select("f1", "f2", F.col("doc").alias("first")))
    out = sig.select("id", "n", "f1", "f2").join(smallest, ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("first")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
