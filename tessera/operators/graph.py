"""Impact of events over the graph of issuers, and weights of its nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What of an impact passes each kind of edge, what is too small to count, weights of the signals of a node.
ATTENUATION = {"supplier_of": 0.6, "competitor_of": 0.35, "subsidiary_of": 0.55}
MIN_MAGNITUDE = 0.05
SIGNALS = {"news": 0.5, "sentiment": 0.25, "ta": 0.15, "corr": 0.1}
#: Relations as seen from the asset: where it is the subject of the edge, and where it is the object.
RELATIONS = {"competitor_of": ("competitor", "competitor"), "supplier_of": ("customer", "supplier"), "subsidiary_of": ("parent", "subsidiary")}
#: Copies of a node's impacts, over which the edges of a node of many are dealt.
SALT = 16
#: Of a clique's neighbours that reach a node by a stronger edge of its own, so many are left out of its class's list; a node with more gets a list of its own.
OWN = 8


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def passed(magnitude: Column, predicate: Column, weight: Column) -> Column:
    """What of a magnitude an edge passes on, 3 places; null for an unknown kind of edge and below the least magnitude."""
    out = F.round(magnitude * weight * _lookup(ATTENUATION, predicate), 3)
    return F.when(out >= MIN_MAGNITUDE, out)


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour, predicate, relation, weight): both ends of edges (subject, predicate, object, weight) of the kinds that pass
    impacts on; of several between two nodes the one of greatest weight (then predicate, then as subject)."""
    e = edges.where(F.col("predicate").isin(*ATTENUATION) & (F.col("subject") != F.col("object")))
    both = e.select(F.col("subject").alias("id"), F.col("object").alias("neighbour"), "predicate", "weight", F.lit(1).alias("first"))
    both = both.unionByName(e.select(F.col("object").alias("id"), F.col("subject").alias("neighbour"), "predicate", "weight", F.lit(0).alias("first")))
    best = both.where("weight is not null").groupBy("id", "neighbour").agg(F.max(F.struct("weight", "predicate", "first")).alias("x"))
    side = F.when(F.col("x.first") == 1, _lookup({k: a for k, (a, _) in RELATIONS.items()}, F.col("x.predicate"))).otherwise(_lookup({k: b for k, (_, b) in RELATIONS.items()}, F.col("x.predicate")))
    return best.select("id", "neighbour", "x.predicate", side.alias("relation"), "x.weight")


def _top(rows: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


@dataclass(frozen=True)
class Cliques:
    """Edges of one kind between all nodes of a group, told by their members instead of pair by pair.

    members: (grp, node, cls), the classes being few; weight: that of the edge of two nodes of these classes, the same both ways. The kind
    must have one relation for both ends. A node can be in several groups."""

    members: DataFrame
    predicate: str
    weight: Callable[[Column, Column], Column]


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _share(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")


def _passed_on(rows: DataFrame, keys: list[str], predicate: Column, weight: Column) -> DataFrame:
    """rows with impacts _t of a neighbour: (keys, title, type, direction, magnitude) of what an edge passes on, of one title the greatest."""
    given = F.transform("_t", lambda t: F.struct(passed(t["magnitude"], predicate, weight).alias("magnitude"), t["direction"].alias("direction"), t["type"].alias("type"), t["title"].alias("title")))
    d = rows.select(*keys, F.sort_array(F.filter(given, lambda t: t["magnitude"].isNotNull()), asc=False).alias("_g"))
    first = F.filter("_g", lambda t, i: ~F.exists(F.slice("_g", F.lit(1), i), lambda u: u["title"].eqNullSafe(t["title"])))
    return d.select(*keys, F.explode(first).alias("_x")).select(*keys, "_x.title", "_x.type", "_x.direction", "_x.magnitude")


def propagated(edges: DataFrame, impacts: DataFrame, each: int = 3, limit: int = 8, cliques: Cliques | None = None) -> DataFrame:
    """(id, place, via, relation, title, type, direction, magnitude): what the events of its neighbours mean for an asset, greatest first.

    impacts: (asset_id, title, type, direction, magnitude). The `each` greatest of a neighbour (ties by title) go over the edge,
    weakened; of one title by one neighbour the greatest counts; `limit` stay. One step, the direction is kept.

    No node is worked out by one task: the few impacts of a node are copied SALT times and its edges dealt to the copies, and an
    asset's list is cut down for each share of its neighbours before the shares meet. Edges of cliques are not made: nodes of one class of a
    group see the same neighbours by the same weights, so a list a class is ranked, long enough for what a node must leave out of it."""
    order = [F.desc("magnitude"), F.asc("via"), F.asc_nulls_last("title")]
    found = ["via", "relation", "title", "type", "direction", "magnitude"]
    top = _top(impacts.where("magnitude is not null"), ["asset_id"], each, [F.desc("magnitude"), F.asc_nulls_last("title"), F.asc("direction")])
    top = top.groupBy(F.col("asset_id").alias("neighbour")).agg(F.collect_list(F.struct("magnitude", "direction", "type", "title")).alias("_t"))
    links, left_out = neighbours(edges), None
    if cliques is not None:
        links, left_out = _against(links, cliques)
    d = links.withColumn("_salt", _share("id")).join(_salted(top), ["neighbour", "_salt"]).withColumnRenamed("neighbour", "via")
    d = _passed_on(d, ["id", "via", "relation"], F.col("predicate"), F.col("weight"))
    d = _top(d.withColumn("_share", _share("via")), ["id", "_share"], limit, order).select("id", *found)
    if cliques is not None:
        d = d.unionByName(_from_cliques(cliques, top, left_out, each, limit, order).select("id", *found))
        d = d.groupBy("id", "via", "title").agg(F.max(F.struct("magnitude", "direction", "type", "relation")).alias("x")).select("id", "via", "x.relation", "title", "x.type", "x.direction", "x.magnitude")
    d = _top(d, ["id"], limit, order)
    return d.select("id", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("place"), *found)


def _against(links: DataFrame, cliques: Cliques) -> tuple[DataFrame, DataFrame]:
    """The links that no edge of a clique beats, and (id, left_out): the neighbours in a node's groups that it has by such a link."""
    m = cliques.members
    a, b = m.select(F.col("node").alias("id"), "grp", F.col("cls").alias("_a")), m.select(F.col("node").alias("neighbour"), "grp", F.col("cls").alias("_b"))
    both = links.select("id", "neighbour").join(a, "id").join(b, ["neighbour", "grp"]).groupBy("id", "neighbour").agg(F.max(cliques.weight(F.col("_a"), F.col("_b"))).alias("_w"))
    d = links.join(both, ["id", "neighbour"], "left")
    d = d.where(F.col("_w").isNull() | (F.struct("weight", "predicate") > F.struct("_w", F.lit(cliques.predicate).alias("predicate"))))
    return d.drop("_w"), d.where("_w is not null").groupBy("id").agg(F.collect_list("neighbour").alias("left_out"))


def _from_cliques(cliques: Cliques, top: DataFrame, left_out: DataFrame, each: int, limit: int, order: list[Column]) -> DataFrame:
    m, kind = cliques.members, F.lit(cliques.predicate)
    source = m.join(top.withColumnRenamed("neighbour", "node"), "node").select("grp", F.col("node").alias("via"), F.col("cls").alias("_b"), "_t", _share("node").alias("_salt"))
    classes = _salted(m.select("grp", "cls").distinct())
    d = _passed_on(source.join(classes, ["grp", "_salt"]), ["grp", "cls", "via", "_salt"], kind, cliques.weight(F.col("cls"), F.col("_b")))
    enough = limit + each * (1 + OWN)
    d = _top(_top(d, ["grp", "cls", "_salt"], enough, order), ["grp", "cls"], enough, order)
    d = d.groupBy("grp", "cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("magnitude")).alias("_o"), "via", F.col("title").isNull().alias("_n"), "title", "type", "direction", "magnitude"))).alias("_l"))
    node = m.select("grp", F.col("node").alias("id"), "cls").join(left_out, "id", "left").withColumn("left_out", F.coalesce("left_out", F.array().cast("array<bigint>")))
    few = node.where(F.size("left_out") <= OWN).join(d, ["grp", "cls"])
    few = few.select("id", F.explode(F.slice(F.filter("_l", lambda x: (x["via"] != F.col("id")) & ~F.array_contains("left_out", x["via"])), 1, limit)).alias("x")).select("id", "x.*")
    many = _salted(node.where(F.size("left_out") > OWN)).join(source, ["grp", "_salt"]).where((F.col("via") != F.col("id")) & ~F.array_contains("left_out", F.col("via")))
    many = _passed_on(many, ["id", "grp", "via", "_salt"], kind, cliques.weight(F.col("cls"), F.col("_b")))
    many = _top(many, ["id", "grp", "_salt"], limit, order)
    out = ["id", "via", "title", "type", "direction", "magnitude"]
    return few.select(*out).unionByName(many.select(*out)).withColumn("relation", F.lit(RELATIONS[cliques.predicate][0]))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def combined(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals (news, sentiment, ta, corr) that are there, each cut to 0 .. 1; 0 without any."""
    num = sum((F.when(c.isNotNull(), SIGNALS.get(k, 0.0) * clamp(c)).otherwise(0.0) for k, c in signals.items()), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), F.lit(SIGNALS.get(k, 0.0))).otherwise(0.0) for k, c in signals.items()), F.lit(0.0))
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def ta_strength(rsi: Column, macd_hist: Column, last: Column) -> Column:
    """How far from the middle the indicators stand, 0 .. 1: the mean of those that are there, null without any."""
    r = F.when(rsi.isNotNull(), F.least(F.abs(rsi - 50) / 50, F.lit(1.0)))
    m = F.when((last != 0) & macd_hist.isNotNull(), F.least(F.abs(macd_hist) / (0.02 * F.abs(last)), F.lit(1.0)))
    both = F.array_compact(F.array(r, m))
    return F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both))


def normalised_weight(value: Column, peak: Column, floor: float = 0.2) -> Column:
    """value over the peak, moved into floor .. 1; floor where there is no peak."""
    return F.when(peak > 0, clamp(floor + (1 - floor) * F.least(F.coalesce(value, F.lit(0.0)) / peak, F.lit(1.0)))).otherwise(floor)


def group_weights(nodes: DataFrame, group: str) -> DataFrame:
    """(group, weight): .6 of the greatest and .4 of the mean weight of its nodes (group, weight)."""
    return nodes.groupBy(group).agg(clamp(0.6 * F.max("weight") + 0.4 * F.avg("weight")).alias("weight"))
