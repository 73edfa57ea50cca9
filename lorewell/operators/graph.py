"""Knowledge graph: nodes, edges, relationships, validation, degrees and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators.topics import TOPICS
from lorewell.session import cut

# Phrases that mark introductory and advanced titles.
BEGINNER = ["intro", "introduction", "beginner", "101", "basics", "primer", "overview", "what is", "getting started"]
DEEP = ["deep dive", "advanced", "in depth", "from scratch", "internals", "expert"]
TOPIC_WEIGHT, SOURCE_WEIGHT = 2.0, 0.5


def nodes(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node_id, type, label) of resources, topics and tags."""
    spark = resources.sparkSession
    topics = spark.createDataFrame([(f"topic:{t}", "topic", t) for t in TOPICS], "node_id string, type string, label string")
    items = resources.select(T.route("resource:", F.col("id")).alias("node_id"), F.lit("resource").alias("type"), T.display_title(F.col("title"), F.coalesce("canonical_id", "id")).alias("label"))
    tag = F.lower(F.trim("t"))
    tags = resources.select(F.explode("tags").alias("t")).select(tag.alias("label")).filter("label <> ''").distinct().select(F.concat(F.lit("tag:"), T.slug(F.col("label"))).alias("node_id"), F.lit("tag").alias("type"), "label")
    return topics.unionByName(items).unionByName(tags)


def edges(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(type, source, target): resources and topics both ways, resources and tags; each triple once."""
    node = T.route("resource:", F.col("id"))
    rt = assigned.select(node.alias("r"), F.explode("topics").alias("t")).withColumn("t", F.concat(F.lit("topic:"), F.col("t")))
    one = rt.select(F.lit("resource_has_topic").alias("type"), F.col("r").alias("source"), F.col("t").alias("target"))
    two = rt.select(F.lit("topic_has_resource").alias("type"), F.col("t").alias("source"), F.col("r").alias("target"))
    tags = resources.select(node.alias("source"), F.explode("tags").alias("t")).select(F.lit("resource_has_tag").alias("type"), "source", F.lower(F.trim("t")).alias("t")).filter("t <> ''")
    tagged = tags.select("type", "source", F.concat(F.lit("tag:"), T.slug(F.col("t"))).alias("target"))
    return one.unionByName(two).unionByName(tagged).distinct()


def count_types(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def degrees(all_edges: DataFrame, n: int = 50) -> DataFrame:
    """The `n` nodes with most edges in and out; ties by id."""
    ends = all_edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node_id").limit(n)


def depth(label):
    """-1 for introductory, 1 for advanced, 0 for other titles."""
    low = F.lower(F.coalesce(label, F.lit("")))
    score = F.lit(0)
    for p in BEGINNER:
        score = score - low.contains(p).cast("int")
    for p in DEEP:
        score = score + low.contains(p).cast("int")
    return F.signum(score.cast("double")).cast("int")


def relationship_classes(resources: DataFrame, assigned: DataFrame) -> DataFrame:
    """(topics, source_type, depth, n): resources with the same signals are one class.

    Relationships depend on topics, source type and depth alone, so they hold between classes; a class stands for its
    members, and no pair of members is made.
    """
    label = T.display_title(F.col("title"), F.coalesce("canonical_id", "id"))
    return resources.join(assigned, "id").select(F.array_join(F.sort_array("topics"), ",").alias("topics"), "source_type", depth(label).alias("depth")).groupBy("topics", "source_type", "depth").agg(F.count("*").alias("n"))


def class_relationships(classes: DataFrame) -> DataFrame:
    """(topics_a, type_a, depth_a, topics_b, type_b, depth_b, shared, score, similar, prerequisite): pairs of classes that share a topic.

    Classes meet on the topics that they share; how many there are depends on the definitions of topics, not on the data.
    """
    c = classes.filter("topics <> ''").select("topics", "source_type", "depth", F.explode(F.split("topics", ",")).alias("topic"))
    a, b = c.alias("a"), c.alias("b")
    key = lambda x: F.struct(f"{x}.topics", f"{x}.source_type", f"{x}.depth")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (key("a") <= key("b")))
    sums = pairs.groupBy(*(F.col(f"{x}.{k}").alias(f"{n}_{x}") for x in "ab" for k, n in (("topics", "topics"), ("source_type", "type"), ("depth", "depth")))).agg(F.count("*").alias("shared"))
    score = F.col("shared") * TOPIC_WEIGHT + F.when(F.col("type_a") == F.col("type_b"), SOURCE_WEIGHT).otherwise(0.0)
    return sums.withColumn("score", F.round(score, 6)).withColumn("similar", F.col("score") >= 1.0).withColumn("prerequisite", (F.col("depth_a") * F.col("depth_b")) == -1)


def validate(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(severity, code, n): duplicate nodes, missing ends, self-edges, resources without topic; only what occurs."""
    ids = all_nodes.select("node_id").distinct()
    row = lambda df, sev, code: df.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(sev).alias("severity"), F.lit(code).alias("code"), "n")
    twice = all_nodes.groupBy("node_id").agg(F.count("*").alias("c")).filter("c > 1")
    ends = all_edges.select(F.explode(F.array("source", "target")).alias("node_id")).join(ids, "node_id", "left_anti")
    alone = all_nodes.filter("type = 'resource'").select("node_id").distinct().join(all_edges.filter("type = 'resource_has_topic'").select(F.col("source").alias("node_id")), "node_id", "left_anti")
    out = row(twice, "error", "duplicate_node")
    for part in (row(ends, "error", "missing_endpoint"), row(all_edges.filter("source = target"), "error", "self_edge"), row(alone, "warning", "resource_without_topic")):
        out = out.unionByName(part)
    return out


def neighbourhood(all_edges: DataFrame, node: str) -> DataFrame:
    """The ids one edge away from `node`, and itself."""
    near = all_edges.filter((F.col("source") == node) | (F.col("target") == node))
    return near.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def shortest_path(all_edges: DataFrame, start: str, goal: str, types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(step, node_id) of a shortest undirected path; no rows if there is none (with `most`, none of so many edges).

    Breadth first with one join a level; a node's parent is the least id that reaches it, so the path is determined.
    """
    spark = all_edges.sparkSession
    used = all_edges if types is None else all_edges.filter(F.col("type").isin(types))
    both = cut(used.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(used.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct())
    seen = spark.createDataFrame([(start, None, 0)], "node_id string, parent string, level int")
    found = start == goal
    level = 0
    while not found and (most is None or level < most):  # until nothing new is reached
        level += 1
        front = seen.filter(F.col("level") == level - 1)
        reached = both.join(front, both["a"] == front["node_id"]).groupBy(F.col("b").alias("node_id")).agg(F.min("a").alias("parent")).withColumn("level", F.lit(level))
        fresh = reached.join(seen.select("node_id"), "node_id", "left_anti")
        grown = cut(seen.unionByName(fresh))
        at = grown.filter(F.col("level") == level)
        if not at.limit(1).count():
            return spark.createDataFrame([], "step int, node_id string")
        found = at.filter(F.col("node_id") == goal).limit(1).count() > 0
        seen = grown
    if not found:
        return spark.createDataFrame([], "step int, node_id string")
    path, here = [], goal
    while here is not None:  # one row for each step back
        path.append(here)
        here = seen.filter(F.col("node_id") == here).select("parent").first()[0]
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, node_id string")
