"""Property graphs as node and edge tables: lookups, hops, conjunctions, degrees, sub-graphs, discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block that meet the other side's rows together, and pairs that a block makes at most.
BLOCK_ROWS, BLOCK_PAIRS = 256, 1 << 22


def one_hop(edges: DataFrame, probes: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    """Edges whose subject is a probe's entity: probes (probe, entity)."""
    e = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    return probes.join(e, probes.entity == e.subject).select("probe", *edges.columns)


def either_endpoint(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that touch an entity (column entity) at either end, each once; two equi-joins, no theta join."""
    ids = entities.select("entity").distinct()
    out = edges.join(ids, edges.subject == ids.entity, "left_semi")
    into = edges.join(ids, edges.object == ids.entity, "left_semi").join(ids, edges.subject == ids.entity, "left_anti")
    return out.unionByName(into)


def host_parameter(edges: DataFrame, hop: str, relations: Sequence[str], inferred: DataFrame | None = None) -> DataFrame:
    """Two hops: the values of the node that a subject points to by ``hop``, or by ``inferred`` (subject, host) without such an edge."""
    hosts = edges.where(F.col("relation") == hop).groupBy("subject").agg(F.min_by("object", "ordinal").alias("host"))
    if inferred is not None:
        known = hosts.select(F.col("subject").alias("_known"))
        hosts = hosts.unionByName(inferred.join(known, inferred.subject == known._known, "left_anti").select("subject", "host"))
    second = edges.where(F.col("relation").isin(*relations)).select(F.col("subject").alias("host"), F.col("relation").alias("parameter"), F.col("object").alias("value"), "ordinal")
    return hosts.join(second, "host").select("subject", "host", "parameter", "value", "ordinal")


def having_all(edges: DataFrame, facts: Sequence[tuple[str, str]]) -> DataFrame:
    """Subjects that have every (relation, object) fact."""
    out = None
    for relation, obj in facts:
        one = edges.where((F.col("relation") == relation) & (F.col("object") == obj)).select("subject").distinct()
        out = one if out is None else out.join(one, "subject", "left_semi")
    return out


def missing_defaults(defaults: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Default facts whose key has no edge yet."""
    return defaults.join(edges.select(*keys).distinct(), list(keys), "left_anti")


def missing_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], keys: tuple[str, str], edges: DataFrame, rows_a_task: int = 20_000_000) -> DataFrame:
    """(keys): all pairs of rows of ``left`` and ``right`` that agree in ``on``, without those that ``edges`` has; keys are one column of each side.

    Pairs are made last and never shuffled: rows of ``left`` go in blocks of ``BLOCK_ROWS`` at most, each with its edges that are such pairs,
    and meet the rows of ``right``, the side to broadcast. A row of ``right`` is paired with a whole block before the next one is, so that in a
    file one key stays the same and the other comes back in the same order, which parquet writes in a third of a byte a pair.
    Blocks are dealt over as many tasks as the number of pairs asks for, whatever the size of ``left``.
    """
    a, b = keys
    small = right.select(*on, b)
    own = left.groupBy(*on, a).agg(F.count("*").alias("_times"))
    both = own.groupBy(*on).agg(F.sum("_times").alias("_left")).join(right.groupBy(*on).agg(F.count("*").alias("_right")), list(on))
    n = both.agg(F.sum(F.col("_left") * F.col("_right"))).first()[0] or 0
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_PAIRS) / F.col("_right"))))
    # Equal rows share a block up to its size; the others go to blocks of their own hash.
    shares = own.join(both, list(on)).withColumn("_most", most).withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_times") - 1) / F.col("_most")))))
    block = F.pmod(F.xxhash64(a, "_i"), F.ceil(F.col("_left") / F.col("_most")))
    shares = shares.select(*on, a, block.alias("_block"), F.least("_most", F.col("_times") - F.col("_i") * F.col("_most")).cast("int").alias("_n"))
    blocks = shares.groupBy(*on, "_block").agg(F.flatten(F.collect_list(F.array_repeat(a, F.col("_n")))).alias("_rows"))
    ends = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).join(F.broadcast(small.distinct()), F.col("_b") == F.col(b)).select(*on, F.col("_a").alias(a), b)
    met = ends.join(shares.select(*on, a, "_block").hint("shuffle_hash"), [*on, a]).groupBy(*on, "_block", b).agg(F.collect_set(a).alias("_met"))
    has = met.groupBy(*on, "_block").agg(F.map_from_entries(F.collect_list(F.struct(b, "_met"))).alias("_has"))
    dealt = blocks.join(has, [*on, "_block"], "left").repartition(max(left.sparkSession.sparkContext.defaultParallelism, n // rows_a_task + 1))
    pairs = dealt.join(F.broadcast(small), list(on)).select(b, "_rows", F.try_element_at("_has", F.col(b)).alias("_met"))
    return pairs.select(F.explode("_rows").alias(a), b, "_met").where(~F.coalesce(F.array_contains("_met", F.col(a)), F.lit(False))).select(a, b)


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(name, degree): edges that touch each node, in and out."""
    w = F.lit(1) if weight is None else F.col(weight)
    ends = edges.select(F.explode(F.array("subject", "object")).alias("name"), w.alias("w"))
    return ends.groupBy("name").agg(F.sum("w").cast("long").alias("degree"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "name").limit(n)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column name)."""
    ids = nodes.select("name")
    kept = edges.join(ids, edges.subject == ids.name, "left_semi")
    return kept.join(ids, kept.object == ids.name, "left_semi")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that at least one edge touches."""
    ends = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("subject", "object")).alias("name")).distinct()
    return nodes.join(ends, "name", "left_anti")


def drop_namespace(edges: DataFrame, source_name: str) -> DataFrame:
    """All rows but those of one source."""
    return edges.where(~F.col("source_name").eqNullSafe(F.lit(source_name)))


def nodes_of(edges: DataFrame) -> DataFrame:
    """(name, first_ordinal): each end of an edge once."""
    return edges.select(F.explode(F.array("subject", "object")).alias("name"), "ordinal").groupBy("name").agg(F.min("ordinal").alias("first_ordinal"))


def reachable(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within ``depth`` links (src, dst) of the seeds (node), by the least depth.

    Each level joins the frontier with the links and drops what was seen; a checkpoint cuts each level's lineage.
    """
    from factloom.sources.tables import cut

    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(met.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def stats(edges: DataFrame) -> DataFrame:
    """Edges, relations, subjects by relation: the counts of a graph."""
    return edges.groupBy("relation").agg(F.count("*").alias("n_edges"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("object").alias("n_objects"))
