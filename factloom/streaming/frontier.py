"""Budgeted discovery of pages over a frontier that is kept in a table, so that a run goes on where the last one ended.

The table is a log in rounds. A round takes the next nodes of the least pending depth, best first, and writes one folder: what it
visited and what it found. A folder counts once it is complete (its ``_SUCCESS``), so a round that is killed leaves nothing
and is done again. Nodes wait in the order (depth, score falling, node); a round only takes nodes of one depth, and what they lead to
is deeper, so the order of visits doesn't depend on how many nodes a round takes, nor on where runs end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Nodes that a round takes at most; so many rows are ordered in one task.
ROUND_NODES = 10_000


@dataclass(frozen=True)
class Rules:
    """What a run may do. allow: which nodes are visited and followed; candidate: which fetched ones are wanted; both of columns of ``pages``."""

    max_depth: int
    page_budget: int
    candidate_budget: int = 0  # 0: no bound


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rounds(spark: SparkSession, path: str) -> list[str]:
    """The complete rounds' folders, in order."""
    top, fs = _fs(spark, path)
    if not fs.exists(top):
        return []
    made = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("round-")]
    return sorted(p.toString() for p in made if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    found = rounds(spark, path)
    return spark.read.parquet(*found) if found else None


def visited(spark: SparkSession, path: str) -> DataFrame | None:
    """(node, depth, score, place, fetched, candidate) of all nodes visited so far; null before the first round."""
    log = _log(spark, path)
    return None if log is None else log.where("event = 'visited'").select("node", "depth", "score", "place", "fetched", "candidate")


def pending(spark: SparkSession, path: str) -> DataFrame | None:
    """(node, depth, score) of all nodes that wait, each by its least depth."""
    log = _log(spark, path)
    if log is None:
        return None
    state = log.groupBy("node").agg(F.min("depth").alias("depth"), F.max("score").alias("score"), F.bool_or(F.col("event") == "visited").alias("done"))
    return state.where(~F.col("done")).select("node", "depth", "score")


def discover(
    spark: SparkSession, path: str, seeds: DataFrame, links: DataFrame, pages: DataFrame, rules: Rules, *,
    allow: Callable[[DataFrame], Column] = lambda pages: F.lit(True), candidate: Callable[[DataFrame], Column] = lambda pages: F.lit(False), score: Callable[[DataFrame], Column] = lambda pages: F.lit(0), round_nodes: int = ROUND_NODES,
) -> DataFrame:
    """Visit pages from the seeds (node) over links (src, dst) until the budgets of this run or the frontier are spent; returns ``visited``.

    pages: one row for each node that can be fetched. Nodes without a row are visited without being fetched and don't count; their score
    is 0. A run stops behind the page with which it has fetched ``page_budget`` pages or ``candidate_budget`` candidates. Nodes that
    aren't allowed are never listed; nodes deeper than ``max_depth`` aren't found.
    """
    known = pages.select("node", F.coalesce(allow(pages), F.lit(False)).alias("_allowed"), F.coalesce(candidate(pages), F.lit(False)).alias("_candidate"), F.coalesce(score(pages).cast("double"), F.lit(0.0)).alias("score"), F.lit(True).alias("fetched"))

    def listed(nodes: DataFrame) -> DataFrame:
        """Nodes (node, depth) with what is known of them, without those that aren't allowed."""
        met = nodes.groupBy("node").agg(F.min("depth").alias("depth")).join(known, "node", "left")
        return met.where(F.coalesce("_allowed", F.lit(True))).select("node", "depth", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("fetched", F.lit(False)).alias("fetched"), F.coalesce("_candidate", F.lit(False)).alias("candidate"))

    def event(rows: DataFrame, name: str, place: Column) -> DataFrame:
        return rows.select("node", F.lit(name).alias("event"), F.col("depth").cast("int").alias("depth"), "score", place.cast("bigint").alias("place"), F.col("fetched"), "candidate")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/round-{number:06d}")

    number = len(rounds(spark, path))
    fresh = listed(seeds.where("node is not null").select("node", F.lit(0).alias("depth")))
    if number:  # seeds that are new to a resumed run
        fresh = fresh.join(_log(spark, path).select("node").distinct(), "node", "left_anti")
    if not number or not fresh.isEmpty():
        write(event(fresh, "found", F.lit(None)), number)
        number += 1
    pages_left, wanted_left = rules.page_budget, rules.candidate_budget or None
    while pages_left > 0 and (wanted_left is None or wanted_left > 0):
        waiting = pending(spark, path)
        level = waiting.agg(F.min("depth")).first()[0]
        if level is None:
            break
        place = Window.orderBy(F.desc("score"), "node")
        # At most round_nodes rows from here to the end of the round's visits.
        best = waiting.where(F.col("depth") == level).orderBy(F.desc("score"), "node").limit(round_nodes).select("node", "depth")
        so_far = place.rowsBetween(Window.unboundedPreceding, -1)
        ahead = lambda c: F.coalesce(F.count_if(c).over(so_far), F.lit(0))
        taken = listed(best).withColumns({"_no": F.row_number().over(place), "_pages": ahead(F.col("fetched")), "_wanted": ahead(F.col("fetched") & F.col("candidate"))}).where(F.col("_pages") < pages_left)
        if wanted_left is not None:
            taken = taken.where(F.col("_wanted") < wanted_left)
        visits = event(taken, "visited", F.lit(number) * (1 << 32) + F.col("_no"))
        if level < rules.max_depth:
            out = taken.where("fetched").select(F.col("node").alias("src")).join(links, "src").where("dst is not null").select(F.col("dst").alias("node"), F.lit(level + 1).alias("depth"))
            seen = _log(spark, path).select("node").distinct()
            write(visits.unionByName(event(listed(out).join(seen, "node", "left_anti"), "found", F.lit(None))), number)
        else:
            write(visits, number)
        done = spark.read.parquet(f"{path}/round-{number:06d}").where("event = 'visited' and fetched").agg(F.count("*"), F.count_if("candidate")).first()
        pages_left -= done[0]
        wanted_left = None if wanted_left is None else wanted_left - done[1]
        number += 1
    return visited(spark, path)
