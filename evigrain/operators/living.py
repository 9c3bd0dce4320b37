"""Snapshots of living reviews, discovery by citation, and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, kind, before_digest, after_digest) of the records that were added, changed or went missing."""
    b = before.select("record_id", F.sha2("body", 256).alias("before_digest"))
    a = after.select("record_id", F.sha2("body", 256).alias("after_digest"))
    kind = F.when(F.col("before_digest").isNull(), "added").when(F.col("after_digest").isNull(), "missing_from_source").when(F.col("before_digest") != F.col("after_digest"), "updated")
    return b.join(a, "record_id", "full").select("record_id", kind.alias("kind"), "before_digest", "after_digest").where("kind IS NOT NULL")


def candidates(edges: DataFrame, seeds: DataFrame, max_depth: int, max_records: int | None = None) -> DataFrame:
    """(node, depth, edge_ids): nodes within max_depth steps of a seed, seeds left out.

    Breadth first, one join per level; only new nodes go on. edge_ids are the edges that
    reach the node on such walks, with the edges by which their sources were first reached.
    Ordered by depth and node, then cut to max_records, where given.
    """
    e = edges.select("edge_id", "source", "target")
    reached = cut(seeds.select(F.col("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("path")).distinct())
    frontier, evidence = reached, None
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, frontier["node"] == e["source"]).select(F.col("target").alias("node"), F.explode(F.array_append("path", F.col("edge_id"))).alias("edge"))
        step = cut(step.groupBy("node").agg(F.array_sort(F.collect_set("edge")).alias("path")))
        evidence = step if evidence is None else evidence.unionByName(step)
        frontier = cut(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    found = evidence.select("node", F.explode("path").alias("edge")).groupBy("node").agg(F.array_sort(F.collect_set("edge")).alias("edge_ids"))
    out = reached.where("depth > 0").select("node", "depth").join(found, "node").select("node", "depth", "edge_ids")
    return out.orderBy("depth", "node").limit(max_records) if max_records is not None else out


def lineage(runs: DataFrame) -> DataFrame:
    """(run_id, ancestors, cyclic): the length of each run's chain of parents, over runs (run_id, parent_id) with distinct run_id.

    By doubling, until every chain has ended, however long. After k rounds those of fewer than 2^k ancestors have ended. A
    chain holds one run of each smaller number of ancestors; so if none ends in a round, no open one ever does: all lead into
    a cycle, and their ancestors are null. An unknown parent counts as an ancestor and ends the chain. Ended chains are
    written once.
    """
    columns = ("run_id", "up", "ancestors")
    now = cut(runs.select("run_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("long").alias("ancestors")))
    ended, still = now.where("up IS NULL"), now.where("up IS NOT NULL")
    n = still.count()
    while n:
        hop = ended.unionByName(still).select(F.col("run_id").alias("up"), F.col("up").alias("next"), F.col("ancestors").alias("more"))
        now = cut(still.join(hop, "up", "left").select("run_id", F.col("next").alias("up"), (F.col("ancestors") + F.coalesce("more", F.lit(0))).alias("ancestors")))
        ended, still, before = ended.unionByName(now.where("up IS NULL").select(*columns)), now.where("up IS NOT NULL"), n
        n = still.count()
        if n == before:
            break
    done = ended.unionByName(still)
    return done.select("run_id", F.when(F.col("up").isNull(), F.col("ancestors")).alias("ancestors"), F.col("up").isNotNull().alias("cyclic"))


def ancestor_pairs(pairs: DataFrame, runs: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """The distinct pairs (run_id, candidate) whose candidate lies on the run's chain of parents.

    The difference of both depths says how far up the candidate would be; each run walks there by the powers of two in
    it. Runs above or below a cycle have no depth and no pairs. ``chains`` is lineage(runs), if known.
    """
    depth = (lineage(runs) if chains is None else chains).where("NOT cyclic").select("run_id", "ancestors")
    over = depth.select(F.col("run_id").alias("candidate"), F.col("ancestors").alias("above"))
    asked = pairs.select("run_id", "candidate").distinct().join(depth, "run_id").join(over, "candidate")
    walk = cut(asked.where("ancestors > above").select("run_id", "candidate", F.col("run_id").alias("at"), (F.col("ancestors") - F.col("above")).alias("far")))
    farthest = walk.agg(F.max("far")).first()[0] or 0
    jump = runs.where("parent_id IS NOT NULL").select(F.col("run_id").alias("at"), F.col("parent_id").alias("up"))
    for k in range(farthest.bit_length()):
        if k:
            jump = cut(jump.join(jump.select(F.col("at").alias("up"), F.col("up").alias("next")), "up").select("at", F.col("next").alias("up")))
        goes = F.col("far").bitwiseAND(F.lit(1 << k)) != 0
        moved = walk.where(goes).join(jump, "at").select("run_id", "candidate", F.col("up").alias("at"), "far")
        walk = cut(walk.where(~goes).unionByName(moved))
    return walk.where("at = candidate").select("run_id", "candidate")


def lineage_violations(runs: DataFrame) -> DataFrame:
    """(run_id, code) of the breaches of lineage over runs (run_id, review_id, parent_id, supersedes_id, completed).

    Parents must be known and of the same review, chains free of cycles, run ids distinct; what a completed run
    supersedes must be known, of the same review and an ancestor. Of rows with one run_id the smallest stands for it when
    others refer to it. Below a cycle, supersession is not judged.
    """
    known = cut(runs.groupBy("run_id").agg(F.min(F.struct("review_id", "parent_id")).alias("one"), F.count("*").alias("rows")).select("run_id", "one.*", "rows"))
    target = known.select(F.col("run_id").alias("target"), F.col("review_id").alias("target_review"), F.lit(True).alias("found"))
    both = F.array(F.struct(F.lit("parent").alias("role"), F.col("parent_id").alias("target")), F.struct(F.lit("superseded").alias("role"), F.when(F.col("completed"), F.col("supersedes_id")).alias("target")))
    refs = runs.select("run_id", "review_id", F.explode(F.filter(both, lambda r: r["target"].isNotNull())).alias("ref")).select("run_id", "review_id", "ref.*")
    refs = cut(refs.join(target, "target", "left").withColumn("code", F.when(F.col("found").isNull(), F.concat(F.lit("unknown_"), "role")).when(~F.col("target_review").eqNullSafe(F.col("review_id")), F.concat(F.lit("cross_review_"), "role"))))
    ends = known.join(known.select(F.col("run_id").alias("parent_id")), "parent_id", "left_semi")
    links = cut(known.select("run_id").join(ends.select("run_id", "parent_id"), "run_id", "left"))
    chains = cut(lineage(links))
    asked = refs.where("role = 'superseded' AND code IS NULL").select("run_id", F.col("target").alias("candidate")).distinct()
    asked = asked.join(chains.where("NOT cyclic"), "run_id", "left_semi")
    wrong = asked.join(ancestor_pairs(asked, links, chains), ["run_id", "candidate"], "left_anti")
    codes = [refs.where("code IS NOT NULL").select("run_id", "code"), known.where("rows > 1").select("run_id", F.lit("duplicate_run").alias("code")),
             chains.where("cyclic").select("run_id", F.lit("lineage_cycle").alias("code")), wrong.select("run_id", F.lit("invalid_supersession").alias("code"))]
    return codes[0].unionByName(codes[1]).unionByName(codes[2]).unionByName(codes[3]).distinct()
