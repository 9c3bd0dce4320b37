"""Reconciling independent screening decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(decisions: DataFrame, required: int = 2, agent_may_exclude: bool = False) -> DataFrame:
    """decisions with ``rejection``: the first rule each breaks, in order of time and id; null where it breaks none.

    Row rules come first, then a repeated decision_id, a reviewer who decided before, and a
    full quorum of humans (counting the humans that come before by these rules).
    """
    wrong = (
        F.when((F.col("decision") == "exclude") & F.col("exclusion_reason").isNull(), "missing_exclusion_reason")
        .when((F.col("decision") != "exclude") & F.col("exclusion_reason").isNotNull(), "unexpected_exclusion_reason")
        .when(~F.col("confidence").between(0, 1), "invalid_confidence")
        .when((F.col("reviewer_kind") == "agent") & (F.col("decision") == "exclude") & F.lit(not agent_may_exclude), "agent_exclusion_denied")
    )
    order = ["decided_at", "decision_id"]
    d = decisions.withColumn("wrong", wrong)
    d = d.withColumn("same_id", F.row_number().over(W.partitionBy("decision_id", F.isnull("wrong")).orderBy(*order)))
    ok = F.isnull("wrong") & (F.col("same_id") == 1)
    d = d.withColumn("ok", ok).withColumn("turn", F.row_number().over(W.partitionBy("subject_id", "round", "reviewer_id", "ok").orderBy(*order)))
    d = d.withColumn("counts", F.col("ok") & (F.col("turn") == 1) & (F.col("reviewer_kind") == "human"))
    d = d.withColumn("humans", F.sum(F.col("counts").cast("int")).over(W.partitionBy("subject_id", "round").orderBy(*order)))
    rejection = F.coalesce(F.col("wrong"), F.when(F.col("same_id") > 1, "duplicate_decision_id").when(F.col("turn") > 1, "duplicate_reviewer").when(F.col("counts") & (F.col("humans") > required), "independent_review_complete"))
    return d.withColumn("rejection", rejection)


def admit(decisions: DataFrame, required: int = 2, agent_may_exclude: bool = False) -> DataFrame:
    """(decision_id, admitted, rejection) by the rules of ``judged``."""
    return judged(decisions, required, agent_may_exclude).select("decision_id", F.isnull("rejection").alias("admitted"), "rejection")


def status(decisions: DataFrame, resolutions: DataFrame, required: int = 2) -> DataFrame:
    """(subject_id, round, humans, status, outcome): resolved, pending, consensus or conflict; agents never count."""
    got = decisions.groupBy("subject_id", "round").agg(
        F.count_if(F.col("reviewer_kind") == "human").alias("humans"),
        F.count_distinct(F.when(F.col("reviewer_kind") == "human", F.col("decision"))).alias("kinds"),
        F.min(F.when(F.col("reviewer_kind") == "human", F.col("decision"))).alias("only"),
    )
    got = got.join(resolutions, ["subject_id", "round"], "left")
    state = F.when(F.col("resolved").isNotNull(), "resolved").when(F.col("humans") < required, "pending").when(F.col("kinds") == 1, "consensus").otherwise("conflict")
    got = got.withColumn("status", state)
    outcome = F.when(F.col("status") == "resolved", F.col("resolved")).when(F.col("status") == "consensus", F.col("only"))
    return got.select("subject_id", "round", "humans", "status", outcome.alias("outcome"))


def confirmed_agent_exclusions(decisions: DataFrame) -> DataFrame:
    """(agent_decision_id, human_decision_id): an agent's exclusion that a human of the same subject and round made too."""
    d = decisions.where(F.col("decision") == "exclude").select("subject_id", "round", "decision_id", "reviewer_kind")
    agent = d.where("reviewer_kind = 'agent'").select("subject_id", "round", F.col("decision_id").alias("agent_decision_id"))
    human = d.where("reviewer_kind = 'human'").select("subject_id", "round", F.col("decision_id").alias("human_decision_id"))
    return agent.join(human, ["subject_id", "round"]).select("agent_decision_id", "human_decision_id")


def resolve(decisions: DataFrame, requests: DataFrame, required: int = 2) -> DataFrame:
    """(request_id, accepted, rejection) of adjudications (request_id, subject_id, round, adjudicator_id, decision_ids).

    An adjudication names all human decisions of a conflict and comes from someone who made none. The first accepted one
    (by request_id) finalises its round; a round without decisions has no conflict.
    """
    human = F.col("reviewer_kind") != "agent"
    known = decisions.groupBy("subject_id", "round").agg(
        F.collect_set(F.when(human, F.col("decision_id"))).alias("known"), F.collect_set("reviewer_id").alias("reviewers"), F.count_if(human).alias("humans"),
        # the least and the greatest tell whether they differ; a count of kinds would shuffle all decisions once more
        F.min(F.when(human, F.col("decision"))).alias("least"), F.max(F.when(human, F.col("decision"))).alias("most"),
    )
    ids = F.array_distinct("decision_ids")
    wrong = (
        F.when(F.coalesce(F.col("humans") < required, F.lit(True)) | F.coalesce(F.col("least") == F.col("most"), F.lit(True)), "no_conflict")
        .when(F.size(F.array_except(ids, "known")) > 0, "unknown_decision")
        .when(F.size(ids) < F.size("known"), "incomplete_resolution")
        .when(F.array_contains("reviewers", F.col("adjudicator_id")), "adjudicator_not_independent")
    )
    r = requests.join(known, ["subject_id", "round"], "left").withColumn("wrong", wrong)
    w = W.partitionBy("subject_id", "round").orderBy("request_id").rowsBetween(W.unboundedPreceding, -1)
    done = F.coalesce(F.count_if(F.isnull("wrong")).over(w), F.lit(0)) > 0
    rejection = F.when(done, "round_finalized").otherwise(F.col("wrong"))
    return r.select("request_id", rejection.isNull().alias("accepted"), rejection.alias("rejection"))


def apply_bulk(decisions: DataFrame, previews: DataFrame, **rules) -> DataFrame:
    """(board_id, state, decisions, first_rejection): a board's batch of decisions is applied whole or not at all.

    ``decisions`` has a column board_id (a board's decisions are one batch), ``previews`` the board's revision now and at the
    preview. stale_preview comes before the rules; first_rejection is that of the earliest decision that breaks one.
    """
    first = F.min(F.when(F.col("rejection").isNotNull(), F.struct("decided_at", "decision_id", "rejection")))
    batch = judged(decisions, **rules).groupBy("board_id").agg(F.count("*").alias("decisions"), first["rejection"].alias("first_rejection"))
    got = previews.join(batch, "board_id", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0).cast("long")))
    state = F.when(F.col("decisions") == 0, "empty_submission").when(F.col("base_revision") != F.col("revision"), "stale_preview").when(F.col("first_rejection").isNotNull(), "rejected").otherwise("applied")
    return got.select("board_id", state.alias("state"), "decisions", "first_rejection")
