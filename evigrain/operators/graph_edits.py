"""Ordered edits of a study graph: what was accepted decides about what follows.

An edit attaches a new report to a study, or links a report that is there to one, each with
a piece of evidence that has an id of its own. Edits are decided in rounds of joins: an edit
waits only for earlier undecided ones that share its report, its report and study, or its
link's id, and is refused as soon as an earlier accepted one rules it out. So the rounds
follow the longest chain of dependence, not the number of edits, and a key that all edits
share takes two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut

EDIT = ("seq", "kind", "report_id", "study_id", "link_id", "from_id", "to_id", "relationship", "confidence", "evidence", "title")
#: Fixed value: the relationship that a report's link to its study states.
REPORT_OF_STUDY = "report_of_study"
INITIAL = -1


def static_code(studies: DataFrame):
    """What is wrong with an edit whatever came before it; rows have ``study_known``."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    link = same("from_id", "report_id") & same("to_id", "study_id") & F.coalesce(F.col("relationship") == REPORT_OF_STUDY, F.lit(False))
    return (
        F.when(~F.coalesce(F.col("kind").isin("attach", "link"), F.lit(False)), "unknown_edit").when(F.col("study_known").isNull(), "unknown_study").when(~link, "invalid_attachment_link")
        .when(blank("report_id") | ((F.col("kind") == "attach") & blank("title")), "invalid_report").when(blank("link_id") | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) | ~F.coalesce(F.col("evidence") > 0, F.lit(False)), "invalid_link")
    )


def apply_edits(edits: DataFrame, reports: DataFrame, studies: DataFrame, links: DataFrame) -> DataFrame:
    """(seq, accepted, code): the decision about each edit, in order of seq, which is unique.

    ``reports`` has report_id, ``studies`` study_id and report_ids, ``links`` link_id. What is wrong with an edit by itself
    is named before what earlier ones make of it; a report that is there, or isn't, before the pair and the link's id.
    """
    known = studies.select("study_id", F.lit(True).alias("study_known")).distinct()
    e = cut(edits.select(*EDIT).join(known, "study_id", "left").withColumn("code", static_code(studies)))
    decided = [e.where("code IS NOT NULL").select("seq", "code")]
    open_ = e.where("code IS NULL").select("seq", "kind", "report_id", "study_id", "link_id")
    first = F.lit(INITIAL).cast("long")
    # what is in the graph, by the key it takes: since when
    taken = {
        "link_id": links.select("link_id", first.alias("since")).distinct(),
        "pair": studies.select(F.explode("report_ids").alias("report_id"), "study_id", first.alias("since")).distinct(),
        "report_id": reports.select("report_id", first.alias("since")).distinct(),
    }
    keys = {"link_id": ["link_id"], "pair": ["report_id", "study_id"], "report_id": ["report_id"]}
    taken = {name: cut(rows) for name, rows in taken.items()}
    while not open_.isEmpty():
        got = open_
        for name, key in keys.items():
            waiting = open_.where("kind = 'attach'") if name == "report_id" else open_
            got = got.join(waiting.groupBy(*key).agg(F.min("seq").alias(f"open_{name}")), key, "left").join(taken[name].groupBy(*key).agg(F.min("since").alias(f"held_{name}")), key, "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
        attach = F.col("kind") == "attach"
        wait = F.lit(None).cast("string")
        held = before("held_report_id")
        code = F.when(attach & held, "duplicate_report").when(~held & before("open_report_id"), wait).when(~attach & ~held, "unknown_report")
        code = code.when(before("held_pair"), "duplicate_pair").when(before("open_pair"), wait).when(before("held_link_id"), "duplicate_link").when(before("open_link_id"), wait).otherwise("")
        got = cut(got.withColumn("code", code).select("seq", "kind", "report_id", "study_id", "link_id", "code"))
        new = got.where("code IS NOT NULL")
        decided.append(new.select("seq", "code"))
        accepted = new.where("code = ''")
        since = F.col("seq").cast("long").alias("since")
        taken = {
            "link_id": cut(taken["link_id"].unionByName(accepted.select("link_id", since))), "pair": cut(taken["pair"].unionByName(accepted.select("report_id", "study_id", since))),
            "report_id": cut(taken["report_id"].unionByName(accepted.where("kind = 'attach'").select("report_id", since))),
        }
        open_ = got.where("code IS NULL").drop("code")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("seq", (F.col("code") == "").alias("accepted"), F.nullif("code", F.lit("")).alias("code"))
