"""Ordered edits against a loop that applies them one by one."""

import random

import pytest

from evigrain.operators import graph_edits

DDL = "seq long, kind string, report_id string, study_id string, link_id string, from_id string, to_id string, relationship string, confidence double, evidence int, title string"


def edit(seq, kind, report, study, link, **more):
    row = dict(seq=seq, kind=kind, report_id=report, study_id=study, link_id=link, from_id=report, to_id=study, relationship="report_of_study", confidence=0.5, evidence=1, title="t") | more
    return tuple(row[c.split()[0]] for c in DDL.split(", "))


def brute(edits, reports, studies, links):
    reports, links = set(reports), set(links)
    pairs = {(r, s) for s, rs in studies.items() for r in rs}
    out = {}
    for seq, kind, report, study, link, a, b, relation, confidence, evidence, title in sorted(edits):
        code = None
        if kind not in ("attach", "link"):
            code = "unknown_edit"
        elif study not in studies:
            code = "unknown_study"
        elif (a, b, relation) != (report, study, "report_of_study"):
            code = "invalid_attachment_link"
        elif not report.strip() or kind == "attach" and not title.strip():
            code = "invalid_report"
        elif not link.strip() or not 0 <= confidence <= 1 or evidence < 1:
            code = "invalid_link"
        elif kind == "attach" and report in reports:
            code = "duplicate_report"
        elif kind == "link" and report not in reports:
            code = "unknown_report"
        elif (report, study) in pairs:
            code = "duplicate_pair"
        elif link in links:
            code = "duplicate_link"
        if code is None:
            reports.add(report)
            pairs.add((report, study))
            links.add(link)
        out[seq] = (code is None, code)
    return out


def run(spark, edits, reports, studies, links):
    got = graph_edits.apply_edits(spark.createDataFrame(edits, DDL), spark.createDataFrame([(r,) for r in reports], "report_id string"), spark.createDataFrame(list(studies.items()), "study_id string, report_ids array<string>"), spark.createDataFrame([(x,) for x in links], "link_id string"))
    rows = got.collect()
    assert len(rows) == len(edits)
    return {r.seq: (r.accepted, r.code) for r in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_edits(spark, seed):
    rng = random.Random(seed)
    reports, studies, links = ["r0", "r1"], {"s0": ["r0"], "s1": [], "s2": ["r1", "r0"]}, ["l0"]
    edits = []
    for seq in range(120):
        more = dict(rng.choice([{}] * 12 + [dict(confidence=1.5), dict(evidence=0), dict(from_id="x"), dict(relationship="cites"), dict(title=" "), dict(kind="drop")]))
        kind = more.pop("kind", None) or rng.choice(["attach", "link"])
        edits.append(edit(seq, kind, f"r{rng.randint(0, 25)}", f"s{rng.randint(0, 3)}", f"l{rng.randint(0, 60)}", **more))
    want = brute(edits, reports, studies, links)
    assert run(spark, edits, reports, studies, links) == want
    assert {c for _, c in want.values()} >= {None, "unknown_report", "duplicate_report", "duplicate_pair", "duplicate_link", "unknown_study"}


def test_chains_of_dependence(spark):
    """Each edit hangs on the one before: a refused one frees the id that the next needs."""
    edits = [edit(0, "link", "new", "s0", "a"), edit(1, "attach", "new", "s0", "a"), edit(2, "link", "new", "s1", "a"), edit(3, "link", "new", "s1", "b"), edit(4, "attach", "other", "s1", "b"), edit(5, "attach", "other", "s1", "c"), edit(6, "link", "other", "s0", "c"), edit(7, "link", "other", "s0", "d"), edit(8, "link", "other", "s0", "e")]
    studies = {"s0": [], "s1": []}
    assert run(spark, edits, ["z"], studies, ["y"]) == brute(edits, ["z"], studies, ["y"])


def test_one_key_for_all(spark):
    edits = [edit(i, "attach", f"r{i}", "s0", "same") for i in range(300)]
    got = run(spark, edits, ["z"], {"s0": []}, ["y"])
    assert [s for s, (ok, _) in got.items() if ok] == [0]
