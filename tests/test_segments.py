"""Segment files and receipts: gaps, wrong names, older events."""

import json

from evigrain.sources import segments


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text if isinstance(text, str) else json.dumps(text) + "\n")


def event(i):
    return {"event_id": f"e{i}", "event_hash": f"h{i}"}


def name(i, ordinal=None):
    return f"{i if ordinal is None else ordinal:020d}-h{i}.json"


def test_event_segments(spark, tmp_path):
    for i in (1, 2, 3):
        write(tmp_path / "good" / "events", name(i), event(i))
    write(tmp_path / "good" / "events", ".half.pending", "{")
    write(tmp_path / "older" / ".", "audit.jsonl", "\n".join(json.dumps(event(i)) for i in (1, 2)) + "\n\n")
    write(tmp_path / "older" / "events", name(3), event(3))
    for i in (1, 3, 4):
        write(tmp_path / "gap here" / "events", name(i), event(i))
    write(tmp_path / "bad" / "events", name(1), event(9))
    write(tmp_path / "bad" / "events", name(2), "no json\n")
    write(tmp_path / "bad" / "events", name(3), json.dumps(event(3)) + "\n" + json.dumps(event(4)) + "\n")
    got = {(r.review, r.ordinal): (r.event_id, r.problem) for r in segments.event_segments(spark, str(tmp_path)).collect()}
    assert got == {
        ("good", 1): ("e1", None), ("good", 2): ("e2", None), ("good", 3): ("e3", None), ("older", 3): ("e3", None), ("gap here", 1): ("e1", None), ("gap here", 2): ("e3", "unexpected_name"), ("gap here", 3): ("e4", "unexpected_name"),
        ("bad", 1): ("e9", "unexpected_name"), ("bad", 2): (None, "not_json"), ("bad", 3): ("e3", "not_one_event"),
    }


def test_lifecycle_receipts(spark, tmp_path):
    folder = tmp_path / "r1" / "lifecycle" / "receipts"
    write(folder, "a.json", '{\n "request": {"request_id": "a"}\n}\n')
    write(folder, "b.json", {"request": {"request_id": "c"}})
    write(folder, "d.json", "{")
    write(folder, "notes.txt", "x")
    got = {r.file: (r.review, r.request_id, r.problem) for r in segments.lifecycle_receipts(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("r1", "a", None), "b.json": ("r1", "c", "name_differs"), "d.json": ("r1", None, "not_json")}


def test_nothing_there(spark, tmp_path):
    assert segments.event_segments(spark, str(tmp_path)).count() == 0
    assert segments.lifecycle_receipts(spark, str(tmp_path)).count() == 0
