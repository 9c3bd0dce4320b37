"""Files in and out by format name."""

import pytest
from pyspark.sql import functions as F

from evigrain import interchange as I

FIELDS = [f.split()[0] for f in I.RECORD.split(", ")]


def records(spark):
    rows = [("r1", "r1", "journal_article", "A title", "Line one\nline two", ["Doe, J.", "Roe, A."], "J. of X", 2001, "10.1/x", "123", ["s"], ["en"], ["u"]), ("r2", "r2", "conference", "B", None, [], None, None, None, None, [], [], [])]
    return spark.createDataFrame(rows, I.RECORD)


@pytest.mark.parametrize("fmt", ["ris", "nbib", "json_lines"])
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    written = I.export_records(records(spark).coalesce(1), path, fmt)
    got = {r.title: r for r in I.import_records(spark, f"{path}/*.txt", fmt).collect()}
    assert set(got) == {"A title", "B"} and all(r.error is None for r in got.values()) and written.count() == 2
    assert got["A title"].authors == ["Doe, J.", "Roe, A."] and got["A title"].year == 2001 and got["A title"].doi == ("10.1/x [doi]" if fmt == "nbib" else "10.1/x")  # the mark stays where there is no resolver
    assert got["A title"].abstract == ("Line one\nline two" if fmt == "json_lines" else "Line one line two")


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"record_id": "x", "title": "t", "year": 3},\n {"record_id": "y"}]')
    (tmp_path / "b.json").write_text('{"record_id": "x"}')
    (tmp_path / "c.jsonl").write_text('{"record_id": "z", "title": "q"}\n\nbroken\n[1]\n')
    (tmp_path / "d.csl").write_text('[{"id": "i", "type": "report", "title": "T", "author": [{"family": "F", "given": "G"}], "issued": {"date-parts": [[1999]]}}]')
    (tmp_path / "e.csl").write_text("nothing")
    got = I.import_records(spark, str(tmp_path / "*.json"), "records_json").collect()
    assert sorted((r.record_id or "", r.title or "", r.error or "") for r in got) == [("", "", 'not a list of records: {"record_id": "x"}'), ("x", "t", ""), ("y", "", "")]
    got = I.import_records(spark, str(tmp_path / "c.jsonl"), "json_lines").collect()
    assert sorted((r.record_id or "", r.error or "") for r in got) == [("", "not a record: [1]"), ("", "not a record: broken"), ("z", "")]
    got = I.import_records(spark, str(tmp_path / "*.csl"), "csl_json").collect()
    assert sorted((r.title or "", r.year or 0, tuple(r.authors or ()), r.error or "") for r in got) == [("", 0, (), "not a list of items: nothing"), ("T", 1999, ("F, G",), "")]


def test_unsupported(spark):
    with pytest.raises(I.UnsupportedFormatError):
        I.import_records(spark, "x", "csv")
    with pytest.raises(I.UnsupportedFormatError):
        I.rendered(records(spark), "word")


def test_csv_and_receipt(spark):
    r = records(spark)
    got = I.rendered(r, "csv")
    assert got.where("record_id = 'r2'").first().text == '"r2","B","","","","",""'
    receipt = I.conversion_receipt("rev", r, got, "ris", "csv", ("years dropped",))
    again = I.conversion_receipt("rev", r.orderBy(F.desc("title")), got, "ris", "csv", ("years dropped",))
    assert receipt["input_digest"] == again["input_digest"] != receipt["output_digest"] and receipt["records_written"] == 2
    assert I.conversion_receipt("rev", r.unionByName(r), got, "ris", "csv")["input_digest"] != receipt["input_digest"]
    with pytest.raises(ValueError):
        I.conversion_receipt("rev", r, got, "a", "b", ("w",), lossless=True)
    with pytest.raises(ValueError):
        I.conversion_receipt("rev", r.limit(1), got, "a", "b")
