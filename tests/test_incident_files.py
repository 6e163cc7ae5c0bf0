"""Bundles read from written files, and artifacts read back."""

import json

import pytest

from opslens.sources import incident_files

EVENTS = "timestamp,level,service,trace_id,message,root_cause\n1,INFO,a,t1,hi,\n2,ERROR,b,t1,\"lost, again\",\n3,ERROR,c,t2,gone,cause\n4,INFO,c,t1,bye,\n"


def test_incidents_csv(spark, tmp_path):
    (tmp_path / "incidents.csv").write_text('﻿incident_id,start,fault_start,services,trace_ids\nA,1,,"[""x"", "" "", ""y""]","p，q; r"\n,2,3,,\n', encoding="utf-8")
    got = {r.incident_id: r for r in incident_files.read_bundle(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "I00002"}
    assert got["A"].fault_start == "1" and got["A"].services == ["x", "y"] and got["A"].trace_ids == ["p", "q", "r"]
    assert got["I00002"].fault_start == "3" and got["I00002"].detected_window_start == "2" and got["I00002"].services == []


def test_events_csv(spark, tmp_path):
    (tmp_path / "events.csv").write_text(EVENTS)
    detail = incident_files.read_bundle(spark, str(tmp_path), "b1").first()
    assert (detail.incident_id, detail.source_incident_id, detail.primary_trace_id, detail.root_cause_candidate) == ("b1:I00001", "I00001", "t1", "lost, again")
    assert (detail.fault_start, detail.fault_end, detail.services) == ("1", "4", ["a", "b", "c"])
    rows = incident_files.read_csv(spark, str(tmp_path / "events.csv"))
    assert [r.place for r in incident_files.from_events(rows)[1].orderBy("place").collect()] == [1, 2, 4]
    _, timeline = incident_files.from_events(rows.withColumn("trace_id", rows.trace_id.substr(9, 1)), most=1)
    assert [r.place for r in timeline.collect()] == [2]
    assert incident_files.from_events(rows.filter("level = 'INFO'"))[0].count() == 0


def test_details_come_first(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "events.csv").write_text(EVENTS)
    (tmp_path / "sub" / "incident_details.json").write_text(json.dumps([{"incident_id": "I1", "services": ["a"]}, {"incident_id": "I2", "fault_start": "7"}]))
    assert {(r.incident_id, r.fault_start, len(r.services)) for r in incident_files.read_bundle(spark, str(tmp_path)).collect()} == {("I1", "", 1), ("I2", "7", 0)}
    (tmp_path / "sub" / "incident_details.json").write_text("[]")
    assert incident_files.read_bundle(spark, str(tmp_path)).first().incident_id == "I00001"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "other.txt").write_text("x")
    with pytest.raises(ValueError):
        incident_files.read_bundle(spark, str(tmp_path / "none"))


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("I1", ["a", "b"], 'said "x", y'), ("I2", [], None)], "incident_id string, services array<string>, root_cause_candidate string")
    incident_files.write_artifacts({"kept": rows, "incidents": rows}, str(tmp_path), csv=("incidents",))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
    back = {r.incident_id: r for r in incident_files.from_incidents(incident_files.read_csv(spark, str(tmp_path / "incidents"))).collect()}
    assert back["I1"].services == ["a", "b"] and back["I1"].root_cause_candidate == 'said "x", y' and back["I2"].services == []
    assert "- regions: 3" in incident_files.run_report(spark.sql("select 3 as regions"))
    found = spark.sql("select 'I1' as incident, 2 as rank, 'b' as candidate, 'timeout' as fault_mode, 0.5 as score, 'suspected' as status union all select 'I1', 1, 'a', null, 0.75, 'probable'")
    assert incident_files.analysis_report(found).first().text == "## I1\n\n1. a —  (0.750, probable)\n2. b — timeout (0.500, suspected)"
