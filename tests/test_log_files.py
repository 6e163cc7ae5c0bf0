"""The data source of log and zip files: parts, encodings, filters, refusals, and the stream."""

import zipfile

import pytest

from opslens.sources import log_events, log_files

HEAD = "26/01/20 14:12:2{}.100 {} --- [main] c.a.Start : up {}"


def _lines(n):
    return [HEAD.format(i % 10, ("INFO", "ERROR", "WARN")[i % 3], i) if i % 4 else f"  at frame {i} é" for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 100, 4096, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, size):
    lines = _lines(60) + ["", "last without end"]
    (tmp_path / "a.log").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "b.txt").write_text("not asked for")
    rows = log_files.load(spark, str(tmp_path), rangeBytes=size).collect()
    assert [r.text for r in sorted(rows, key=lambda r: (r.part, r.line))] == lines
    if size == 100:
        assert len({r.part for r in rows}) > 10 and all(r.level == (r.text.split()[2] if r.text[:2] == "26" else None) for r in rows)


def test_encodings_and_names(spark, tmp_path):
    for name, encoding in (("a.log", "utf-16"), ("sub.txt", "gbk")):
        (tmp_path / name).write_text("26/01/20 14:12:20.100 ERROR --- [m] c : 故障\r\nmore\r\n", encoding=encoding, newline="")
    told = lambda **o: sorted(r.text for r in log_files.load(spark, str(tmp_path), **o).collect())
    assert told(encoding="utf-16", rangeBytes=5) == ["26/01/20 14:12:20.100 ERROR --- [m] c : 故障", "more"]
    assert told(include="*.txt", encoding="gbk")[0].endswith("故障") and told(include="*.log,*.txt", exclude="*") == []
    assert "�" in told(include="*.txt")[0] and "�" not in told(include="*.txt", errors="ignore")[0]
    with pytest.raises(Exception, match="decode"):
        told(include="*.txt", errors="strict")


def test_members_of_a_zip_are_tasks_of_their_own(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(12):
            z.writestr(f"in/s{i}.log", "\n".join(_lines(20)))
    found = log_files.load(spark, str(tmp_path), kind="zip")
    assert found.rdd.getNumPartitions() == 12 and found.count() == 240
    one = found.filter("source_file = 'in/s3.log' and level = 'ERROR'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == sum(" ERROR " in x for x in _lines(20))
    assert found.filter("source_file like 'in/s1%'").count() == 60 and found.filter("level in ('WARN', 'INFO') and line < 3").count() == 12 * sum(x[:2] == "26" and " ERROR " not in x for x in _lines(2))
    for name, options in (("in/y.exe", {}), ("../y.log", {}), ("in/y.log", {"maxMembers": 0}), ("in/y.log", {"maxBytes": 3})):
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            z.writestr(name, "text of it")
        with pytest.raises(Exception, match="more than|refused"):
            log_files.load(spark, str(tmp_path), kind="zip", **options).count()


def test_events_go_through_the_source(spark, tmp_path):
    (tmp_path / "host1").mkdir()
    (tmp_path / "host1" / "orders-api-1.log").write_text("\n".join(_lines(40)))
    rows = log_events.read_logs(spark, str(tmp_path), rangeBytes=150).collect()
    assert len(rows) == sum(x[:2] == "26" for x in _lines(40)) and {r.service for r in rows} == {"orders-api"} and {r.instance for r in rows} == {"host1"}
    assert {r.source_line: r.raw_block for r in rows}[4] == "\n".join(_lines(40)[3:5])
    profile = {r.name: r.n for r in log_events.precheck(spark, str(tmp_path)).collect()}
    assert profile["lines"] == 40 and profile["header_lines"] == 30 and profile["unparsed_times"] == 0 and profile["level ERROR"] == sum(" ERROR " in x for x in _lines(40))


def test_what_is_appended_streams_in_whole_lines(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhal")
    query = log_files.load(spark, str(folder), stream=True, rangeBytes=3).writeStream.format("memory").queryName("appended").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    assert sorted(r.text for r in spark.table("appended").collect()) == ["one", "two"]
    with (folder / "a.log").open("a") as file:
        file.write("f\nthree\n")
    (folder / "b.log").write_text("other\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.text for r in spark.table("appended").collect()) == ["half", "one", "other", "three", "two"]
