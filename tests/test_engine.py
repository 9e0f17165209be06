"""Files to report: routing, limits, diagnostics, all detectors, reports, configuration and the command line."""

import json
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.model import ALERT, LOG_TYPES
from tidewatch.operators.detectors import BruteForce
from tidewatch.plans import cli, report
from tidewatch.plans.analyze import analyze_directory, analyze_paths, analyze_ssh_file, ordered_events, write
from tidewatch.sources import config, files, synthetic


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    synthetic.generate(spark, folder)
    return folder


@pytest.fixture(scope="module")
def analysis(spark, logs):
    return analyze_directory(spark, logs)


def test_all_detectors_fire(analysis):
    alerts = analysis.alert_list()
    assert {a.detector for a in alerts} == {"brute_force", "port_scan", "suspicious_login", "privilege_escalation", "impossible_travel", "unusual_traffic"}
    assert analysis.event_count == 103 and not analysis.diagnostic_list()
    ranks = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    keys = [(ranks.index(a.severity), a.time_start) for a in alerts]
    assert keys == sorted(keys)
    assert all(a.time_start.tzinfo for a in alerts)


def test_clean_log(spark, tmp_path):
    synthetic.generate(spark, tmp_path, "key_logins")
    assert analyze_directory(spark, tmp_path).alert_list() == ()


def test_events_in_order(spark, logs, tmp_path):
    one = tmp_path / "b_auth.log"
    one.write_text("Mar 10 02:00:01 h sshd[1]: Invalid user b from 1.1.1.1\nMar 10 02:00:00 h sshd[1]: Invalid user c from 1.1.1.1\n")
    two = tmp_path / "a_auth.log"
    two.write_text("Mar 10 02:00:00 h sshd[1]: Invalid user a from 1.1.1.1\n")
    rows = ordered_events(analyze_paths(spark, [one, two], detectors=[]).events).collect()
    assert [r.user for r in rows] == ["c", "a", "b"] and rows[0].source == str(one)


def test_routing(spark, tmp_path):
    make = lambda name, text: (tmp_path / name).write_text(text) and tmp_path / name
    ssh = "Mar 10 02:00:00 h sshd[1]: Invalid user b from 1.1.1.1\n"
    fw = "Mar 10 02:00:00 h kernel: DROP SRC=1.1.1.1 DPT=3\n"
    paths = [
        make("x1.log", ssh), make("x2.txt", fw), make("my_access.log", "nothing"), make("x3.log", "what\nis this\n"), make("win.csv", "﻿Event_ID,TimeCreated\n4624,2026-03-10T02:00:00Z\n"), make("other.csv", "a,b\n1,2\n"), tmp_path / "gone.log",
        make("big.log", ssh * 400), make("long_auth.log", "x" * 600 + "\n"), make("x4.log", "\n\n" + fw + ssh + ssh), make("x5.log", fw + ssh),
    ]
    routed = files.route(spark, paths, limits=files.Limits(20_000, 500))
    assert [(r.format, r.reason) for r in routed] == [
        ("ssh", None), ("firewall", None), ("web", None), (None, "unable to determine log format from filename or content"), ("windows", None), (None, "CSV file does not match the Windows Security Event Log schema"), (None, "path is not a file"),
        (None, "file exceeds maximum size of 20000 bytes"), (None, "line exceeds maximum length of 500 bytes"), ("ssh", None), (None, "unable to determine log format from filename or content"),
    ]
    assert [files.route(spark, [paths[0]], {paths[0]: x})[0].format for x in (*LOG_TYPES, "odd")] == [*LOG_TYPES, None]
    assert files.select_parser(spark, paths[0]) == ("ssh", None) and files.select_parser(spark, paths[0], "odd")[1] == "unknown explicit format 'odd'"
    result = analyze_paths(spark, paths[:7])
    assert result.files_skipped == (paths[3], paths[5], paths[6])
    assert [(d.path.name, d.message, d.format) for d in result.diagnostic_list()] == [
        ("my_access.log", "line 1: malformed or unsupported web line", "web"), ("x3.log", "unable to determine log format from filename or content", None), ("other.csv", "CSV file does not match the Windows Security Event Log schema", None), ("gone.log", "path is not a file", None),
    ]


def test_large_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Line ends of all kinds, long, empty and broken UTF-8 lines, cuts within them, marks at the start, odd names and a file given twice: numbers and lines are those of whole files."""
    rng = random.Random(3)
    bits = [b"a", "\u00e4\u20ac\U0001f600".encode() * 9, b"\xff\xe2\x82", b"\n", b"\r\n", b"\r", b"\n\r", b"\r\r\n", b"word " * 40, b"", b"\xef\xbb\xbf"]
    some = lambda n: b"".join(rng.choice(bits) for _ in range(n))
    made = {"a b.log": some(1500), "100% [x].log": b"\xef\xbb\xbf" + some(900), "c+%20d.log": some(700) + b"\n", "d.log": b"\xef\xbb\xbfone\r", "e.log": b"", "f.log": b"\n", "g.log": b"no end"}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    given = list(enumerate(tmp_path / n for n in [*made, "c+%20d.log"]))
    options = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        split = files.split_lines(spark, given)
        assert split.select("source").where(F.col("source").contains("100%")).count() > 0
        have = sorted(tuple(r[x] for x in ("source", "file_ord", "line_no", "line")) for r in split.collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    want = sorted(tuple(r) for r in files.scan_lines(files._contents(spark, given)).collect())
    assert len(have) > 1500 and have == want

    ssh, fw = "Mar 10 02:00:{:02d} h sshd[1]: Invalid user b from 1.1.1.1\n", "Mar 10 02:00:00 h kernel: DROP SRC=1.1.1.1 DPT=3\n"
    texts = {"x1.log": "".join(ssh.format(i % 60) for i in range(200)) + "what\n", "x2.txt": fw * 70, "x3.log": "is this\n" * 60, "x4.log": ssh.format(1) + "x" * 3000, "my_access.log": "none\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    told = {}
    for whole in (files.WHOLE, 100):
        monkeypatch.setattr(files, "WHOLE", whole)
        routed = files.route(spark, [tmp_path / n for n in texts], limits=files.Limits(max_line_length=2000))
        assert [r.large for r in routed] == [whole == 100] * 4 + [False]
        events, bad = files.read(spark, routed)
        told[whole] = [(r.format, r.reason) for r in routed], sorted(map(str, events.collect())), sorted(map(str, bad.collect()))
    a, b = told.values()
    assert a == b and len(a[1]) == 270 and len(a[2]) == 4
    assert a[0] == [("ssh", None), ("firewall", None), (None, "unable to determine log format from filename or content"), (None, "line exceeds maximum length of 2000 bytes"), ("web", None)]


def test_odd_names_and_stores(spark, tmp_path):
    line = "Mar 10 02:00:00 h sshd[1]: Invalid user b from 1.1.1.1\n"
    names = ["a b.log", "c%20d.log", "e[f]{g}*.log", "h,i?.log", "é.log"]
    for name in names:
        (tmp_path / name).write_text(line)
    (tmp_path / "w x.csv").write_text('"Event ID",TimeCreated\n4624,2026-03-10T02:00:00Z\n')
    paths = files.discover(tmp_path)
    routed = files.route(spark, [*paths, paths[0]])
    assert [r.format for r in routed] == [*("windows" if p.suffix == ".csv" else "ssh" for p in paths), "ssh"]
    events, _ = files.read(spark, routed)
    assert sorted((r.file_ord, r.source) for r in events.collect()) == [(r.ordinal, str(r.path)) for r in routed]
    uris = files.discover(f"file://{tmp_path}")
    assert [u.removeprefix("file:") for u in uris] == [str(p) for p in paths]
    again, bad = files.read(spark, files.route(spark, [*uris, f"file://{tmp_path}/gone.log"]))
    assert again.count() == len(uris) and [r.message for r in bad.collect()] == ["path is not a file"]
    for uri, error in ((f"file://{tmp_path}/none", FileNotFoundError), (uris[0], NotADirectoryError)):
        with pytest.raises(error):
            files.discover(uri)


def test_own_parser(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewatch.model import DIAGNOSTIC, EVENT

    def colons(lines):
        """user:kind lines, a minute each."""
        ok = F.col("line").rlike("^[a-z]+:[a-z_]+$")
        known = {"timestamp": F.timestamp_seconds(F.col("line_no") * 60), "log_type": F.lit("ssh"), "event_type": F.split_part("line", F.lit(":"), F.lit(2)), "user": F.split_part("line", F.lit(":"), F.lit(1))}
        kept = {x: F.col(x) for x in ("source", "file_ord", "line_no")}
        good = lines.where(ok).select(*((known | kept).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields))
        told = {"path": F.col("source"), "message": F.lit("no colon"), "format": F.lit("colons"), "file_ord": F.col("file_ord"), "line_no": F.col("line_no")}
        return good, lines.where(~ok).select(*(told[f.name].cast(f.dataType).alias(f.name) for f in DIAGNOSTIC.fields))

    p = tmp_path / "own.log"
    p.write_text("ann:login_failure\nwhat\nbob:login_success\n")
    result = analyze_paths(spark, [p], formats={p: "colons"}, own={"colons": colons}, detectors=[])
    assert [(r.user, r.event_type, r.line_no) for r in ordered_events(result.events).collect()] == [("ann", "login_failure", 1), ("bob", "login_success", 3)]
    assert [d.message for d in result.diagnostic_list()] == ["no colon"]
    result.release()
    assert not result.events.is_cached and analyze_paths(spark, [p], formats={p: "colons"}).files_skipped == (p,)
    replaced = analyze_paths(spark, [p], formats={p: "ssh"}, own={"ssh": colons}, detectors=[])
    assert replaced.event_count == 2


@pytest.mark.parametrize(("name", "kind"), [("SSHD.log", "ssh"), ("secure.txt", "ssh"), ("fw1.log", "firewall"), ("auth_fw.log", "ssh"), ("nginx.log", "web"), ("plain.log", None)])
def test_name_hints(name, kind):
    assert files.name_hint(Path(name)) == kind


def test_lines_and_bytes(spark, tmp_path):
    p = tmp_path / "auth.log"
    p.write_bytes(b"bad \xff\r\n\rMar 10 02:00:00 h sshd[1]: Invalid user \xff from 1.1.1.1")
    result = analyze_paths(spark, [p], detectors=[])
    assert [d.message[:7] for d in result.diagnostic_list()] == ["line 1:", "line 2:"]
    assert result.events.first().line_no == 3 and "�" in result.events.first().user
    empty = tmp_path / "empty_auth.log"
    empty.write_text("")
    assert analyze_paths(spark, [empty]).event_count == 0 and analyze_paths(spark, []).alert_list() == ()


def test_discovery(tmp_path):
    for name in ("b.LOG", "a.txt", "c.bin"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub.log").mkdir()
    assert [p.name for p in files.discover(tmp_path)] == ["a.txt", "b.LOG"]
    with pytest.raises(FileNotFoundError):
        files.discover(tmp_path / "none")
    with pytest.raises(NotADirectoryError):
        files.discover(tmp_path / "a.txt")


def test_own_detectors_and_locations(spark, logs):
    class Own:
        def detect(self, events):
            return events.limit(1).select(*(F.lit({"severity": "LOW", "title": "own"}.get(f.name)).cast(f.dataType).alias(f.name) for f in ALERT.fields[:-1]), F.array(F.lit(0).cast("long")).alias("ord"))

    assert [a.title for a in analyze_directory(spark, logs, detectors=[Own(), BruteForce()]).alert_list()] == ["Potential brute-force attack detected"] * 2 + ["own"]
    assert not [a for a in analyze_directory(spark, logs, locations={"9.9.9.9": (0, 0, "x")}).alert_list() if a.detector == "impossible_travel"]
    assert [a for a in analyze_directory(spark, logs, locations={}).alert_list() if a.detector == "impossible_travel"]
    assert len(analyze_ssh_file(spark, logs / "guessing.log")) == 1
    assert len(analyze_ssh_file(spark, logs / "guessing.log", threshold=10)) == 0


def test_sink(spark, analysis, tmp_path):
    write(analysis, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/events").where("log_type = 'web'").count() == 60
    assert spark.read.parquet(f"{tmp_path}/alerts").count() == len(analysis.alert_list())


def test_reports(analysis):
    text = report.text_report(analysis)
    assert text.startswith("Analysis report\n\nFiles processed:\n- ") and "Files skipped:\nNone\n" in text and "Parser diagnostics/errors:\nNone\n" in text
    data = json.loads(report.json_report(analysis))
    assert sorted(data) == ["alerts", "diagnostics", "event_count", "files_processed", "files_skipped"]
    assert data["alerts"][0]["time_start"].endswith("+00:00") and "ml_findings" not in data
    assert [a["title"] for a in data["alerts"]] == [a.title for a in analysis.alert_list()]


def test_alert_text():
    from tidewatch.model import Alert

    t = datetime(2026, 3, 10, 2, tzinfo=timezone.utc)
    text = report.alert_text(Alert("LOW", "T", "S token=abc", {"some_key": None, "when_at": t, "ips": ("a", "b")}, ("do",), ("1.1.1.1",), t, t, "d", "low"))
    assert text == "Severity: LOW\nDetector: d\nTitle: T\nSummary: S token=[REDACTED]\n\nObserved evidence:\nSome key: None\nWhen at: 2026-03-10T02:00:00+00:00\nIps: a, b\nSource IPs: 1.1.1.1\nTime range: 2026-03-10T02:00:00+00:00\nConfidence: low\n\nRecommended actions:\n1. do"
    bare = report.alert_text(Alert("LOW", "T", "S", {}, ()))
    assert "Observed evidence:\nNone supplied\nTime range: Not available\n\nRecommended actions:\nNone supplied" in bare


# -- configuration --


def test_configuration(tmp_path):
    assert config.load(None) == config.Config()
    p = tmp_path / "c.toml"
    p.write_text('[brute_force]\nthreshold = 3\n[report]\nminimum_severity = "HIGH"\n[input]\nmax_line_length = 9\n[ml.isolation_forest]\nn_estimators = 5\n[llm]\nenabled = true\n')
    c = config.load(p)
    assert c.detector_options["brute_force"] == {"threshold": 3} and set(c.detector_options) == set(config.DETECTORS)
    assert c.report_options == {"minimum_severity": "HIGH"} and c.input_limits.max_line_length == 9 and c.ml_options == {"isolation_forest": {"n_estimators": 5}} and c.llm_options == {"enabled": True}


@pytest.mark.parametrize(("text", "match"), [
    ("[odd]\n", "unknown configuration section"), ("brute_force = 1\n", "must be a table"), ("[report]\nx = 1\n", "unknown report option"), ('[report]\nminimum_severity = "odd"\n', "minimum_severity must be"), ("[input]\nmax_line_length = 0\n", "invalid input limits"),
    ("[input]\nx = 0\n", "unknown input option"), ("[ml.x]\n", "unknown ML"), ("[ml.isolation_forest]\nx = 1\n", "unknown isolation_forest"), ("[llm]\nenabled = 1\n", "true or false"), ('[llm]\nprovider = "x"\n', "provider"), ('[llm]\nmodel = " "\n', "model"),
    ("[llm]\ntimeout_seconds = 301\n", "timeout_seconds"), ("[llm]\ntimeout_seconds = true\n", "timeout_seconds"), ("not toml", "could not load"),
])
def test_configuration_errors(tmp_path, text, match):
    p = tmp_path / "c.toml"
    p.write_text(text)
    with pytest.raises(config.ConfigurationError, match=match):
        config.load(p)
    with pytest.raises(config.ConfigurationError, match="does not exist"):
        config.load(tmp_path / "none")


# -- command line --


def run(spark, *args):
    return cli.main(["analyze", *map(str, args)], spark)


def test_cli(spark, logs, tmp_path, capsys):
    out = tmp_path / "r.json"
    assert run(spark, "--logs", logs, "--format", "json", "--out", out, "--minimum-severity", "HIGH", "--timezone", "Asia/Tokyo", "--summarize") == 0
    data = json.loads(out.read_text())
    assert {a["severity"] for a in data["alerts"]} == {"HIGH", "CRITICAL"} and data["alerts"][0]["time_start"].endswith("+09:00")
    assert len(data["llm_summaries"]) == len(data["alerts"]) and {s["source"] for s in data["llm_summaries"]} == {"fallback"}
    assert run(spark, "--logs", logs / "guessing.log") == 0
    assert "Number of alerts: 1" in capsys.readouterr().out


def test_cli_failures(spark, logs, tmp_path, capsys):
    bad = tmp_path / "bad.toml"
    bad.write_text("[brute_force]\nthreshold = 0\n")
    odd = tmp_path / "odd.toml"
    odd.write_text("[brute_force]\nodd = 0\n")
    for args, message in (
        (("--logs", tmp_path / "none"), "does not exist"), (("--logs", tmp_path / "x"), "does not exist"), (("--logs", logs, "--config", tmp_path / "none"), "does not exist"), (("--logs", logs, "--config", bad), "invalid configuration values"),
        (("--logs", logs, "--config", odd), "invalid configuration values"), (("--logs", logs, "--timezone", "No/Where"), "unknown timezone"), (("--logs", logs, "--out", tmp_path / "no" / "r"), "could not write"), (("--logs", logs, "--enable-ml", "--ml-training-logs", logs), "must be separate"),
    ):
        assert run(spark, *args) == 1
        assert message in capsys.readouterr().err
    for args in (("--logs", logs, "--enable-ml"), ("--logs", logs, "--ml-training-logs", logs), ("--logs", logs, "--format", "x"), ()):
        with pytest.raises(SystemExit) as e:
            run(spark, *args)
        assert e.value.code == 2
    (tmp_path / "nothing").mkdir()
    assert run(spark, "--logs", tmp_path / "nothing") == 1


def test_synthetic(spark, tmp_path):
    one, two, three = (synthetic.generate(spark, tmp_path / str(i), units=2, seed=s) for i, s in enumerate((5, 5, 6)))
    assert [p.read_bytes() for p in one.values()] == [p.read_bytes() for p in two.values()] != [p.read_bytes() for p in three.values()]
    assert {k: len(p.read_text().splitlines()) for k, p in one.items()} == {k: 2 * x.lines + (x.kind == "windows") for k, x in synthetic.scenarios().items()}
    assert synthetic.lines(spark, "port_sweep", units=3000).count() == 48_000
    with pytest.raises(ValueError):
        synthetic.generate(spark, tmp_path, "odd")
