"""Lines and records of each format, field by field, and what is rejected."""

from datetime import datetime

import pytest

from tidewatch.plans.analyze import parse_lines

AT = "Mar 10 02:00:00 host "


def one(spark, log_format, line):
    good, bad = parse_lines(spark, log_format, [line])
    rows = good.collect()
    assert len(rows) + bad.count() == 1
    return rows[0].asDict() if rows else None


@pytest.mark.parametrize(("line", "kind", "status", "user", "ip", "method"), [
    ("sshd[1]: Failed password for root from 192.0.2.1 port 22 ssh2", "login_failure", "failure", "root", "192.0.2.1", "password"),
    ("sshd[1]: Failed password for invalid user bob from 2001:db8::1 port 9 ssh2", "login_failure", "failure", "bob", "2001:db8::1", "password"),
    ("sshd[1]: Accepted password for al from 192.0.2.2 port 22 ssh2", "login_success", "success", "al", "192.0.2.2", "password"),
    ("sshd: Accepted publickey for al from 192.0.2.2", "login_success", "success", "al", "192.0.2.2", "publickey"),
    ("sshd[1]: Invalid user eve from 192.0.2.3 port 1", "login_failure", "failure", "eve", "192.0.2.3", None),
])
def test_ssh_logins(spark, line, kind, status, user, ip, method):
    e = one(spark, "ssh", AT + line)
    assert (e["event_type"], e["status"], e["user"], e["src_ip"], e["log_type"]) == (kind, status, user, ip, "ssh")
    assert e["metadata"].get("authentication_method") == method and e["metadata"]["service"] == "sshd"
    assert e["timestamp"] == datetime(2026, 3, 10, 2)


def test_ssh_actions(spark):
    e = one(spark, "ssh", AT + "sudo: alice : TTY=pts/0 ; password=secret COMMAND=/bin/ls")
    assert (e["event_type"], e["user"], e["status"], e["metadata"]) == ("privilege_action", "alice", "executed", {"action": "sudo", "service": "sudo"})
    assert "secret" not in e["raw_line"] and "password=[REDACTED]" in e["raw_line"]
    assert one(spark, "ssh", AT + "su: (to root) bob on pts/1")["user"] == "root"
    assert one(spark, "ssh", AT + "sudo[12]: alice : TTY") is None


@pytest.mark.parametrize("line", ["", "nonsense", "Feb 29 02:00:00 h sshd[1]: Failed password for a from b", "Mar 99 02:00:00 h sshd[1]: Failed password for a from b", "mar 10 02:00:00 h sshd: Invalid user a from b", " Mar 10 02:00:00 h sshd: Invalid user a from b", AT + "cron[1]: job"])
def test_ssh_rejects(spark, line):
    assert one(spark, "ssh", line) is None


def test_single_digit_day_and_year(spark):
    good, _ = parse_lines(spark, "ssh", ["Mar  1 02:00:00 h sshd[1]: Invalid user a from b"], year=2024)
    assert good.first().timestamp == datetime(2024, 3, 1, 2)


def test_firewall(spark):
    e = one(spark, "firewall", AT + "kernel: DROP IN=eth0 OUT= SRC=192.0.2.9 DST=198.51.100.1 LEN=60 PROTO=tcp SPT=4000 DPT=443 PKTS=3")
    assert (e["src_ip"], e["dst_ip"], e["dst_port"], e["protocol"], e["status"], e["bytes_sent"]) == ("192.0.2.9", "198.51.100.1", 443, "TCP", "dropped", 60)
    assert e["metadata"] == {"in_interface": "eth0", "src_port": "4000", "packet_count": "3"}


@pytest.mark.parametrize(("word", "status"), [("ACCEPT", "accepted"), ("allowed", "accepted"), ("REJECT", "denied"), ("DENY", "denied"), ("BLOCK", "dropped"), ("seen", "unknown"), ("DROP ACCEPT", "accepted")])
def test_firewall_status(spark, word, status):
    assert one(spark, "firewall", f"{AT}kernel: {word} SRC=1.2.3.4")["status"] == status


@pytest.mark.parametrize(("pairs", "size"), [("LEN=0 BYTES=7", 7), ("LEN=0", None), ("LEN=0 BYTES=0", 0), ("LEN=x BYTES=5", 5), ("LEN=1_0", 10), ("BYTES=-2", -2), ("", None)])
def test_firewall_sizes(spark, pairs, size):
    assert one(spark, "firewall", f"{AT}kernel: SRC=1.2.3.4 {pairs}")["bytes_sent"] == size


def test_firewall_last_pair_counts_and_rejects(spark):
    e = one(spark, "firewall", AT + "fw: dpt=1 DPT=2 SRC= src=9.9.9.9 DPT=3x")
    assert (e["dst_port"], e["src_ip"], e["dst_ip"]) == (None, "9.9.9.9", None)
    assert one(spark, "firewall", AT + "fw: DST=")["dst_ip"] == ""
    assert one(spark, "firewall", AT + "fw: LEN=60 IN=eth0") is None


def test_web(spark):
    e = one(spark, "web", '192.0.2.4 id bob [10/Mar/2026:04:00:00 +0200] "GET /a?token=abc HTTP/1.1" 404 0 "http://r.example/?token=x" "agent/1" tail')
    assert (e["timestamp"], e["src_ip"], e["user"], e["status"], e["bytes_sent"], e["path"]) == (datetime(2026, 3, 10, 2), "192.0.2.4", "bob", "404", 0, "/a?token=[REDACTED]")
    assert e["metadata"] == {"ident": "id", "protocol_version": "HTTP/1.1", "referrer": "http://r.example/?token=[REDACTED]", "user_agent": "agent/1", "method": "GET"}


def test_web_gaps(spark):
    e = one(spark, "web", '  1.1.1.1 - - [10/Mar/2026:02:00:00 +00:00] "garbage" - -')
    assert (e["user"], e["status"], e["bytes_sent"], e["path"], e["metadata"]) == (None, None, None, None, {})
    for bad in ('1.1.1.1 - - [bad] "GET / HTTP/1.1" 200 1', "1.1.1.1 - -", '1.1.1.1 - - [10/Mar/2026:02:00:00 +0000] "GET / HTTP/1.1" 20 1'):
        assert one(spark, "web", bad) is None


HEADER = "EventID,TimeCreated,Computer,IpAddress,TargetUserName,SubjectUserName,NewProcessId,MemberName,Group Name"


def windows(spark, *rows, header=HEADER):
    good, bad = parse_lines(spark, "windows", [header, *rows])
    return [r.asDict() for r in good.orderBy("line_no").collect()], [(r.line_no, r.message) for r in bad.orderBy("line_no").collect()]


def test_windows(spark):
    good, bad = windows(
        spark, "4624,2026-03-10T02:00:00.1234567Z,pc,192.0.2.5,al,-,-,-,-", '4688,2026-03-10 02:01:00+02:00,pc,-,t,"last, first",0x7a4,,', "4720,2026-03-10T02:02:00,pc,-,new,adm,-,m,Admins",
        "4672,2026-03-10T02:00:00Z,pc,-,-,SYSTEM,010,m,g", "9999,20260310T021403Z,pc,,a,b", "x", "4625,never,pc,-,a,b,-,-,-", "4625,2026-03-10T02:00:00Z,a,b,c,d,e,f,g,h,i",
    )
    assert [(r["event_type"], r["user"], r["status"]) for r in good] == [("login_success", "al", "success"), ("process_creation", "last, first", None), ("user_created", "new", None), ("privilege_assignment", "SYSTEM", None), ("windows_event", "a", None)]
    assert [r["timestamp"] for r in good] == [datetime(2026, 3, 10, 2, 0, 0, 123456), datetime(2026, 3, 10, 0, 1), datetime(2026, 3, 10, 2, 2), datetime(2026, 3, 10, 2), datetime(2026, 3, 10, 2, 14, 3)]
    assert good[0]["src_ip"] == "192.0.2.5" and good[1]["metadata"]["new_process_id"] == "1956" and good[3]["metadata"]["new_process_id"] == "010"
    assert good[2]["metadata"]["member_name"] == "m" and "member_name" not in good[3]["metadata"]
    assert bad == [(7, "line 7: malformed Windows Event Log row"), (8, "line 8: malformed Windows Event Log row"), (9, "line 9: malformed Windows CSV row")]


def test_windows_headers_and_quotes(spark):
    good, bad = windows(spark, '4624,"2026-03-10T02:00:00Z","say ""hi""\nthere",x', "", "4624,2026-03-10T02:00:00Z,pc,second", header="event_id, Time Created ,Computer,computer".replace(" Time Created ", "timestamp"))
    assert [r["metadata"].get("computer") for r in good] == ["x", "second"] and not bad
    assert [r["line_no"] for r in good] == [2, 3]


def test_windows_later_column_counts_even_if_missing(spark):
    good, _ = windows(spark, "4624,2026-03-10T02:00:00Z,pc", header="event_id,timestamp,Computer,computer")
    assert "computer" not in good[0]["metadata"]
