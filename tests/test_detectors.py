"""Detectors at, above and just below their thresholds, with ties, and against plain-Python counterparts."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.model import EVENT
from tidewatch.operators import alerts as A
from tidewatch.operators import frames
from tidewatch.operators.detectors import BruteForce, ImpossibleTravel, PortScan, SuspiciousLogin, UnusualTraffic
from tidewatch.operators.privilege import PRIVILEGED_GROUPS, PrivilegeEscalation

T0 = datetime(2026, 3, 10, 2, 0)  # a Tuesday


def event(minutes=0.0, line=0, **own):
    base = {"timestamp": T0 + timedelta(minutes=minutes), "source": "t", "log_type": "ssh", "event_type": "login_failure", "metadata": {}, "file_ord": 0, "line_no": line}
    return base | own


def frame(spark, events):
    rows = [tuple({"line_no": i, **e}.get(f) if e.get("line_no") or f != "line_no" else i for f in EVENT.fieldNames()) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, EVENT)


def found(spark, detector, events):
    return A.to_driver(detector.detect(frame(spark, events)))


def failed(minutes, ip="192.0.2.1", user="bob", **own):
    return event(minutes, src_ip=ip, user=user, status="failure", **own)


def passed(minutes, ip="192.0.2.1", user="bob", **own):
    return event(minutes, event_type="login_success", src_ip=ip, user=user, status="success", **own)


# -- failures --


@pytest.mark.parametrize(("n", "gap", "alerts"), [(4, 1, 0), (5, 1, 1), (12, 1, 1), (5, 1.25, 1), (5, 1.26, 0), (9, 6, 0)])
def test_brute_force(spark, n, gap, alerts):
    out = found(spark, BruteForce(), [failed(i * gap) for i in range(n)])
    assert len(out) == alerts
    if out:
        assert (out[0].severity, out[0].evidence["observed_count"], out[0].source_ips) == ("HIGH", 5, ("192.0.2.1",))
        assert out[0].time_end - out[0].time_start == timedelta(minutes=4 * gap)


def test_brute_force_groups(spark):
    events = [failed(i, user=u) for i in range(5) for u in (None, "a")] + [failed(i, ip="") for i in range(6)] + [failed(i, log_type="windows", ip="1.1.1.1") for i in range(6)]
    out = found(spark, BruteForce(), events)
    assert [x.evidence["username"] for x in out] == [None, "a"]


def test_brute_force_ties_and_options(spark):
    assert len(found(spark, BruteForce(), [failed(0) for _ in range(5)])) == 1
    assert len(found(spark, BruteForce(threshold=1), [failed(0), failed(9)])) == 1
    for bad in ({"threshold": 0}, {"window_minutes": 0}):
        with pytest.raises(ValueError):
            BruteForce(**bad)


# -- scans --


def connection(seconds, port, host="198.51.100.1", status="denied", ip="203.0.113.9"):
    return event(seconds / 60, log_type="firewall", event_type="network_connection", src_ip=ip, dst_ip=host, dst_port=port, status=status)


@pytest.mark.parametrize(("ports", "gap", "hosts", "denied", "severity"), [(9, 1, 1, 9, None), (10, 1, 1, 10, "MEDIUM"), (25, 1, 1, 25, "HIGH"), (50, 1, 2, 50, "CRITICAL"), (50, 1, 2, 40, "CRITICAL"), (50, 1, 2, 39, "HIGH"), (50, 1, 1, 50, "HIGH"), (10, 6.6, 1, 10, "MEDIUM"), (10, 6.7, 1, 10, None)])
def test_port_scan(spark, ports, gap, hosts, denied, severity):
    events = [connection(i * gap, 1000 + i, f"10.0.0.{i % hosts}", "denied" if i < denied else "accepted") for i in range(ports)]
    out = found(spark, PortScan(), events)
    assert [x.severity for x in out] == ([severity] if severity else [])
    if severity == "MEDIUM":
        assert out[0].evidence["distinct_destination_ports"] == 10 and out[0].evidence["threshold_crossed"] == "medium"


def plain_scans(events, window, medium, high, critical, hosts, ratio):
    best = {}
    by = {}
    for e in sorted(events, key=lambda e: e["timestamp"]):
        by.setdefault(e["src_ip"], []).append(e)
    for ip, own in by.items():
        for i, e in enumerate(own):
            w = [x for x in own[: i + 1] if e["timestamp"] - x["timestamp"] <= timedelta(seconds=window)]
            p, h = len({x["dst_port"] for x in w}), len({x["dst_ip"] for x in w if x["dst_ip"]})
            d = sum(x["status"] in ("denied", "dropped") for x in w) / len(w)
            if p >= medium:
                level = 3 if p >= critical and h >= hosts and d >= ratio else 2 if p >= high else 1
                if ip not in best or level > best[ip][0]:
                    best[ip] = (level, p, h, len(w), w[0]["timestamp"], e["timestamp"])
    return best


def test_port_scan_against_plain_python(spark):
    rng = random.Random(6)
    events = [connection(rng.randrange(0, 60), rng.randrange(12), rng.choice(["a", "b", "", None]), rng.choice(["denied", "accepted", "dropped"]), f"10.0.0.{rng.randrange(3)}") for _ in range(150)]
    want = plain_scans(events, 10, 3, 5, 7, 2, 0.5)
    out = found(spark, PortScan(10, 3, 5, 7, 2, 0.5), events)
    utc = lambda t: t.replace(tzinfo=timezone.utc)
    have = {x.source_ips[0]: (["MEDIUM", "HIGH", "CRITICAL"].index(x.severity) + 1, x.evidence["distinct_destination_ports"], x.evidence["distinct_destination_hosts"], x.time_start, x.time_end) for x in out}
    assert have == {k: (*v[:3], utc(v[4]), utc(v[5])) for k, v in want.items()}


# -- logins --


@pytest.mark.parametrize(("n", "after", "severity"), [(2, 1, None), (3, 1, "HIGH"), (5, 1, "HIGH"), (6, 1, "CRITICAL"), (3, 8, "HIGH"), (3, 8.1, None)])
def test_success_after_failures(spark, n, after, severity):
    out = found(spark, SuspiciousLogin(), [failed(i, user=f"u{i}") for i in range(n)] + [passed(n - 1 + after, user=None)])
    assert [x.severity for x in out] == ([severity] if severity else [])
    if out:
        assert out[0].evidence["username"] == f"u{n - 1}" and out[0].evidence["failed_attempts_count"] == n


def test_failures_count_before_the_login_alone(spark):
    tied = [failed(0), failed(0), passed(0), failed(0), passed(0)]
    assert [x.evidence["failed_attempts_count"] for x in found(spark, SuspiciousLogin(), tied)] == [3]


def test_many_accounts(spark):
    events = [passed(i * 5, user=u) for i, u in enumerate(["a", "b", "b", "c", "d"])] + [passed(i, ip="1.1.1.1", user="x") for i in range(4)]
    out = found(spark, SuspiciousLogin(), events)
    assert [(x.title, x.evidence["users"]) for x in out] == [("Multiple account logins from single source", ["a", "b", "c"])]
    assert not found(spark, SuspiciousLogin(), [passed(i * 8, user=u) for i, u in enumerate("abcd")])


def test_off_hours(spark):
    days = [passed(-60 * 24 * 3), passed(0), passed(60 * 6), passed(60 * 15.99), passed(60 * 16)]  # Saturday, then 02:00, 08:00, 17:59 and 18:00
    assert not found(spark, SuspiciousLogin(), days)
    out = found(spark, SuspiciousLogin(enable_off_hours=True), days)
    assert [(x.evidence["is_weekend"], x.time_start.hour) for x in out] == [(True, 2), (False, 2), (False, 18)]
    with pytest.raises(ValueError):
        SuspiciousLogin(normal_hours_start=9, normal_hours_end=9)


# -- travel --

PLACES = {"1.1.1.1": (40.7128, -74.006, "New York"), "2.2.2.2": (51.5074, -0.1278, "London"), "3.3.3.3": (40.8, -74.0, "near"), "10.0.0.1": (0, 0, "home"), "bad": (99, 0, "no"), "x": ("a", 1, "no"), "y": (1, 2), "z": (1, 2, "")}


@pytest.mark.parametrize(("gap", "n"), [(15, 1), (600, 0), (0, 0), (371.0, 1), (372.0, 0)])
def test_travel(spark, gap, n):
    out = found(spark, ImpossibleTravel(PLACES), [passed(0, "1.1.1.1"), passed(gap, "2.2.2.2")])
    assert len(out) == n
    if gap == 15:
        assert out[0].evidence["distance_km"] == pytest.approx(5570.23, abs=0.01) and out[0].source_ips == ("1.1.1.1", "2.2.2.2")


def test_travel_pairs(spark):
    assert not found(spark, ImpossibleTravel(PLACES), [passed(0, "1.1.1.1"), passed(5, "9.9.9.9"), passed(9, "2.2.2.2")])  # an unknown place stands between
    assert not found(spark, ImpossibleTravel(PLACES), [passed(0, "1.1.1.1"), passed(1, "3.3.3.3")])  # too near
    assert not found(spark, ImpossibleTravel(PLACES), [passed(0, "1.1.1.1"), passed(1, "2.2.2.2", user="al")])
    events = [passed(0, "1.1.1.1"), passed(1, "10.0.0.1"), passed(2, "2.2.2.2")]
    assert len(found(spark, ImpossibleTravel(PLACES), events)) == 2
    assert [x.source_ips for x in found(spark, ImpossibleTravel(PLACES, ignore_private_ips=True), events)] == [("1.1.1.1", "2.2.2.2")]
    assert not found(spark, ImpossibleTravel({}), events)
    for bad in ({"max_speed_kmh": 0}, {"min_distance_km": -1}, {"min_elapsed_minutes": float("nan")}):
        with pytest.raises(ValueError):
            ImpossibleTravel(PLACES, **bad)


# -- traffic --


def requests(counts, **own):
    return [event(5 * i + 0.01 * k, log_type="web", event_type="http_request", src_ip="192.0.2.44", status="200", path=f"/{k % 3}", bytes_sent=10) | own for i, n in enumerate(counts) for k in range(n)]


@pytest.mark.parametrize(("last", "severity"), [(10, None), (11, "MEDIUM"), (14, "HIGH"), (50, "CRITICAL")])
def test_traffic_scores(spark, last, severity):
    out = found(spark, UnusualTraffic(), requests([1, 6, 6, 6, 6, last]))
    assert [x.severity for x in out] == ([severity] if severity else [])
    if last == 11:
        assert out[0].evidence["score"] == 3.0
        assert out[0].evidence | {"score": 0} == out[0].evidence | {"observed_count": 11, "distinct_paths": 3, "bytes_sent_total": 110, "status_code_distribution": {"200": 11}, "baseline_sample_count": 5, "score": 0}


def test_traffic_groups_and_quartiles(spark):
    assert not found(spark, UnusualTraffic(), requests([1, 1, 1, 1, 50]))  # four buckets before it
    assert found(spark, UnusualTraffic(), requests([2, 2, 2, 2, 2, 3]))[0].severity == "CRITICAL"  # no spread
    iqr = found(spark, UnusualTraffic(statistical_method="iqr", min_baseline_buckets=4), requests([1, 2, 4, 9, 20]))
    assert iqr[0].evidence["baseline_statistic"] == 3.0 and iqr[0].evidence["score"] == pytest.approx(17 / 3.5)
    by = found(spark, UnusualTraffic(grouping="service"), requests([2, 2, 2, 2, 2, 30], src_ip=None))
    assert by[0].evidence["service"] == "web" and by[0].source_ips == ()
    both = found(spark, UnusualTraffic(grouping="source_ip_service"), requests([2, 2, 2, 2, 2, 30]))
    assert list(both[0].evidence)[:3] == ["source_ip", "service", "grouping"]
    for bad in ({"grouping": "x"}, {"statistical_method": "x"}, {"high_multiplier": 1}, {"critical_multiplier": 1.5}, {"event_types": ()}, {"min_baseline_buckets": 1}):
        with pytest.raises(ValueError):
            UnusualTraffic(**bad)


# -- privileges --


def win(minutes, kind, user="al", computer="pc", ip=None, **meta):
    ids = {"user_created": "4720", "privileged_group_membership": "4732", "privilege_assignment": "4672", "process_creation": "4688", "login_failure": "4625"}
    return event(minutes, log_type="windows", event_type=kind, user=user, src_ip=ip, metadata={"event_id": ids[kind], "computer": computer} | meta)


def joined(minutes, member="al", group="Administrators", **own):
    return win(minutes, "privileged_group_membership", user=group, member_name=member, **own)


def titles(spark, events, **options):
    return [(x.severity, x.evidence["rule"]) for x in found(spark, PrivilegeEscalation(**options), events)]


def test_privilege_stages(spark):
    new, group, act = win(0, "user_created"), joined(10), win(20, "privilege_assignment")
    assert titles(spark, [new, group, act]) == [("CRITICAL", "privilege_escalation_chain")]
    assert titles(spark, [new, group]) == [("HIGH", "account_created_then_privileged_group_membership")]
    assert titles(spark, [group, act]) == [("HIGH", "privileged_group_membership_followed_by_activity")]
    assert titles(spark, [new, act]) == [("HIGH", "privileged_activity_following_new_account")]
    assert titles(spark, [win(0, "login_failure"), win(5, "process_creation")]) == [("HIGH", "process_creation_after_suspicious_login")]
    assert titles(spark, [win(0, "login_failure"), win(5, "privilege_assignment")]) == [("HIGH", "privilege_assignment_after_suspicious_login")]
    assert titles(spark, [new]) == [("LOW", "isolated_account_created")]
    assert titles(spark, [group]) == [("MEDIUM", "isolated_privileged_group_membership")]
    assert titles(spark, [act]) == [("LOW", "isolated_privilege_assignment")]
    assert titles(spark, [win(0, "process_creation")]) == []
    sudo = event(0, event_type="privilege_action", user="al", status="executed", metadata={"action": "sudo"})
    assert titles(spark, [sudo]) == [("LOW", "isolated_sudo_activity")]


def test_privilege_windows_and_contexts(spark):
    assert titles(spark, [win(0, "user_created"), joined(30)])[0][1].startswith("account_created")
    assert len(titles(spark, [win(0, "user_created"), joined(31)])) == 2
    assert len(titles(spark, [win(0, "user_created", computer="other"), joined(1)])) == 2
    assert len(titles(spark, [win(0, "user_created", computer=None), joined(1)])) == 2
    assert len(titles(spark, [win(0, "user_created", computer=None, ip="1.1.1.1"), joined(1, ip="1.1.1.1")])) == 1
    assert len(titles(spark, [win(0, "user_created", computer=None), joined(1, computer=None)])) == 1
    assert len(titles(spark, [win(0, "user_created", user=None), joined(1, member=None)])) == 2
    assert titles(spark, [win(0, "user_created", user="AL", computer="PC"), joined(1)])[0][1].startswith("account_created")
    assert titles(spark, [joined(0, group="Users")]) == []
    assert titles(spark, [win(0, "user_created"), joined(1), win(2, "privilege_assignment")], known_administrative_accounts=["AL"]) == [("HIGH", "privilege_escalation_chain")]
    with pytest.raises(ValueError):
        PrivilegeEscalation(correlation_window_minutes=0)


def plain_privileges(events, window, process_window):
    """The same stages over all records at once, with sets of used indexes."""
    rec = sorted(range(len(events)), key=lambda i: events[i]["timestamp"])
    meta = lambda i, k: events[i]["metadata"].get(k)
    group_name = lambda i: meta(i, "group_name") or meta(i, "target_user") or events[i]["user"]
    kind = lambda k: [i for i in rec if events[i]["event_type"] == k]
    created, assigned, process, failures = kind("user_created"), kind("privilege_assignment"), kind("process_creation"), kind("login_failure")
    groups = [i for i in kind("privileged_group_membership") if group_name(i) and group_name(i).lower() in PRIVILEGED_GROUPS]
    actions = [i for i in kind("privilege_action") if events[i]["log_type"] == "ssh"]
    activity = sorted(assigned + process + actions, key=lambda i: events[i]["timestamp"])
    account = lambda i: (meta(i, "member_name") or events[i]["user"]) if i in groups else events[i]["user"]
    used, out = set(), []

    def near(lead, options, minutes, sign, exclude=True):
        best = None
        for i in options:
            a, b = account(lead), account(i)
            if (exclude and i in used) or a is None or b is None or a.lower() != b.lower():
                continue
            hosts = [meta(lead, "computer"), meta(i, "computer")]
            ips = [events[lead].get("src_ip"), events[i].get("src_ip")]
            fits = hosts[0].lower() == hosts[1].lower() if all(hosts) else ips[0] == ips[1] if all(ips) else not any(hosts)
            gap = (events[i]["timestamp"] - events[lead]["timestamp"]) * sign
            if fits and timedelta(0) <= gap <= timedelta(minutes=minutes) and (best is None or gap < best[0]):
                best = (gap, i)
        return best and best[1]

    def emit(rule, *members):
        out.append((rule, events[members[0]]["timestamp"], events[members[-1]]["timestamp"], account(members[-1] if "login" in rule else members[0])))

    for g in groups:
        c = near(g, created, window, -1)
        a = near(g, activity, window, 1) if c is not None else None
        if a is not None:
            emit("privilege_escalation_chain", c, g, a)
            used |= {c, g, a}
    for g in groups:
        if g not in used and (c := near(g, created, window, -1)) is not None:
            emit("account_created_then_privileged_group_membership", c, g)
            used |= {c, g}
    for g in groups:
        if g not in used and (a := near(g, activity, window, 1)) is not None:
            emit("privileged_group_membership_followed_by_activity", g, a)
            used |= {g, a}
    for c in created:
        if c not in used and (a := near(c, activity, window, 1)) is not None:
            emit("privileged_activity_following_new_account", c, a)
            used |= {c, a}
    for p in process:
        if p not in used and (x := near(p, failures + assigned, process_window, -1, False)) is not None:
            emit("process_creation_after_suspicious_login", x, p)
            used |= {p, x}
    for a in assigned:
        if a not in used and (x := near(a, failures, process_window, -1, False)) is not None:
            emit("privilege_assignment_after_suspicious_login", x, a)
            used |= {a}
    for own, rule in ((created, "isolated_account_created"), (groups, "isolated_privileged_group_membership"), (assigned, "isolated_privilege_assignment"), (actions, "isolated_sudo_activity")):
        for i in own:
            if i not in used:
                emit(rule, i)
    return out


def privilege_events(n, minutes, seed=12, accounts=("a", "A", "b", "c", None)):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        kind = rng.choice(["user_created", "privileged_group_membership", "privilege_assignment", "process_creation", "login_failure", "privilege_action"])
        own = {"event_id": f"e{i}"} | ({"computer": c} if (c := rng.choice(["pc", "PC", "lab", None])) else {})
        if kind == "privileged_group_membership":
            own |= {"group_name": rng.choice(["Administrators", "Users"]), "member_name": rng.choice([x for x in ("a", "B", "c") if x in (*accounts, "B")])}
        if kind == "privilege_action":
            own |= {"action": "sudo"}
        events.append(event(rng.randrange(0, minutes), log_type="ssh" if kind == "privilege_action" else "windows", event_type=kind, user=rng.choice(accounts), src_ip=rng.choice(["1.1.1.1", "2.2.2.2", None]), metadata=own))
    return events


def same_privileges(spark, events, **blocks):
    out = found(spark, PrivilegeEscalation(10, 5, **blocks), events)
    naive = lambda t: t.replace(tzinfo=None)
    have = [(x.evidence["rule"], naive(x.time_start), naive(x.time_end), (x.evidence["username"] or "").lower()) for x in out]
    want = [(r, s, e, (a or "").lower()) for r, s, e, a in plain_privileges(events, 10, 5)]
    assert sorted(have) == sorted(want)
    return {x[0] for x in have}


@pytest.mark.parametrize("blocks", [{}, {"block_windows": 5, "margin_windows": 7}, {"block_windows": 9, "margin_windows": 20}])
def test_privileges_against_plain_python(spark, blocks):
    assert len(same_privileges(spark, privilege_events(220, 400), **blocks)) == 10


def test_an_account_that_never_pauses(spark, monkeypatch):
    """One account holds nearly all records, without a gap over the window: blocks of it are folded apart and agree."""
    folds = []
    monkeypatch.setattr(PrivilegeEscalation, "_folded", lambda self, spread, own=PrivilegeEscalation._folded: folds.append(own(self, spread)) or folds[-1])
    events = privilege_events(500, 1500, seed=3, accounts=("a", "A", "a"))
    assert len(same_privileges(spark, events, block_windows=5, margin_windows=18)) == 10
    parts = folds[0].where("at_start is not null").count()
    assert parts >= 30


def test_blocks_that_disagree_are_widened(spark, monkeypatch):
    """A queue that is never worked off: an action more or less at the start shifts all later matches."""
    folds = []
    monkeypatch.setattr(PrivilegeEscalation, "_folded", lambda self, spread, own=PrivilegeEscalation._folded: folds.append(1) or own(self, spread))
    group = lambda m: event(m, log_type="windows", event_type="privileged_group_membership", user="a", metadata={"group_name": "Administrators", "event_id": f"g{m}"})
    act = lambda m: event(m, log_type="windows", event_type="privilege_assignment", user="a", metadata={"event_id": f"a{m}"})
    same_privileges(spark, [group(0), group(1)] + [x for m in range(2, 600, 4) for x in (act(m), group(m + 2))], block_windows=5, margin_windows=7)
    assert len(folds) > 2


# -- alerts --


def test_copies_and_order(spark):
    events = [failed(i, user=u) for i in range(5) for u in ("a", "b")]
    df = BruteForce().detect(frame(spark, events))
    assert df.count() == 2 and A.distinct(df).count() == 1
    assert json.loads(A.distinct(df).first().evidence)["username"] == "a"  # the one found first
    rows = [("LOW", None, T0, 0), ("HIGH", T0 + timedelta(1), None, 1), ("HIGH", None, T0, 2), ("odd", None, None, 3), ("HIGH", None, None, 4), ("CRITICAL", T0, T0, 5)]
    made = spark.createDataFrame([(s, str(i), "", "{}", [], [], a, b, "d", None, [i]) for s, a, b, i in rows], A.ALERT)
    assert [x.title for x in A.to_driver(made)] == ["5", "4", "2", "1", "0", "3"]
    assert [x.title for x in A.to_driver(A.at_least(made, "MEDIUM"))] == ["5", "4", "2", "1"]


# -- rolling figures --


@pytest.mark.parametrize(("window", "seed", "pieces"), [(0, 1, 1), (1, 2, 1), (7, 3, 1), (40, 4, 1), (1000, 5, 1), (1, 2, 2), (7, 3, 3), (40, 4, 7), (1000, 5, 256), (90, 6, 91)])
def test_rolling_against_brute_force(spark, window, seed, pieces):
    """A hot key, ties, repeated rows, nulls, instants before 1970 and at bucket borders; windows whole and in pieces."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(-30, 60), i, rng.choice([1, 2, 3, 4, None]), rng.choice([True, False, None])) for i in range(160)]
    df = spark.createDataFrame(rows, "g string, us long, i long, v int, ok boolean")
    got = {
        r["i"]: tuple(r[x] for x in ("n", "good", "values", "last", "first_us") if r["n"] or x == "n")
        for r in frames.rolling(df, ["g"], ["us", "i"], window, {"n": F.lit(True), "good": F.col("v") > 2}, {"values": F.col("v")}, {"last": F.col("v")}, F.col("ok"), pieces).collect()
    }
    want = {}
    for g, us, i, _, _ in rows:
        held = sorted(((u, j, v) for h, u, j, v, ok in rows if ok and h == g and us - window <= u and (u, j) <= (us, i)), key=lambda x: x[:2])
        values = {v for _, _, v in held if v is not None}
        want[i] = (len(held), sum(v is not None and v > 2 for _, _, v in held), len(values), held[-1][2], held[0][0]) if held else (0,)
    assert got == want


def test_hot_source_of_many_ports(spark):
    """Each frame of one source holds thousands of rows: figures come from sums, not from collected rows."""
    events = [event(i / 2000, i, log_type="firewall", event_type="network_connection", src_ip="192.0.2.9", dst_ip=f"10.0.0.{i % 3}", dst_port=i % 60, status="denied") for i in range(6000)]
    (out,) = found(spark, PortScan(), events)
    assert out.severity == "CRITICAL"
    assert (out.evidence["distinct_destination_ports"], out.evidence["distinct_destination_hosts"], out.evidence["denied_rejected_count"]) == (50, 3, 50)


def test_one_busy_window_is_spread(spark):
    """All rows of one source, half of them with one port, lie within one window: no task has them all, and the figures stay."""
    df = spark.range(20_000).select(F.lit("s").alias("g"), (F.col("id") * 3).alias("us"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("v"))
    window = 80_000
    pieces = frames.pieces_for(df, ["g"], "us", window, 1000)
    assert pieces > 1 and frames.pieces_for(df, ["g"], "us", window) == 1
    assert frames.pieces_for(df.withColumn("us", F.lit(5)), ["g"], "us", window, 1000) == window + 1  # one instant can't be cut
    made = lambda n: frames.rolling(df, ["g"], ["us", "i"], window, {"n": F.lit(True)}, {"values": F.col("v")}, {"last": F.col("v")}, pieces=n)
    assert made(pieces).exceptAll(made(1)).isEmpty() and made(pieces).count() == 20_000
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = {n: made(n).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for n in (1, pieces)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert held[1] == 20_000 and held[pieces] < 10_000


# -- prefixes --


@pytest.mark.parametrize("kind", ["long", "double"])
def test_prefix_quantiles(spark, kind):
    rng = random.Random(9)
    table = [(k, i, rng.choice([None, *range(6)]) if k else rng.randrange(10**6)) for k in (0, 1, None) for i in range(3000 if k == 0 else 60)]
    rng.shuffle(table)
    df = spark.createDataFrame(table, "k long, i long, v long").withColumn("v", F.col("v").cast(kind))
    have = {(r.k, r.i): r.q for r in frames.prefix_quantiles(df, ["k"], ["i"], "v", (0.25, 0.5, 0.75)).collect()}
    for k in (0, 1, None):
        values = [v for _, v in sorted((i, v) for a, i, v in table if a == k and v is not None)] if k == 0 else None
        seen = []
        for i, v in sorted(((i, v) for a, i, v in table if a == k), key=lambda x: x[0]):
            if k != 0 or i % 100 == 0:
                want = [float(np.percentile(seen, s)) for s in (25, 50, 75)] if seen else None
                assert have[k, i] == (pytest.approx(want) if want else None)
            seen += [v] if v is not None else []
        assert values is None or len(values) == 3000


def test_prefix_quantiles_of_a_long_group_are_near_linear(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    began = time.perf_counter()
    last = frames.prefix_quantiles(df, ["k"], ["id"], "v", (0.25, 0.5, 0.75)).where("id = 99999").first()
    assert time.perf_counter() - began < 60
    values = np.array([r.v for r in df.where("id < 99999").collect()])
    assert last.q == pytest.approx(np.percentile(values, (25, 50, 75)).tolist())


def test_running_sums_are_carried(spark):
    rng = random.Random(4)
    table = [(rng.choice(["hot", "hot", "hot", "b", None]), float(rng.choice([rng.randrange(50), rng.random() * 1000])), rng.randrange(5)) for _ in range(900)]
    df = spark.createDataFrame(table, "k string, v double, n long")
    for parts in (2, 32):
        out = frames.running(df, ["k"], "v", "n", "total", parts).collect()
        assert len(out) == len(table)
        for r in out:
            assert r.total == sum(n for k, v, n in table if k == r.k and v <= r.v)
    plan = frames.running(df, ["k"], "v", "n", "total")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "BroadcastNestedLoop" not in plan
