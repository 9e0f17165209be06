"""Correlation of account creation, group membership and privileged activity.

Records match only if their accounts are equal (ignoring case) and their times at most the
larger window apart. The sequential part, which hands each record to one finding at most, runs
apart for each account and block of time, over the block's records and those of a margin on either
side. Decisions about a lead follow from what leads within two windows of it have taken, so two
neighbouring blocks that decide all alike within four windows of their border can be joined
there: each decision of the two halves follows from those around it, and only the sequential result
has that property. Blocks that disagree are done again with wider margins, in the end over all that
can reach them. So an account that never pauses is spread over tasks, and none is ever sorted
as a whole. What has no account can match nothing and goes through the same fold, one record at a time.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.model import ALERT
from tidewatch.operators.detectors import ORDER, _check, _timed
from tidewatch.session import scratch, ship

# Fixed values.
PRIVILEGED_GROUPS = ("administrators", "domain admins", "enterprise admins", "schema admins", "backup operators", "server operators", "account operators", "print operators")
REVIEW = ("Review the affected account's recent authentication and privilege history", "Verify that the account creation, group change, or privileged action was authorized")
ESCALATION = (*REVIEW, "Confirm the account still requires the privileges or group membership it received", "Consider requiring re-verification of the account pending manual investigation")
KINDS = {"user_created": "created", "privileged_group_membership": "group", "privilege_assignment": "assignment", "process_creation": "process", "privilege_action": "action", "login_failure": "failure"}
ACTIVITY = ("assignment", "process", "action")
LOWER = {"CRITICAL": "HIGH", "HIGH": "MEDIUM"}


@dataclass(frozen=True)
class Rule:
    """A stage: each leading record looks for partners; what it takes is taken from later stages."""

    name: str
    title: str
    severity: str
    confidence: str
    lead: str


CHAIN = Rule("privilege_escalation_chain", "New account escalated to privileged activity", "CRITICAL", "high", "group")
JOINED = Rule("account_created_then_privileged_group_membership", "New account added to a privileged group", "HIGH", "high", "group")
ACTED = Rule("privileged_group_membership_followed_by_activity", "Privileged activity following group membership change", "HIGH", "high", "group")
NEW_ACTED = Rule("privileged_activity_following_new_account", "Privileged activity following new account creation", "HIGH", "high", "created")
PROCESS = Rule("process_creation_after_suspicious_login", "Process creation following a suspicious login or privileged event", "HIGH", "medium", "process")
ASSIGNED = Rule("privilege_assignment_after_suspicious_login", "Special privileges assigned following a suspicious login", "HIGH", "medium", "assignment")
ALONE = {
    "created": Rule("isolated_account_created", "New user account created", "LOW", "low", "created"),
    "group": Rule("isolated_privileged_group_membership", "Account added to a privileged group", "MEDIUM", "medium", "group"),
    "assignment": Rule("isolated_privilege_assignment", "Special privileges assigned to a new logon", "LOW", "low", "assignment"),
    "action": Rule("isolated_{action}_activity", "SSH '{action}' activity observed", "LOW", "low", "action"),
}


@dataclass
class Record:
    kind: str
    us: int
    seq: tuple[int, int, int]
    account: str | None
    host: str | None
    src_ip: str | None
    event_id: str | None
    group: str | None
    process: str | None
    pid: str | None
    privileges: str | None
    action: str | None
    taken: bool = False


def same_context(a: Record, b: Record) -> bool:
    """Equal hosts if both have one; equal addresses if both have one; a host on one side alone asks for addresses."""
    if a.host and b.host:
        return a.host.lower() == b.host.lower()
    if a.src_ip and b.src_ip:
        return a.src_ip == b.src_ip
    return not (a.host or b.host)


class Timeline:
    """Records in order of time, and of what is given where times are equal."""

    def __init__(self, records: Iterable[Record]) -> None:
        self.records = sorted(records, key=lambda r: r.us)
        self.times = [r.us for r in self.records]

    def nearest(self, lead: Record, window: int, after: bool, free: bool = True) -> Record | None:
        """The nearest record (the first of equals) before or after the lead, in the window and its context."""
        if lead.account is None:
            return None
        fits = lambda x: not (free and x.taken) and x.account is not None and same_context(x, lead)
        if after:
            some = range(bisect_left(self.times, lead.us), bisect_right(self.times, lead.us + window))
            return next((self.records[i] for i in some if fits(self.records[i])), None)
        best = None
        for i in range(bisect_right(self.times, lead.us) - 1, bisect_left(self.times, lead.us - window) - 1, -1):
            if best is not None and self.times[i] < best.us:
                break
            if fits(self.records[i]):
                best = self.records[i]
        return best


def _iso(us: int) -> str:
    t = datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)
    return t.isoformat()


def _number(x: str | None) -> int | str | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() else x


class Fold:
    """The stages over the records of one account and block, in order."""

    def __init__(self, records: Sequence[Record], window: int, process_window: int, minutes: float, process_minutes: float, trusted: frozenset[str]) -> None:
        self.of = {k: [r for r in records if r.kind == k] for k in KINDS.values()}
        self.created, self.failures = Timeline(self.of["created"]), Timeline(self.of["failure"])
        # Equal instants: assignments, then processes, then actions; failures before assignments.
        self.activity, self.logins = Timeline(r for k in ACTIVITY for r in self.of[k]), Timeline(self.of["failure"] + self.of["assignment"])
        self.window, self.process_window, self.minutes, self.process_minutes, self.trusted = window, process_window, minutes, process_minutes, trusted
        self.out: list[tuple] = []
        self.decisions: list[tuple] = []  # the lead's instant, the stage and the records of each finding

    def run(self) -> list[tuple]:
        for stage, group in ((s, g) for s in (1, 2, 3) for g in self.of["group"]):
            if group.taken:
                continue
            created = self.created.nearest(group, self.window, False) if stage < 3 else None
            acted = self.activity.nearest(group, self.window, True) if stage != 2 else None
            if (stage < 3 and not created) or (stage != 2 and not acted):
                continue
            self.found(stage, (CHAIN, JOINED, ACTED)[stage - 1], [x for x in (created, group, acted) if x], group, created=created, group=group, acted=acted)
        for created in self.of["created"]:
            acted = None if created.taken else self.activity.nearest(created, self.window, True)
            if acted:
                self.found(4, NEW_ACTED, [created, acted], created, created=created, acted=acted)
        for process in self.of["process"]:
            login = None if process.taken else self.logins.nearest(process, self.process_window, False, free=False)
            if login:
                self.after_login(5, PROCESS, login, process)
                login.taken = True
        for assigned in self.of["assignment"]:
            login = None if assigned.taken else self.failures.nearest(assigned, self.process_window, False, free=False)
            if login:
                self.after_login(6, ASSIGNED, login, assigned)
        for place, kind in enumerate(ALONE):
            for r in self.of[kind]:
                if not r.taken:
                    self.alone(7 + place, ALONE[kind], r)
        return self.out

    def known(self, records: Sequence[Record]) -> bool:
        return any(r.account is not None and r.account.lower() in self.trusted for r in records)

    def emit(self, stage: int, rule: Rule, records: Sequence[Record], lead: Record, facts: dict, summary: str, title: str | None = None, actions: Sequence[str] = ESCALATION) -> None:
        severity = LOWER.get(rule.severity, rule.severity) if stage < 7 and self.known(records) else rule.severity
        ips = sorted({r.src_ip for r in records if r.src_ip})
        start, end = records[0].us, records[-1].us
        self.out.append((severity, title or rule.title, summary, json.dumps(facts), list(actions), ips, start, end, "privilege_escalation", rule.confidence, [start, stage, *lead.seq]))
        self.decisions.append((lead.us, stage, tuple(r.seq for r in records)))
        for r in records if stage < 5 else [lead]:
            r.taken = True

    def digest(self, start: int, end: int) -> int:
        """Of all decisions about leads from start up to end."""
        some = sorted(x for x in self.decisions if start <= x[0] < end)
        return int.from_bytes(hashlib.blake2b(repr(some).encode(), digest_size=8).digest(), "big", signed=True)

    @staticmethod
    def ids(records: Sequence[Record]) -> list[str]:
        return [r.event_id for r in records if r.event_id]

    def base(self, records: Sequence[Record]) -> dict:
        return {"related_event_ids": self.ids(records), "correlation_window_minutes": self.minutes}

    def found(self, stage: int, rule: Rule, records: list[Record], lead: Record, created: Record | None = None, group: Record | None = None, acted: Record | None = None) -> None:
        named = group or created
        hosts = [x.host for x in (group, created, acted) if x and x.host]
        facts = self.base(records) | {"rule": rule.name, "username": named.account}
        facts |= {"group_name": group.group} if group else {}
        facts["computer"] = hosts[0] if hosts else [x for x in (group, created, acted) if x][-1].host
        facts |= {"created_event_id": created.event_id} if created else {}
        facts |= {"group_event_id": group.event_id} if group else {}
        facts |= {"account_created_at": _iso(created.us)} if created else {}
        facts |= {"group_membership_at": _iso(group.us)} if group else {}
        facts |= {"activity_at": _iso(acted.us)} if acted else {}
        facts["known_administrative_account"] = self.known(records)
        if acted:
            facts["activity_event_id"] = acted.event_id
            facts |= {k: v for k, v in (("process_name", acted.process), ("process_id", _number(acted.pid)), ("action", acted.action)) if v is not None}
        start = "Potential privilege escalation detected: "
        text = {
            CHAIN: f"account '{named.account}' was created, added to privileged group '{group and group.group}', and performed privileged activity, all within {self.minutes} minutes.",
            JOINED: f"account '{named.account}' was created and then added to privileged group '{group and group.group}' within {self.minutes} minutes.",
            ACTED: f"account '{named.account}' performed privileged activity within {self.minutes} minutes of being added to privileged group '{group and group.group}'.",
            NEW_ACTED: f"newly created account '{named.account}' performed privileged activity within {self.minutes} minutes of creation.",
        }[rule]
        self.emit(stage, rule, records, lead, facts, start + text)

    def after_login(self, stage: int, rule: Rule, login: Record, lead: Record) -> None:
        facts = {"rule": rule.name, "related_event_ids": self.ids([login, lead]), "process_correlation_window_minutes": self.process_minutes}
        facts |= {"event_id": lead.event_id} if rule is ASSIGNED else {}
        facts |= {"username": lead.account, "computer": lead.host or login.host, "source_ip": lead.src_ip or login.src_ip, "login_event_id": login.event_id, "login_at": _iso(login.us)}
        if rule is PROCESS:
            facts |= {"process_event_id": lead.event_id, "process_at": _iso(lead.us), "process_name": lead.process, "process_id": _number(lead.pid)}
            text = f"process '{lead.process or 'unknown'}' was created for account '{lead.account}' within {self.process_minutes} minutes of a suspicious login or privilege-related event."
        else:
            facts |= {"assignment_event_id": lead.event_id, "assignment_at": _iso(lead.us), "privileges": lead.privileges}
            text = f"special privileges were assigned to a new logon for account '{lead.account}' within {self.process_minutes} minutes of a suspicious authentication event."
        facts["known_administrative_account"] = self.known([login, lead])
        self.emit(stage, rule, [login, lead], lead, facts, "Potential privilege escalation detected: " + text)

    def alone(self, stage: int, rule: Rule, r: Record) -> None:
        action = r.action or "privilege_action"
        facts = self.base([r]) | {"rule": rule.name.format(action=action), "event_id": r.event_id, "username": r.account}
        facts |= {"group_name": r.group} if r.kind == "group" else {}
        facts |= {"computer": r.host} if r.kind != "action" else {}
        facts["source_ip"] = r.src_ip
        where = r.host or "an unknown host"
        if r.kind == "assignment":
            facts |= {"privileges": r.privileges, "known_administrative_account": self.known([r])}
        if r.kind == "action":
            facts["action"] = action
        text = {
            "created": f"Account '{r.account}' was created on {where} with no correlated privileged-group membership or privileged activity observed.",
            "assignment": f"Special privileges were assigned to a new logon for '{r.account}' on {where}. No corroborating suspicious login, account creation, or privileged-group membership was observed, so this is reported as an informational finding rather than confirmed privilege escalation.",
            "group": f"Account '{r.account}' was added to privileged group '{r.group}' on {where} with no correlated account creation or follow-on activity observed.",
            "action": f"Account '{r.account}' used '{action}' with no correlated account creation, privileged-group membership, or further activity observed.",
        }[r.kind]
        self.emit(stage, rule, [r], r, facts, text, rule.title.format(action=action), REVIEW)


COLUMNS = ("kind", "us", "file_ord", "line_no", "account", "host", "src_ip", "event_id", "group_name", "process", "pid", "privileges", "action")


def record(kind: str, us: int, file_ord: int, line_no: int, *rest: str | None) -> Record:
    return Record(kind, us, (us, file_ord, line_no), *rest)


#: Windows on either side of a border within which two blocks must decide alike (each decision looks two windows far, to what again was decided within two).
AGREE = 4


@dataclass(frozen=True)
class PrivilegeEscalation:
    """block_windows and margin_windows: the length of a block and of its margins in windows; results don't depend on them. A margin of
    18 windows is never too short for what comes after a block; what came before may reach as far as its matches are chained."""

    correlation_window_minutes: float = 30
    process_correlation_window_minutes: float = 15
    privileged_groups: Sequence[str] | None = None
    known_administrative_accounts: Sequence[str] | None = None
    block_windows: int = 80
    margin_windows: int = 20

    def __post_init__(self) -> None:
        _check(self.correlation_window_minutes > 0, "correlation_window_minutes must be positive")
        _check(self.process_correlation_window_minutes > 0, "process_correlation_window_minutes must be positive")
        _check(self.block_windows > AGREE and self.margin_windows >= AGREE + 3, "blocks need over 4 windows and margins 7")

    @property
    def far(self) -> int:
        return round(max(self.correlation_window_minutes, self.process_correlation_window_minutes) * 60_000_000)

    def records(self, events: DataFrame) -> DataFrame:
        """The columns of COLUMNS."""
        kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()))
        meta = lambda k: F.try_element_at("metadata", F.lit(k))
        full = lambda *c: F.coalesce(*(F.when(x != "", x) for x in c))
        group = full(meta("group_name"), meta("target_user"), F.col("user"))
        names = [x.lower() for x in (self.privileged_groups or PRIVILEGED_GROUPS)]
        is_group, is_process = F.col("event_type") == "privileged_group_membership", F.col("event_type") == "process_creation"
        r = _timed(events).where(kind.isNotNull() & ((F.col("event_type") != "privilege_action") | (F.col("log_type") == "ssh")) & (~is_group | F.coalesce(F.lower(group).isin(names), F.lit(False))))
        return r.select(
            kind.alias("kind"), *ORDER, F.when(is_group, full(meta("member_name"), F.col("user"))).otherwise(F.col("user")).alias("account"), meta("computer").alias("host"), "src_ip",
            F.coalesce(meta("event_id"), F.when(F.col("event_type") == "privilege_action", meta("action"))).alias("event_id"), F.when(is_group, group).alias("group_name"),
            F.when(is_process, meta("new_process_name")).alias("process"), F.when(is_process, meta("new_process_id")).alias("pid"), meta("privileges").alias("privileges"), meta("action").alias("action"),
        )

    def spread(self, records: DataFrame, margin: int) -> DataFrame:
        """Each record in its block and in those whose margins hold it: key, alone (for records without an account, apart), block and whether it is its home."""
        length, reach = self.block_windows * self.far, margin * self.far
        block = lambda us: F.floor(us / F.lit(length)).cast("long")
        known = F.col("account").isNotNull()
        near = F.sequence(block(F.col("us") - reach), block(F.col("us") + reach))
        own = F.when(known, near).otherwise(F.array(block(F.col("us"))))
        return records.select(F.lower("account").alias("key"), F.when(known, F.lit(0).cast("long")).otherwise(F.xxhash64(*ORDER)).alias("alone"), F.explode(own).alias("block"), (block(F.col("us"))).alias("home"), *COLUMNS)

    def _folded(self, spread: DataFrame) -> DataFrame:
        """Alerts of each block's own leads, and for a block with records beyond it a row with digests of what was decided about its borders."""
        minutes, process_minutes = self.correlation_window_minutes, self.process_correlation_window_minutes
        trusted = frozenset(x.lower() for x in (self.known_administrative_accounts or ()))
        windows = round(minutes * 60_000_000), round(process_minutes * 60_000_000), minutes, process_minutes
        length, near = self.block_windows * self.far, AGREE * self.far
        schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ALERT)}, key string, block long, at_start long, at_end long"
        arrow = to_arrow_schema(T._parse_datatype_string(schema))

        def block_of(key: tuple, records: list[Record], inner: bool) -> Iterator[tuple]:
            if not inner:
                return
            name, _, block = key
            fold, start, end = Fold(records, *windows, trusted), block * length, (block + 1) * length
            for alert, (us, *_) in zip(fold.run(), fold.decisions):
                if start <= us < end:
                    yield *alert, name, block, None, None
            if records[0].us < start or records[-1].us >= end:
                yield *[None] * len(ALERT), name, block, fold.digest(start - near, start + near), fold.digest(end - near, end + near)

        def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks follow each other in order, so one is held at a time."""
            held: list[Record] = []
            last, inner = None, False

            def batch_of(rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows)) or [()] * len(arrow)
                return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, arrow)], schema=arrow)

            for batch in batches:
                out: list[tuple] = []
                for key, alone, block, home, *values in zip(*(c.to_pylist() for c in batch.columns)):
                    if (key, alone, block) != last:
                        out += block_of(last, held, inner)
                        held, last, inner = [], (key, alone, block), False
                    held.append(record(*values))
                    inner |= home == block
                yield batch_of(out)
            yield batch_of(list(block_of(last, held, inner)))

        return spread.repartition("key", "alone", "block").sortWithinPartitions("key", "alone", "block", *ORDER).mapInArrow(fold, schema)

    def detect(self, events: DataFrame) -> DataFrame:
        """The alerts. Blocks are folded and written to the shared folder when this is called, as it must be known whether they agree."""
        spark = events.sparkSession
        ship(spark)
        at, margin, n = scratch(spark, "privilege"), self.margin_windows, 0
        records = self.records(events)

        def written(df: DataFrame) -> DataFrame:
            nonlocal n
            n += 1
            df.write.parquet(f"{at}/{n}")
            return spark.read.parquet(f"{at}/{n}")

        now = written(self._folded(self.spread(records, margin)))
        while True:
            borders = now.where("at_start is not null").select("key", "block", "at_start", "at_end")
            after = borders.select("key", (F.col("block") - 1).alias("block"), F.col("at_start").alias("told"))
            apart = borders.join(after, ["key", "block"]).where("at_end <> told").select("key", F.explode(F.array("block", F.col("block") + 1)).alias("block")).distinct()
            apart = written(apart)
            if apart.isEmpty():
                return now.where("at_start is null").select(*ALERT.names)
            margin *= 2
            again = written(self._folded(self.spread(records, margin).join(apart, ["key", "block"], "left_semi").select("key", "alone", "block", "home", *COLUMNS)))
            now = now.join(apart, [now["key"].eqNullSafe(apart["key"]), now["block"] == apart["block"]], "left_anti").unionByName(again)
