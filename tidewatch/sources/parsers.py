"""Log formats as column expressions over lines.

A line frame has source, file_ord, line_no and line. parse() gives events and rejects from one
frame; a reject is a line that its format does not accept.

A format is a list of stages. A stage makes columns from those of earlier ones; each stage is a
projection of its own, so what many fields share (a match, a message, a cell) is made once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import instants, text
from tidewatch.model import EVENT

DEFAULT_YEAR = 2026


class LogParser(Protocol):
    """A format of a user's own: (events, rejects) of a line frame, in the columns of model.EVENT and model.DIAGNOSTIC.
    The lines' file_ord and line_no must be carried on; they make the order of events total."""

    def __call__(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]: ...


# The patterns of the formats.
SSHD = r"(?Ud)sshd(?:\[[^\]]+\])?:\s+(.*?)(?:\s+port\s+\d+)?(?:\s+ssh\S*)?$"
FAILED = r"(?U)Failed password for (?:invalid user )?(\S+) from ([^\s]+)"
ACCEPTED_PASSWORD = r"(?U)Accepted password for (\S+) from ([^\s]+)"
ACCEPTED_KEY = r"(?U)Accepted publickey for (\S+) from ([^\s]+)"
INVALID_USER = r"(?U)Invalid user (\S+) from ([^\s]+)"
SUDO = r"(?U)sudo:\s+(\S+)\s*:\s+"
SU = r"(?U)su:\s+\((?:to\s+)?(\S+)\)\s+(.*)"
PAIR = r"(?U)[A-Za-z]+=\S*"
ACCEPT = r"(?i)\b(ACCEPT(?:ED)?|ALLOW(?:ED)?)\b"
DENY = r"(?i)\b(REJECT(?:ED)?|DENY|DENIED)\b"
DROP = r"(?i)\b(DROP(?:PED)?|BLOCK(?:ED)?)\b"
IDENTIFYING = ("SRC", "DST", "PROTO", "DPT")
COMBINED = r'(?U)^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3}|-)\s+(\d+|-)(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?'
REQUEST = r"(?U)^([A-Z]+)\s+(\S+)\s+(\S+)$"
WINDOWS_TYPES = {
    "4624": "login_success", "4625": "login_failure", "4672": "privilege_assignment", "4720": "user_created",
    "4728": "privileged_group_membership", "4732": "privileged_group_membership", "4688": "process_creation",
}
#: Field of a Windows event, and the header spellings that name it.
WINDOWS_FIELDS = {
    "event_id": ("eventid", "event id"),
    "timestamp": ("timecreated systemtime", "timecreated", "timestamp"),
    "computer": ("computer",),
    "target_user": ("targetusername", "target user name"),
    "target_domain": ("targetdomainname", "target domain name"),
    "subject_user": ("subjectusername", "subject user name"),
    "subject_domain": ("subjectdomainname", "subject domain name"),
    "logon_type": ("logontype", "logon type"),
    "source_ip": ("ipaddress", "ip address"),
    "process_name": ("processname", "process name"),
    "process_id": ("processid", "process id"),
    "privileges": ("privilegelist", "privilege list"),
    "event_record_id": ("eventrecordid", "event record id"),
    "channel": ("channel",),
    "execution_process_id": ("execution processid", "execution process id"),
    "execution_thread_id": ("execution threadid", "execution thread id"),
    "provider_name": ("providername", "provider name"),
    "provider_guid": ("providerguid", "provider guid"),
    "parent_process_name": ("parentprocessname", "parent process name"),
    "command_line": ("commandline", "command line"),
    "new_process_name": ("newprocessname", "new process name"),
    "new_process_id": ("newprocessid", "new process id"),
    "token_elevation_type": ("tokenelevationtype", "token elevation type"),
    "mandatory_label": ("mandatorylabel", "mandatory label"),
    "status_code": ("status",),
    "failure_reason": ("failurereason", "failure reason"),
    "sub_status": ("substatus", "sub status"),
    "authentication_package": ("authenticationpackagename", "authentication package name"),
    "logon_process": ("logonprocessname", "logon process name"),
}
#: Fields that only the account and group events have.
WINDOWS_GROUP_FIELDS = {"group_name": ("group name",), "member_name": ("membername", "member name")}
WINDOWS_GROUP_EVENTS = ("4720", "4728", "4732")
WINDOWS_SUBJECT_EVENTS = ("4672", "4688")
WINDOWS_NUMBERS = ("process_id", "new_process_id", "execution_process_id", "execution_thread_id")
# What is said of lines that are not accepted.
REJECTS = {
    "ssh": "malformed or unsupported SSH line", "firewall": "malformed or unsupported firewall line", "web": "malformed or unsupported web line",
    "windows": "malformed Windows Event Log row", "windows_csv": "malformed Windows CSV row",
}


def _metadata(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))


Columns = dict[str, Column]
Stage = Callable[[Columns], Columns]


def staged(df: DataFrame, stages: Sequence[Stage], *given: str) -> tuple[DataFrame, Columns]:
    """df with the columns of all stages, and how they are named."""
    cols = {x: F.col(x) for x in given}
    for stage in stages:
        made = stage(cols)
        df = df.withColumns({f"__{k}": v for k, v in made.items()})
        cols |= {k: F.col(f"__{k}") for k in made}
    return df, cols


def _fields(ok: Column, **columns: Column) -> Columns:
    """ok (whether the line is accepted) and all columns of an event but its place."""
    return {"ok": F.coalesce(ok, F.lit(False))} | {f.name: columns.get(f.name, F.lit(None)).cast(f.dataType) for f in EVENT.fields if f.name not in PLACE}


PLACE = ("source", "file_ord", "line_no")
# What each SSH message says, in the order in which they are tried: pattern, event type, status, way, service.
SSH_SAYS = (
    (FAILED, "login_failure", "failure", "password", "sshd"), (ACCEPTED_PASSWORD, "login_success", "success", "password", "sshd"), (ACCEPTED_KEY, "login_success", "success", "publickey", "sshd"),
    (INVALID_USER, "login_failure", "failure", None, "sshd"), (SUDO, "privilege_action", "executed", None, "sudo"), (SU, "privilege_action", "executed", None, "su"),
)


def ssh(year: int = DEFAULT_YEAR) -> list[Stage]:
    def said(message: Column) -> Column:
        """Number, user and address of the first pattern that fits."""
        cases = [F.when(message.rlike(p), F.struct(F.lit(i).alias("i"), F.regexp_extract(message, p, 1).alias("user"), (F.regexp_extract(message, p, 2) if kind.startswith("login") else F.lit(None).cast("string")).alias("ip"))) for i, (p, kind, *_) in enumerate(SSH_SAYS)]
        return F.coalesce(*cases)

    of = lambda c, k: F.get(F.array(*(F.lit(x[k]).cast("string") for x in SSH_SAYS)), c["said"]["i"])
    return [
        lambda c: {"parts": text.cut(c["line"], instants.SYSLOG, 3), "raw": text.collapsed(c["line"])},
        lambda c: {"when": instants.syslog(c["parts"], year), "rest": instants.after_syslog(c["parts"])},
        lambda c: {"message": F.when(c["when"].isNotNull(), text.stripped(F.when(c["rest"].rlike(SSHD), F.regexp_extract(c["rest"], SSHD, 1)).otherwise(c["rest"])))},
        lambda c: {"said": said(c["message"])},
        lambda c: _fields(
            c["said"].isNotNull(), timestamp=c["when"], log_type=F.lit("ssh"), raw_line=text.redact(c["raw"]), event_type=of(c, 1), status=of(c, 2), user=c["said"]["user"], src_ip=c["said"]["ip"],
            metadata=_metadata(("action", F.when(of(c, 1) == "privilege_action", of(c, 4))), ("service", of(c, 4)), ("authentication_method", of(c, 3))),
        ),
    ]


def firewall(year: int = DEFAULT_YEAR) -> list[Stage]:
    def event(c: Columns) -> Columns:
        def value(key: str) -> Column:  # of the last pair with the key
            at = F.array_position(c["keys"], key)
            return F.substring(F.get(c["pairs"], F.when(at > 0, at - 1).cast("int")), len(key) + 2, 1 << 30)

        def number(first: str, second: str) -> Column:  # zero counts as missing in favour of the second
            a, b = text.integer(value(first)), text.integer(value(second))
            return F.when(a != 0, a).otherwise(b)

        some, rest = lambda x: F.when(x != "", x), c["rest"]
        return _fields(
            c["when"].isNotNull() & F.arrays_overlap(c["keys"], F.array(*map(F.lit, IDENTIFYING))), timestamp=c["when"], log_type=F.lit("firewall"), event_type=F.lit("network_connection"), raw_line=text.redact(c["raw"]),
            src_ip=value("SRC"), dst_ip=value("DST"), dst_port=text.integer(value("DPT")).try_cast("int"), protocol=F.upper(some(value("PROTO"))),
            status=F.when(rest.rlike(ACCEPT), "accepted").when(rest.rlike(DENY), "denied").when(rest.rlike(DROP), "dropped").otherwise("unknown"), bytes_sent=number("LEN", "BYTES"),
            metadata=_metadata(("in_interface", some(value("IN"))), ("out_interface", some(value("OUT"))), ("src_port", text.integer(value("SPT"))), ("packet_count", number("PKTS", "COUNT"))),
        )

    return [
        lambda c: {"parts": text.cut(c["line"], instants.SYSLOG, 3), "raw": text.collapsed(c["line"])},
        lambda c: {"when": instants.syslog(c["parts"], year), "rest": instants.after_syslog(c["parts"])},
        lambda c: {"pairs": F.reverse(F.regexp_extract_all(c["rest"], F.lit(PAIR), 0))},
        lambda c: {"keys": F.transform(c["pairs"], lambda x: F.upper(F.substring_index(x, "=", 1)))},
        event,
    ]


def web() -> list[Stage]:
    part = lambda c, i: F.get(c["parts"], i - 1)
    asked = lambda c, i: F.when(F.size(c["asked"]) == 4, F.nullif(F.get(c["asked"], i - 1), F.lit("")))
    return [
        lambda c: {"own": text.stripped(c["line"]), "raw": text.collapsed(c["line"])},
        lambda c: {"parts": text.cut(c["own"], COMBINED, 9)},
        lambda c: {"when": F.when(F.size(c["parts"]) == 10, instants.common_log(part(c, 4))), "asked": text.cut(text.stripped(part(c, 5)), REQUEST, 3)},
        lambda c: {"path": asked(c, 2), "referrer": text.present(part(c, 8)), "agent": text.present(part(c, 9))},
        lambda c: _fields(
            c["when"].isNotNull(), timestamp=c["when"], log_type=F.lit("web"), event_type=F.lit("http_request"), raw_line=text.redact(c["raw"]),
            src_ip=part(c, 1), user=text.present(part(c, 3)), status=text.present(part(c, 6)), bytes_sent=text.present(part(c, 7)).try_cast("bigint"), path=text.redact(c["path"]),
            metadata=_metadata(("ident", text.present(part(c, 2))), ("protocol_version", asked(c, 3)), ("referrer", text.redact(c["referrer"])), ("user_agent", text.redact(c["agent"])), ("method", asked(c, 1))),
        ),
    ]


def windows() -> list[Stage]:
    """cells: a map of normalized header to cell; raw: the record's text; extra: whether it has more cells than headers."""
    aliases = WINDOWS_FIELDS | WINDOWS_GROUP_FIELDS
    known = [F.lit(x) for own in aliases.values() for x in own]
    named = lambda c, own: F.coalesce(*(F.try_element_at(c["clean"], F.lit(x)) for x in own))

    def event(c: Columns) -> Columns:
        grouped, event_id, target, subject = c["event_id"].isin(*WINDOWS_GROUP_EVENTS), c["event_id"], c["target_user"], c["subject_user"]
        field = {k: F.when(grouped, c[k]) if k in WINDOWS_GROUP_FIELDS else c[k] for k in aliases}
        kind = F.coalesce(*(F.when(event_id == k, F.lit(v)) for k, v in WINDOWS_TYPES.items()), F.lit("windows_event"))
        return _fields(
            event_id.isNotNull() & c["when"].isNotNull() & ~c["extra"], timestamp=c["when"], log_type=F.lit("windows"), event_type=kind, src_ip=c["source_ip"], raw_line=text.redact(c["flat"]),
            user=F.when(grouped, target).when(event_id.isin(*WINDOWS_SUBJECT_EVENTS), subject).otherwise(F.coalesce(target, subject)),
            status=F.when(event_id == "4624", "success").when(event_id == "4625", "failure"),
            metadata=_metadata(*((k, text.integer_any_base(v) if k in WINDOWS_NUMBERS else v) for k, v in field.items())),
        )

    return [
        lambda c: {"some": F.map_filter(c["cells"], lambda k, v: k.isin(*known) & v.isNotNull()), "flat": F.regexp_replace(c["raw"], "[\r\n]", " ")},
        lambda c: {"filled": F.map_filter(F.transform_values(c["some"], lambda k, v: text.stripped(v)), lambda k, v: (v != "") & (v != "-"))},
        lambda c: {"clean": F.transform_values(c["filled"], lambda k, v: text.redact(v))},
        lambda c: {k: named(c, own) for k, own in aliases.items()},
        lambda c: {"when": instants.iso(c["timestamp"])},
        event,
    ]


TEXT_FORMATS: dict[str, Callable[..., list[Stage]]] = {"ssh": ssh, "firewall": firewall, "web": lambda year=DEFAULT_YEAR: web()}


def acceptance(lines: DataFrame) -> DataFrame:
    """lines with a column for each text format, named after it: whether it accepts the line."""
    for log_format, stages in TEXT_FORMATS.items():
        df, c = staged(lines, stages(), "line")
        lines = df.select(*lines.columns, c["ok"].alias(log_format))
    return lines


def _split(df: DataFrame, stages: Sequence[Stage], log_format: str, reject: Column, *given: str) -> tuple[DataFrame, DataFrame]:
    df, c = staged(df, stages, *given)
    # A filter would be pushed down through all stages and repeat them; an array of one or no element is not.
    keep = lambda ok: df.withColumn("__one", F.explode(F.when(ok, F.array(F.lit(1)))))
    events = keep(c["ok"]).select(*(F.col(x) if x in PLACE else c[x].alias(x) for x in EVENT.fieldNames()))
    bad = keep(~c["ok"]).select(F.col("source").alias("path"), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), reject).alias("message"), F.lit(log_format).alias("format"), "file_ord", "line_no")
    return events, bad


def parse(lines: DataFrame, log_format: str, year: int = DEFAULT_YEAR) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a line frame in a text format."""
    return _split(lines.select(*PLACE, "line"), TEXT_FORMATS[log_format](year), log_format, F.lit(REJECTS[log_format]), "line")


def parse_windows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of records: source, file_ord, line_no, cells (map), raw, extra (more cells than headers)."""
    reject = F.when(F.col("extra"), REJECTS["windows_csv"]).otherwise(REJECTS["windows"])
    return _split(rows, windows(), "windows", reject, "cells", "raw", "extra")


def parse_lines(spark, log_format: str, lines, source: str = "<memory>", year: int = DEFAULT_YEAR) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of lines in memory."""
    if log_format == "windows":
        from tidewatch.sources.files import csv_records

        rows = [(source, 0, *r) for r in csv_records("\n".join(x.rstrip("\n") for x in lines))]
        return parse_windows(spark.createDataFrame(rows, "source string, file_ord long, line_no long, cells map<string,string>, raw string, extra boolean"))
    rows = [(source, 0, i, x.rstrip("\r\n")) for i, x in enumerate(lines, 1)]
    return parse(spark.createDataFrame(rows, "source string, file_ord long, line_no long, line string"), log_format, year)
