"""Made-up logs of any length, from expressions over a range of numbers; the same for the same seed."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.detectors import SYNTHETIC_LOCATIONS

#: The columns of a Windows export (fixed values).
HEADER = ("EventID", "TimeCreated", "Computer", "IpAddress", "TargetUserName", "TargetDomainName", "SubjectUserName", "SubjectDomainName", "LogonType", "ProcessName", "NewProcessName", "NewProcessId", "MemberName", "PrivilegeList", "Group Name", "Unused Column")


@dataclass(frozen=True)
class Scenario:
    """Units of so many lines, `every` seconds apart. What a line says follows from n, its number in its unit, u, the unit's number, and r, a number from the seed."""

    kind: str
    lines: int
    every: int
    text: Column | None = None
    jumps: tuple[int, ...] = ()  # seconds of single lines, in place of steps


def _syslog(host: str, program: str, message: Column) -> Column:
    return F.concat(F.date_format("at", "MMM dd HH:mm:ss"), F.lit(f" {host}"), F.col("u").cast("string"), F.lit(f" {program}: "), message)


def _sshd(says: Column, user: Column, ip: Column) -> Column:
    return _syslog("gate", "sshd[4100]", F.concat(says, F.lit(" for "), user, F.lit(" from "), ip, F.lit(" port 51515 ssh2")))


def _ip(net: str) -> Column:
    return F.concat(F.lit(f"{net}."), (F.col("u") % 250 + 1).cast("string"))


def _name(start: str) -> Column:
    return F.concat(F.lit(start), F.col("u").cast("string"))


def scenarios() -> dict[str, Scenario]:
    """By name: what each shows and how its lines are made."""
    n, r = F.col("n"), F.col("r")
    port = (1_100 + (n * 37 + r % 29) % 60_000).cast("string")
    request = F.concat(_ip("192.0.2"), F.lit(" - - ["), F.date_format("at", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /item/'), (r % 12).cast("string"), F.lit(' HTTP/1.1" 200 '), (400 + r % 5_000).cast("string"), F.lit(' "-" "agent/3"'))
    return {
        "key_logins": Scenario("ssh", 5, 1_500, _sshd(F.lit("Accepted publickey"), _name("crew"), _ip("198.51.100"))),
        "guessing": Scenario("ssh", 9, 20, _sshd(F.lit("Failed password"), _name("keeper"), _ip("203.0.113"))),
        "guessed": Scenario("ssh", 7, 25, _sshd(F.when(n < 6, "Failed password").otherwise("Accepted password"), _name("pilot"), _ip("203.0.113"))),
        "port_sweep": Scenario("firewall", 16, 2, _syslog("wall", "kernel", F.concat(F.lit("DROP IN=wan0 OUT= SRC="), _ip("203.0.113"), F.lit(" DST=192.0.2.9 LEN=44 PROTO=TCP SPT=50505 DPT="), port))),
        "request_surge": Scenario("web", 60, 1, request, tuple(150 * i for i in range(24))),
        "account_misuse": Scenario("windows", 6, 240),
    }


def _windows(n: Column) -> dict[str, Column]:
    """A new account that joins the administrators and acts, and one that logs in from two distant places."""
    near, far = sorted(SYNTHETIC_LOCATIONS)[0], sorted(SYNTHETIC_LOCATIONS)[-1]
    pick = lambda *cells: F.element_at(F.array(*(F.lit(x) for x in cells)), n + 1)
    own = lambda *places: F.when(n.isin(*places), _name("deckhand"))
    return {
        "EventID": pick("4720", "4732", "4672", "4688", "4624", "4624"), "TimeCreated": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "Computer": _name("bridge"), "IpAddress": pick(None, None, None, None, near, far),
        "TargetUserName": F.coalesce(own(0), F.when(n == 1, "Administrators"), F.when(n > 3, _name("courier"))), "SubjectUserName": own(2, 3), "LogonType": pick(None, None, None, None, "10", "10"),
        "NewProcessName": pick(None, None, None, r"D:\tools\sounding.exe", None, None), "NewProcessId": pick(None, None, None, "0x51c", None, None), "MemberName": own(1), "PrivilegeList": pick(None, None, "SeBackupPrivilege", None, None, None),
    }


def lines(spark: SparkSession, scenario: str, units: int = 1, seed: int = 1, start: str = "2026-05-04 08:00:00") -> DataFrame:
    """The scenario's lines, in columns u, n and line; Windows rows in the columns of HEADER, with `-` for no value."""
    if scenario not in scenarios():
        raise ValueError(f"unknown scenario '{scenario}'; choose one of: {', '.join(('all', *scenarios()))}")
    one = scenarios()[scenario]
    after = len(one.jumps)
    seconds = F.when(F.col("n") < after, F.element_at(F.array(*map(F.lit, one.jumps or (0,))), F.least("n", F.lit(max(after - 1, 0))) + 1)).otherwise((one.jumps or (0,))[-1] + (F.col("n") - max(after - 1, 0)) * one.every)
    rows = spark.range(units).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(one.lines - 1))).alias("n"))
    rows = rows.withColumn("r", F.pmod(F.xxhash64(F.lit(seed), "u", "n"), F.lit(1 << 20))).withColumn("at", F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds))
    if one.kind != "windows":
        return rows.select("u", "n", one.text.alias("line"))
    cells = _windows(F.col("n"))
    return rows.select("u", "n", *(F.coalesce(cells.get(h, F.lit(None)).cast("string") if h in cells else F.lit(None).cast("string"), F.lit("-")).alias(h) for h in HEADER))


def generate(spark: SparkSession, folder: str | Path, scenario: str = "all", units: int = 1, seed: int = 1) -> dict[str, Path]:
    """Writes a local file for one scenario or for each; their paths by scenario. Lines stream through the driver: for logs beyond a disk, write lines() itself."""
    folder, out = Path(folder), {}
    folder.mkdir(parents=True, exist_ok=True)
    for name in scenarios() if scenario == "all" else (scenario,):
        made = lines(spark, name, units, seed).orderBy("u", "n").drop("u", "n")
        windows = made.columns != ["line"]
        out[name] = folder / f"{name}.{'csv' if windows else 'log'}"
        with out[name].open("w", encoding="utf-8", newline="") as f:
            writer = csv.writer(f, lineterminator="\n", **({} if windows else {"quoting": csv.QUOTE_NONE, "quotechar": None, "delimiter": "\x1f"}))
            writer.writerows([HEADER] if windows else [])
            writer.writerows(made.toLocalIterator())
    return out
