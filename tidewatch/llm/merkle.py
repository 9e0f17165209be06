"""A Merkle manifest of a table, with a proof for every row.

Each row is a leaf; the leaves of a group make a tree, the roots of the groups make the last
tree. A node is the digest of its run of `ARITY` consecutive nodes below; it is found by its
coordinates (tree, level, place), which follow from a leaf's place and the size of its tree.
So a proof needs no walk: each leaf is exploded into the coordinates of its siblings, those are
joined with the written node table, put in order, concatenated and folded.

Places come from a range partitioning of all rows and the counts of its parts, so a group of any
size is spread over tasks. Levels are made from blocks of 3^6 nodes. Nodes near a root are
siblings of very many leaves: those of level L and up are broadcast, where L is the least level
with 6 N / 3^L <= SMALL; a tree has nodes on a level only if it has over 3^(L-1) leaves, so these
are at most SMALL nodes for any N rows and any number of groups. Below L, no node is asked for
by more than 2 * 3^(L-1) leaves, a share of at most 36 / SMALL of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SMALL, Work

ARITY = 3
#: Levels that are made from one block of ARITY ** LEVELS nodes.
LEVELS = 6
#: The name of the tree of groups; those of groups are empty (null) or start with an equals sign.
TOP = "/"

def _powers() -> Column:
    return F.expr(f"array({', '.join(f'{ARITY**i}L' for i in range(39))})")


def leaf(*columns: Column) -> Column:
    """Digest of a row: each value's count of UTF-8 bytes, a colon and the value; `-` for null."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def _power(level: Column) -> Column:
    return F.element_at(_powers(), level + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(_powers(), lambda x: x < n))


def _listed(df: DataFrame, work: Work, name: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """The rows in the order of tree, then by, written with their place in that order (at), and for each part of the table
    and tree: the first place, the number of the tree's rows in parts before, and the tree's size n."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", *by, "tie")]
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = work.write(ranged.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    running = "sum(held) over (partition by tree order by part) - held"
    return rows, work.write(parts.select("part", "tree", "first", F.expr(running).alias("before"), F.expr("sum(held) over (partition by tree)").alias("n")), f"{name}-parts")


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, ["part", "tree"]).withColumn("i", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def _above(below: Column) -> Column:
    """The digests of the runs of a list of digests."""
    return F.when(F.size(below) > 0, F.transform(F.sequence(F.lit(0), _div(F.size(below) - 1, F.lit(ARITY)).cast("int")), lambda i: F.sha2(F.array_join(F.slice(below, i * ARITY + 1, F.lit(ARITY)), ""), 256)))


def _grown(leaves: DataFrame, work: Work, name: str) -> tuple[DataFrame, int]:
    """The node table (tree, level, i, digest, n: size of the tree) of leaves (tree, i, digest, n), and its greatest height."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "i", "digest", "n")
    height = nodes.agg(F.max(_height(F.col("n")))).first()[0] or 0
    base = 0
    while base < height:
        block = ARITY**LEVELS
        last = nodes.where((F.col("level") == base) & (_height(F.col("n")) > base))
        rows = last.groupBy("tree", "n", F.expr(f"i div {block}").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]).alias("d0"))
        for k in range(LEVELS):
            rows = rows.withColumn(f"d{k + 1}", _above(F.col(f"d{k}")))
        each = F.explode(F.array(*(F.struct(F.lit(base + k).alias("level"), F.lit(block // ARITY**k).alias("wide"), F.col(f"d{k}").alias("found")) for k in range(1, LEVELS + 1))))
        made = rows.select("tree", "n", "block", each.alias("x")).where(F.col("x.level") <= _height(F.col("n")))
        made = made.select("tree", "n", F.col("x.level").alias("level"), (F.col("block") * F.col("x.wide")).alias("from"), F.posexplode("x.found").alias("k", "digest"))
        base += LEVELS
        nodes = nodes.unionByName(work.write(made.select("tree", "level", (F.col("from") + F.col("k")).alias("i"), "digest", "n"), f"{name}-{base}"))
    return nodes, height


def _siblings() -> Column:
    """Coordinates (level, i) of the siblings of the leaf at place i of a tree of n leaves."""

    def of(level: Column) -> Column:
        own, size = _div(F.col("i"), _power(level)), _div(F.col("n") - 1, _power(level)) + 1
        start = _div(own, F.lit(ARITY)) * ARITY
        return F.transform(F.filter(F.sequence(start, F.least(start + ARITY - 1, size - 1)), lambda j: j != own), lambda j: F.struct(level.alias("level"), j.alias("j")))

    height = _height(F.col("n"))
    return F.when(height > 0, F.flatten(F.transform(F.sequence(F.lit(0), height - 1), of)))


def _proofs(leaves: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """tree, i and the siblings (level, j, digest) of every leaf that has any, from the root's end unordered."""
    near = next(level for level in range(39) if 2 * ARITY * rows <= SMALL * ARITY**level)
    asked = leaves.select("tree", "i", F.explode(_siblings()).alias("x")).select("tree", "i", F.col("x.level").alias("level"), F.col("x.j").alias("j"))
    known = nodes.select("tree", "level", F.col("i").alias("j"), F.unhex("digest").alias("digest"))
    low, high = F.col("level") < near, F.col("level") >= near
    found = asked.where(low).join(known.where(low), ["tree", "level", "j"]).unionByName(asked.where(high).join(F.broadcast(known.where(high)), ["tree", "level", "j"]))
    return found.groupBy("tree", "i").agg(F.collect_list(F.struct("level", "j", "digest")).alias("found"))


def _folded(start: Column, i: Column, n: Column, siblings: Column) -> Column:
    """The root that a leaf's digest gives with its siblings, in order of level and place."""

    def side(level: Column, left: bool) -> Column:
        own = _div(i, _power(level))
        return F.array_join(F.transform(F.filter(siblings, lambda x: (x["level"] == level) & ((x["j"] < own) if left else (x["j"] > own))), lambda x: F.lower(F.hex(x["digest"]))), "")

    return F.when(_height(n) > 0, F.aggregate(F.sequence(F.lit(0), _height(n) - 1), start, lambda acc, level: F.sha2(F.concat(side(level, True), acc, side(level, False)), 256))).otherwise(start)


def _hex(siblings: Column) -> Column:
    return F.array_join(F.transform(siblings, lambda x: F.lower(F.hex(x["digest"]))), "")


def prove(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf digests `columns`; leaves of a group are in the order of key (null first), rows of equal keys by
    their digests. `changed` is a leaf digest to check against the manifest in place of a row's own (as an
    expression over docs); folded_root is what it gives with the row's siblings, verified whether that is the
    root. Groups are ordered by their names as bytes, null first; null and empty are two groups. Equal rows are leaves of
    their own. A lone leaf is its group's root, a lone group's root is the root, and a proof without
    siblings is the digest of nothing. An empty table gives no rows; other columns are not read.
    """
    work = Work(docs.sparkSession, "merkle")
    own = leaf(*(F.col(c) for c in columns))
    rows, parts = _listed(docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"), own.alias("digest"), (own if changed is None else changed).alias("held")), work, "leaves", "key", "digest")
    leaves = work.write(_placed(rows, parts), "placed")
    nodes, _ = _grown(leaves, work, "nodes")
    roots = nodes.where(F.col("level") == _height(F.col("n"))).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    tops = work.write(_placed(*_listed(roots, work, "groups", "of")), "groups-placed")
    above, height = _grown(tops, work, "top")
    root = above.where((F.col("level") == height)).select(F.lit(TOP).alias("tree"), F.col("digest").alias("root"))
    n_rows, n_tops = leaves.count(), tops.count()
    over = tops.join(_proofs(tops, above, n_tops), ["tree", "i"], "left").join(F.broadcast(root), "tree")
    over = work.write(over.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("i").alias("top_i"), F.col("n").alias("top_n"), F.array_sort(F.coalesce("found", F.array().cast("array<struct<level:int,j:bigint,digest:binary>>"))).alias("top_found")), "over")
    # what a group's rows share reaches them by part and group, so that no group is one key
    shared = _placed(rows, parts.join(over, "tree"))
    found = F.array_sort(F.coalesce("found", F.array().cast("array<struct<level:int,j:bigint,digest:binary>>")))
    out = shared.join(_proofs(leaves, nodes, n_rows), ["tree", "i"], "left").withColumn("found", found)
    out = out.withColumn("folded", _folded(F.col("held"), F.col("i"), F.col("n"), F.col("found"))).withColumn("folded_root", _folded(F.col("folded"), F.col("top_i"), F.col("top_n"), F.col("top_found")))
    return out.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat(_hex(F.col("found")), _hex(F.col("top_found"))), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def newline_free(docs_columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", text: str = "text") -> Column:
    """The digest of a row whose text has lost its newlines, where the unsigned CRC-32 of the decimal key is even; else its own."""
    own = [F.col(c) for c in docs_columns]
    stripped = [F.regexp_replace(c, "\n", "") if name == text else c for name, c in zip(docs_columns, own)]
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, leaf(*stripped)).otherwise(leaf(*own))
