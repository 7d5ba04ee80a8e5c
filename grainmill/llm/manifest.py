"""Operator 12: a Merkle manifest of a dataset: window-based levels over narrow tables of digests, and an audit of each row against it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import drop_table, small, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value so that no two lists of values read alike: byte count, colon, value; a hyphen for a null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def positions(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """nodes, written, with _i (from 0, in the order of `order` within `group`) and _n (the group's size).

    All rows are sorted by sampled ranges of (group, order), so a group of any size lies in as many tasks as it needs; what
    is counted is one row for each group and task.
    """
    held = table(nodes.orderBy(group, *order).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_row", 33)
    counts = held.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_k"), F.min("_row").alias("_first"))
    every = Window.partitionBy(group)
    starts = table(counts.select(group, "_part", "_first", (F.sum("_k").over(every.orderBy("_part")) - F.col("_k")).alias("_before"), F.sum("_k").over(every).alias("_n")), "starts")
    out = table(held.withColumn("_part", part).join(small(starts, 128), [group, "_part"]).withColumn("_i", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_part", "_first", "_before"), "places")
    drop_table(held)
    drop_table(starts)
    return out


def _with_run(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes of groups of more than one, each with _p, its parent's place, and _run, all digests of its run."""
    run = Window.partitionBy("_g", "_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.where("_n > 1").withColumn("_p", F.expr(f"_i DIV {fanout}")).withColumn("_run", F.collect_list("_h").over(run))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels over leaves (_g, _i, _n, _h): tables of nodes with the same columns; a group's last node is where its _n is 1.

    The digests of a run, at most `fanout` of them, are collected by a window over (group, parent's place), at every row;
    of a run one row goes on, as the parent.
    """
    levels, n = [leaves], leaves.agg(F.max("_n")).first()[0] or 0
    while n > 1:
        nodes = _with_run(levels[-1], fanout).where(f"_i % {fanout} = 0")
        levels.append(table(nodes.select("_g", F.col("_p").alias("_i"), F.expr(f"(_n + {fanout - 1}) DIV {fanout}").alias("_n"), F.sha2(F.array_join("_run", "").cast("binary"), 256).alias("_h")), "level"))
        n = -(-n // fanout)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """_g, _h: the last node of each group."""
    out = levels[0].where("_n = 1").select("_g", "_h")
    for level in levels[1:]:
        out = out.unionByName(level.where("_n = 1").select("_g", "_h"))
    return out


def with_steps(levels: list[DataFrame], above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """The first level with _steps: for each level up to the group's last node, the digests of the run left and right of the row's node.

    above: _g, _above: steps that go on from the group's last node. Steps are handed down from parents to the at most
    `fanout` nodes of their run; on each level but the first they are written.
    """
    none = F.lit(None).cast(STEPS)

    def last(level: DataFrame) -> DataFrame:
        held = level.where("_n = 1")
        if above is None:
            return held.withColumn("_steps", F.coalesce(none, F.array().cast(STEPS)))
        return held.join(above.withColumnRenamed("_above", "_steps"), "_g")

    at = last(levels[-1])
    for k in range(len(levels) - 2, -1, -1):
        parents = at.select("_g", F.col("_i").alias("_p"), F.col("_steps").alias("_up"))
        if k < len(levels) - 2:
            parents = table(parents, "steps")
        place = (F.col("_i") % fanout).cast("int")
        own = F.struct(F.array_join(F.slice("_run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("_run", place + 2, F.lit(fanout)), "").alias("right"))
        inner = _with_run(levels[k], fanout).join(parents, ["_g", "_p"]).withColumn("_steps", F.concat(F.array(own), "_up"))
        at = inner.drop("_p", "_run", "_up").unionByName(last(levels[k]))
    return at


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(steps: Column) -> Column:
    """All digests of the steps, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


class Manifest(NamedTuple):
    """rows: doc_id, leaf, shown_leaf, subroot, root, steps; groups: group, subroot, root."""

    rows: DataFrame
    groups: DataFrame


def manifest(docs: DataFrame, group: str = "source", columns: Sequence[str] = COLUMNS, shown: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of docs: a leaf digest for each row, a subroot for each value of `group`, one root, and each row's steps to it.

    Leaves of a group stand in order of doc_id (null first; rows of one doc_id in order of their digests, so the result does
    not depend on how rows lie); runs of `fanout` become a parent while a group has more than one node. Subroots, by the
    UTF-8 bytes of the group (null first), lead to the root in the same way. shown: other values of some columns, whose
    digest is shown_leaf (else the leaf): an audit folds it along the steps. Repeated rows are leaves of their own. Texts
    are read once and hashed whole; only digests and ids are moved. An empty table gives no rows. Columns of docs
    with names as here do not matter.
    """
    values = {c: docs[c] for c in columns}
    leaf, other = row_digest(list(values.values())), row_digest(list((values | (shown or {})).values()))
    key = F.coalesce(F.concat(F.lit("s"), docs[group].cast("string")), F.lit("n"))
    nodes = table(docs.select(key.alias("_g"), docs["doc_id"].alias("_id"), leaf.alias("_h"), (other if shown else F.lit(None).cast("string")).alias("_shown")), "leaves")
    leaves = positions(nodes, "_g", ["_id", "_h"])
    drop_table(nodes)
    levels = tree(leaves, fanout)
    subroots = table(tops(levels), "subroots")
    upper = tree(positions(subroots.select(F.lit("").alias("_g"), F.col("_g").alias("_of"), "_h"), "_g", ["_of"]), fanout)
    root = tops(upper).select(F.col("_h").alias("_root"))
    # One row for each group.
    groups = table(with_steps(upper, fanout=fanout).select(F.col("_of").alias("_g"), F.col("_h").alias("_sub"), F.col("_steps").alias("_above")).crossJoin(F.broadcast(root)), "groups")
    steps = with_steps(levels, groups.select("_g", "_above"), fanout)
    of = groups.select("_g", F.col("_sub").alias("subroot"), F.col("_root").alias("root"))
    rows = steps.join(small(of, 200), "_g").select(F.col("_id").alias("doc_id"), F.col("_h").alias("leaf"), F.coalesce("_shown", "_h").alias("shown_leaf"), "subroot", "root", F.col("_steps").alias("steps"))
    return Manifest(rows, of.select(F.when(F.col("_g") != "n", F.substring("_g", 2, 1 << 30)).alias("group"), "subroot", "root"))


def tampered(docs: DataFrame) -> Column:
    """The text with A-Z in lower case where 5 divides crc32 of the doc_id; nulls, and texts of null ids, as they are."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, low).otherwise(F.col("text"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings), and folded_root, verified of the rows with tampered texts."""
    rows = manifest(docs, shown={"text": tampered(docs)}).rows
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("shown_leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
