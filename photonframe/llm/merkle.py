"""WARC fixity audit: Merkle trees over the records of an archive, replica against replica.

Only DataFrame functions. The two replicas are read independently of each other. A record's
leaf hashes its name, its length and its payload digest; a node hashes its children in order,
that is an ordered range of offsets. Where a range begins is settled by the records' names:
a record starts a node of level k where the hash of its name is divisible by the fanout to
the power k. So a lost, added or longer record changes the nodes above itself and no others,
though it shifts all offsets after it; offsets are reported, not hashed. The audit compares
the roots of two replicas and goes down only below nodes that differ: each level is a join of
the children of mismatching nodes, so its cost follows the damage, not the archive. Levels
are a dozen at most (log of the longest archive), each written to the shared folder once.

Cases: a null payload is told from an empty one; a null archive is an archive and a null key
a key of their own; records of equal archive and key are told apart by their number in order
of digest; records that only one replica has are reported as missing or extra, with the place
in the replica that has them; an archive that only one replica has differs at its root; empty
replicas give no rows; payloads of any length are hashed whole where they are read, only
digests are shuffled; columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _named(c: Column) -> Column:
    """As text, nulls told from all texts."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def records(table: DataFrame, archive: Column, key: Column, payload: Column) -> DataFrame:
    """(archive, arc, name, idx, offset, length, digest): records in key order, offsets are
    the bytes before them. An archive is one file and so bounded; its window holds digests."""
    raw = payload.cast("binary")
    rows = table.select(archive.alias("archive"), key.alias("key"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("length"), F.coalesce(F.sha2(raw, 256), F.lit("null")).alias("digest"))
    rows = rows.withColumn("arc", _named(F.col("archive")))
    order = Window.partitionBy("arc").orderBy("key", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    nth = F.row_number().over(Window.partitionBy("arc", "key").orderBy("digest"))
    name = F.concat_ws(":", nth, _named(F.col("key")))
    return rows.withColumns({"offset": before, "idx": (F.row_number().over(order) - 1).cast("long"), "name": name}).drop("key")


class Tree:
    """levels: nodes (arc, name, parent, idx, hash), leaves first; roots: (arc, archive, root)."""

    def __init__(self, rows: DataFrame, depth: int, fanout: int = 16) -> None:
        place = F.conv(F.substring(F.sha2("name", 256), 1, 15), 16, 10).cast("long")
        so_far = Window.partitionBy("arc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        starts = {f"up{k}": F.coalesce(F.last(F.when(F.col("place") % fanout**k == 0, F.col("name")), ignorenulls=True).over(so_far), F.lit("")) for k in range(1, depth + 1)}
        leaf = F.sha2(F.concat_ws(":", "name", "length", "digest"), 256)
        self.leaves = materialize(rows.withColumn("place", place).withColumns({**starts, f"up{depth + 1}": F.lit(""), "hash": leaf}).drop("place"), "leaves")
        level = self.leaves.select("arc", "name", F.col("up1").alias("parent"), "idx", "hash", *(f"up{k}" for k in range(2, depth + 2)))
        self.levels = [level]
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")
        for k in range(1, depth + 1):  # of one node all higher starts are equal
            above = [f"up{i}" for i in range(k + 1, depth + 2)]
            level = materialize(level.groupBy("arc", F.col("parent").alias("name"), *above).agg(F.sha2(children, 256).alias("hash"), F.min("idx").alias("idx")).withColumn("parent", F.col(above[0])), "level")
            self.levels.append(level)
        self.roots = level.groupBy("arc").agg(F.sha2(children, 256).alias("root"))


def depth_for(longest: int, fanout: int) -> int:
    depth = 1
    while fanout**depth < longest:
        depth += 1
    return depth


def audit(left: DataFrame, right: DataFrame, fanout: int = 16) -> tuple[DataFrame, DataFrame]:
    """Of two replicas' records: (arc, archive, root_a, root_b, intact) for every archive, and
    (arc, idx, status, offset, length) for each record at fault: status corrupt, missing (only
    in the first) or extra (only in the second)."""
    left, right = materialize(left, "records"), materialize(right, "records")
    longest = left.select("idx").unionByName(right.select("idx")).agg(F.max("idx")).first()[0]
    depth = depth_for(1 if longest is None else longest + 1, fanout)
    a, b = Tree(left, depth, fanout), Tree(right, depth, fanout)
    names = a.leaves.select("arc", "archive").unionByName(b.leaves.select("arc", "archive")).groupBy("arc").agg(F.first("archive").alias("archive"))
    roots = a.roots.withColumnRenamed("root", "root_a").join(b.roots.withColumnRenamed("root", "root_b"), "arc", "full").join(names, "arc")
    roots = roots.withColumn("intact", F.col("root_a").eqNullSafe(F.col("root_b")))
    open_ = roots.where("not intact").select("arc", F.lit("").alias("parent"))
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    for k in range(depth, -1, -1):
        below = [t.levels[k].join(open_, ["arc", "parent"], "left_semi").select("arc", "name", F.col("hash").alias(n)) for t, n in ((a, "a"), (b, "b"))]
        open_ = materialize(below[0].join(below[1], ["arc", "name"], "full").where(differs).select("arc", F.col("name").alias("parent")), "open")
    found = open_.withColumnRenamed("parent", "name")
    place = [t.leaves.join(found, ["arc", "name"], "left_semi").select("arc", "name", F.struct("idx", "offset", "length").alias(n)) for t, n in ((a, "a"), (b, "b"))]
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    where = F.coalesce("a", "b")
    return roots, place[0].join(place[1], ["arc", "name"], "full").select("arc", where["idx"].alias("idx"), status.alias("status"), where["offset"].alias("offset"), where["length"].alias("length"))


def report(left: DataFrame, right: DataFrame, fanout: int = 16) -> DataFrame:
    """One row for each archive: its roots, whether they agree, and the faults in order."""
    roots, faults = audit(left, right, fanout)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "status", "offset", "length"))), lambda x: F.concat_ws(":", x["idx"], x["status"], x["offset"], x["length"])), ",")
    found = faults.groupBy("arc").agg(F.count("*").alias("n_faults"), text.alias("faults"))
    out = roots.join(found, "arc", "left")
    return out.select("archive", "root_a", "root_b", "intact", F.coalesce("n_faults", F.lit(0)).alias("n_faults"), F.coalesce("faults", F.lit("")).alias("faults"))
