"""WARC records and Merkle fixity audits of archives.

Records are written in WARC/1.1 form; an archive is an ordered run of them. The leaf of a place is
the hash of the offset ranges and digests of its records; ``FANOUT`` neighbouring nodes are hashed into
one of the next level, up to the root. Two replicas are compared from their roots, and only the children
of nodes that differ are looked at, level by level, down to the corrupt records.

All of it is DataFrame functions. Bytes are hashed before any shuffle, records that both replicas have
and repeated ones are one row, and all that follows is dealt once by archive. An archive holds the records
of a fixed range of numbers; one of over ``2 * ARCHIVE`` different records (repeated or null ids) is cut
into parts by digest, so that no group grows with the table.

Defined results: a null payload or url is an empty one; records of a null id are in archives whose number
is null; records of equal ids are ordered by their bytes; a record that only one replica has is ``missing``
or ``extra``, or ``corrupt`` where its id has another one instead (in one part); one whose range alone differs
is ``moved``, all others are ``ok``; an empty table has no archives and gives an empty table; other columns
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import written

#: Numbers of records in an archive, and children of a node of its tree.
ARCHIVE = 4096
FANOUT = 16
LEVELS = 3  # FANOUT ** LEVELS covers an archive
NONE = -(1 << 63)  # the archive of records without id


def record(url: Column, payload: Column) -> Column:
    """The bytes of a resource record: header, empty line, payload and two line ends."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def _counted(ours: DataFrame, theirs: DataFrame, key: str, data: str) -> DataFrame:
    """Different records ``key, length, digest`` with their number in either replica and their archive."""

    def hashed(records: DataFrame, a: int, b: int) -> DataFrame:
        return records.select(F.col(key).cast("bigint").alias("key"), F.length(data).cast("bigint").alias("length"), F.sha2(F.col(data), 256).alias("digest"), F.lit(a).alias("ours"), F.lit(b).alias("theirs"))

    both = hashed(ours, 1, 0).unionByName(hashed(theirs, 0, 1))
    both = both.groupBy("key", "length", "digest").agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))
    return both.withColumn("archive", F.coalesce(F.floor(F.col("key") / ARCHIVE).cast("bigint"), F.lit(NONE)))


def leaves(ours: DataFrame, theirs: DataFrame, key: str, data: str) -> DataFrame:
    """``archive, part, place, key, length, digest, ours, theirs`` of each different record, and where its first copy starts in either."""
    counted = written(_counted(ours, theirs, key, data), "records")
    large = counted.groupBy("archive").agg(F.count("*").alias("n")).where(F.col("n") > 2 * ARCHIVE)
    of_digest = F.xxhash64("digest")
    parted = counted.join(large, "archive", "left").withColumn("part", F.coalesce(F.pmod(of_digest, F.ceil(F.col("n") / ARCHIVE)), F.lit(0)).cast("int")).drop("n")
    # a place is a number's own, so that a record that is lost moves no other
    place = F.pmod(F.coalesce("key", F.xxhash64(F.lit(1), "digest")), F.lit(ARCHIVE)).cast("int")
    order = Window.partitionBy("archive", "part").orderBy("key", "digest", "length").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda n: F.sum(F.col("length") * F.col(n)).over(order) - F.col("length") * F.col(n)
    return parted.repartition("archive", "part").select("*", place.alias("place"), start("ours").alias("start"), start("theirs").alias("their_start"))


def trees(leaf: DataFrame) -> list[DataFrame]:
    """Levels 0 (places of records) to ``LEVELS`` (the root) of both replicas: ``archive, part, place, x, y``."""
    joined = lambda rows, *fields: F.sha2(F.concat_ws("|", F.transform(F.array_sort(rows), lambda r: F.concat_ws(":", *(r[f] for f in fields)))), 256)
    ours, theirs = (F.collect_list(F.when(F.col(n) > 0, F.struct(F.col(s).alias("start"), "length", "digest", F.col(n).alias("n")))) for n, s in (("ours", "start"), ("theirs", "their_start")))
    fields = ("start", "length", "digest", "n")
    levels = [leaf.groupBy("archive", "part", "place").agg(joined(ours, *fields).alias("x"), joined(theirs, *fields).alias("y"))]
    for _ in range(LEVELS):
        up = F.floor(F.col("place") / FANOUT).cast("int").alias("place")
        nodes = [joined(F.collect_list(F.struct("place", F.col(c).alias("node"))), "place", "node").alias(c) for c in "xy"]
        levels.append(levels[-1].groupBy("archive", "part", up).agg(*nodes))
    return levels


def differing(levels: list[DataFrame]) -> DataFrame:
    """``archive, part, places``: the places of an archive that differ, found from the root down."""
    found = None
    for level in reversed(levels):
        if found is not None:
            level = level.join(found, ["archive", "part"]).where(F.array_contains("places", F.floor(F.col("place") / FANOUT).cast("int")))
        found = level.where("x <> y").groupBy("archive", "part").agg(F.collect_list("place").alias("places"))
    return found


def audit(ours: DataFrame, theirs: DataFrame, key: str, data: str) -> DataFrame:
    """All records of both replicas: ``archive, key, start, length, digest, replica_digest, verdict``."""
    leaf = leaves(ours, theirs, key, data)
    bad = written(differing(trees(leaf)), "differing")
    looked = leaf.join(bad, ["archive", "part"], "left").withColumn("bad", F.coalesce(F.array_contains("places", F.col("place")), F.lit(False)))
    both = F.least("ours", "theirs")
    at = lambda first, last, start: F.explode(F.transform(F.sequence(first, last), lambda i: start + i * F.col("length")))
    same = F.when(~F.col("bad") | (F.col("start") == F.col("their_start")), "ok").otherwise("moved")
    intact = looked.where("ours > 0 and theirs > 0").select("archive", "key", at(F.lit(0), both - 1, F.col("start")).alias("start"), "length", "digest", F.col("digest").alias("replica_digest"), same.alias("verdict"))
    # below nodes that differ: what one replica has and the other hasn't, by turns of an id
    alone = looked.where("bad and ours <> theirs").withColumn("mine", F.col("ours") > F.col("theirs"))
    start = F.when(F.col("mine"), F.col("start")).otherwise(F.col("their_start"))
    alone = alone.select("archive", "part", "place", "key", "mine", "length", "digest", at(both, F.greatest("ours", "theirs") - 1, start).alias("start"))
    turn = F.row_number().over(Window.partitionBy("archive", "part", "place", "key", "mine").orderBy("start", "digest"))
    paired = alone.withColumn("turn", turn).groupBy("archive", "part", "place", "key", "turn").agg(*(F.max(F.when(F.col("mine") == m, F.struct("start", "length", "digest"))).alias(n) for n, m in (("a", True), ("b", False))))
    verdict = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("corrupt")
    found = paired.select("archive", "key", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("start", "length")), F.col("a.digest").alias("digest"), F.col("b.digest").alias("replica_digest"), verdict.alias("verdict"))
    archive = F.when(F.col("archive") != NONE, F.col("archive")).alias("archive")
    return intact.unionByName(found).select(archive, F.col("key").alias(key), "start", "length", "digest", "replica_digest", "verdict")
