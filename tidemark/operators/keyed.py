"""A table of one row a key: upserts that leave untouched partitions alone, and lookups.

Rows are ``digest`` (hex), ``kind``, ``size``, ``version``, ``written_at``, ``payload``
(JSON or any text) and a check of these, in Parquet folders by the first digits of the
digest.  An upsert reads and replaces the folders its keys fall into; of the rows of
one key the latest stands, so that the order in which batches come, and whether one
comes twice, makes no difference.  The merged rows are written beside the table before
they replace anything: a run that ends in between can be repeated.

Defined results: a row of another version is stale, one whose check or size doesn't
fit is damaged, and files that can't be read are passed over; all these are misses,
never faults.  Of rows of one key and time the greatest payload stands; rows without
a digest are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scratch import discard, stored

VERSION = 1
#: Rows of a file, so that tasks that merge are more where rows are more.
FILE = 1 << 18
KEY = ["digest", "kind"]
ROW = "digest string, kind string, size long, version int, written_at timestamp, payload string, check long"


def check() -> Column:
    return F.xxhash64("digest", "kind", "size", "version", "payload")


def entries(rows: DataFrame, kind: str | None = None, version: int = VERSION) -> DataFrame:
    """Rows (digest, size, payload, written_at[, kind]) as the table keeps them."""
    named = rows.withColumn("kind", F.lit(kind)) if kind is not None else rows
    out = named.withColumn("version", F.lit(version)).withColumn("check", check())
    return out.select(*[F.col(c).cast(t) for c, t in (x.split() for x in ROW.split(", "))])


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows with their ``part``, or None where no table is yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(f"{ROW}, part string").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def _part(digits: int) -> Column:
    return F.substring("digest", 1, digits)


def latest(rows: DataFrame) -> DataFrame:
    """One row a key: the latest, of equal times the greatest."""
    cols = [c for c in rows.columns if c not in (*KEY, "written_at")]
    top = F.max(F.struct("written_at", *cols))
    return rows.groupBy(*KEY).agg(top.alias("x")).select(*KEY, "x.*").select(*rows.columns)


def merged(rows: DataFrame, parts: int, files: int = 1) -> DataFrame:
    """``latest`` of rows with ``part``, dealt as they are written: a folder's digests over ``files`` tasks.

    One shuffle serves both, as a key's rows are in one folder and file; hex digests
    go through it as bytes.
    """
    packed = F.unhex("digest")
    hexed = F.coalesce(F.lower(F.hex(packed)) == F.col("digest"), F.lit(False))
    cols = [c for c in rows.columns if c not in (*KEY, "written_at", "part")]
    at = F.pmod(F.xxhash64("digest"), F.lit(files)).alias("__at")
    own = ["part", "__at", "__bytes", "__text", "kind"]
    x = rows.select("part", at, F.when(hexed, packed).alias("__bytes"), F.when(~hexed, F.col("digest")).alias("__text"), "kind", "written_at", *cols)
    # more tasks than files, or several would fall into one task; those without rows write nothing
    x = x.repartition(4 * parts * files, "part", "__at")
    top = x.groupBy(*own).agg(F.max(F.struct("written_at", *cols)).alias("x"))
    digest = F.coalesce(F.lower(F.hex("__bytes")), "__text").alias("digest")
    return top.select(digest, "kind", "x.*", "part").select(*rows.columns)


def upsert(path: str, rows: DataFrame, digits: int = 2, files: int | None = None) -> None:
    """Merge rows of ``entries`` into the table; only folders of their digests are written.

    ``files`` is how many files a folder gets, by default one for ``FILE`` rows to be
    merged; its rows are dealt over them by digest.
    """
    spark = rows.sparkSession
    new = stored(rows.where("digest is not null").withColumn("part", _part(digits)), "upsert", compression="zstd")
    parts = [r[0] for r in new.select("part").distinct().collect()]  # 16 ** digits at most
    if parts:
        old = read(spark, path)
        whole = new if old is None else old.where(F.col("part").isin(parts)).unionByName(new)
        files = files or 1 + whole.count() // (len(parts) * FILE)  # from the files' footers
        # all folders are written beside the table before one of them is replaced
        merged(whole, len(parts), files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(path)
    discard(new)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour", digits: int = 2) -> StreamingQuery:
    """Merge a stream of rows of ``entries``, batch by batch, until it has none at present.

    What is delivered again within ``late`` is dropped before the merge; a batch that
    is repeated after a failure merges to the same table.
    """
    once = stream.withWatermark("written_at", late).dropDuplicatesWithinWatermark([*KEY, "written_at", "check"])
    merge = lambda batch, _: upsert(path, batch, digits)
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookup(wanted: DataFrame, path: str, kind: str, version: int = VERSION, digits: int = 2) -> DataFrame:
    """``wanted`` (with digest, size) and ``found`` (hit, stale, damaged or miss) and the payload of hits.

    The join is on part and digest, so that only folders of wanted digests need be read.
    """
    table = read(wanted.sparkSession, path)
    if table is None:
        return wanted.withColumn("found", F.lit("miss")).withColumn("payload", F.lit(None).cast("string"))
    own = table.where(F.col("kind") == kind).withColumn("sound", F.coalesce(F.col("check") == check(), F.lit(False)))
    own = own.select(F.col("part").alias("__part"), F.col("digest").alias("__digest"), F.struct("version", "size", "sound", "payload").alias("__row"))
    w = wanted.withColumn("__p", _part(digits))
    j = w.join(own, (w["__p"] == own["__part"]) & (w["digest"] == own["__digest"]), "left")
    row = F.col("__row")
    found = (
        F.when(row.isNull(), "miss").when(~row["sound"], "damaged").when(row["version"] != version, "stale").when(~row["size"].eqNullSafe(F.col("size")), "damaged").otherwise("hit")
    )
    j = j.withColumn("found", found)
    return j.select(*wanted.columns, "found", F.when(F.col("found") == "hit", row["payload"]).alias("payload"))


def forget(path: str, spark: SparkSession, digests: DataFrame, digits: int = 2) -> None:
    """Drop rows of these digests; folders without any of them keep their files, emptied ones hold an empty file."""
    table = read(spark, path)
    if table is None:
        return
    gone = digests.select("digest").distinct().withColumn("part", _part(digits))
    parts = [r[0] for r in gone.select("part").distinct().collect()]
    own = table.where(F.col("part").isin(parts))
    left = stored(own.join(gone, ["part", "digest"], "left_anti").select(*table.columns), "left")
    # a folder of which nothing is left is no output of the writer: it keeps one row that no lookup takes
    void = own.select("part").distinct().join(left.select("part").distinct(), "part", "left_anti")
    blank = void.select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in ROW.split(", "))], "part")
    whole = stored(left.unionByName(blank), "forget")
    whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    discard(left, whole)


def cached(wanted: DataFrame, path: str, kind: str, make, version: int = VERSION) -> DataFrame:
    """``wanted`` with the payload of each row's bytes: looked up, or made by ``make`` and kept.

    ``make`` takes the rows that were missed, once per digest, and returns digest,
    size, payload; what it returns nothing for has a null payload.
    """
    looked = stored(lookup(wanted, path, kind, version), "looked")
    missed = looked.where("found <> 'hit'").select(*wanted.columns).dropDuplicates(["digest"])
    made = stored(make(missed).withColumn("written_at", F.current_timestamp()).select("digest", "size", "payload", "written_at"), "made")
    upsert(path, entries(made, kind, version))
    new = made.select("digest", F.col("payload").alias("__new"))
    return looked.join(new, "digest", "left").select(*wanted.columns, "found", F.coalesce("payload", "__new").alias("payload"))
