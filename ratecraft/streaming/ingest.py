"""Rate uploads that keep arriving: names, rejection, duplicate guard on keyed state, groups and outcome, as three streams.

``check_uploads`` settles names and rejection of each arriving upload and writes accepted rows; ``guard_rows`` inserts each of them
once; ``number_groups`` gives each new group its id. The rate table itself is read by none of them: what it holds is known to the
state of the streams, which Spark keeps in its checkpoints. All of them survive a restart at any point and a replay of any upload.

Folder of a job: ``outcome`` and ``members`` (a decision a batch), ``accepted`` (records for the guard), ``rows`` (the rate rows),
``groups`` (key_hash, group_id), ``known`` (groups the table had before), ``checkpoint``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ratecraft import constants as K
from ratecraft.operators import maintain as M
from ratecraft.plans.ingest import member_names, named_rows, problems
from ratecraft.session import stage

RECORD = "row_hash string, kind string, key_hash string, content string, batch bigint, line bigint, upload_id string, payload string"
OUTCOME = "upload_id string, success boolean, problem string"
MEMBER = "field string, name string"
INSERTED = "key_hash string, upload_id string, payload string"
GROUP = "key_hash string, group_id bigint"
KNOWN = "bucket bigint, key_hash string, group_id bigint"
#: how many counters number the groups between them; fixed for the life of a job
BUCKETS = 256

Masters = Callable[[], tuple[dict[str, DataFrame], DataFrame, DataFrame]]


def rate_uploads(spark: SparkSession, path: str, schema: str, uploads_per_batch: int = 20, form: str = "csv") -> DataFrame:
    """Upload files as they arrive in a folder, cells as text. A file is one upload: it is accepted or rejected as a whole."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", uploads_per_batch)
    files = (source.option("header", True) if form == "csv" else source).format(form).load(path)
    return files.withColumns({"upload_id": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")})


# ---- acceptance -----------------------------------------------------------------------------------
def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return _exists(spark, f"{path}/_SUCCESS")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was written under a path so far, no rows where nothing was."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def numbered(batch: DataFrame) -> DataFrame:
    """A batch with ``line``: rows by upload, block and place there, so that a retried batch numbers them as the first try did.

    Lines are dealt to all tasks, for an upload comes in few blocks. The numbers of the blocks, a few rows, are sent to the batch:
    a batch of repeated cells is a small file however many rows it has, so by file sizes Spark may send the batch to them.
    """
    placed = stage(batch.withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("upload_id", "block").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("upload_id", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("upload_id", "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    lines = placed.join(F.broadcast(offsets), ["upload_id", "block"]).withColumn("line", F.col("_at") + F.col("_shift"))
    return stage(lines.drop("_at", "_shift", "block").repartition("line"))


def records(rows: DataFrame, kind: str, payload: bool = False) -> DataFrame:
    """Typed rates as records of the guard.

    ``row_hash`` covers the rule and the RTO list, so rows with the same live content, and rows of one group with the same list,
    share it, and one hot rule is still spread by its lists.
    """
    rule = [f for f in K.GROUP_FIELDS if f not in ("status", "is_deleted", "upload_batch")]
    rto = F.coalesce("new_rto_list", F.lit("\x00"))
    return rows.select(
        F.sha2(F.concat_ws("\x1f", M.key_text(rows, rule), rto), 256).alias("row_hash"), F.lit(kind).alias("kind"), "key_hash",
        M.content_hash(rows, K.LIVE_CONTENT_FIELDS).alias("content"),
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("batch", "bigint"), ("line", "bigint"), ("upload_id", "string"))],
        (F.to_json(F.struct(*[c for c in rows.columns if c not in ("batch", "line", "upload_id")])) if payload else F.lit(None).cast("string")).alias("payload"))


def feed_table(rates: DataFrame, folder: str) -> None:
    """Tells a job what a rate table holds: before its first upload the whole table, later rows that were added past it or switched.

    Rows that are live (ACTIVE and not deleted) block uploads of their content, rows that no longer are stop doing so; every row
    blocks its RTO list in its group. ``rates`` has ``key_hash`` and ``group_id``; new group ids come after its highest.
    """
    live = F.coalesce((F.col("status") == "ACTIVE") & (F.col("is_deleted") == "NO"), F.lit(False))
    table = rates.drop("batch", "line", "upload_id")
    fed = [records(table, "held"), records(table.where(~live), "gone"), records(table.where(live), "live")]
    reduce(DataFrame.unionByName, fed).distinct().write.mode("append").parquet(f"{folder}/accepted")
    feed_groups(rates.select("key_hash", "group_id").distinct(), folder)


def feed_groups(groups: DataFrame, folder: str) -> None:
    """Adds (key_hash, group_id) to the known groups, and for each counter the highest id it has to pass."""
    top = groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).cast("bigint")).scalar()
    floors = groups.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(None).cast("string").alias("key_hash"), top.alias("group_id"))
    own = groups.select(_bucket().alias("bucket"), "key_hash", F.col("group_id").cast("bigint").alias("group_id"))
    own.unionByName(floors).write.mode("append").parquet(f"{folder}/known")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key_hash"), F.lit(BUCKETS)).cast("bigint")


def check_batch(batch: DataFrame, number: int, folder: str, masters: Masters) -> None:
    """Decides on the uploads of a batch and writes the rows of those accepted.

    The decisions are written first and a retried batch keeps them; its records may then stand twice in ``accepted``, which
    the guard ignores. A name that no master has is a new member, known to the batches that follow.
    """
    spark = batch.sparkSession
    rows = numbered(batch)
    uploads = rows.select("upload_id").distinct()
    dimensions, rto_master, make_master = masters()
    before = _table(spark, f"{folder}/members", f"{MEMBER}, batch bigint").where(F.col("batch") < number).select("field", "name").distinct()
    known = {}  # new members have no number yet; a master's name of the same spelling goes before theirs
    for field, master in dimensions.items():
        own = before.where(F.col("field") == field).select(F.lit(-1).cast("bigint").alias("id"), "name")
        known[field] = master.select(F.col("id").cast("bigint").alias("id"), "name").unionByName(own)
    decided = f"{folder}/outcome/batch={number}"
    if not _written(spark, decided):
        found = problems(rows, rto_master, make_master, ("line", "upload_id"))
        first = found.groupBy("upload_id").agg(F.min_by("problem", F.struct("line", "problem")).alias("problem"))
        uploads.join(first, "upload_id", "left").select("upload_id", F.col("problem").isNull().alias("success"), "problem").write.mode("overwrite").parquet(decided)
    accepted = stage(rows.join(spark.read.schema(OUTCOME).parquet(decided).where("success").select("upload_id"), "upload_id"))
    members = f"{folder}/members/batch={number}"
    names = stage(member_names(accepted, known))
    if not _written(spark, members):
        names.where("is_new").select("field", "name").write.mode("overwrite").parquet(members)
    kept = named_rows(accepted, names, list(known))
    # staged: hashes and payload would each work out every typed cell again
    typed = stage(M.typed_upload(kept)).withColumn("batch", F.lit(number).cast("bigint"))
    # The first row of each (group, RTO list): copies inside a batch go before the guard's shuffle. A copy whose text differs
    # elsewhere is held back by the first one either way, unless the first one's content is live, so the content counts too.
    made = records(typed, "upload", payload=True)
    first = made.groupBy("row_hash", "key_hash", "content").agg(F.min_by(F.struct(*made.columns), "line").alias("_r")).select("_r.*")
    first.write.mode("append").parquet(f"{folder}/accepted")


def check_uploads(uploads: DataFrame, folder: str, masters: Masters) -> StreamingQuery:
    """Starts the first stream over ``uploads`` (see :func:`rate_uploads`); stops when all that has arrived is decided.

    ``masters`` gives the dimension masters by field (see ``DIMENSIONS``), the RTO master and the make master, read anew for each
    batch. A batch with no rows changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        check_batch(batch, number, folder, masters)

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint/check").trigger(availableNow=True).start()


# ---- keyed state ----------------------------------------------------------------------------------
@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several columns needs the RocksDB store; a query keeps the setting it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _row_guard(ttl_ms: int | None) -> StatefulProcessor:
    import pandas as pd

    class RowGuard(StatefulProcessor):
        """Lets each row pass once: what its key holds is a set of groups that have it and of contents that are live."""

        def init(self, handle) -> None:
            self.held = handle.getMapState("held", "hash string", "batch bigint", ttl_ms)
            self.live = handle.getMapState("live", "hash string", "batch bigint")

        def handleInputRows(self, key, rows, timer_values):
            frame = pd.concat(list(rows), ignore_index=True)
            frame["batch"] = frame["batch"].fillna(-1)  # the table's own rows come before uploads
            frame = frame.sort_values(["batch", "line", "kind"], kind="stable")
            passed = []
            for r in frame.itertuples(index=False):
                if r.kind == "held":
                    self.held.updateValue((r.key_hash,), (int(r.batch),))
                elif r.kind == "live":
                    self.live.updateValue((r.content,), (int(r.batch),))
                elif r.kind == "gone":
                    self.live.removeKey((r.content,))
                elif not self.held.containsKey((r.key_hash,)) and not self.live.containsKey((r.content,)):
                    self.held.updateValue((r.key_hash,), (int(r.batch),))
                    passed.append((r.key_hash, r.upload_id, r.payload))
            yield pd.DataFrame(passed, columns=["key_hash", "upload_id", "payload"], dtype="object")

        def close(self) -> None:
            pass

    return RowGuard()


def guard_rows(spark: SparkSession, folder: str, keep_ms: int | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts the second stream: accepted rows into ``rows``, each (group, RTO list) once and none whose content is live.

    A key holds the few groups of one rule and RTO list. ``keep_ms`` is the time to live of what uploads left in the state: a replay
    that comes later is inserted again, so it is unlimited unless set. Of rows that arrive together the first batch and line wins.
    """
    records_in = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/accepted")
    with _rocksdb(spark):
        rows = records_in.groupBy("row_hash").transformWithStateInPandas(
            _row_guard(keep_ms), INSERTED, "Append", "None" if keep_ms is None else "ProcessingTime")
        return rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint/guard").outputMode(
            "append").trigger(availableNow=True).start()


def _group_numbers(buckets: int) -> StatefulProcessor:
    import pandas as pd

    class GroupNumbers(StatefulProcessor):
        """Ids of a bucket's groups: counter * buckets + bucket + 1, so that buckets never meet."""

        def init(self, handle) -> None:
            self.known = handle.getMapState("known", "hash string", "group_id bigint")
            self.counter = handle.getValueState("counter", "n bigint")

        def handleInputRows(self, key, rows, timer_values):
            n = int(self.counter.get()[0]) if self.counter.exists() else 0
            wanted = set()
            for frame in rows:  # known groups go before new ones, whatever order they come in
                fed = frame["group_id"].notna()
                for r in frame[fed].itertuples(index=False):
                    if r.key_hash is None:
                        n = max(n, -(-int(r.group_id) // buckets))
                    else:
                        self.known.updateValue((r.key_hash,), (int(r.group_id),))
                wanted.update(frame["key_hash"][~fed])
            made = []
            for h in sorted(wanted):
                if not self.known.containsKey((h,)):
                    made.append((h, n * buckets + int(key[0]) + 1))
                    self.known.updateValue((h,), (made[-1][1],))
                    n += 1
            self.counter.update((n,))
            yield pd.DataFrame(made, columns=["key_hash", "group_id"]).astype({"group_id": "int64"})

        def close(self) -> None:
            pass

    return GroupNumbers()


def _distinct_in_batches(frames):
    for frame in frames:
        yield frame.drop_duplicates()


def number_groups(spark: SparkSession, folder: str) -> StreamingQuery:
    """Starts the third stream: an id for every group of ``rows`` that has none, into ``groups``.

    Ids are unique, not gapless, and come after those of the known groups. Repeats of a group go before the shuffle, batch by
    batch; a counter's task then holds the distinct groups of its share of one trigger.
    """
    found = spark.readStream.schema(INSERTED).parquet(f"{folder}/rows").select("key_hash").mapInPandas(_distinct_in_batches, "key_hash string")
    if not _exists(spark, f"{folder}/known"):
        feed_groups(spark.createDataFrame([], GROUP), folder)
    fed = spark.readStream.schema(KNOWN).parquet(f"{folder}/known")
    both = fed.unionByName(found.select(_bucket().alias("bucket"), "key_hash", F.lit(None).cast("bigint").alias("group_id")))
    with _rocksdb(spark):
        groups = both.groupBy("bucket").transformWithStateInPandas(_group_numbers(BUCKETS), GROUP, "Append", "None")
        return groups.writeStream.format("parquet").option("path", f"{folder}/groups").option("checkpointLocation", f"{folder}/checkpoint/groups").outputMode(
            "append").trigger(availableNow=True).start()


def run_ingest(uploads: DataFrame, folder: str, masters: Masters, keep_ms: int | None = None) -> None:
    """Everything that has arrived, through all three streams; nothing happens where nothing ever arrived."""
    spark = uploads.sparkSession
    check_uploads(uploads, folder, masters).awaitTermination()
    if not _exists(spark, f"{folder}/accepted"):
        return
    guard_rows(spark, folder, keep_ms).awaitTermination()
    number_groups(spark, folder).awaitTermination()


# ---- what came of it ------------------------------------------------------------------------------
def ingested_rates(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rate rows of a job with ``group_id`` and ``upload_id``; ``schema`` is that of typed uploads."""
    rows = _table(spark, f"{folder}/rows", INSERTED)
    known = _table(spark, f"{folder}/known", KNOWN).where("key_hash IS NOT NULL").select("key_hash", "group_id").distinct()
    groups = _table(spark, f"{folder}/groups", GROUP).unionByName(known)
    return rows.withColumn("_r", F.from_json("payload", schema)).select("_r.*", "upload_id").join(groups, "key_hash")


def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(upload_id, success, rows, problem) of every upload that was decided."""
    outcome = _table(spark, f"{folder}/outcome", OUTCOME)
    counts = _table(spark, f"{folder}/rows", INSERTED).groupBy("upload_id").agg(F.count("*").alias("rows"))
    return outcome.join(counts, "upload_id", "left").select("upload_id", "success", F.coalesce("rows", F.lit(0)).alias("rows"), "problem")
