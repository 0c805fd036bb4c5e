"""Formula attempts as they arrive: which repeat an earlier form or selection, and the best of each form so far.

What has been seen is keyed state of a streaming query, so a batch costs what it brings, not what there already is. Each
batch is written under its number, and only counts once the row with its metrics is there: a batch that is run again after
a stop replaces itself. Indices must follow each other without a gap from batch to batch; otherwise the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import scans, scoring

#: What a stream has to bring; `sound` says that an attempt has a signal and a reward, `flaw` why not.
FIELDS = ("attempt_index", "canonical_hash", "selection_hash", "token_len", "reward", "sound", "flaw")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN = "first long, n long, sound_n long, first_sound long, best_reward double, best_len int, best_index long"
_OUT = "kind string, key string, attempt_index long, repeated boolean, " + _SEEN


class _Seen(StatefulProcessor):
    """For each attempt of a key: whether the key was there before, and what is known of the key after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, n, sound_n, first_sound, reward, length, index = self.seen.get() if self.seen.exists() else (None, 0, 0, None, None, None, None)
        for r in sorted(rows, key=lambda r: r["attempt_index"]):
            i, repeated = r["attempt_index"], n > 0
            first, n = i if first is None else first, n + 1
            if r["sound"]:
                sound_n, first_sound = sound_n + 1, i if first_sound is None else first_sound
                if reward is None or (-r["reward"], r["token_len"], i) < (-reward, length, index):
                    reward, length, index = r["reward"], r["token_len"], i
            yield Row(kind=key[0], key=key[1], attempt_index=i, repeated=repeated, first=first, n=n, sound_n=sound_n, first_sound=first_sound, best_reward=reward, best_len=length, best_index=index)
        self.seen.update((first, n, sound_n, first_sound, reward, length, index))

    def close(self) -> None:
        pass


def marked(stream: DataFrame) -> DataFrame:
    """One row for each attempt and kind of key: `form` where there is a canonical hash, `selection` where it is sound,
    and `attempt`, which needs no state."""
    form = F.when(F.col("canonical_hash").isNotNull(), F.struct(F.lit("form").alias("kind"), F.col("canonical_hash").alias("key")))
    chosen = F.when(F.col("sound"), F.struct(F.lit("selection").alias("kind"), F.col("selection_hash").alias("key")))
    keyed = stream.select("attempt_index", "token_len", "reward", "sound", F.explode(F.array_compact(F.array(form, chosen))).alias("k")).select("k.kind", "k.key", "attempt_index", "token_len", "reward", "sound")
    seen = keyed.groupBy("kind", "key").transformWithState(statefulProcessor=_Seen(), outputStructType=_OUT, outputMode="Append", timeMode="None")
    nothing = [F.lit(None).cast(kind).alias(n) for n, kind in (("reward", "double"), ("sound", "boolean"), ("flaw", "string"))]
    plain = stream.select(F.lit("attempt").alias("kind"), F.lit(None).cast("string").alias("key"), "attempt_index", *FIELDS[4:])
    return seen.select("*", *nothing).unionByName(plain, allowMissingColumns=True)


def resolved(rows: DataFrame) -> DataFrame:
    """(attempt_index, status, reward) from the rows of `marked`; all kinds of an attempt are in one batch."""
    def repeats(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("repeated")))

    out = rows.groupBy("attempt_index").agg(F.max("flaw").alias("flaw"), F.max("reward").alias("reward"), repeats("form").alias("form"), repeats("selection").alias("selection"))
    status = F.coalesce("flaw", F.when(F.col("form"), "canonical_duplicate").when(F.col("selection"), "selection_duplicate").otherwise("accepted_unique"))
    return out.select("attempt_index", status.alias("status"), "reward")


def _committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What `folder` has under `name`, of batches whose metrics are there."""
    return spark.read.parquet(f"{folder}/{name}").join(spark.read.parquet(f"{folder}/metrics").select("batch").distinct(), "batch", "left_semi")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each batch, or each arrival where `follow` was given their size: its number, first and last index, attempts,
    accepted ones and duplicates, sound ones, mean and best reward, and the best reward so far, which starts at the hard one.
    An arrival that came in several batches is one row."""
    total = [F.sum(n).alias(n) for n in ("attempts", "accepted_unique", "canonical_duplicate", "selection_duplicate", "sound", "reward")]
    found = spark.read.parquet(f"{folder}/metrics").groupBy("arrival").agg(F.min("first").alias("first"), F.max("last").alias("last"), *total, F.max("best_reward").alias("best_reward"), F.max("best_so_far").alias("best_so_far"))
    mean = F.try_divide("reward", F.col("sound").cast("double")).alias("mean_reward")
    return found.select(F.col("arrival").cast("int").alias("batch"), "first", "last", "attempts", "accepted_unique", "canonical_duplicate", "selection_duplicate", "sound", mean, "best_reward", "best_so_far")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """(attempt_index, status, reward) of all batches."""
    return _committed(spark, folder, "attempts").drop("batch")


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """(canonical_hash, attempts, first_index, first_sound, sound, token_len, reward, best_index): the last word on each form."""
    last = _committed(spark, folder, "forms").groupBy("key").agg(F.max_by(F.struct("n", "first", "first_sound", "sound_n", "best_len", "best_reward", "best_index"), "n").alias("x"))
    return last.select(F.col("key").alias("canonical_hash"), F.col("x.n").alias("attempts"), F.col("x.first").alias("first_index"), "x.first_sound", F.col("x.sound_n").alias("sound"), F.col("x.best_len").alias("token_len"), F.col("x.best_reward").alias("reward"), "x.best_index")


def follow(stream: DataFrame, folder: str, checkpoint: str, size: int | None = None) -> StreamingQuery:
    """Starts a query over `stream` (FIELDS) that takes what is there and ends; started again it goes on behind that.

    folder and checkpoint are in storage that driver and executors share.
    size: attempts of an arrival. Metrics are of arrivals then, of which a batch of the query may bring many at once; so the
    number of batches, each with jobs of its own, does not grow with that of arrivals.
    """
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        # A session of the query's own, so tables are read with it.
        session = rows.sparkSession
        rows = rows.persist()
        try:
            done, best = -1, scoring.HARD
            try:
                before = session.read.parquet(f"{folder}/metrics").where(F.col("batch") < batch).agg(F.max("last"), F.max("best_so_far")).first()
                done, best = (before[0], before[1]) if before[0] is not None else (done, best)
            except Exception as error:  # no batch has been written yet
                if "PATH_NOT_FOUND" not in str(error):
                    raise
            seen = Observation("batch")
            found = resolved(rows).observe(seen, F.min("attempt_index").alias("first"), F.max("attempt_index").alias("last"), F.count(F.lit(1)).alias("attempts"))
            found.write.mode("overwrite").parquet(f"{folder}/attempts/batch={batch}")
            got = seen.get
            if not got["attempts"]:
                return
            repeated = rows.where("kind = 'attempt'").count() != got["attempts"]
            if got["first"] != done + 1 or got["last"] - got["first"] + 1 != got["attempts"] or repeated:
                raise ValueError(f"attempts {got['first']} to {got['last']} ({got['attempts']} different) do not follow {done} without a gap")
            rows.where("kind = 'form'").groupBy("key").agg(F.max_by(F.struct("first", "n", "sound_n", "first_sound", "best_reward", "best_len", "best_index"), "n").alias("x")).select("key", "x.*").write.mode("overwrite").parquet(f"{folder}/forms/batch={batch}")
            of = lambda status: F.count_if(F.col("status") == status).alias(status)
            arrival = (F.floor(F.col("attempt_index") / size) if size else F.lit(batch)).cast("long").alias("arrival")
            per = session.read.parquet(f"{folder}/attempts/batch={batch}").groupBy(arrival).agg(
                F.min("attempt_index").alias("first"), F.max("attempt_index").alias("last"), F.count(F.lit(1)).alias("attempts"), of("accepted_unique"), of("canonical_duplicate"), of("selection_duplicate"),
                F.count("reward").alias("sound"), F.sum("reward").alias("reward"), F.max("reward").alias("best_reward"),
            )
            so_far = scans.running(per, "arrival", {"best_so_far": ("best_reward", "max")})
            so_far.withColumn("best_so_far", F.greatest("best_so_far", F.lit(best))).write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch}")
        finally:
            rows.unpersist()

    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        return marked(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)
