"""Structured Streaming jobs (X): ingestion, arrival, status, event-time metrics, watches and incremental indexing.

Each job is a function of a streaming DataFrame; the queries feed it the given tables as a file stream, let it drain with
availableNow and return what its sink holds. Windowed jobs run in update mode, so their state ends with the watermark, after
which late rows are dropped; a key that several batches say counts as the last of them says it. Sessions alone are shown in
complete mode, which keeps them all. The latest status of a key is state of its own, with a timer that ends it. What must be
remembered for good (contents, facts, index entries, when a job last ran) is a table in the shared folder whose parts bear
the number of the batch that wrote them: a job that is stopped goes on where it was, and a batch that runs again writes the same part again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.operators.density import with_retry
from factloom.operators.indexing import DIM, markdown_points
from factloom.operators.points import EMBEDDED, PARAGRAPH_SQL, PointStore
from factloom.plans.fixtures import oracle
from factloom.plans.fixtures import table as read
from factloom.plans.registry import ORACLE_SQL, QUERIES
from factloom.session import checkpointed, new_folder

WATERMARK = "1 day"


def stream(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A given table as a file stream, event times as instants; `files` of it at most to a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parque[t]")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def drain(df: DataFrame, mode: str, each: Callable[[DataFrame, int], DataFrame] = lambda batch, n: batch, keys: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
    """Runs a stream over what there is: the rows of all batches; in update mode the last row of each key, in complete mode the
    last batch. `at` is the job's folder, with its state and what its sink holds: called with the same one again, the job goes on."""
    spark, at = df.sparkSession, at or new_folder(df.sparkSession, "stream")

    def put(batch: DataFrame, n: int) -> None:
        each(batch, n).withColumn("batch__", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/{n}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    done = parts(spark, f"{at}/out")
    out = spark.read.parquet(*[f"{at}/out/{n}" for n in (done[-1:] if mode == "complete" else done)])
    if mode == "update":
        rest = [c for c in out.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch__").alias("x")).select(*keys, *[f"x.{c}" for c in rest])
    return out.drop("batch__")


def parts(spark: SparkSession, at: str) -> list[int]:
    """The numbers of the parts of a table that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS")))


def job(name: str, table: str, mode: str, keys: tuple[str, ...] = (), sql: str | None = None):
    def put(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: drain(f(stream(spark, sf_dir, table)), mode, keys=keys)
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return put


class Store:
    """Rows that were seen, by their keys, as a table of one part for each batch; every COMPACT parts are written together."""

    COMPACT = 20

    def __init__(self, spark: SparkSession, at: str, schema: str, *keys: str) -> None:
        self.spark, self.at, self.schema, self.keys = spark, at.rstrip("/"), schema, list(keys)

    def seen(self, before: int | None = None) -> DataFrame:
        """The rows of the batches before the given one, or of all."""
        ok = lambda n: before is None or n < before
        base = [n for n in parts(self.spark, f"{self.at}/base") if ok(n)][-1:]
        single = [n for n in parts(self.spark, f"{self.at}/part") if ok(n) and not (base and n <= base[0])]
        at = [*(f"{self.at}/base/{n}" for n in base), *(f"{self.at}/part/{n}" for n in single)]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Those of the batch's rows, one for each key, that weren't seen before it; they are from now on. The same batch again gives the same."""
        own = [f.split(" ")[0] for f in self.schema.split(", ")]
        new = rows.select(*own).dropDuplicates(self.keys).join(self.seen(batch).select(*self.keys), self.keys, "left_anti").select(*own)
        new.write.mode("overwrite").parquet(f"{self.at}/part/{batch}")
        bases = parts(self.spark, f"{self.at}/base")
        if sum(n > (bases or [-1])[-1] for n in parts(self.spark, f"{self.at}/part")) > self.COMPACT:
            self.seen(batch).write.mode("overwrite").parquet(f"{self.at}/base/{batch - 1}")
        return self.spark.read.schema(self.schema).parquet(f"{self.at}/part/{batch}")


def seconds(c: Column) -> Column:
    return F.unix_timestamp(c)


def contents(docs: DataFrame) -> DataFrame:
    """content_id, chars, lines of each text."""
    new = docs.where("text IS NOT NULL").withColumn("content_id", F.concat(F.lit("doc:"), F.substring(F.sha2("text", 256), 1, 16)))
    return new.select("content_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


CONTENT = "content_id string, chars long, lines long"


def ingested(docs: DataFrame, at: str) -> DataFrame:
    """Continuous ingestion in the folder `at`: content-addressed, each content once, cut into lines."""
    store = Store(docs.sparkSession, f"{at}/contents", CONTENT, "content_id")
    return drain(contents(docs), "append", store.add, at=at)


def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(stream(spark, sf_dir, "documents"), new_folder(spark, "ingest"))


QUERIES["X1"] = x1
ORACLE_SQL["X1"] = "SELECT 'doc:' || substr(sha256(text), 1, 16) AS content_id, min(length(text))::BIGINT AS chars, min(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1"


@job("X2", "events", "append", sql="SELECT DISTINCT user_id, event_type, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def x2(events: DataFrame) -> DataFrame:
    """Arrivals of a user's event type on a day, each once within the watermark."""
    keyed = events.withColumn("day", F.to_date("ts").cast("string")).withWatermark("ts", "40 days")
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


#: How long a status holds without another event.
HOLDS = timedelta(hours=6)


class Status(StatefulProcessor):
    """The latest status of a key and since when; ended by an event-time timer HOLDS after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "us long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        best = max((r["us"], r["event_type"]) for r in rows)
        held = self.state.get() if self.state.exists() else None
        if held and tuple(held) >= best:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(best)
        self.handle.registerTimer(best[0] // 1000 + HOLDS // timedelta(milliseconds=1))
        yield Row(user_id=key[0], status=best[1], us=best[0], ended=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.state.exists():
            us, status = self.state.get()
            self.state.clear()
            yield Row(user_id=key[0], status=status, us=us, ended=True)

    def close(self) -> None:
        pass


@contextmanager
def states_on_disk(spark: SparkSession) -> Iterator[None]:
    """Keyed state of arbitrary form needs the state store on disk; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def statuses(events: DataFrame, at: str, delay: str = WATERMARK) -> DataFrame:
    """user_id, status, ts and whether it has ended: the latest status of each key, bounded by its timers, in the folder `at`."""
    kind = events.schema["user_id"].dataType.simpleString()
    late = events.select("user_id", "event_type", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    out = late.groupBy("user_id").transformWithState(Status(), f"user_id {kind}, status string, us long, ended boolean", "Update", "EventTime")
    with states_on_disk(events.sparkSession):
        return drain(out, "update", keys=("user_id",), at=at).select("user_id", "status", F.timestamp_micros("us").alias("ts"), "ended")


def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of each key, and whether it ran out before the watermark."""
    found = statuses(stream(spark, sf_dir, "events"), new_folder(spark, "status"))
    return found.select("user_id", "status", seconds(F.col("ts")).alias("last_ts"), "ended")


QUERIES["X4"] = x4
ORACLE_SQL["X4"] = f"""
    WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
    SELECT user_id, max(event_type) AS status, floor(epoch(ts))::BIGINT AS last_ts, ts + INTERVAL {HOLDS // timedelta(hours=1)} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS ended FROM events JOIN l USING (user_id, ts) GROUP BY 1, 3, 4"""


@job("X5", "events", "update", ("start", "event_type"), sql="SELECT floor(epoch(ts) / 300)::BIGINT * 300 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x5(events: DataFrame) -> DataFrame:
    """Metrics over tumbling windows of five minutes."""
    w = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(seconds(F.col("window.start")).alias("start"), "event_type", "n", "total")


@job("X5_sliding", "events", "update", ("start",), sql="WITH w AS (SELECT floor(epoch(ts) / 300)::BIGINT * 300 - unnest(generate_series(0, 11)) * 300 AS start, value FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def x5_sliding(events: DataFrame) -> DataFrame:
    """Events of the last hour, every five minutes."""
    w = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour", "5 minutes")).agg(F.count("*").alias("n"))
    return w.select(seconds(F.col("window.start")).alias("start"), "n")


@job("X5_session", "events", "complete", sql="""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def x5_session(events: DataFrame) -> DataFrame:
    """Sessions of a user, which half an hour without events ends. Session windows know no update mode; complete mode shows the open ones too."""
    w = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", seconds(F.col("session_window.start")).alias("start"), "n")


@job("X6", "events", "update", ("start",), sql="WITH w AS (SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 - unnest(generate_series(0, 6)) * 86400 AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def x6(events: DataFrame) -> DataFrame:
    """Events of seven days, rolling by a day."""
    w = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n"))
    return w.select(seconds(F.col("window.start")).alias("start"), "n")


#: Fixed value: characters of a text that stand for its title.
TITLE = 80
WATCHES_SQL = "SELECT item_id AS topic_id, lower(regexp_extract(text, '^\\S+ (\\p{L}+)', 1)) AS keyword FROM benchmark"


def alerts(docs: DataFrame, watches: DataFrame, known: DataFrame, at: str) -> DataFrame:
    """doc_id and topic_id of documents (doc_id, title) that are new and whose title has a watched keyword (topic_id, keyword).
    What was known at the first load is silent, and a document is told of once. Titles are cut into words and parts of words by
    the keywords' lengths, so titles and keywords meet by an equi-join, however many there are."""
    spark = docs.sparkSession
    store = Store(spark, f"{at}/known", "doc_id long, title string", "doc_id")
    store.add(known.withColumn("title", F.lit("")), 0)
    words = watches.where("keyword <> ''").select("topic_id", F.lower("keyword").alias("keyword"))
    sizes = sorted(r[0] for r in words.select(F.length("keyword")).distinct().collect())  # as many as keywords have lengths

    def told(batch: DataFrame, n: int) -> DataFrame:
        new = store.add(batch.select("doc_id", F.lower("title").alias("title")), n + 1)
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.length("title") - k + 1), lambda i: F.substring(F.col("title"), i, F.lit(k)))
        cuts = F.flatten(F.array(*(F.when(F.length("title") >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in sizes)))
        return new.select("doc_id", F.explode(F.array_distinct(cuts)).alias("keyword")).join(words, "keyword").select("doc_id", "topic_id", "keyword")

    return drain(docs, "append", told, at=at)


def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the documents that came after the first load (every third one's) for the words that the benchmark watches."""
    title = F.substring("text", 1, TITLE).alias("title")
    watches = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), F.lower(F.regexp_extract("text", r"^\S+ (\p{L}+)", 1)).alias("keyword"))
    known = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    return alerts(stream(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", title), watches, known, new_folder(spark, "watch"))


QUERIES["X7"] = x7
ORACLE_SQL["X7"] = f"WITH w AS ({WATCHES_SQL}) SELECT doc_id, topic_id, keyword FROM documents JOIN w ON keyword <> '' AND contains(lower(left(text, {TITLE})), keyword) WHERE doc_id % 3 <> 0"


def indexed(docs: DataFrame, store: PointStore, at: str) -> DataFrame:
    """Incremental index of documents (doc_id, text) in the folder `at`: a batch is a generation; what changed, document by document."""
    first = max(store.generation() + 1 if not parts(store.spark, f"{at}/out") else 0, 0)
    path = f"{at}/first"
    if not parts(store.spark, path):  # the generation of the first batch, for all times that the job goes on
        store.spark.range(first, first + 1).write.mode("overwrite").parquet(f"{path}/0")
    first = store.spark.read.parquet(f"{path}/0").first()["id"]

    def put(batch: DataFrame, n: int) -> DataFrame:
        own = checkpointed(batch)
        return store.apply(markdown_points(own), own.select(F.col("doc_id").alias("document_id")), first + n)

    return drain(docs, "append", put, at=at)


def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every third document, then all documents as a stream: what changes, and how many contents that embeds."""
    store = PointStore(spark)
    store.apply(markdown_points(read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", "text")))
    found = indexed(stream(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), store, new_folder(spark, "index"))
    alive = store.points().groupBy("document_id").agg(F.count("*").alias("alive"), F.min(F.size("vector")).cast("long").alias("dim"))
    return found.join(alive, "document_id")


QUERIES["X8"] = x8
ORACLE_SQL["X8"] = oracle(f"""
    WITH {PARAGRAPH_SQL}, k AS (SELECT doc_id, idx, sha256('doc' || chr(31) || left(text, {EMBEDDED})) AS key FROM md), old AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
    SELECT doc_id AS document_id, count(*) AS points, count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM old) THEN key END) AS embedded, 1::BIGINT AS generation, count(*) AS alive, {DIM}::BIGINT AS dim FROM k WHERE doc_id % 3 <> 0 GROUP BY 1""")


class Debounced:
    """Runs a job over all facts so far, at most once in `wait` seconds, and only after new ones came; `finish` runs what is left.
    When it last ran, and after which batch, is a table beside the facts, so a job that is stopped knows it when it goes on."""

    def __init__(self, facts: Store, regroup: Callable[[DataFrame], DataFrame], wait: float, clock: Callable[[], float] = time.time) -> None:
        self.facts, self.regroup, self.wait, self.clock = facts, regroup, wait, clock

    def _runs(self) -> list[int]:
        return parts(self.facts.spark, f"{self.facts.at}/runs")

    def _last(self) -> tuple[float, int]:
        """When the last run was, and the last batch it saw."""
        runs = self._runs()
        r = self.facts.spark.read.parquet(f"{self.facts.at}/runs/{runs[-1]}").first() if runs else None
        return (r["at"], r["batch"]) if r else (-float("inf"), -1)

    def pending(self) -> bool:
        """Whether facts came after the last run."""
        last = self._last()[1]
        return any(not self.facts.spark.read.schema(self.facts.schema).parquet(f"{self.facts.at}/part/{n}").isEmpty() for n in parts(self.facts.spark, f"{self.facts.at}/part") if n > last)

    def batch(self, rows: DataFrame, n: int) -> DataFrame:
        new = self.facts.add(rows, n)
        if self.clock() - self._last()[0] >= self.wait and self.pending():
            self.run(n)
        return new

    def run(self, batch: int) -> None:
        spark, k = self.facts.spark, len(self._runs())
        self.regroup(self.facts.seen()).write.mode("overwrite").parquet(f"{self.facts.at}/groups/{k}")
        spark.createDataFrame([(float(self.clock()), batch)], "at double, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.facts.at}/runs/{k}")

    def finish(self) -> DataFrame:
        """The groups of all facts, found now if some came after the last run."""
        if self.pending() or not self._runs():
            self.run(max(parts(self.facts.spark, f"{self.facts.at}/part"), default=-1))
        return self.facts.spark.read.parquet(f"{self.facts.at}/groups/{self._runs()[-1]}")


FACT = "id long, v array<float>"


def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced clustering: density clusters of all vectors so far, found again at most every 30 seconds."""
    at = new_folder(spark, "clusters")
    runs = Debounced(Store(spark, f"{at}/facts", FACT, "id"), lambda facts: with_retry(facts).select("id", "label"), 30)
    vectors = stream(spark, sf_dir, "embeddings")
    drain(vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v")), "append", runs.batch, at=at)
    return runs.finish().select(F.col("id").alias("vec_id"), "label")


QUERIES["X3"] = x3
