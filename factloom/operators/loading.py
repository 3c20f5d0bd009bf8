"""Loads of file trees, tables and event logs, through files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import new_folder
from factloom.sources import files


def write_tree(documents: DataFrame, root: str) -> None:
    """Documents as JSON lines, in a folder for each source."""
    line = F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})
    documents.select("source", line.alias("value")).write.mode("append").partitionBy("source").text(root)


@query("S5", "documents", sql="""
    SELECT doc_id, source AS source_location, md5(text) AS text_md5, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS run FROM documents""")
def s5(spark, documents):
    """Resumable load: a tree of files is loaded, grows and is loaded again; files of the log are left alone."""
    root = new_folder(spark, "tree")
    load = files.Load(spark, root, new_folder(spark, "loaded"))
    for part in ("doc_id % 4 = 0", "NOT coalesce(doc_id % 4 = 0, false)"):
        write_tree(documents.where(part), root)
        load.run()
    load.run()  # finds nothing
    got = F.from_json("line", "doc_id long, text string")
    return load.lines().select(got.alias("d"), "source_location", "run").select("d.doc_id", "source_location", F.md5(F.col("d.text").cast("binary")).alias("text_md5"), "run")


@query("S20_csv", "documents", sql="""
    SELECT doc_id, coalesce(source, '') AS source, 4::BIGINT AS n_cells, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def s20_csv(spark: SparkSession, documents):
    """Tables of quoted texts, with quotes, delimiters and line ends in them, written and read back by byte ranges."""
    root = new_folder(spark, "tables")
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "source", "lang", "text")]
    options = {"sep": ";", "quoteAll": True, "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    documents.select(*blank).write.options(**options).csv(root)
    cell = lambda i: F.get("cells", F.lit(i))
    rows = files.read_csv(files.listing(spark, root))
    return rows.select(cell(0).cast("long").alias("doc_id"), cell(1).alias("source"), F.size("cells").cast("long").alias("n_cells"), F.md5(cell(3).cast("binary")).alias("text_md5"))


ENTRY = "event_id long, ts timestamp, event_type string, props string"


@query("S23", "events", sql=f"""
    SELECT event_id, event_type, CASE WHEN length(props) > {files.LOG_CHARS} THEN left(props, {files.LOG_CHARS}) || chr(10) || '… (+' || CAST(length(props) - {files.LOG_CHARS} AS VARCHAR) || ' симв.)' ELSE props END AS detail
    FROM events WHERE event_id % 10 <> 3 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def s23(spark: SparkSession, events):
    """The last hundred entries of an event log that was appended to twice; lines that broke off (every tenth here) are no entries."""
    log = new_folder(spark, "log")
    entries = events.select("event_id", "ts", "event_type", "props")
    files.append_log(entries.where("event_id % 10 < 3"), log)
    files.append_log(entries.where("event_id % 10 > 3"), log)
    broken = F.substring(F.to_json(F.struct("event_id", "ts", "event_type")), 1, 20)
    entries.where("event_id % 10 = 3").select(broken.alias("value")).write.mode("append").text(log)
    spark.dataSource.register(files.TextLines)
    lines = spark.read.format("text_lines").load(log)
    last = files.parsed_log(lines, ENTRY).where("corrupt IS NULL").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return last.select("event_id", "event_type", F.col("props").alias("detail"))
