"""Records from files and results to files: JSON lines, mail folders, notes in Markdown, month-partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("message_id", T.StringType(), False), T.StructField("subject", T.StringType()), T.StructField("sender_name", T.StringType()), T.StructField("sender_addr", T.StringType()),
    T.StructField("to_addrs", T.ArrayType(T.StringType())), T.StructField("cc_addrs", T.ArrayType(T.StringType())), T.StructField("sent_on", T.StringType()), T.StructField("body_text", T.StringType()),
    T.StructField("body_html", T.StringType()), T.StructField("in_reply_to", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("conversation_key", T.StringType()),
    T.StructField("attachments", T.ArrayType(T.StringType())), T.StructField("folder", T.StringType()),
])
READERS = {}


def reader(name: str):
    """Register a source by name: (spark, path) to records."""
    return lambda f: READERS.setdefault(name, f)


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Records of a registered source with derived time; a blank time is null and stays in ``sent_on``.

    A record without a message id is named by a digest of its time, sender, subject and bodies, so that two of them stay two
    and one that is read again stays one.
    """
    if name not in READERS:
        raise ValueError(f"no source {name!r}; there are {sorted(READERS)}")
    rows = READERS[name](spark, path)
    content = F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("sent_on", "sender_addr", "subject", "body_text", "body_html")])
    own = F.trim(F.coalesce("message_id", F.lit("")))
    rows = rows.withColumn("message_id", F.when(own != "", own).otherwise(F.concat(F.lit("<"), F.sha2(content.cast("binary"), 256), F.lit("@no-id>"))))
    return rows.withColumn("sent_ts", F.try_to_timestamp(F.when(F.col("sent_on") != "", F.replace("sent_on", F.lit("T"), F.lit(" ")))).cast("timestamp_ntz"))


@reader("jsonl")
def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; the schema is fixed, so nothing is scanned to infer it."""
    return spark.read.schema(RECORD).json(path)


@reader("mbox")
def mail_folder(spark: SparkSession, path: str) -> DataFrame:
    """Mail in mbox files, split at ``From `` lines by Spark's line reader, each message parsed by itself."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import email
        from email import policy
        from email.utils import getaddresses, parseaddr, parsedate_to_datetime

        for batch in batches:
            rows = []
            for raw in batch["value"]:
                m = email.message_from_string(raw, policy=policy.compat32)
                texts = {}
                for p in m.walk():
                    if not p.is_multipart() and not p.get_filename() and p.get_content_disposition() != "attachment":
                        texts.setdefault(p.get_content_type(), []).append((p.get_payload(decode=True) or b"").decode(p.get_content_charset() or "utf-8", "replace"))
                part = {kind: "\n".join(found) for kind, found in texts.items()}
                name, addr = parseaddr(m.get("From", ""))
                people = lambda h, m=m: [a.lower() for _, a in getaddresses(m.get_all(h, [])) if a]
                try:
                    sent = parsedate_to_datetime(m["Date"]).strftime("%Y-%m-%dT%H:%M:%S")
                except (TypeError, ValueError):
                    sent = ""
                rows.append((m.get("Message-ID") or "", m.get("Subject") or "", name, addr.lower(), people("To"), people("Cc"), sent, part.get("text/plain", ""), part.get("text/html", ""),
                             m.get("In-Reply-To") or "", (m.get("References") or "").split(), "", [p.get_filename() for p in m.walk() if p.get_filename()], ""))
            yield pd.DataFrame(rows, columns=RECORD.names)

    texts = spark.read.option("lineSep", "\nFrom ").text(path).select(F.regexp_replace("value", r"^(?:From )?[^\n]*\n", "").alias("value")).where("trim(value) <> ''")
    return texts.mapInPandas(parsed, RECORD)


@reader("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: path, mtime, title (first heading), threads of the front matter, body without front matter."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path).select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.trim(F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", ""), F.lit(" \n"))
    ids = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^threads:\s*(.*)$", 1), F.lit(r"\d+"), F.lit(0))
    return files.select("path", "mtime", F.regexp_extract(body, r"(?m)^# (.*)$", 1).alias("title"), F.transform(ids, lambda x: x.cast("bigint")).alias("threads"), body.alias("body"))


def mirror(known: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new or changed files, vanished paths) of an index that mirrors a folder."""
    changed = files.join(known.select("path", F.col("mtime").alias("old")), "path", "left").where(F.col("old").isNull() | (F.col("mtime") > F.col("old"))).drop("old")
    return changed, known.select("path").join(files.select("path"), "path", "left_anti")


def write_messages(m: DataFrame, path: str, mode: str = "append") -> None:
    """The message table by month, so that time ranges prune folders; rows of one month meet in few files."""
    month = F.date_format("sent_ts", "yyyy-MM")
    m.withColumn("sent_month", month).repartition("sent_month").write.mode(mode).partitionBy("sent_month").parquet(path)


def write_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line, appended."""
    rows.write.mode("append").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts (name, text) as one file a name."""
    reports.select("text", "name").repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def result_json(found: DataFrame) -> DataFrame:
    """Search results as JSON rows: id, thread_id, subject, sender, date to the minute, direction, attachments, tier, snippet."""
    has = F.coalesce(F.size("attach_names") > 0, F.lit(False)) if "attach_names" in found.columns else F.lit(False)
    snippet = F.col("snippet") if "snippet" in found.columns else F.lit("")
    return found.select(F.to_json(F.struct(
        "id", "thread_id", "subject", "sender_addr", F.date_format("sent_ts", "yyyy-MM-dd'T'HH:mm").alias("date"), "is_sent", has.alias("has_attach"), "tier", snippet.alias("snippet")
    )).alias("value"))
