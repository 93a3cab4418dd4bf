"""Ingest: first arrival wins, stable ids, threads, directory of cleaned messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettergraph.functions.text import normalised_subject
from lettergraph.operators.links import components
from lettergraph.shared import written


def first_arrivals(records: DataFrame, key: str = "message_id", order: str = "arrival") -> DataFrame:
    """One record a message id: the first to arrive. A partial aggregation, so repeated ids cost no window."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def slot(ts: Column) -> tuple[Column, Column]:
    """Day as YYMMDD and quarter hour of the day."""
    day = (F.year(ts) % 100) * 10_000 + F.month(ts) * 100 + F.dayofmonth(ts)
    return day.cast("bigint"), (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("bigint")


def time_ids(records: DataFrame, order: str = "arrival") -> DataFrame:
    """Ids from the record's own time and its number in its quarter hour, in three digits, and from nothing else; null without a time.

    Nothing is passed on: a number past 999 runs into the next quarter hour's, so ids are different only where no quarter hour
    holds more.  ``allocated_ids`` keeps them different.
    """
    day, quarter = slot(F.col("sent_ts"))
    number = F.row_number().over(Window.partitionBy("day", "quarter").orderBy(F.asc_nulls_last(order)))
    rows = records.withColumn("day", day).withColumn("quarter", quarter).withColumn("number", number)
    return rows.withColumn("id", F.col("day") * 100_000 + F.col("quarter") * 1000 + F.col("number")).drop("day", "quarter", "number")


def allocated_ids(records: DataFrame, order: str = "arrival", digits: int | None = 3) -> DataFrame:
    """Ids from the record's own time: day, quarter hour in two digits, and the number in it in ``digits``.

    Three digits hold 95,904 records a day; a larger store takes more, up to ten, and None takes the fewest from three on that
    hold its fullest day: one number for all records, as ids of different lengths could meet.  A quarter hour
    that is full passes the rest on to the next of the same day.  The place of a record in its
    day follows from counts a quarter hour, ``next free = max(start of slot, place after the records before)``: a running
    maximum over at most 96 slots a day, then a number within each slot.  Records without a time share the day 0.
    """
    day, quarter = (F.coalesce(c, F.lit(0)) for c in slot(F.col("sent_ts")))
    rows = records.withColumn("day", day).withColumn("quarter", quarter)
    counts = rows.groupBy("day", "quarter").agg(F.count("*").alias("n"))
    by_day = Window.partitionBy("day").orderBy("quarter")
    if digits is None:
        # A day fits where from each quarter on the records fill no more than the slots that are left.
        left = F.sum("n").over(by_day.rowsBetween(0, Window.unboundedFollowing)) / (96 - F.col("quarter"))
        need = counts.select(left.alias("left")).agg(F.coalesce(F.max("left"), F.lit(0)).alias("left"))
        fewest = F.coalesce(*[F.when(F.col("left") <= 10**d - 1, F.lit(10**d).cast("bigint")) for d in range(3, 10)], F.lit(10**10))
        counts = counts.join(F.broadcast(need.select(fewest.alias("width"))))  # one row
    else:
        counts = counts.withColumn("width", F.lit(10**digits).cast("bigint"))
    width, room = F.col("width"), F.col("width") - 1
    # With so much room a slot: first place = total before + max over slots so far of (slot start - total before that slot).
    before = F.coalesce(F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).withColumn("first", F.col("before") + F.max(F.col("quarter") * room - F.col("before")).over(by_day))
    number = F.row_number().over(Window.partitionBy("day", "quarter").orderBy(F.asc_nulls_last(order))) - 1
    seated = rows.withColumn("number", number).join(placed.select("day", "quarter", "first", "width"), ["day", "quarter"])
    place = F.col("first") + F.col("number")
    slot_no = (place - place % room) / room
    fits = slot_no < 96
    new_id = F.col("day") * (100 * width) + slot_no.cast("bigint") * width + place % room + 1
    return seated.withColumn("id", F.when(fits, new_id).otherwise(F.raise_error(F.lit("a day holds more records than ids: take more digits")).cast("bigint")).cast("bigint")).drop("day", "quarter", "number", "first", "width")


def arrival_numbers(records: DataFrame, offset: int = 0, order: str = "arrival") -> DataFrame:
    """1-based arrival numbers, numbered within ranges of the order key so that no task holds all rows."""
    # Written: both uses below must see the same ranges, on a retry too.
    ranged = written(records.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    starts = ranged.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_first", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_nr", number).join(F.broadcast(starts.select("_part", "_first")), "_part").withColumn("seq", F.col("_first") + F.col("_nr") + offset).drop("_part", "_nr", "_first")  # one row a partition


def assign_threads(records: DataFrame, window_days: int = 30) -> DataFrame:
    """Threads in order of arrival: by reference, by conversation key, by subject within 30 days, else a new one.

    Records that could meet, by any of the three, form one component; threads are then assigned in order within it.
    ``records``: message_id, refs, conversation_key, subject, sent_ts, arrival.  A thread is named by the arrival of its
    first message.  A record without a time joins by reference or key only.

    A subject is cut where no record can reach back: at gaps of more than ``window_days`` days that nothing dated before them
    arrived after, and over which no record of the subject names another.  A subject with conversation keys, or with names from
    or to other subjects, is not cut, as a thread of it may be kept going from there.  A subject that never rests is one
    sequence.  Only those keys and names over subjects are links to be followed in rounds.
    """
    # Hashes stand for names here: two that meet put records in one component that need not be, which changes no thread.
    norm, time = normalised_subject(F.col("subject")), F.col("sent_ts").cast("timestamp_ntz")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    rows = written(records.select(
        "message_id", "refs", "conversation_key", norm.alias("norm"), F.when(norm != "", time.cast("date")).alias("day"), F.timestamp_diff("MICROSECOND", epoch, time).alias("us"), "arrival",
        F.xxhash64(F.lit("m"), "message_id").alias("self"),
    ), "records")
    named = rows.select("norm", "day", "self", F.explode("refs").alias("ref")).select("norm", "day", "self", F.xxhash64(F.lit("m"), "ref").alias("other"))
    met = written(named.join(rows.select(F.col("self").alias("other"), F.col("norm").alias("their_norm"), F.col("day").alias("their_day")), "other"), "named")
    same = F.coalesce((F.col("norm") == F.col("their_norm")) & F.col("day").isNotNull() & F.col("their_day").isNotNull(), F.lit(False))
    keyed = F.when(F.coalesce("conversation_key", F.lit("")) != "", F.xxhash64(F.lit("c"), "conversation_key"))

    dated, no = F.when(F.col("day").isNotNull(), F.col("arrival")), F.lit(None).cast("long")
    told = rows.select("norm", "day", dated.alias("low"), dated.alias("high"), F.col("day").alias("until"), keyed.isNotNull().alias("beyond"))
    told = told.union(met.where(same).where("day <> their_day").select("norm", F.least("day", "their_day"), no, no, F.greatest("day", "their_day"), F.lit(False)))
    for side in (("norm", "day"), ("their_norm", "their_day")):
        told = told.union(met.where(~same).select(*side, no, no, F.lit(None).cast("date"), F.lit(True)))
    told = told.where("norm <> ''")
    days = told.groupBy("norm", "day").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("until").alias("until"), F.max("beyond").alias("beyond"))
    order = Window.partitionBy("norm").orderBy("day")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # Two days more than the window: whole days stand for times here.
    cut = (F.datediff("day", F.lag("day").over(order)) > window_days + 1) & (F.max("high").over(before) < F.min("low").over(on)) & (F.max("until").over(before) < F.col("day")) & ~F.max("beyond").over(Window.partitionBy("norm"))
    days = days.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("session", F.sum("cut").over(order)).select("norm", "day", "session")
    subject = F.when(F.col("session").isNotNull(), F.xxhash64(F.lit("s"), "session", "norm"))
    homes = written(rows.join(days, ["norm", "day"], "left").select(*rows.columns, F.coalesce(subject, keyed, "self").alias("home"), keyed.alias("key")).drop("day"), "homes")

    home = lambda name: homes.select(F.col("self").alias(name), F.col("home").alias(f"{name}_home"))
    across = met.where(~same).select("self", "other").join(home("self"), "self").join(home("other"), "other").select(F.col("self_home").alias("a"), F.col("other_home").alias("b"))
    groups = components(across.union(homes.where("key IS NOT NULL").select("home", "key")).where("a <> b").distinct())
    component = F.coalesce("component", "home").alias("component")
    seated = homes.join(groups.withColumnRenamed("node", "home"), "home", "left").select(component, "message_id", "refs", "conversation_key", "norm", "us", "arrival")
    reach = window_days * 86_400_000_000

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components one after the other, each in order of arrival; a subject's newest thread is all that has to be known of it."""
        now = None
        for batch in batches:
            ids, threads = batch.column(1), []
            for group, message, refs, key, norm, us, arrival in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now:
                    now, by_message, by_key, newest, last, subject_of = group, {}, {}, {}, {}, {}
                thread = next((by_message[x] for x in refs or () if x in by_message), None)
                if thread is None and key:
                    thread = by_key.get(key)
                if thread is None and norm and us is not None and norm in newest and newest[norm][0] >= us - reach:
                    thread = -newest[norm][1]
                if thread is None:
                    thread = arrival
                    subject_of[thread] = norm
                    if key:
                        by_key[key] = thread
                if us is not None:
                    last[thread] = max(last.get(thread, us), us)
                    about = subject_of[thread]
                    newest[about] = max(newest.get(about, (last[thread], -thread)), (last[thread], -thread))  # of two as new the one opened first
                by_message[message] = thread
                threads.append(thread)
            yield pa.RecordBatch.from_arrays([ids, pa.array(threads, type=pa.int64())], names=["message_id", "thread_id"])

    return seated.repartition("component").sortWithinPartitions("component", "arrival").mapInArrow(placed, "message_id string, thread_id long")


def first_held(m: DataFrame) -> DataFrame:
    """The first message held of each thread, by arrival: its quoted history stands nowhere else and is kept."""
    return m.groupBy("thread_id").agg(F.min_by("id", "seq").alias("id"))


def merge_folder_state(done: Column, drained: Column, keep: Column) -> Column:
    """Folders read to the end: those done before that are still in scope, and the new ones; an empty scope keeps all."""
    return F.array_sort(F.array_union(F.when(F.size(keep) > 0, F.array_intersect(done, keep)).otherwise(done), drained))


def folder_plan(folders: DataFrame, excluded: list[str], most: int, subfolders: bool = True) -> DataFrame:
    """Which folders to read: roots always; others unless out of scope, special, no mail, excluded or past the cap.

    ``folders``: label, depth, is_root, is_special, is_mail.  Every folder comes back with a reason, empty if read.
    """
    reason = (
        F.when(F.col("is_root"), "").when(F.lit(not subfolders), "subfolders_off").when(F.col("is_special"), "special").when(~F.col("is_mail"), "not_mail")
        .when(F.lower("label").isin(*[e.lower() for e in excluded]), "excluded").otherwise("")
    )
    marked = folders.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy((F.col("reason") == "").alias("read")).orderBy((~F.col("is_root")).cast("int"), "depth", "label"))
    return marked.withColumn("nth", nth).withColumn("reason", F.when((F.col("reason") == "") & ~F.col("is_root") & (F.col("nth") > most), "over_cap").otherwise(F.col("reason"))).drop("nth")


def merged_by_time(sources: list[DataFrame]) -> DataFrame:
    """Several record streams as one in time order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("sent_ts", "message_id")


def since(records: DataFrame, watermark: str, overlap_minutes: int = 30, zone: str | None = None) -> DataFrame:
    """Records after a watermark with some overlap; a plain range, so it reaches the source.  ``zone`` is where the watermark's clock
    stands, if the records' times are UTC."""
    at = F.lit(watermark).cast("timestamp_ntz") if zone is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(watermark).cast("timestamp_ntz"))
    return records.where(F.col("sent_ts") > at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(overlap_minutes)))
