"""Logs rendered from the driver's tables, as input of the registered queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import times
from logweave.operators.records import Format, fields, records
from logweave.operators.timeaxis import normalise, summary

CLASSIC = Format("classic", r"^(?'Time'\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) (?'Level'\w+) (?'Thread'\S+) (?'Component'\S+) (?'Message'.*)", ("Level", "Thread", "Component"))
CLOCK = Format("clock", r"^(?'Time'\d{2}:\d{2}:\d{2}\.\d{3})\t(?'Thread'\S+)\t(?'Severity'\w+)\t(?'Component'\S+)?\t(?'Message'.*)", ("Thread", "Severity", "Component"), "Time", "HH:mm:ss.SSS")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Four files of classic log lines."""
    e = table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), F.upper("event_type"), F.lit(" T-"), F.col("user_id").cast("string"), F.lit(" comp"), (F.col("user_id") % 3).cast("string"), F.lit(" value="), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" props="), F.col("props"))
    return e.select((F.col("event_id") % 4).alias("file_id"), F.col("event_id").alias("byte_offset"), text.alias("text"))


def parsed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Their records with fields."""
    return fields(records(event_lines(spark, sf), CLASSIC), CLASSIC)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Their records with fields and normalised time."""
    rows = parsed_rows(spark, sf)
    return normalise(rows.withColumn("ts_raw", times.parse(F.col("Time"))), time_only=False)


def clock_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records with times of day only: file_id, line_no, ts_raw; every seventh has none."""
    e = table(spark, sf, "events")
    text = F.concat(F.when(F.col("event_id") % 7 == 3, "").otherwise(F.date_format("ts", "HH:mm:ss.SSS")), F.lit("\t"))
    raw = times.parse(F.split(text, "\t")[0], CLOCK.time_format)
    return e.select((F.col("event_id") % 4).alias("file_id"), F.floor(F.col("event_id") / 4).alias("line_no"), raw.alias("ts_raw"))


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of lines; byte_offset is the number of the line."""
    d = table(spark, sf, "documents").filter("doc_id is not null")
    return d.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("byte_offset", "text")).withColumn("byte_offset", F.col("byte_offset").cast("long"))


def conversation_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("long").alias("line_no"), "role", "text")


def file_table(rows: DataFrame) -> DataFrame:
    return summary(rows)


#: The same in SQL. log: file_id, byte_offset, line_no, text, level, thread, component, message, time, ts (microseconds).
LOG = """
log as (
  select event_id % 4 as file_id, event_id as byte_offset, row_number() over (partition by event_id % 4 order by event_id) - 1 as line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') as time, upper(event_type) as level,
         'T-' || user_id as thread, 'comp' || (user_id % 3) as component,
         'value=' || value::decimal(12,2)::varchar || ' props=' || props as message, epoch_us(ts) // 1000 * 1000 as ts
  from events),
rec as (select *, time || ' ' || level || ' ' || thread || ' ' || component || ' ' || message as text from log)
"""
CLOCKED = """
clock as (
  select event_id % 4 as file_id, event_id // 4 as line_no,
         case when event_id % 7 = 3 then null else (epoch_us(ts) // 1000 % 86400000) * 1000 end as ts_raw
  from events),
lasts as (select *, last_value(ts_raw ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as l from clock),
days as (select *, sum(case when ts_raw < l - 3600000000 then 1 else 0 end) over (partition by file_id order by line_no) as d from lasts),
norm as (select file_id, line_no, ts_raw, coalesce(max(ts_raw + d * 86400000000) over (partition by file_id order by line_no), 0)::bigint as ts_norm from days)
"""
