"""Inputs derived from the given tables, as SQL that Spark and DuckDB both read where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.sources.tables import read_table

# jobs, requests, calls, ... as (name, expression) over events / conversations / part / documents
JOBS = (
    ("job_id", "event_id"), ("session_id", "user_id"), ("created_at", "ts"), ("event_type", "event_type"), ("props", "props"),
    ("status", "case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'purchase' then 'completed'"
               " when 'error' then 'failed' else 'cancelled' end"),
)
REQUESTS = (
    ("event_id", "event_id"), ("client", "cast(user_id as varchar(20))"),
    ("method", "case when event_id%17=0 then 'OPTIONS' else 'GET' end"),
    ("path", "case event_type when 'purchase' then '/api/analyze/' when 'error' then '/health'"
             " when 'view' then concat('/api/status/', cast(event_id as varchar(20))) when 'click' then '/api/jobs' else '/api/analyze' end"),
)
STATES = (
    ("job_id", "user_id"), ("event_id", "event_id"), ("changed_at", "ts"), ("step", "cast(event_id%9 as int)"),
    ("status", "case event_type when 'signup' then 'queued' when 'view' then 'processing' when 'purchase' then 'completed'"
               " when 'error' then 'failed' else 'cancelled' end"),
)
NAMES = (
    ("dataset", "p_brand"), ("ordinal", "cast(p_partkey as int)"),
    ("name", "case when p_partkey%3=0 then upper(p_name) when p_partkey%7=0 then concat(p_name, ' ')"
             " when p_partkey%11=0 then concat('.', p_name, '!') when p_partkey%5=0 then replace(p_name, ' ', '_') else p_name end"),
)
FILES = (
    ("doc_id", "doc_id"),
    ("file_name", "concat(case when doc_id%11=0 then '._' else source end, ' ', lang, '/', cast(doc_id as varchar(20)),"
                  " case when doc_id%3=0 then '.CSV' when doc_id%3=1 then '.csv' else '' end)"),
)
NL, TAB, FENCE = "chr(10)", "chr(9)", "concat('``', '`')"
REPLIES = (
    ("conv_id", "conv_id"), ("turn", "turn"),
    ("reply", f"case (conv_id+turn)%4"
              f" when 0 then concat({FENCE}, 'json', {NL}, '{{\"conv\": ', cast(conv_id as varchar(20)), ', \"n\": ',"
              f" cast(length(text) as varchar(20)), '}}', {NL}, {FENCE})"
              f" when 1 then concat(text, ' [', cast(turn as varchar(20)), ', ', cast(length(text) as varchar(20)), '] ')"
              f" when 2 then concat('  ', text, {NL}, {NL}, {NL}, {NL}, text, {TAB})"
              f" else concat('{{\"a\": ', text, '}}') end"),
)
LISTS = (
    ("conv_id", "conv_id"), ("turn", "turn"),
    ("reply", f"case (conv_id+turn)%3"
              f" when 0 then concat('Intro', {NL}, '1. ', text, {NL}, {NL}, '# 2) ', role, {NL}, '  more ', cast(turn as varchar(20)),"
              f" {NL}, '3 - last', {NL}, '2: ', text, {NL}, '9. ninth')"
              f" when 1 then concat('1)', {NL}, text, {NL}, '2.', {NL}, '3: ', role)"
              f" else text end"),
)
TEXT_UPLOADS = (
    ("path", "concat('up/', cast(doc_id as varchar(20)), '.csv')"),
    ("body", f"case doc_id%5 when 0 then concat('a,b,c', {NL})"
             f" when 1 then concat(' , ,', {NL}, '1,2,3', {NL})"
             f" when 2 then concat('id', {TAB}, 'n', {NL}, cast(doc_id as varchar(20)), {TAB}, cast(n_chars as varchar(20)), {NL})"
             f" when 3 then concat('id;lang;source', {NL}, cast(doc_id as varchar(20)), ';', lang, ';', source, {NL}, '1;a;b', {NL})"
             f" else text end"),
)
# Upload kinds by doc_id % 8: hex bytes in front of the text, and whether NULs follow it.
HEADS = {0: "89504E470D0A", 1: "504B0304", 2: "EFBBBF", 3: "FFFE", 4: "4361666E69E9", 5: ""}
UPLOAD_PATH = ("concat('up/', cast(doc_id as varchar(20)), case when doc_id%7=0 then '.txt' when doc_id%3=0 then '.CSV'"
               " else '.csv' end)")


def sql_view(table: str, columns) -> str:
    return "(select " + ", ".join(f"{e} as {n}" for n, e in columns) + f" from {table})"


def view(spark: SparkSession, folder: str, table: str, columns) -> DataFrame:
    return read_table(spark, folder, table).selectExpr(*[f"{e} as {n}" for n, e in columns])


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploaded files: pictures, archives, byte-order marks, latin-1, NULs and plain text."""
    docs = read_table(spark, folder, "documents")
    body = F.encode("text", "UTF-8")
    kind = F.col("doc_id") % 8
    content = F
    for k, head in HEADS.items():
        content = content.when(kind == k, F.concat(F.unhex(F.lit(head)), body))
    nuls = F.unhex(F.repeat(F.lit("00"), F.length("text")))
    content = content.when(kind == 6, F.concat(body, nuls)).otherwise(body)
    return docs.select(F.expr(UPLOAD_PATH).alias("path"), content.alias("content")).withColumn(
        "length", F.octet_length("content").cast("bigint"))


def sql_uploads() -> str:
    heads = " ".join(f"when {k} then unhex('{h}') || encode(text)" for k, h in HEADS.items())
    return (f"(select {UPLOAD_PATH} as path, case doc_id%8 {heads} when 6 then encode(text) || unhex(repeat('00', length(text)))"
            " else encode(text) end as content from documents)")


def text_uploads(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "documents", TEXT_UPLOADS).select("path", F.encode("body", "UTF-8").alias("content"))
