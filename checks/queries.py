"""One registered query per operator, with the DuckDB SQL it must agree with where SQL can say it.

Steps of one analysis that only look at small results share the analysis of a folder, so a rule
query does not profile the table again. `fresh()` forgets it (the benchmark does, before each run).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import book, views as V
from colscope import constants as K
from colscope.functions import numeric as N
from colscope.functions import text as X
from colscope.functions.session import new_folder
from colscope.operators import charts as CH, findings as FN, history as HX, mlstats as ML, profile as P, quality as QI
from colscope.operators import quantiles as Q, recommend as RC, requestlog as RL, stats as ST, targets as TG, textjobs as TX
from colscope.operators.longform import columns_of, schema_table
from colscope.plans.analysis import Analysis
from colscope.plans.slices import Slices
from colscope.schemas import as_finding, union_all
from colscope.sources import csvfiles, uploads as UP
from colscope.sources.tables import REVERSAL_COLUMNS, dirty_orders, nan_to_null, read_table, reversal_orders, spread_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
NOW = "timestamp '2024-01-20 12:00:00'"
_memo: dict[tuple[str, str], Analysis] = {}


def query(key: str, fn: Query, sql: str | None = None, replace: dict | None = None, own: dict | None = None) -> None:
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = book.sql(sql, replace, own)


def fresh() -> None:
    _memo.clear()
    _sliced.clear()


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_orders(read_table(spark, folder, "orders"))


def A(spark: SparkSession, folder: str) -> Analysis:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _memo:
        _memo[key] = Analysis(dirty(spark, folder), book.DATASET)
    return _memo[key]


def joined(c: str, sep: str = ", ") -> Column:
    return F.array_join(c, sep).alias(c)


def numbers(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.format_string("%.0f", x)), ", ").alias(c)


# ================================================================ IN: sources, sinks, ingest checks


def _csv_roundtrip(s, d):
    orders = read_table(s, d, "orders")
    path = new_folder(s, "csv")
    orders.write.option("header", True).csv(path)
    return csvfiles.csv_load(s, path, schema=orders.schema)


def _csv_mixed(s, d):
    """All documents in one folder of UTF-8, UTF-16 and latin-1 files, with quotes and line breaks in cells, read without a schema."""
    docs = read_table(s, d, "documents").select("doc_id", "text")
    plain = F.decode(F.encode(F.regexp_replace("text", "[^\u0000-\u00ff]", "?"), "ISO-8859-1"), "ISO-8859-1") == F.col("text")
    kind = F.when(F.col("doc_id") % 3 == 1, "UTF-16").when((F.col("doc_id") % 3 == 2) & plain, "ISO-8859-1").otherwise("UTF-8")
    path = new_folder(s, "csv")
    for k in ("UTF-8", "UTF-16", "ISO-8859-1"):
        docs.where(kind == k).write.mode("append").option("header", True).option("escape", '"').option("encoding", k).csv(path)
    return csvfiles.csv_load(s, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


query("in1_csv_load", _csv_roundtrip, "select * from orders")
query("in1_csv_mixed_encodings", _csv_mixed, "select doc_id, text from documents")
query("in2_empty_guard",
      lambda s, d: union_all([csvfiles.empty_guard(read_table(s, d, t), t) for t in TABLES]),
      " union all ".join(f"select '{t}' as dataset, count(*) = 0 as is_empty from {t}" for t in TABLES))
query("in3_file_triage", lambda s, d: UP.file_triage(V.uploads(s, d), max_mb=1),
      f"""select path, error is null as valid, error from (select path, case when octet_length(content) > 1048576 then 'too_large'
          when not ends_with(lower(path), '.csv') then 'not_csv' end as error from {V.sql_uploads()})""")
_heads = " or ".join(f"starts_with(hex(content), '{h}')" for h in K.BINARY_HEADS)
_nul = "(octet_length(content) - length(replace(regexp_replace(hex(content), '(..)', '\\1 ', 'g'), '00 ', ''))/3)"
query("in4_binary_detect", lambda s, d: UP.binary_detect(V.uploads(s, d)),
      f"select path, {_heads} or coalesce({_nul}/nullif(octet_length(content),0) > 0.05, false) as is_binary from {V.sql_uploads()}")
query("in5_encoding_detect", lambda s, d: UP.encoding_detect(V.uploads(s, d)),
      f"""select path, case when starts_with(hex(content),'EFBBBF') then 'utf-8-sig'
          when starts_with(hex(content),'FFFE') or starts_with(hex(content),'FEFF') then 'utf-16'
          when try(decode(content)) is not null then 'utf-8' else 'latin-1' end as encoding from {V.sql_uploads()}""")


def _same_delimiter() -> str:
    def n(x, d):
        return f"(length({x}) - length(replace({x}, {d}, '')))"

    whens = " ".join(
        f"when {n('header', d)} > 0 and len(list_filter(rows, lambda v: {n('v', d)} <> {n('header', d)})) = 0 then {d}"
        for d in ("','", "';'", "chr(9)", "'|'"))
    return f"case {whens} else ',' end"


query("in6_header_check", lambda s, d: UP.header_check(V.text_uploads(s, d)),
      f"""select path, delimiter, cast(n_columns as integer) as n_columns, error is null as valid, error from (
        select *, case when {book.strip("replace(header, delimiter, '')")} = '' then 'no_header'
            when n_columns > 2000 then 'too_many_columns' when len(rows) = 0 then 'no_data_rows' end as error from (
          select *, length(header) - length(replace(header, delimiter, '')) + 1 as n_columns from (
            select *, {_same_delimiter()} as delimiter from (
              select path, lines[1] as header, list_filter(lines[2:], lambda v: v <> '') as rows from (
                select path, string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)) as lines
                from {V.sql_view('documents', V.TEXT_UPLOADS)})))))""")
_formula = book.in_list(f"substr({book.strip('v')},1,1)", K.FORMULA_STARTS)
query("in7_formula_injection_scan", lambda s, d: UP.formula_injection(read_table(s, d, "documents"), "documents"),
      " union all ".join(
          f"select 'documents' as dataset, {o} as ordinal, '{c}' as name, count(*) filter (where {_formula}) as formula_cells"
          f" from (select {c} as v from documents)" for o, c in ((1, "text"), (2, "lang"), (3, "source"))))
query("in8_nan_to_null", lambda s, d: nan_to_null(dirty(s, d)).select("order_id", "ratio", "amount", F.isnull("ratio").alias("gap")),
      "select order_id, ratio, amount, ratio is null as gap from d")


def _dims(s, d):
    return union_all([csvfiles.dataset_info(read_table(s, d, t), t) for t in TABLES]).withColumn("column_names", joined("column_names"))


COLS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,"
                " l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props", "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label", "pages": "page_id, url, html", "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic", "conversations": "conv_id, turn, role, text",
}
query("in9_dataset_info", _dims, " union all ".join(
    f"select '{t}' as dataset, count(*) as rows, {len(COLS[t].split(','))} as columns, '{COLS[t]}' as column_names from {t}"
    for t in TABLES))


def _sanitized(s, d):
    x = dirty(s, d).select("order_id", "ratio", F.struct(F.col("ratio").alias("r"), F.array("ratio", "amount").alias("a")).alias("n"))
    doc = csvfiles.as_json(x)
    field = lambda p: F.get_json_object("document", p).try_cast("double")
    return doc.select("order_id", "ratio", field("$.n.r").alias("nested"), field("$.n.a[0]").alias("in_array"),
                      field("$.n.a[1]").alias("amount"))


_fin = "case when isfinite(ratio) then ratio end"
query("in10_json_sanitize", _sanitized,
      f"select order_id, {_fin} as ratio, {_fin} as nested, {_fin} as in_array, amount from dirty")


def _sink(s, d):
    path = new_folder(s, "results")
    counts = union_all([P.column_counts(read_table(s, d, t), t) for t in ("customer", "orders")])
    written = csvfiles.result_sink({"column_counts": counts}, path)
    return s.read.parquet(written["column_counts"]).select(*counts.columns)


def sql_counts(table: str) -> str:
    return " union all ".join(
        f"select '{table}' as dataset, {i} as ordinal, '{c.strip()}' as name, count(*) as rows, count(*)-count({c}) as missing_count,"
        f" count(distinct {c}) as unique_count, round((count(*)-count({c}))*100.0::double/count(*),2) as missing_pct,"
        f" round(count(distinct {c})*100.0::double/count(*),2) as unique_pct from {table}"
        for i, c in enumerate(COLS[table].split(",")))


query("in11_result_sink", _sink, sql_counts("customer") + " union all " + sql_counts("orders"))
_stem = "regexp_replace(regexp_replace(file_name, '\\.csv$', '', 'i'), '[^A-Za-z0-9._-]', '_', 'g')"
query("in12_safe_name", lambda s, d: UP.safe_name(V.view(s, d, "documents", V.FILES), "file_name"),
      f"select *, coalesce(nullif(trim({_stem}, '._'), ''), 'report') as safe_name from {V.sql_view('documents', V.FILES)}")


# ================================================================ PR: profile

_DS = f"'{book.DATASET}' as dataset"
query("pr1_column_counts", lambda s, d: P.column_counts(dirty(s, d), book.DATASET), f"select {_DS}, * from counts")
query("pr1_column_counts_lineitem", lambda s, d: P.column_counts(read_table(s, d, "lineitem"), "lineitem"), sql_counts("lineitem"))
query("pr1_column_counts_documents", lambda s, d: P.column_counts(read_table(s, d, "documents"), "documents"), sql_counts("documents"))
query("pr2_value_histogram", lambda s, d: P.value_histogram(dirty(s, d), book.DATASET), f"select {_DS}, * from hist")
query("pr3_basic_info", lambda s, d: P.basic_info(P.column_counts(dirty(s, d), book.DATASET)), f"select {_DS}, * from info")
query("pr4_duplicate_rows", lambda s, d: P.duplicate_rows(dirty(s, d), book.DATASET), f"select {_DS}, * from dups")
query("pr4_duplicate_rows_lineitem", lambda s, d: P.duplicate_rows(read_table(s, d, "lineitem"), "lineitem"),
      "select 'lineitem' as dataset, cast(coalesce(sum(n),0) as bigint) as duplicate_rows from (select count(*) as n from lineitem"
      f" group by {COLS['lineitem']}) where n > 1")
_fixed = sum(P.FIXED_WIDTH.get(t, 0) for _, _, t in book.COLUMNS)
_var = " + ".join(f"coalesce(strlen({n}),0)" for _, n in book.TEXT)
query("pr5_memory_mb", lambda s, d: P.memory_mb(dirty(s, d), book.DATASET),
      f"select {_DS}, round((count(*)*{_fixed} + sum({_var}))/1048576.0::double, 3) as memory_mb from d")


def _fin4(c, alias=None):
    """Rounded to 4 digits by way of a decimal: DuckDB rounds doubles after scaling them, which turns
    499.70504999999997 into a tie."""
    return f"case when isfinite({c}) then cast(round(cast(cast({c} as varchar) as decimal(38,15)),4) as double) end as {alias or c}"


query("pr6_numeric_profile", lambda s, d: P.numeric_profile(P.moments(dirty(s, d), book.DATASET)),
      f"select {_DS}, ordinal, name, {_fin4('mean')}, {_fin4('std')}, {_fin4('mn', 'min')}, {_fin4('mx', 'max')},"
      " round(zeros*100.0::double/nn,2) as zeros_pct, round(negatives*100.0::double/nn,2) as negative_pct from mom")
query("pr7_skewness_kurtosis", lambda s, d: P.shape_profile(P.moments(dirty(s, d), book.DATASET)),
      f"select {_DS}, ordinal, name, {_fin4('skewness')}, {_fin4('kurtosis')} from mom")
query("pr8_median", lambda s, d: P.medians(dirty(s, d), book.DATASET), f"select {_DS}, ordinal, name, {_fin4('median')} from ostat")
query("pr9_nearest_quantile", lambda s, d: Q.nearest_quantiles(dirty(s, d), (0.01, 0.25, 0.75, 0.99), dataset=book.DATASET),
      " union all ".join(f"select {_DS}, ordinal, name, {q}::double as q, nn, {c} as value from ostat"
                         for q, c in ((0.01, "q01"), (0.25, "q25"), (0.75, "q75"), (0.99, "q99"))))
LINE = tuple(enumerate(c.strip() for c in COLS["lineitem"].split(",")))[:8]
_line_long = book.union(f"select {i} as ordinal, '{c}' as name, cast({c} as double) as v from lineitem" for i, c in LINE)
query("pr9_nearest_quantile_lineitem",
      lambda s, d: Q.nearest_quantiles(read_table(s, d, "lineitem"), (0.25, 0.5, 0.75), dataset="lineitem"),
      f"with r as ({book.ranked('(' + _line_long + ')')}) " + " union all ".join(
          f"select 'lineitem' as dataset, ordinal, any_value(name) as name, {q}::double as q, any_value(nn) as nn, {book.nearest(q)} as value"
          " from r group by ordinal" for q in (0.25, 0.5, 0.75)))


def _line_numbers(s, d):
    m = P.moments(read_table(s, d, "lineitem"), "lineitem")
    return P.numeric_profile(m).join(P.shape_profile(m).drop("name"), ["dataset", "ordinal"])


query("pr6_numeric_profile_lineitem", _line_numbers,
      f"select 'lineitem' as dataset, ordinal, name, {_fin4('mean')}, {_fin4('std')}, {_fin4('mn', 'min')}, {_fin4('mx', 'max')},"
      f" round(zeros*100.0::double/nn,2) as zeros_pct, round(negatives*100.0::double/nn,2) as negative_pct, {_fin4('skewness')},"
      f" {_fin4('kurtosis')} from mom", {"nlong": _line_long})
query("pr10_inf_count", lambda s, d: P.inf_counts(P.moments(dirty(s, d), book.DATASET)), f"select {_DS}, ordinal, name, inf_count from mom")
query("pr11_quartiles", lambda s, d: A(s, d).quartiles,
      f"select {_DS}, ordinal, o.name, median, q25, q75, greatest(mn, q25-1.5*(q75-q25)) as whisker_low,"
      " least(mx, q75+1.5*(q75-q25)) as whisker_high from ostat o join (select ordinal, mn, mx from mom) m using (ordinal)")
query("pr12_top_values", lambda s, d: P.top_values(dirty(s, d), book.DATASET),
      f"select {_DS}, ordinal, name, rank, coalesce(value_str,'None') as value, cnt as count from tops")
query("pr12_top_values_documents", lambda s, d: P.top_values(read_table(s, d, "documents"), "documents"),
      " union all ".join(
          f"select 'documents' as dataset, {o} as ordinal, '{c}' as name, cast(rank as integer) as rank, coalesce(v,'None') as value, n as count from"
          f" (select {c} as v, count(*) as n, row_number() over (order by count(*) desc, {c} nulls first) as rank from documents group by {c}) where rank <= 5"
          for o, c in ((1, "text"), (2, "lang"), (3, "source"))))
_text_cols = {
    "pr13_avg_length": "avg_length", "pr14_whitespace_count": "whitespace_issues", "pr15_disguised_count": "disguised_missing",
    "pr17_looks_numeric": "numeric_like", "pr18_mixed_type": "mixed_type", "pr19_datetime_column": "is_datetime",
}
for _k, _c in _text_cols.items():
    query(_k, lambda s, d, c=_c: P.text_profile(dirty(s, d), book.DATASET).select("dataset", "ordinal", "name", "nn", c),
          f"select {_DS}, ordinal, name, nn, {_c} from text2")
query("pr14_text_profile_conversations",
      lambda s, d: P.text_profile(read_table(s, d, "conversations"), "conversations").drop("mixed_type", "is_datetime"),
      " union all ".join(
          f"select 'conversations' as dataset, {o} as ordinal, '{c}' as name, count(v) as nn, round(avg(length(v)),4) as avg_length,"
          f" count(*) filter (where {book.strip('v')} <> v) as whitespace_issues,"
          f" count(*) filter (where {book.in_list('lower(' + book.strip('v') + ')', K.DISGUISED_MISSING)}) as disguised_missing,"
          f" count(*) filter (where {book.looks_numeric('v')}) as numeric_like,"
          f" count(*) filter (where {book.is_day('v', X.YMD_PATTERN, '%Y-%m-%d')}) as ymd,"
          f" count(*) filter (where {book.is_day('v', X.DMY_PATTERN, '%d-%m-%Y')}) as dmy"
          f" from (select {c} as v from conversations)" for o, c in ((2, "role"), (3, "text"))))
query("pr2_value_histogram_documents", lambda s, d: P.value_histogram(read_table(s, d, "documents"), "documents"),
      " union all ".join(
          f"select 'documents' as dataset, {o} as ordinal, '{c}' as name, {f'cast({c} as bigint)' if o in (0, 4) else 'null::bigint'} as value_int,"
          f" null::double as value_dbl, {'null::varchar' if o in (0, 4) else c} as value_str, count(*) as cnt from documents group by {c}"
          for o, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))))


def _sampled(s, d):
    """All columns; fractions, whose texts differ between engines, with ten digits."""
    df = dirty(s, d)
    doubles = [c.ordinal for c in columns_of(df) if c.family == "float"]
    value = F.when(F.col("ordinal").isin(*doubles), F.format_string("%.9e", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    return P.sample_values(df, book.DATASET).withColumn("value", value)


_drawn = ("coalesce(cast(value_int as varchar), case when isinf(value_dbl) then case when value_dbl > 0 then 'Infinity' else '-Infinity' end"
          " else printf('%.9e', value_dbl) end, value_str)")
query("pr16_sample_values", _sampled,
      f"""select {_DS}, ordinal, name, cast(rank as integer) as rank, value from (
        select ordinal, name, value, row_number() over (partition by ordinal order by md5(value || '#0'), value) as rank from (
          select ordinal, name, {_drawn} as value from hist
          where value_int is not null or value_dbl is not null or value_str is not null)) where rank <= 5""")
query("pr20_id_column", lambda s, d: A(s, d).ids, f"select {_DS}, ordinal, name, is_id from ids")
query("pr21_column_kind", lambda s, d: A(s, d).kinds, f"select {_DS}, ordinal, name, dtype, kind from kinds")
query("pr22_structure_type", lambda s, d: A(s, d).structure.select("dataset", "type", joined("datetime_columns"), joined("id_columns")),
      f"select {_DS}, type, array_to_string(dt, ', ') as datetime_columns, array_to_string(idc, ', ') as id_columns from structure")
_KIND_OF = {"bigint": "numeric_count", "int": "numeric_count", "double": "numeric_count", "string": "categorical_count", "boolean": "boolean_count"}


def _kinds(s, d):
    """Every table, as long as it has rows."""
    return union_all([P.kind_counts(schema_table(read_table(s, d, t), t).join(
        csvfiles.dataset_info(read_table(s, d, t), t).where("rows > 0").select("dataset"), "dataset")) for t in TABLES])


# the types as DuckDB itself describes a row of each table
query("pr23_kind_counts", _kinds, " union all ".join(
    f"select '{t}' as dataset, count(*) filter (where k in ('BIGINT','INTEGER','DOUBLE','FLOAT')) as numeric_count,"
    f" count(*) filter (where k = 'VARCHAR') as categorical_count, count(*) filter (where k = 'BOOLEAN') as boolean_count from ("
    f"select unnest([{', '.join(f'typeof({c})' for c in COLS[t].split(", "))}]) as k from (select * from {t} limit 1))" for t in TABLES))
query("pr24_column_notes", lambda s, d: P.column_notes(A(s, d).profile),
      f"""select {_DS}, c.ordinal, c.name, array_to_string(list_filter([
        case when missing_pct >= 50 then 'high missingness' end,
        case when abs(skewness) > 2 then printf('skewed (%.1f)', round(skewness,4)) end,
        case when disguised_missing > 0 then printf('%d disguised nulls', disguised_missing) end,
        case when whitespace_issues > 0 then 'whitespace issues' end,
        case when inf_count > 0 then printf('%d infinities', inf_count) end], lambda x: x is not null), ', ') as notes
      from counts c left join (select ordinal, skewness, inf_count from mom) m using (ordinal)
        left join (select ordinal, disguised_missing, whitespace_issues from text) t using (ordinal)""")
_pfields = ("mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis")
query("profile_column_profile",
      lambda s, d: A(s, d).profile.select("dataset", "ordinal", "name", "dtype", "kind", "missing_count", "missing_pct", "unique_count",
                                          "unique_pct", *_pfields, "inf_count", "avg_length", "whitespace_issues", "disguised_missing"),
      f"select {_DS}, ordinal, k.name, dtype, kind, missing_count, missing_pct, unique_count, unique_pct, {_fin4('mean')}, {_fin4('std')},"
      f" {_fin4('mn', 'min')}, {_fin4('mx', 'max')}, {_fin4('median')}, {_fin4('q25')}, {_fin4('q75')}, {_fin4('skewness')},"
      f" {_fin4('kurtosis')}, inf_count, avg_length, whitespace_issues, disguised_missing from kinds k join (select * exclude (name) from counts) c using (ordinal)"
      " left join (select * exclude (name, rows, nn) from mom) m using (ordinal) left join (select ordinal, median, q25, q75 from ostat) o using (ordinal)"
      " left join (select ordinal, avg_length, whitespace_issues, disguised_missing from text) t using (ordinal)")

# ================================================================ QI, DT, CN

FLAT = ("dataset", "seq", "type", "severity", "column", "var1", "var2", "correlation", "percentage", "majority_pct", "skewness",
        "count", "unique_count", "message")
_FLAT_SQL = ", ".join(f'"{c}"' for c in FLAT)
_flat_cols = _FLAT_SQL + ", array_to_string(columns, ', ') as columns, array_to_string(list_transform(sentinel_values, lambda x: printf('%.0f', x)), ', ') as sentinel_values"


def flat(df: DataFrame) -> DataFrame:
    return df.select(*FLAT, joined("columns"), numbers("sentinel_values"))


def finding_query(key: str, fn: Query, source: str, replace: dict | None = None) -> None:
    query(key, lambda s, d: flat(fn(s, d)), f"select {_flat_cols} from {source}", replace)


finding_query("qi1_high_missingness", lambda s, d: QI.high_missingness(A(s, d).counts), "qi1")
finding_query("qi2_moderate_missingness", lambda s, d: QI.moderate_missingness(A(s, d).counts), "qi2")
finding_query("qi3_constant_column", lambda s, d: QI.constant_columns(A(s, d).counts), "qi3")
finding_query("qi4_numeric_sentinels", lambda s, d: QI.numeric_sentinels(QI.sentinel_candidates(dirty(s, d), book.DATASET)), "qi4")
finding_query("qi5_high_cardinality", lambda s, d: QI.high_cardinality(A(s, d).schema, A(s, d).counts), "qi5")
finding_query("qi6_mixed_types", lambda s, d: QI.mixed_types(A(s, d).text), "qi6")
finding_query("qi7_disguised_missing", lambda s, d: QI.disguised_missing(A(s, d).text, A(s, d).counts), "qi7")
finding_query("qi8_whitespace_issues", lambda s, d: QI.whitespace_issues(A(s, d).text), "qi8")
finding_query("qi9_duplicate_rows", lambda s, d: QI.duplicate_row_finding(A(s, d).duplicates, A(s, d).info), "qi9")
finding_query("qi10_infinite_values", lambda s, d: QI.infinite_values(A(s, d).moments), "qi10")
finding_query("qi11_quality_issues", lambda s, d: A(s, d).quality, "quality")
query("dt1_suggest_category", lambda s, d: QI.suggest_category(A(s, d).schema, A(s, d).counts),
      f"select {_DS}, ordinal, s.name, dtype as current_dtype, 'category' as suggested_dtype, printf('%d distinct values', unique_count) as reason"
      " from schema_ s join counts c using (ordinal) where family='text' and unique_count between 1 and 50")
_floats = [(i, n) for i, n, t in book.COLUMNS if t == "double"]
query("dt2_suggest_integer", lambda s, d: QI.suggest_integer(dirty(s, d), book.DATASET),
      f"select {_DS}, ordinal, any_value(name) as name, 'double' as current_dtype, 'nullable integer' as suggested_dtype,"
      f" 'only whole numbers' as reason from nlong where ordinal in ({', '.join(str(i) for i, _ in _floats)}) and v is not null"
      " group by ordinal having bool_and(case when isinf(v) then false else v % 1 = 0 end)")
_ints = [(i, n, t) for i, n, t in book.COLUMNS if t in ("bigint", "int")]
query("dt3_suggest_narrow_int", lambda s, d: QI.suggest_narrow_int(dirty(s, d), book.DATASET),
      f"select {_DS}, ordinal, name, current_dtype, case when lo >= -128 and hi <= 127 then 'int8' else 'int16' end as suggested_dtype,"
      " printf('range %d to %d', lo, hi) as reason from (" + book.union(
          f"select {i} as ordinal, '{n}' as name, '{t}' as current_dtype, min({n}) as lo, max({n}) as hi from d" for i, n, t in _ints)
      + ") where lo >= -32768 and hi <= 32767")
_names = V.sql_view("part", V.NAMES)
query("cn1_name_case_collision", lambda s, d: QI.name_case_collisions(V.view(s, d, "part", V.NAMES)),
      f"""select dataset, ordinal, 'duplicate_after_lowering' as type, earlier as first_name, name as second_name from (
        select *, lag(name) over (partition by dataset, lower({book.strip('name')}) order by ordinal) as earlier from {_names})
      where earlier is not null""")
_word = r"[^\p{L}\p{M}\p{N}_]"
query("cn2_name_special_chars", lambda s, d: QI.name_special_chars(V.view(s, d, "part", V.NAMES)),
      f"select dataset, ordinal, 'special_characters' as type, name, lower(trim(regexp_replace(name, '{_word}+', '_', 'g'), '_')) as suggestion"
      f" from {_names} where regexp_matches(name, '{_word}')")
query("cn3_name_whitespace", lambda s, d: QI.name_whitespace(V.view(s, d, "part", V.NAMES)),
      f"select dataset, ordinal, 'whitespace_in_name' as type, name from {_names} where {book.strip('name')} <> name")

# ================================================================ TG

_TCOLS = 'rank, ordinal, "column", cast(score as integer) as score, task_type, n_classes, imbalance_ratio, reasons'
query("tg1_suggest_targets", lambda s, d: A(s, d).targets.withColumn("reasons", joined("reasons")), f"select {_DS}, {_TCOLS} from targets")
query("tg2_imbalance_ratio", lambda s, d: TG.imbalance_ratio(TG.class_counts(dirty(s, d), None, book.DATASET)),
      f"select {_DS}, ordinal, name, imbalance_ratio, buckets from ratios join schema_ using (ordinal)")


def _explicit(s, d):
    a = Analysis(dirty(s, d), book.DATASET, target="priority")
    return a.targets.withColumn("reasons", joined("reasons"))


query("tg3_explicit_target", _explicit,
      f"""select {_DS}, cast(row_number() over (order by r0) as integer) as rank, ordinal, "column", cast(score as integer) as score, task_type,
        n_classes, imbalance_ratio, reasons from (
        select rank as r0, ordinal, "column", score, task_type, n_classes, imbalance_ratio, reasons from targets where "column" <> 'priority'
        union all select 0, ordinal, s.name, 999, case when unique_count <= 20 then 'classification' else 'regression' end, unique_count,
          case when unique_count <= 20 and buckets >= 2 then imbalance_ratio end, 'chosen by the caller'
        from scores s join ratios using (ordinal) where s.name = 'priority')""")
query("tg4_class_distribution", lambda s, d: A(s, d).distribution,
      f"select {_DS}, ordinal, name, value, cnt as count, pct, flag from dist")

# ================================================================ ST


def _scrub_log(s, d):
    _, log = ST.sentinel_scrub(dirty(s, d), None, book.DATASET)
    return log.withColumn("values", numbers("values"))


query("st1_sentinel_scrub", _scrub_log,
      f"select {_DS}, ordinal, name as \"column\", 'blueprint' as source, array_to_string(list_transform(vals, lambda x: printf('%.0f', x)), ', ') as values,"
      " cast(list_sum(cnts) as bigint) as cells_replaced from sent")
query("st1_scrubbed_table", lambda s, d: ST.sentinel_scrub(dirty(s, d))[0].select("order_id", "amount", "bonus"),
      "select order_id, case when not exists (select 1 from cand c where c.name='amount' and c.cand=d.amount) then amount end as amount,"
      " case when not exists (select 1 from cand c where c.name='bonus' and c.cand=d.bonus) then bonus end as bonus from d")
query("st2_row_sample", lambda s, d: ST.row_sample(read_table(s, d, "lineitem"), key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
      "select * from lineitem order by md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)) limit 50000")
query("st3_feature_columns", lambda s, d: A(s, d).features, f"select {_DS}, ordinal, name, role from feat")
query("st4_pearson_matrix", lambda s, d: A(s, d).pairs.withColumn("r", N.rounded(F.col("r"), 4)),
      f"select {_DS}, i, j, col_a, col_b, n, round(r,4)+0.0::double as r from pairs")
_lp = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]
query("st4_pearson_matrix_lineitem",
      lambda s, d: ST.pearson_pairs(read_table(s, d, "lineitem"), dataset="lineitem").withColumn("r", N.rounded(F.col("r"), 4)),
      " union all ".join(f"select 'lineitem' as dataset, {a[0]} as i, {b[0]} as j, '{a[1]}' as col_a, '{b[1]}' as col_b, count(*) as n,"
                         f" round(corr({a[1]}, {b[1]}),4)+0.0::double as r from lineitem" for a, b in _lp))
query("st5_top_correlations", lambda s, d: A(s, d).correlations,
      f"select {_DS}, rank, col_a, col_b, correlation, strength, n from corr")
finding_query("st6_multicollinearity", lambda s, d: ST.multicollinearity(A(s, d).pairs), "st6")
finding_query("st7_high_correlation", lambda s, d: ST.high_correlation(A(s, d).pairs), "st7")
finding_query("st8_high_outliers", lambda s, d: ST.high_outliers(A(s, d).outliers), "st8")
_SPREAD = "(select cast(cust_id as double) as x, hetero as y from d)"
query("st9_ols_fit",
      lambda s, d: ST.ols_fit(spread_orders(read_table(s, d, "orders")), "x", "hetero", "spread").withColumns(
          {"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)}),
      f"select 'spread' as dataset, 'x' as x, 'hetero' as y, round(regr_slope(t.y, t.x),4) as slope, round(regr_intercept(t.y, t.x),4) as intercept,"
      f" count(*) as n from {_SPREAD} t")
_res = f"""(select x, y, y - (sl*x + ic) as res, median(x) over () as med from {_SPREAD},
  (select regr_slope(y, x) as sl, regr_intercept(y, x) as ic from {_SPREAD}))"""
_het = f"""(select count(*) as n, count(*) filter (where x < med) as n_low, count(*) filter (where x >= med) as n_high,
  var_pop(res) filter (where x >= med)/(var_pop(res) filter (where x < med)+1e-10) as ratio from {_res})"""
query("st10_residual_spread",
      lambda s, d: ST.residual_spread(spread_orders(read_table(s, d, "orders")), "x", "hetero", "spread").withColumn("ratio", F.round("ratio", 4)),
      f"select 'spread' as dataset, 'x' as x, 'hetero' as y, n, n_low, n_high, round(ratio,4) as ratio from {_het}")
finding_query("st10_heteroscedasticity",
              lambda s, d: ST.heteroscedasticity(ST.residual_spread(spread_orders(read_table(s, d, "orders")), "x", "hetero", "spread")),
              "(" + book.finding(_het, "n >= 30 and n_low >= 5 and n_high >= 5 and (ratio > 4 or ratio < 0.25)", dataset="'spread'",
                                 seq=book.seq(11), type="'heteroscedasticity'", severity="'high'", columns="['x','hetero']",
                                 message="'The spread of \"hetero\" around its trend changes along \"x\".'") + ")")
query("st10_every_pair",
      lambda s, d: A(s, d).spreads.select("dataset", "x", "y", "n", "n_low", "n_high", N.rounded(F.log10("ratio"), 4).alias("log_ratio")),
      f"select {_DS}, x, y, n, n_low, n_high, round(log10(ratio),4)+0.0::double as log_ratio from spreads")
finding_query("st10_every_finding", lambda s, d: A(s, d).spread, "st10")
finding_query("st11_near_zero_variance", lambda s, d: ST.near_zero_variance(A(s, d).clean_moments, A(s, d).counts), "st11")
finding_query("st12_extreme_skewness", lambda s, d: ST.extreme_skewness(A(s, d).clean_moments, A(s, d).clean_order_stats), "st12")
finding_query("st13_class_imbalance", lambda s, d: ST.class_imbalance(A(s, d).targets, A(s, d).class_counts), "st13")
_REV = V.sql_view("(select *, o_custkey as c, o_orderkey as k from orders)", REVERSAL_COLUMNS)
_groups = f"(select grp, count(*) as n, corr(x, y) as group_r from {_REV} group by grp)"
query("st14_reversal_stats",
      lambda s, d: ST.reversal_stats(reversal_orders(read_table(s, d, "orders")), "x", "y", "grp", "reversal").select(
          "dataset", "group", "n", F.round("group_r", 4).alias("group_r"), F.round("overall_r", 4).alias("overall_r"), "n_groups"),
      f"select 'reversal' as dataset, grp as \"group\", n, round(group_r,4) as group_r, round((select corr(x, y) from {_REV}),4) as overall_r,"
      f" (select count(distinct grp) from {_REV}) as n_groups from {_groups}")
finding_query("st14_simpsons_paradox",
              lambda s, d: ST.simpsons_paradox(ST.reversal_stats(reversal_orders(read_table(s, d, "orders")), "x", "y", "grp", "reversal")),
              "(" + book.finding(
                  f"(select count(*) filter (where n >= 10 and sign(group_r) <> sign(o) and abs(group_r) > 0.2) as rev, count(*) as ng"
                  f" from {_groups}, (select corr(x, y) as o from {_REV}))", "ng between 2 and 10 and rev >= 2", dataset="'reversal'",
                  seq=book.seq(7), type="'simpsons_paradox'", severity="'critical'", columns="['x','y','grp']", count="rev",
                  message="printf('\"x\" against \"y\" reverses inside %d groups of \"grp\".', rev)") + ")")
query("st14_every_pair_and_group",
      lambda s, d: A(s, d).reversals.select("dataset", "a", "b", "by", "group", "n", N.rounded(F.col("group_r"), 4).alias("group_r"),
                                            N.rounded(F.col("overall_r"), 4).alias("overall_r"), "n_groups"),
      f"select {_DS}, a, b, \"by\", grp as \"group\", n, round(group_r,4)+0.0::double as group_r, round(overall_r,4)+0.0::double as overall_r,"
      " ng as n_groups from reversals")


def reversal_table(spark: SparkSession, folder: str) -> DataFrame:
    """The reversing view beside the columns it comes from: three numeric columns, two groupings."""
    orders = read_table(spark, folder, "orders").withColumns({"c": F.col("o_custkey"), "k": F.col("o_orderkey")})
    return orders.selectExpr(*[f"{e} as {n}" for n, e in REVERSAL_COLUMNS], "o_totalprice", "o_orderpriority")


_REV_ALL = "(select " + ", ".join(f"{e} as {n}" for n, e in REVERSAL_COLUMNS) + ", o_totalprice, o_orderpriority from (select *, o_custkey as c, o_orderkey as k from orders))"
_triples = " union all ".join(
    f"select '{a}' as a, '{b}' as b, '{g}' as g, {p} as place, count(*) filter (where n >= 10 and sign(r) <> sign(o) and abs(r) > 0.2) as rev, count(*) as ng"
    f" from (select {g} as grp, count(*) as n, corr({a}, {b}) as r from {_REV_ALL} group by {g}), (select corr({a}, {b}) as o from {_REV_ALL}) where grp is not null"
    for g, k in (("grp", 2), ("o_orderpriority", 4)) for a, b, p in (("x", "y", (k * 10000 + 0) * 10000 + 1), ("x", "o_totalprice", (k * 10000 + 0) * 10000 + 3),
                                                                      ("y", "o_totalprice", (k * 10000 + 1) * 10000 + 3)))
finding_query("st14_every_triple",
              lambda s, d: ST.all_triples(reversal_table(s, d), ["x", "y", "o_totalprice"], ["grp", "o_orderpriority"], "triples"),
              "(" + book.finding(f"({_triples})", "ng between 2 and 10 and rev >= 2", dataset="'triples'", seq=f"{7 * 10**12} + place",
                                 type="'simpsons_paradox'", severity="'critical'", columns="[a, b, g]", count="rev",
                                 message="printf('\"%s\" against \"%s\" reverses inside %d groups of \"%s\".', a, b, rev, g)") + ")")
finding_query("st15_leakage_by_name", lambda s, d: ST.leakage_by_name(A(s, d).schema, A(s, d).targets), "st15")
query("st16_patterns", lambda s, d: A(s, d).patterns.withColumns({c: F.array_join(c, ", ") for c in ("skewed_columns", "extremely_skewed_columns")}),
      f"select {_DS}, * replace (array_to_string(skewed_columns, ', ') as skewed_columns,"
      " array_to_string(extremely_skewed_columns, ', ') as extremely_skewed_columns) from patterns")
query("st17_outlier_summary", lambda s, d: A(s, d).outlier_summary, f"select {_DS}, * from outsum")
query("st18_distribution_summary", lambda s, d: A(s, d).shapes, f"select {_DS}, * from shapes")
FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("st19_standardize",
      lambda s, d: ML.standardize(read_table(s, d, "lineitem"), FEATS).select(*[N.rounded(F.col(c), 5).alias(c) for c in FEATS]),
      "select " + ", ".join(f"round(({c} - avg({c}) over ())/stddev_pop({c}) over (),5)+0.0::double as {c}" for c in FEATS) + " from lineitem")


def _power_sums(summary, *, pct=1.0):
    """Sums of powers of the eigenvalue shares: traces of powers of the correlation matrix, whatever the order of components."""
    r = F.col("ratio") / pct
    return summary.agg(F.count("*").alias("n"), F.round(F.sum(r), 2).alias("s1"), F.round(F.sum(r * r), 3).alias("s2"), F.round(F.sum(r * r * r), 3).alias("s3"))


_r = [[f"corr({a}::double, {b}::double)" for b in FEATS] for a in FEATS]
_PCA_SQL = ("select cast(8 as bigint) as n, 1.0::double as s1,"
            " round((" + " + ".join(f"r{i}_{j}*r{j}_{i}" for i in range(8) for j in range(8)) + ")/64,3) as s2,"
            " round((" + " + ".join(f"r{i}_{j}*r{j}_{k}*r{k}_{i}" for i in range(8) for j in range(8) for k in range(8)) + ")/512,3) as s3 from (select "
            + ", ".join(f"{_r[i][j]} as r{i}_{j}" for i in range(8) for j in range(8)) + " from lineitem)")
#: Three far groups of orders: any good partition into 2 or 3 clusters is known.
_PLANTED = """select o_orderkey, cast(case o_orderkey % 3 when 0 then 0 when 1 then 1000 else 5000 end + o_orderkey % 7 as double) as x,
  cast(case o_orderkey % 3 when 0 then 0 when 1 then 1000 else 5000 end + o_custkey % 11 as double) as y,
  cast(case o_orderkey % 3 when 0 then 0 when 1 then 1000 else 5000 end + (o_orderkey + o_custkey) % 5 as double) as z from orders"""


def _planted_view(s, d):
    read_table(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql(_PLANTED)


def _within(groups: str) -> str:
    return (f"(select sum((x-mx)**2 + (y-my)**2 + (z-mz)**2) from (select *, avg(x) over w as mx, avg(y) over w as my, avg(z) over w as mz"
            f" from (select *, {groups} as g from std) window w as (partition by g)))")


query("st20_pca_summary", lambda s, d: _power_sums(ML.pca_summary(read_table(s, d, "lineitem"), FEATS, "lineitem")), _PCA_SQL)
def _elbow(s, d):
    """All five numbers of clusters; beyond the three planted ones the costs are local optima, which must still fall."""
    known = lambda c: F.when(F.col("k") <= 3, F.round(c, 3)).alias(c)
    return ML.kmeans_elbow(_planted_view(s, d), ["x", "y", "z"], "planted").select(
        "dataset", "k", known("inertia"), known("drop"), "chosen", F.coalesce(F.col("drop") > 0, F.lit(True)).alias("falls"))


query("st21_kmeans_elbow", _elbow,
      f"""with planted as ({_PLANTED}), std as (select o_orderkey, (x-avg(x) over ())/stddev_pop(x) over () as x, (y-avg(y) over ())/stddev_pop(y) over () as y,
        (z-avg(z) over ())/stddev_pop(z) over () as z from planted),
        cost as (select {_within("case when o_orderkey % 3 = 2 then 1 else 0 end")} as two, {_within("o_orderkey % 3")} as three)
      select 'planted' as dataset, cast(2 as integer) as k, round(two,3) as inertia, cast(null as double) as drop, false as chosen, true as falls from cost
      union all select 'planted', 3, round(three,3), round(two - three,3), true, true from cost
      union all select 'planted', k::int, null, null, false, true from range(4, 7) t(k)""")
query("st22_cluster_preview", lambda s, d: ML.cluster_preview(_planted_view(s, d), ["x", "y", "z"], "planted", keep=["o_orderkey"]).select("o_orderkey", "label", "n_clusters"),
      "select o_orderkey, cast(o_orderkey % 3 as integer) as label, cast(3 as integer) as n_clusters from orders")

# ================================================================ RC

query("rc1_task_type", lambda s, d: A(s, d).tasks, f"select {_DS}, task_type from tasks")
query("rc2_characteristics", lambda s, d: A(s, d).traits, f"select {_DS}, * from traits")
query("rc3_model_scores",
      lambda s, d: RC.model_scores(A(s, d).traits, A(s, d).tasks).select("dataset", "task_type", "rule_no", "model", "score", joined("reasons", "; ")),
      f"select {_DS}, task_type, rule_no, model, score, reasons from mrank")
query("rc4_pick_model",
      lambda s, d: RC.pick_model(A(s, d).model_scores).select(
          "dataset", "task_type", "primary_model", "confidence", joined("reasoning", "; "),
          F.array_join(F.transform("alternatives", lambda a: a["model"]), ", ").alias("alternatives")),
      f"select {_DS}, * from pick")
_steps = (("has_missing", "Impute: median for numbers, most frequent value for categories."),
          ("has_outliers", "Winsorise at the 1st and 99th percentile."), ("has_skewed", "Log-transform strongly skewed numbers."),
          ("has_categoricals", "Encode categories: one-hot below 10 values, target encoding above."),
          ("has_multicollinearity", "Drop one column of each collinear pair, or use PCA."), ("not is_large", "Scale numeric features."),
          ("true", "Split 80% / 20% before fitting anything."))
query("rc5_preprocessing_steps", lambda s, d: RC.preprocessing_steps(A(s, d).traits).withColumn("preprocessing_steps", joined("preprocessing_steps", " | ")),
      f"select {_DS}, array_to_string(list_filter([" + ", ".join(f"case when {c} then {book.lit(t)} end" for c, t in _steps)
      + "], lambda x: x is not null), ' | ') as preprocessing_steps from traits")
query("rc6_cv_strategy", lambda s, d: RC.cv_strategy(A(s, d).traits, A(s, d).structure),
      f"select {_DS}, case when type='time-series' then 'Time Series Split (Walk-Forward Validation)' when has_imbalance then"
      " 'Stratified 5-Fold Cross-Validation' when is_small then 'Leave-One-Out Cross-Validation (LOOCV) or Stratified 10-Fold' else '5-Fold Cross-Validation' end"
      " as cv_strategy from traits, structure")
query("rc7_metrics", lambda s, d: RC.metrics(A(s, d).traits, A(s, d).tasks).withColumn("recommended_metrics", joined("recommended_metrics")),
      f"select {_DS}, case when task_type='regression' then 'RMSE, MAE, R²' when has_imbalance then 'F1-Score, AUC-ROC, Precision-Recall AUC, not Accuracy'"
      " else 'Accuracy, F1-Score, AUC-ROC' end as recommended_metrics from traits, tasks")

# ================================================================ FN

finding_query("fn1_all_findings", lambda s, d: A(s, d).all_findings, "findings")
query("fn2_rank_findings", lambda s, d: FN.rank_findings(A(s, d).all_findings).select("dataset", "seq", "type", "severity", "weight", "pos"),
      "select dataset, seq, type, severity, cast(weight as integer) as weight, cast(pos as integer) as pos from frank")


def order_findings(s: SparkSession, d: str) -> DataFrame:
    """Findings of three datasets, derived from the orders of each status in one scan."""
    kinds = F.array(*[
        F.struct(F.lit(no).alias("no"), F.lit(t).alias("type"), F.lit(sev).alias("severity"), F.lit(named).alias("named"))
        for no, (t, sev, named) in enumerate(book.ORDER_TYPES)])
    groups = read_table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("col")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("t", F.explode(kinds))
    return as_finding(groups, seq=F.col("t.no") * 1000 + F.substring("col", 1, 1).cast("bigint"), type=F.col("t.type"),
                      severity=F.col("t.severity"), column=F.when(F.col("t.named"), F.col("col")), percentage=F.round(F.col("n") / 10, 1),
                      skewness=F.col("n").cast("double"), count=F.col("n"),
                      message=F.concat(F.lit("seen "), F.col("n").cast("string"), F.lit(" times")))


def order_models(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(book.ORDER_MODELS), "dataset string, primary_model string")


MERGED = ("dataset", "type", "severity", "column", "count", "aggregated", "message")
_MERGED_SQL = ", ".join(f'"{c}"' for c in MERGED) + ", array_to_string(columns, ', ') as columns"


def merged(df: DataFrame) -> DataFrame:
    pair = F.array_join(F.transform("pairs", lambda p: F.concat(p["var1"], F.lit("~"), p["var2"], F.lit("~"),
                                                                F.format_string("%.3f", p["correlation"]))), "|")
    return df.select(*MERGED, joined("columns"), pair.alias("pairtext"))


query("fn3_aggregate_findings", lambda s, d: FN.aggregate_findings(A(s, d).all_findings).select(
          *MERGED, joined("columns"), "position"),
      f"select {_MERGED_SQL}, position from fagg")
query("fn3_aggregate_findings_by_status", lambda s, d: FN.aggregate_findings(order_findings(s, d)).select(
          *MERGED, joined("columns"), "position"),
      f"select {_MERGED_SQL}, position from fagg", book.ORDER_FINDINGS)
def fn4(s: SparkSession, d: str) -> DataFrame:
    ranked = FN.rank_findings(A(s, d).all_findings)
    return merged(FN.merge_pairs(FN.finding_groups(ranked, examples=ranked.count())))


query("fn4_merge_pairs", fn4, f"select {_MERGED_SQL}, pairtext from fgen_pairs")
query("fn4_pair_members", lambda s, d: FN.pair_members(FN.rank_findings(A(s, d).all_findings)).withColumn("correlation", F.round("correlation", 6)),
      "select dataset, type, cast(pos as integer) as pos, var1, var2, round(correlation, 6) as correlation from frank where type in ('high_correlation','multicollinearity')")
for _k, _fn, _src in (("fn5_merge_ranked", FN.merge_ranked, "fgen_ranked"), ("fn6_merge_listed", FN.merge_listed, "fgen_listed")):
    query(_k, lambda s, d, f=_fn: merged(f(FN.finding_groups(FN.rank_findings(order_findings(s, d))))).drop("pairtext"),
          f"select {_MERGED_SQL} from {_src}", book.ORDER_FINDINGS)
query("fn7_merge_generic", lambda s, d: merged(FN.merge_generic(FN.finding_groups(FN.rank_findings(order_findings(s, d))))).drop("pairtext"),
      f"select {_MERGED_SQL} from (select * from fgen_other union all select * from fbare)", book.ORDER_FINDINGS)
query("fn8_model_family",
      lambda s, d: read_table(s, d, "part").select("p_partkey", "p_name", FN.model_family(F.concat("p_name", F.lit(" "), F.element_at(
          F.array(*[F.lit(m) for _, _, m, _ in K.MODELS]), (F.col("p_partkey") % len(K.MODELS) + 1).cast("int")))).alias("family")),
      "select p_partkey, p_name, " + book._fam.replace("primary_model", "model") + " as family from (select *, p_name || ' ' || ["
      + ", ".join(book.lit(m) for _, _, m, _ in K.MODELS) + f"][p_partkey % {len(K.MODELS)} + 1] as model from part)")
_REL = ("dataset", "type", "severity", "column", "original_severity", "action_priority", "model_context_note")
_REL_SQL = ", ".join(f'"{c}"' for c in _REL)
query("fn9_relevance_adjust", lambda s, d: FN.relevance_adjust(A(s, d).grouped, A(s, d).recommendation).select(*_REL[:6], "family"),
      f"select {', '.join(chr(34) + c + chr(34) for c in _REL[:6])}, family from frel")
query("fn9_relevance_adjust_by_status",
      lambda s, d: FN.relevance_adjust(FN.aggregate_findings(order_findings(s, d)), order_models(s)).select(*_REL, "family"),
      f"select {_REL_SQL}, family from frel", book.ORDER_FINDINGS)
query("fn10_action_priority",
      lambda s, d: FN.with_model(order_findings(s, d), order_models(s)).select(
          "dataset", "type", "severity", "column", FN.action_priority(F.col("type"), F.col("severity"), F.col("family")).alias("priority")),
      f'select dataset, type, severity, "column", {book.PRIORITY} as priority from (select f.*, {book._fam} as family from findings f join picks using (dataset))',
      book.ORDER_FINDINGS)
query("fn11_context_note", lambda s, d: FN.relevance_adjust(A(s, d).grouped, A(s, d).recommendation).select("dataset", "type", "column", "model_context_note"),
      'select dataset, type, "column", model_context_note from frel')
query("fn12_headline", lambda s, d: FN.headlines(A(s, d).grouped).select("dataset", "type", "column", "headline"),
      'select dataset, type, "column", headline from fhead')
query("fn12_headline_by_status", lambda s, d: FN.headlines(FN.aggregate_findings(order_findings(s, d))).select("dataset", "type", "column", "headline"),
      'select dataset, type, "column", headline from fhead', book.ORDER_FINDINGS)
query("fn13_severity_split", lambda s, d: A(s, d).split, "select * from split")
query("fn14_health_points", lambda s, d: A(s, d).health, f"select {_DS}, points, label from health")
_sum_first = "(select col_a, col_b, correlation from corr where abs(correlation) >= 0.7 order by rank limit 1)"
_sum_imb = "(select \"column\" as ic, majority_pct as ip from frel where type='class_imbalance' limit 1)"
query("fn15_executive_summary", lambda s, d: A(s, d).summary,
      f"""select {_DS}, concat_ws(' ', format('{{:,}}', rows) || ' rows by ' || columns || ' columns; overall state: ' || label || '.',
        case when missing_percentage > 0 then printf('Empty cells: %.1f%%.', missing_percentage) end,
        case when duplicate_rows > 0 then 'Rows with an identical twin: ' || format('{{:,}}', duplicate_rows) || '.' end,
        case when critical > 0 then printf('Critical findings: %d.', critical) end,
        case when col_a is not null then printf('Closest pair: "%s" with "%s" (r = %+.2f).', col_a, col_b, correlation) end,
        case when ic is not null then printf('Target "%s" has %.0f%% of its rows in one class.', ic, ip) end,
        printf('First model to try: %s (%s).', primary_model, task_type)) as summary
      from info, dups, split, health, pick left join {_sum_first} on true left join {_sum_imb} on true""")
query("fn16_column_relationships", lambda s, d: A(s, d).relationships,
      f"""select {_DS}, col_a, col_b, cast(null as varchar) as split_by, correlation, strength,
        case when correlation > 0 then 'positive' else 'negative' end as direction,
        case when abs(correlation) >= 0.9 then 'high' when abs(correlation) >= 0.7 then 'medium' else 'info' end as severity,
        printf('"%s" and "%s" (r = %+.2f)', col_a, col_b, correlation) as explanation,
        case when abs(correlation) >= 0.9 then 'Keep one of them, or a combination.' when abs(correlation) >= 0.7 then 'Linear models: keep one. Trees: keep both.'
          else 'Nothing to do.' end as action,
        cast(row_number() over (order by abs(correlation) desc, rank) as integer) as position from allcorr where abs(correlation) >= 0.3""")
query("fn17_quick_wins", lambda s, d: FN.quick_wins(A(s, d).duplicates, A(s, d).traits, A(s, d).all_findings).withColumn("tips", joined("tips", " | ")),
      f"""select {_DS}, case when t = '' then 'nothing to mend' else t end as tips from (select array_to_string(list_filter([
        case when duplicate_rows > 0 then format('{{:,}}', duplicate_rows) || ' rows have a twin: keep one of each' end,
        case when has_missing then 'fill or drop the empty cells' end, case when has_imbalance then 'weight or resample the classes' end,
        case when len(cs) > 0 then 'leave out columns of one value: ' || array_to_string(cs, ', ') end,
        case when v1 is not null then printf('keep "%s" or "%s", not both', v1, v2) end], lambda x: x is not null), ' | ') as t
      from dups, traits, (select list("column" order by seq) filter (where type='constant_column') as cs,
        min_by(case when type='multicollinearity' then var1 end, seq) filter (where type='multicollinearity') as v1,
        min_by(case when type='multicollinearity' then var2 end, seq) filter (where type='multicollinearity') as v2 from findings))""")
query("fn18_imbalance_guidance",
      lambda s, d: FN.imbalance_guidance(A(s, d).findings, A(s, d).targets).withColumns(
          {"hints": F.array_join(F.transform("techniques", lambda t: F.concat_ws("/", t["difficulty"], t["code_hint"])), ", ")} | {
              "techniques": F.array_join(F.transform("techniques", lambda t: t["name"]), ", ")} | {c: F.array_join(c, ", ") for c in ("wrong_metrics", "right_metrics")}),
      f"""select {_DS}, f."column" as target_column, majority_pct, coalesce(n_classes, 2) as n_classes, imbalance_ratio,
        'Class Weights, SMOTE, Random Undersampling, Threshold Tuning' as techniques,
        'easy/class_weight="balanced", moderate/imblearn.over_sampling.SMOTE, easy/imblearn.under_sampling.RandomUnderSampler, moderate/sklearn.metrics.precision_recall_curve' as hints,
        printf('Always answering the larger class of "%s" would be right in %.0f%% of the rows.', f."column", majority_pct) as why_it_matters,
        printf('Judge "%s" by F1-score or AUC-ROC.', f."column") as metric_explanation, 'accuracy' as wrong_metrics,
        'F1-score, AUC-ROC, Precision-Recall AUC, Cohen''s Kappa' as right_metrics
      from (select "column", majority_pct from frel where type='class_imbalance') f left join targets t on t."column"=f."column" """)
query("fn19_model_guidance",
      lambda s, d: FN.model_guidance(A(s, d).recommendation).select("dataset", "recommended_model", "task_type", "confidence_label", "confidence_score",
                                                                    joined("key_reasons", "; ")),
      f"select {_DS}, primary_model as recommended_model, task_type, case when confidence >= 0.75 then 'High confidence' when confidence >= 0.55"
      " then 'Moderate confidence' else 'Low confidence' end as confidence_label, confidence as confidence_score, reasoning as key_reasons from pick")


def suspects(s: SparkSession, d: str) -> DataFrame:
    """Suspect columns as an outside source might name them: one per distinct order status and priority."""
    named = read_table(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()
    col = F.expr("case substr(o_orderpriority,1,1) when '1' then 'spike' when '2' then 'final_actual' when '3' then 'churn' when '4' then 'hetero' else 'nowhere' end")
    kind = F.expr("case when o_orderstatus = 'F' then 'leakage' else 'metadata' end")
    return named.select(F.lit(book.DATASET).alias("dataset"), col.alias("column"), kind.alias("kind"))


_susp = """(select distinct case substr(o_orderpriority,1,1) when '1' then 'spike' when '2' then 'final_actual' when '3' then 'churn'
   when '4' then 'hetero' else 'nowhere' end as col, case when o_orderstatus='F' then 'leakage' else 'metadata' end as kind from orders)"""
_known = f"(select s.*, n.ordinal from {_susp} s join schema_ n on n.name=s.col where col not in (select \"column\" from targets))"
_leaks = f"(select * from {_known} where kind='leakage' and col not in (select \"column\" from findings where type='data_leakage_risk'))"
query(
    "fn20_external_suspects",
    lambda s, d: FN.external_suspects(A(s, d).all_findings, A(s, d).schema, A(s, d).targets, suspects(s, d)).where(
        "source = 'external'").select("dataset", "seq", "type", "severity", "column"),
    f"""select {_DS}, cast(14*1000000000000 + ordinal*100000 as bigint) as seq, 'data_leakage_risk' as type, 'critical' as severity, col as "column" from {_leaks}
      union all select {_DS}, cast(15*1000000000000 + ordinal*100000 as bigint), 'metadata_leakage', 'high', col from {_known} where kind='metadata'
        and col not in (select "column" from findings where type in ('data_leakage_risk','metadata_leakage')) and col not in (select col from {_leaks})""")


def enrichment(df: DataFrame) -> DataFrame:
    return df.select("dataset", "type", "column", F.concat(F.lit("More on "), F.col("type")).alias("text")).distinct()


query("fn21_enrichment_overlay",
      lambda s, d: (lambda f: FN.enrichment_overlay(f, enrichment(f)))(FN.aggregate_findings(order_findings(s, d))).select(
          "dataset", "type", "severity", "column", "position", "enriched"),
      "select dataset, type, severity, \"column\", position, true as enriched from fagg", book.ORDER_FINDINGS)
query("fn22_digest",
      lambda s, d: A(s, d).digest.select(
          "dataset", "rows", "columns", "structure", F.size("quality_issues_summary").alias("n_issues"), F.size("column_digest").alias("n_columns"),
          F.size("top_correlations").alias("n_pairs"), F.col("target.column").alias("target"), F.col("model.primary_model").alias("model"),
          F.array_join(F.transform(F.array_sort(F.map_keys("quality_issue_counts")),
                                   lambda k: F.concat(k, F.lit("="), F.element_at("quality_issue_counts", k).cast("string"))), ", ").alias("issue_counts")),
      f"""select {_DS}, rows, columns, type as structure, cast((select count(*) from quality) as integer) as n_issues,
        cast(columns as integer) as n_columns, cast((select count(*) from corr) as integer) as n_pairs,
        (select "column" from targets where rank=1) as target, (select primary_model from pick) as model,
        (select string_agg(t || '=' || n, ', ' order by t) from (select type as t, count(*) as n from quality group by type)) as issue_counts
      from info, structure""")
query("fn23_severity_filter", lambda s, d: FN.keep_severities(A(s, d).findings, ("critical", "high")).select("dataset", "type", "severity", "column"),
      "select dataset, type, severity, \"column\" from frel where severity in ('critical','high')")
query("fn23_strength_filter", lambda s, d: FN.keep_strong(A(s, d).relationships, 0.8).select("dataset", "col_a", "col_b", "correlation"),
      f"select {_DS}, col_a, col_b, correlation from allcorr where abs(correlation) >= 0.8")

# ================================================================ CH

_band = book.bands("missing_pct", CH.MISSING_BANDS, "low")
query("ch1_missing_values", lambda s, d: CH.missing_values(A(s, d).counts),
      f"select {_DS}, cast(row_number() over (order by missing_pct desc, ordinal) as integer) as rank, name, missing_pct, {_band} as band from counts"
      " where missing_pct > 0")
query("ch2_correlation", lambda s, d: CH.correlation(A(s, d).pairs),
      f"""select {_DS}, col_a as "row", col_b as col, round(r,3)+0.0::double as value from pairs union all
        select {_DS}, col_b, col_a, round(r,3)+0.0::double from pairs union all
        select {_DS}, c, c, 1.0::double from (select col_a as c from pairs union select col_b from pairs)""")
query("ch3_target_distribution", lambda s, d: CH.target_distribution(_status_target(s, d), A(s, d).distribution, A(s, d).profile),
      f"select {_DS}, name, value as label, cast(cnt as double) as amount, pct, flag from dist where name='status_code'")
query("ch3_target_distribution_regression",
      lambda s, d: CH.target_distribution(_numeric_target(s, d), A(s, d).distribution, A(s, d).profile),
      " union all ".join(f"select {_DS}, m.name, '{l}' as label, round({c},4) as amount, cast(null as double) as pct, 'normal' as flag"
                         " from mom m join (select ordinal, median from ostat) o using (ordinal) where m.name='heavy_tail'"
                         for l, c in (("min", "mn"), ("max", "mx"), ("mean", "mean"), ("median", "median"))))


def _status_target(s, d):
    return A(s, d).targets.where("column = 'status_code'").withColumn("rank", F.lit(1))


def _numeric_target(s, d):
    return A(s, d).targets.where("column = 'heavy_tail'").withColumn("rank", F.lit(1))


query("ch4_outliers", lambda s, d: CH.outliers(A(s, d).outlier_summary),
      f"select {_DS}, cast(row_number() over (order by outlier_pct desc, ordinal) as integer) as rank, \"column\", outlier_count, outlier_pct,"
      " case when outlier_pct >= 15 then 'critical' when outlier_pct >= 5 then 'high' else 'medium' end as band from outsum where outlier_pct >= 1")
query("ch5_skewness", lambda s, d: CH.skewness(A(s, d).shapes),
      f"select {_DS}, cast(row_number() over (order by abs(skewness) desc, ordinal) as integer) as rank, \"column\", skewness,"
      " case when abs(skewness) >= 50 then 'critical' when abs(skewness) >= 10 then 'high' when abs(skewness) >= 3 then 'medium' else 'normal' end as band"
      " from shapes where abs(skewness) >= 1")


def _step(col, steps, last):
    return "case " + " ".join(f"when {col} < {a} then {b}" for a, b in steps) + f" else {last} end"


_radar = {
    "completeness": f"case when m = 0 then 100 else {_step('m', ((2, 90), (5, 75), (15, 55), (30, 35)), 15)} end",
    "uniqueness": f"case when u = 0 then 100 else {_step('u', ((1, 85), (5, 65), (10, 45)), 25)} end",
    "consistency": _step("bad", ((1, 100), (3, 80), (6, 60), (11, 40)), 20),
    "distribution": _step("ext", ((1, 100), (3, 75), (6, 50)), 25),
    "outliers": f"case when ao = 0 then 100 else {_step('ao', ((2, 85), (5, 65), (10, 45), (20, 25)), 10)} end",
    "reliability": "greatest(0, 100 - critical*20 - high*8)",
}
_ov = "((" + " + ".join(_radar) + ")/6.0::double)"
query("ch6_health_radar", lambda s, d: A(s, d).radar,
      f"""select {_DS}, {', '.join(f'cast({k} as integer) as {k}' for k in _radar)}, round({_ov},4) as overall,
        {book.bands(_ov, ((85, 'Excellent'), (70, 'Good'), (50, 'Fair')), 'Poor')} as label from (
        select {', '.join(f'{v} as {k}' for k, v in _radar.items())} from (
          select missing_percentage as m, duplicate_rows*100.0::double/rows as u, (select coalesce(avg(outlier_pct),0) from outsum) as ao,
            (select count(*) from shapes where abs(skewness) >= 10) as ext, critical, high,
            (select count(*) from findings where type in ('whitespace_issues','disguised_missing','mixed_types','constant_column')) as bad
          from info, dups, split))""")
query("ch7_column_types", lambda s, d: CH.column_types(A(s, d).schema.join(A(s, d).counts.where("rows > 0").select("dataset", "ordinal"), ["dataset", "ordinal"])),
      f"select {_DS}, case family when 'integer' then 'Numeric' when 'float' then 'Numeric' when 'text' then 'Text' when 'temporal' then 'Datetime'"
      " else 'Other' end as label, count(*) as n from schema_ join counts using (ordinal) where rows > 0 group by all")
query("ch8_duplicates", lambda s, d: CH.duplicates(A(s, d).info, A(s, d).duplicates),
      f"select {_DS}, rows - duplicate_rows as unique_rows, duplicate_rows, round(duplicate_rows*100.0::double/rows,2) as duplicate_pct from info, dups where duplicate_rows > 0")
query("ch9_cardinality", lambda s, d: CH.cardinality(A(s, d).counts),
      f"select {_DS}, cast(row_number() over (order by unique_count desc, ordinal) as integer) as rank, name, unique_count, unique_pct,"
      " case when unique_pct >= 95 then 'nearly unique' when unique_pct >= 80 then 'high' else 'normal' end as band from counts")


def _amount_target(s, d):
    return A(s, d).targets.where("rank = 1").withColumn("column", F.lit("amount_gross"))


query("ch10_feature_importance", lambda s, d: CH.feature_importance(_amount_target(s, d), ST.known_correlations(A(s, d).pairs)),
      f"""select {_DS}, cast(row_number() over (order by importance desc, rank) as integer) as rank, 'amount_gross' as target, feature, importance,
        case when importance >= 0.5 then 'strong' when importance >= 0.3 then 'moderate' else 'weak' end as band from (
        select rank, case when col_a='amount_gross' then col_b else col_a end as feature, abs(correlation) as importance from allcorr
        where col_a='amount_gross' or col_b='amount_gross')""")
query("ch11_missing_pattern", lambda s, d: CH.missing_pattern(A(s, d).counts),
      f"select {_DS}, cast(row_number() over (order by missing_pct desc, ordinal) as integer) as rank, name, missing_pct, {_band} as band from counts"
      " where missing_pct > 0 and (select count(*) from counts where missing_pct > 0) >= 2")
query("ch11_co_missing", lambda s, d: CH.co_missing(dirty(s, d), book.DATASET),
      f"select {_DS}, missing_together, count(*) as rows from (select array_to_string(list_filter(["
      + ", ".join(f"case when {n} is null then '{n}' end" for _, n, _ in book.COLUMNS)
      + "], lambda x: x is not null), '+') as missing_together from d) group by missing_together")
_gap = {n: f"sum(case when {n} is null then 1 else 0 end)" for _, n, _ in book.COLUMNS}
query("ch11_co_missing_pairs", lambda s, d: CH.co_missing_pairs(dirty(s, d), book.DATASET),
      f"select {_DS}, *, round(\"both\"*100.0::double/(missing_a+missing_b-\"both\"), 2) as together_pct from (" + " union all ".join(
          f"select {i} as i, {j} as j, '{a}' as col_a, '{b}' as col_b, cast(sum(case when {a} is null and {b} is null then 1 else 0 end) as bigint) as \"both\","
          f" cast({_gap[a]} as bigint) as missing_a, cast({_gap[b]} as bigint) as missing_b from d"
          for i, a, _ in book.COLUMNS for j, b, _ in book.COLUMNS if i < j) + ") where \"both\" > 0")
query("ch12_box_plots", lambda s, d: CH.box_plots(A(s, d).quartiles),
      f"select {_DS}, cast(row_number() over (order by ordinal) as integer) as rank, o.name, median, q25, q75,"
      " greatest(mn, q25-1.5*(q75-q25)) as whisker_low, least(mx, q75+1.5*(q75-q25)) as whisker_high from ostat o join"
      " (select ordinal, mn, mx from mom) m using (ordinal)")
query("ch13_pca_variance", lambda s, d: _power_sums(CH.pca_variance(ML.pca_summary(read_table(s, d, "lineitem"), FEATS, "lineitem")).withColumnRenamed("ratio_pct", "ratio"), pct=100), _PCA_SQL)
query("ch14_cluster_points", lambda s, d: CH.cluster_points(ML.cluster_preview(_planted_view(s, d), ["x", "y", "z"], "planted")).groupBy(
          "dataset", "label", "cluster_points").agg(F.count("*").alias("points")),
      "select 'planted' as dataset, cast(o_orderkey % 3 as integer) as label, count(*) as cluster_points, count(*) as points from orders group by o_orderkey % 3")

# ================================================================ HX

_jobs = V.sql_view("events", V.JOBS)


def jobs(s, d):
    return V.view(s, d, "events", V.JOBS)


query("hx1_latest_per_session", lambda s, d: HX.latest_per_session(jobs(s, d), 3, "completed").select("job_id", "session_id", "created_at", "status", "rank"),
      f"select job_id, session_id, created_at, status, cast(row_number() over (partition by session_id order by created_at desc, job_id) as integer) as rank"
      f" from {_jobs} where status='completed' qualify rank <= 3")
query("hx2_retention_split", lambda s, d: HX.retention_split(jobs(s, d), F.expr(NOW.replace("timestamp", "timestamp_ntz"))),
      f"select count(*) filter (where created_at < {NOW} - interval 48 hours) as removed, count(*) filter (where not (created_at < {NOW} - interval 48 hours)) as kept from {_jobs}")
query("hx2_retained", lambda s, d: HX.retained(jobs(s, d), F.expr(NOW.replace("timestamp", "timestamp_ntz"))).select("job_id", "created_at"),
      f"select job_id, created_at from {_jobs} where not (created_at < {NOW} - interval 48 hours)")
def _history(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "history")
    HX.write_history(jobs(s, d), path)
    HX.apply_retention(s, path, F.expr(NOW.replace("timestamp", "timestamp_ntz")))
    return s.read.schema(jobs(s, d).schema).parquet(path).select("job_id", "created_at")


query("hx2_retention_applied", _history, f"select job_id, created_at from {_jobs} where not (created_at < {NOW} - interval 48 hours)")
query("hx3_active_sessions",
      lambda s, d: HX.active_sessions(read_table(s, d, "events").select(F.col("event_id").alias("session_id"), F.col("ts").alias("created_at")),
                                      F.expr(NOW.replace("timestamp", "timestamp_ntz"))),
      f"select event_id as session_id, ts as created_at, ts + interval 168 hours as expires_at, not (ts + interval 168 hours < {NOW}) as active from events")
query("hx4_metadata_rows", lambda s, d: HX.metadata_rows(A(s, d).info, A(s, d).duplicates, A(s, d).structure, A(s, d).split, A(s, d).recommendation),
      f"select {_DS}, rows as row_count, columns as column_count, missing_percentage, duplicate_rows, type as data_structure_type, critical as critical_issues_count,"
      " high as high_issues_count, medium as medium_issues_count, primary_model as primary_model_recommendation from info, dups, structure, split, pick")


def _history(s, d):
    meta = jobs(s, d).where("status = 'completed'").select("job_id", F.get_json_object("props", "$.k").cast("int").alias("row_count"), F.length("props").alias("column_count"))
    return HX.history_view(jobs(s, d), meta).select("job_id", "session_id", "status", "metadata.row_count", "metadata.column_count", F.isnull("metadata").alias("no_metadata"))


query("hx5_history_view", _history,
      f"select job_id, session_id, status, case when status='completed' then cast(json_extract_string(props, '$.k') as integer) end as row_count,"
      f" case when status='completed' then cast(length(props) as integer) end as column_count, status <> 'completed' as no_metadata from {_jobs}")
_states = V.sql_view("events", V.STATES)
_progress = "case step " + " ".join(f"when {no} then {pct}" for no, _, pct in K.JOB_STEPS) + " else 0 end"
query("hx6_job_state_rules", lambda s, d: HX.job_state_rules(HX.latest_state(V.view(s, d, "events", V.STATES))),
      f"""select job_id, status, status not in ('completed','failed','cancelled') as cancellable,
        case when status='completed' then 100 else {_progress} end as progress from (
        select job_id, arg_max(status, (changed_at, event_id)) as status, max(step) as step from {_states} group by job_id)""")

# ================================================================ RL

def _replayed(s: SparkSession, d: str, slices: int = 4) -> DataFrame:
    """The log as files that arrive in order of time, read as a stream; a last row without a user ends it."""
    events = read_table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return RL.requests_in_window(events, "user_id", "ts", 3600)
    width = (last - first) / slices + datetime.timedelta(seconds=1)
    log, out = new_folder(s, "log"), new_folder(s, "counts")
    for i in range(slices):
        part = events.where((F.col("ts") >= F.lit(first + i * width)) & (F.col("ts") < F.lit(first + (i + 1) * width)))
        part.write.mode("append").parquet(log)
    s.createDataFrame([(None, last + slices * width + datetime.timedelta(days=2))], events.schema).write.mode("append").parquet(log)
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(log)
    counts = RL.streamed_requests_in_window(stream, "user_id", "ts", 3600, 6 * 3600, f"{int(width.total_seconds()) + 1} seconds")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(s, "marks")).trigger(
        availableNow=True).start().awaitTermination()
    return s.read.schema(counts.schema).parquet(out)


_rl1 = ("""select user_id as key, epoch_us(ts) as t, any_value(n) as requests, any_value(w) as in_window from (
        select user_id, ts, count(*) over (partition by user_id, ts) as n,
          count(*) over (partition by user_id order by ts range between interval 3600 seconds preceding and current row) as w from events)
      group by user_id, ts""")
query("rl1_requests_in_window", lambda s, d: RL.requests_in_window(read_table(s, d, "events"), "user_id", "ts", 3600), _rl1)
query("rl1_streamed_requests", _replayed, _rl1)
query("rl3_tier_rules", lambda s, d: RL.tier_rules(V.view(s, d, "events", V.REQUESTS)),
      f"""select *, case when tier <> 'skip' then tier || ':' || client end as limit_key from (
        select *, case tier when 'strict' then 10 when 'global' then 200 end as max_reqs, case when tier <> 'skip' then 60 end as window_s from (
          select *, case when method='OPTIONS' then 'skip' when p = '/health' or starts_with(p, '/api/status/') then 'skip'
            when p = '/api/analyze' then 'strict' else 'global' end as tier from (
            select *, regexp_replace(path, '/+$', '') as p from {V.sql_view('events', V.REQUESTS)})))""".replace("select *, case when tier <> 'skip' then tier", "select * exclude (p), case when tier <> 'skip' then tier"))


# ================================================================ TX

_replies, _lists = V.sql_view("conversations", V.REPLIES), V.sql_view("conversations", V.LISTS)
_unfenced = "regexp_replace(reply, '```(json)?\\s*', '', 'g')"
query("tx1_clean_text", lambda s, d: V.view(s, d, "conversations", V.REPLIES).select("conv_id", "turn", TX.clean_text(F.col("reply")).alias("clean")),
      f"select conv_id, turn, coalesce({book.strip('regexp_replace(' + _unfenced + ', chr(10) || chr(123) || ' + chr(39) + '3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}, '') as clean from {_replies}")
query("tx2_extract_json", lambda s, d: TX.extract_json(V.view(s, d, "conversations", V.REPLIES), "reply").select("conv_id", "turn", "json_text"),
      f"""select conv_id, turn, case when json_valid(w) then w when sp <> '' and json_valid(sp) then sp end as json_text from (
        select *, regexp_extract(w, '(\\[[\\s\\S]*\\]|\\{{[\\s\\S]*\\}})', 1) as sp from (select *, {book.strip(_unfenced)} as w from {_replies}))""")
query("tx3_numbered_list", lambda s, d: TX.numbered_list(V.view(s, d, "conversations", V.LISTS), "reply", 5),
      f"""select conv_id, turn, item, item_text from (
        select conv_id, turn, item, item_text, row_number() over (partition by conv_id, turn, item order by g desc) as rn from (
          select conv_id, turn, g, max(case when head then cast(regexp_extract(line, '^#?[ \\t]*([0-9]+)', 1) as integer) end) as item,
            {book.strip("string_agg(case when head then nullif(regexp_replace(line, '^#?[ \\t]*[0-9]+[ \\t]*[.):\\-]\\s*', ''), '') else line end, ' ' order by pos)")} as item_text
          from (select *, sum(case when head then 1 else 0 end) over (partition by conv_id, turn order by pos) as g from (
            select *, regexp_matches(line, '^#?[ \\t]*[0-9]+[ \\t]*[.):\\-]') as head from (
              select conv_id, turn, pos, {book.strip('l')} as line from (
                select conv_id, turn, unnest(string_split(reply, chr(10))) as l, generate_subscripts(string_split(reply, chr(10)), 1) as pos from {_lists}))
            where line <> '')) where g > 0 group by conv_id, turn, g)
        where item between 1 and 5 and item_text <> '') where rn = 1""")
query("tx4_prompt_fingerprint", lambda s, d: read_table(s, d, "conversations").select("conv_id", "turn", TX.fingerprint(F.col("role"), F.col("text")).alias("fp")),
      "select conv_id, turn, substr(sha256(role || ':' || text),1,16) as fp from conversations")


# ================================================================ whole catalogue


def _overview(s, d):
    return Slices({t: read_table(s, d, t) for t in TABLES}).info


query("catalogue_overview", _overview, " union all ".join(
    f"select dataset, max(rows) as rows, count(*) as columns, cast(sum(missing_count) as bigint) as missing_cells,"
    f" round(cast(sum(missing_count) as double)/(max(rows)*count(*))*100,2) as missing_percentage from ({sql_counts(t)}) group by dataset"
    for t in TABLES))

# ---- many datasets in one plan: fourteen tables, most of them cut into a dataset per value of some columns

SLICED_BY = {"customer": ("c_nationkey",), "supplier": ("s_nationkey",), "part": ("p_brand",), "orders": ("o_orderpriority",),
             "lineitem": ("l_returnflag", "l_linestatus"), "events": ("event_type",), "documents": ("lang", "source"), "conversations": ("role",)}
#: Types of the columns of COLS: integer, float, text, date, other.
KINDS = {"region": "it", "nation": "iti", "customer": "itift", "supplier": "itif", "part": "itttif", "orders": "iitfdt", "lineitem": "iiiiffffttd",
         "events": "iditft", "documents": "ittti", "embeddings": "ioi", "pages": "itt", "benchmark": "it", "labels": "iii", "conversations": "iitt"}
_sliced: dict[tuple[str, str], Slices] = {}


def S(spark: SparkSession, folder: str) -> Slices:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _sliced:
        _sliced[key] = Slices({t: read_table(spark, folder, t) for t in TABLES}, SLICED_BY)
    return _sliced[key]


def _slice_columns(kinds: str):
    """(table, dataset as SQL, ordinal, column, kind) of every column that no table is cut by."""
    for t in TABLES:
        ds = "concat_ws('/', " + ", ".join([f"'{t}'", *[f"coalesce(cast({c} as varchar), 'None')" for c in SLICED_BY.get(t, ())]]) + ")"
        for i, (c, kind) in enumerate(zip(COLS[t].split(", "), KINDS[t], strict=True)):
            if kind in kinds and c not in SLICED_BY.get(t, ()):
                yield t, ds, i, c, kind


_num = "kind in ('i', 'f')"
SLICE_CTE = {
    "models": book.CTE["models"],
    "counts": " union all ".join(
        f"select {ds} as dataset, {i} as ordinal, '{c}' as name, '{kind}' as kind, count(*) as rows, count(*) - count({c}) as missing_count,"
        f" count(distinct {c}) as unique_count from {t} group by 1" for t, ds, i, c, kind in _slice_columns("iftdo")),
    "info": "select dataset, max(rows) as rows, count(*) as columns, cast(sum(missing_count) as bigint) as missing_cells,"
            " round(cast(sum(missing_count) as double)/(max(rows)*count(*))*100, 2) as missing_percentage from counts group by dataset",
    "feat": f"select * from counts where {_num} and not ({book.any_of('name', K.ID_KEYWORDS)} or (rows > missing_count and unique_count = rows - missing_count))",
    "hist": " union all ".join(f"select {ds} as dataset, {i} as ordinal, cast({c} as varchar) as v, count(*) as cnt from {t} group by 1, 3"
                               for t, ds, i, c, _ in _slice_columns("iftdo")),
    "targets": f"""select dataset, ordinal, unique_count as n_classes, case when unique_count <= 10 then 'classification' else 'regression' end as task_type from (
        select *, case when {book.any_of('name', K.TARGET_KEYWORDS)} then 3 else 0 end + case when ordinal = max(ordinal) over (partition by dataset) then 1 else 0 end
          + case when {_num} and unique_count = 2 then 2 when {_num} and unique_count <= 10 then 1 else 0 end
          + case when kind = 't' and unique_count <= 10 then 2 else 0 end as score from counts)
        where score >= 2 qualify row_number() over (partition by dataset order by score desc, ordinal) = 1""",
    "tasks": "select dataset, coalesce(task_type, 'classification') as task_type from info left join targets using (dataset)",
    "nlong": "select n.* from (" + " union all ".join(
        f"select {ds} as dataset, row_number() over () as rid, {i} as ordinal, cast({c} as double) as v from {t}"
        for t, ds, i, c, _ in _slice_columns("if")) + ") n join feat using (dataset, ordinal) where v is not null",
    "imb": "select dataset, true as yes from hist join targets using (dataset, ordinal) where n_classes <= 20 group by dataset having max(cnt)/cast(sum(cnt) as double) >= 0.85",
    "mc": "select distinct dataset, true as yes from (" + " union all ".join(
        f"select {ds} as dataset, {i} as i, {j} as j, count(*) filter (where {a} is not null and {b} is not null) as n, stddev_pop({a}) filter (where {b} is not null) as sa,"
        f" stddev_pop({b}) filter (where {a} is not null) as sb, corr({a}, {b}) as r from {t} group by 1"
        for t, ds, i, a, _ in _slice_columns("if") for u, _, j, b, _ in _slice_columns("if") if t == u and i < j) + """) p
        where n >= 3 and sa > 1e-9 and sb > 1e-9 and abs(r) >= 0.95 and exists (select 1 from feat f where f.dataset = p.dataset and f.ordinal = p.i)
          and exists (select 1 from feat f where f.dataset = p.dataset and f.ordinal = p.j)""",
    "outl": """select distinct dataset, true as yes from (select dataset, ordinal from nlong join (
          select dataset, ordinal, quantile_disc(v, 0.25) as a, quantile_disc(v, 0.75) as b, count(*) as nn from nlong group by 1, 2) using (dataset, ordinal)
        where nn >= 10 and a <> b group by dataset, ordinal having 100.0*sum(case when v < a-3*(b-a) or v > b+3*(b-a) then 1 else 0 end)/count(*) >= 5)""",
    "skew": """select distinct dataset, true as yes from (select dataset, ordinal, avg(power(v-mu,3))/nullif(power(avg(power(v-mu,2)),1.5),0) as s
        from (select *, avg(v) over (partition by dataset, ordinal) as mu from nlong) group by 1, 2) where abs(s) > 2 and abs(s) <= 50""",
    "traits": """select dataset, rows as n_rows, columns as n_cols, coalesce(imb.yes,false) as has_imbalance, coalesce(mc.yes,false) as has_multicollinearity,
        coalesce(outl.yes,false) as has_outliers, missing_percentage > 5 as has_missing, missing_percentage as missing_pct, rows > 50000 as is_large, rows < 500 as is_small,
        columns > 50 as is_high_dimensional, texts > coalesce(numbers,0) as has_categoricals, coalesce(skew.yes,false) as has_skewed
      from info join (select dataset, count(*) filter (where kind='t') as texts from counts group by 1) using (dataset)
        left join (select dataset, count(*) as numbers from feat group by 1) using (dataset) left join imb using (dataset) left join mc using (dataset)
        left join outl using (dataset) left join skew using (dataset)""",
    "mscore": book.CTE["mscore"].replace("select task_type", "select dataset, task_type", 1).replace("from models, traits, tasks where", "from models, traits join tasks using (dataset) where"),
    "mrank": book.CTE["mrank"].replace("over (order by", "over (partition by dataset order by"),
    "pick": book.CTE["pick"].replace("select ", "select dataset, ", 1) + " group by dataset",
}
_shares = ", ".join(f"round({c}_count*100.0::double/rows,2) as {c}_pct" for c in ("missing", "unique"))
query("catalogue_sliced_counts", lambda s, d: S(s, d).counts,
      f"select dataset, ordinal, name, rows, missing_count, unique_count, {_shares} from counts", own=SLICE_CTE)
query("catalogue_sliced_tasks", lambda s, d: S(s, d).tasks, "select dataset, task_type from tasks", own=SLICE_CTE)
query("catalogue_sliced_traits", lambda s, d: S(s, d).traits, "select * from traits", own=SLICE_CTE)
query("catalogue_sliced_models",
      lambda s, d: S(s, d).recommendation.select("dataset", "task_type", "primary_model", "confidence", joined("reasoning", "; "),
                                                 F.array_join(F.transform("alternatives", lambda a: a["model"]), ", ").alias("alternatives")),
      "select * from pick", own=SLICE_CTE)
query("catalogue_sliced_findings", lambda s, d: S(s, d).findings.select("dataset", "type", "severity", "column", "action_priority", "headline"))
query("catalogue_sliced_summary", lambda s, d: S(s, d).summary.join(S(s, d).health, "dataset"))
