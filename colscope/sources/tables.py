"""The given tables, and views derived from them that exercise the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.operators.longform import columns_of
from colscope.functions.numeric import as_double


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """IN8: NaN of float columns becomes null; every other value and type stays."""
    return df.withColumns({
        c.name: as_double(F.col(f"`{c.name}`"), c.dtype).cast(c.dtype)
        for c in columns_of(df) if c.family == "float"
    })


# Orders with the defects that real tables have: one (name, expression) per column. The
# expressions are plain SQL over k = order key, c = customer key, p = price.
DIRTY_COLUMNS = (
    ("order_id", "k"),
    ("cust_id", "c"),
    ("ordered_at", "o_orderdate"),
    ("amount", "case when k%40=0 then cast(-9999 as double) else p end"),
    ("income", "case when k%4=1 then null else p*cast(0.5 as double) end"),
    ("bonus", "case when k%5<3 then null else cast(c%100 as double) end"),
    ("amount_gross", "p*cast(1.1 as double)+(c%7)"),
    ("amount_near", "p+c*cast(161 as double)"),
    ("spike", "case when k=7 then cast(1000000000 as double) else cast(k%13 as double) end"),
    ("flat", "cast(1000+k%3 as double)"),
    ("heavy_tail", "case when k%19=0 then cast(5000 as double) else cast(c%10 as double) end"),
    ("hetero", "cast(c*(case when k%2=0 then 1 else 4 end)*((k*7919)%101-50) as double)"),
    ("ratio", "case when k%500=0 then cast('Infinity' as double)"
              " when k%500=1 then cast('NaN' as double) else p end"),
    ("const_flag", "cast(1 as double)"),
    ("code_txt", "case when k%10<4 then cast(c as varchar(20)) else concat('ERR',cast(c%9 as varchar(20))) end"),
    ("priority", "case when k%50=0 then concat(' ',o_orderpriority)"
                 " when k%33=0 then 'N/A' else o_orderpriority end"),
    ("status_code", "o_orderstatus"),
    ("memo", "concat('note ',cast(k as varchar(20)))"),
    ("final_actual", "p*cast(0.001 as double)"),
    ("churn", "cast(case when k%11=0 then 1 else 0 end as int)"),
)
# Orders whose overall trend reverses inside every status group.
REVERSAL_COLUMNS = (
    ("x", "cast(c%100 + 200*(ascii(o_orderstatus)%7) as double)"),
    ("y", "cast(-(c%100) + 200*(ascii(o_orderstatus)%7) + k%20 as double)"),
    ("grp", "o_orderstatus"),
)


def _orders_view(orders: DataFrame, columns) -> DataFrame:
    base = orders.withColumns({
        "k": F.col("o_orderkey"), "c": F.col("o_custkey"), "p": F.col("o_totalprice")
    })
    return base.selectExpr(*[f"{expr} as {name}" for name, expr in columns])


def dirty_orders(orders: DataFrame) -> DataFrame:
    """Orders plus a second copy of the first keys, with planted quality problems."""
    return _orders_view(orders.unionAll(orders.where("o_orderkey < 100")), DIRTY_COLUMNS)


def reversal_orders(orders: DataFrame) -> DataFrame:
    return _orders_view(orders, REVERSAL_COLUMNS)


def spread_orders(orders: DataFrame) -> DataFrame:
    """Two neutral numeric columns whose residual spread grows with x."""
    return dirty_orders(orders).selectExpr("cast(cust_id as double) as x", "hetero")
