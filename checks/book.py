"""DuckDB SQL for the dirty-orders analysis, as named common table expressions.

Every expression recomputes its step from the raw `orders` table; `sql(name, select)` puts together
the ones a statement needs.
"""

from __future__ import annotations

import re

from colscope import constants as K
from colscope import texts as T
from colscope.functions.text import DMY_PATTERN, NUMBER_PATTERN, WHITESPACE, YMD_PATTERN
from colscope.schemas import ADVICE
from colscope.sources.tables import DIRTY_COLUMNS

DATASET = "dirty"
TYPES = {
    "order_id": "bigint", "cust_id": "bigint", "ordered_at": "timestamp_ntz", "code_txt": "string",
    "priority": "string", "status_code": "string", "memo": "string", "churn": "int",
}
FAMILY = {"bigint": "integer", "int": "integer", "double": "float", "string": "text", "timestamp_ntz": "temporal"}
COLUMNS = [(i, n, TYPES.get(n, "double")) for i, (n, _) in enumerate(DIRTY_COLUMNS)]
NUMERIC = [(i, n) for i, n, t in COLUMNS if FAMILY[t] in ("integer", "float")]
TEXT = [(i, n) for i, n, t in COLUMNS if t == "string"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({col}), {lit(w)})" for w in words) + ")"


def strip(col: str) -> str:
    return f"trim({col}, {lit(WHITESPACE)})"


def in_list(col: str, values) -> str:
    return f"{col} in ({', '.join(lit(v) if isinstance(v, str) else repr(v) for v in values)})"


def case_map(col: str, pairs, default="null") -> str:
    return f"case {col} " + " ".join(f"when {lit(a)} then {b}" for a, b in pairs) + f" else {default} end"


def bands(col: str, steps, default: str) -> str:
    return "case " + " ".join(f"when {col} >= {a} then {lit(b)}" for a, b in steps) + f" else {lit(default)} end"


def printf(fmt: str, cols) -> str:
    """The printf template as SQL; columns that may be null make the text 'null' as in Java."""
    return f"printf({lit(fmt)}, {', '.join(cols)})"


def seq(block: int, major="0", minor="0") -> str:
    return f"cast({block * 10**12} + ({major})*100000 + ({minor}) as bigint)"


def is_day(v: str, pattern: str, fmt: str) -> str:
    return (f"(regexp_matches({v}, {lit(pattern)}) and "
            f"try_strptime(replace(substr({v},1,10),'/','-'), '{fmt}') is not null)")


def looks_numeric(v: str) -> str:
    inner = f"replace({v}, ',', '')"
    return f"regexp_matches({strip(inner)}, {lit(NUMBER_PATTERN)})"


def nearest(q: float) -> str:
    return f"max(v) filter (where rk = cast(floor({q}*(nn-1)+0.5) as bigint))"


def ranked(source: str, where: str = "v is not null") -> str:
    return (f"select *, row_number() over (partition by ordinal order by v) - 1 as rk,"
            f" count(*) over (partition by ordinal) as nn from {source} where {where}")


def moments(source: str) -> str:
    return f"""
      with c as (select s.*, avg(case when isfinite(v) then v end) over (partition by ordinal) as mu from {source} s),
      g as (select ordinal, any_value(name) as name, count(*) as rows, count(v) as nn,
              coalesce(sum(case when isinf(v) then 1 else 0 end),0) as inf_count,
              avg(case when isfinite(v) then v end) as mean,
              sum(case when isfinite(v) then power(v-mu,2) end) as s2, count(case when isfinite(v) then 1 end) as fin,
              sum(case when isfinite(v) then power(v-mu,3) end) as s3, sum(case when isfinite(v) then power(v-mu,4) end) as s4,
              min(v) as mn, max(v) as mx, sum(case when v=0 then 1 else 0 end) as zeros,
              sum(case when v<0 then 1 else 0 end) as negatives from c group by ordinal)
      select ordinal, name, rows, nn, cast(inf_count as bigint) as inf_count, mn, mx, zeros, negatives,
        case when inf_count=0 then mean end as mean,
        case when inf_count=0 and fin>1 then sqrt(s2/(fin-1)) end as std,
        case when inf_count=0 and s2>0 then (s3/fin)/power(s2/fin,1.5) end as skewness,
        case when inf_count=0 and s2>0 then (s4/fin)/power(s2/fin,2)-3 end as kurtosis
      from g"""


FINDING_NULLS = {
    "dataset": "varchar", "seq": "bigint", "type": "varchar", "severity": "varchar", "column": "varchar", "columns": "varchar[]",
    "var1": "varchar", "var2": "varchar", "correlation": "double", "percentage": "double", "majority_pct": "double",
    "skewness": "double", "count": "bigint", "unique_count": "bigint", "sentinel_values": "double[]", "message": "varchar",
}


def finding(source: str, where: str, **values) -> str:
    values.setdefault("dataset", lit(DATASET))
    cols = [f"cast({values.get(n, 'null')} as {t}) as \"{n}\"" for n, t in FINDING_NULLS.items()]
    return f"select {', '.join(cols)} from {source} where {where}"


def union(parts) -> str:
    return "\n union all \n".join(parts)


SENT = ", ".join(repr(v) for v in K.NUMERIC_SENTINELS)
NCOL = len(COLUMNS)

CTE: dict[str, str] = {}
CTE["base"] = ("select *, o_orderkey as k, o_custkey as c, o_totalprice as p from orders union all "
               "select *, o_orderkey as k, o_custkey as c, o_totalprice as p from orders where o_orderkey < 100")
CTE["dirty"] = "select " + ", ".join(f"{e} as {n}" for n, e in DIRTY_COLUMNS) + " from base"
CTE["d"] = "select row_number() over () as rid, * replace (" + ", ".join(
    f"case when isnan({n}) then null else {n} end as {n}" for i, n, t in COLUMNS if t == "double") + ") from dirty"
CTE["schema_"] = "select * from (values " + ", ".join(
    f"({i}, {lit(n)}, {lit(t)}, {lit(FAMILY[t])})" for i, n, t in COLUMNS) + ") t(ordinal, name, dtype, family)"
CTE["nlong"] = union(f"select rid, {i} as ordinal, {lit(n)} as name, cast({n} as double) as v from d" for i, n in NUMERIC)
CTE["tlong"] = union(f"select rid, {i} as ordinal, {lit(n)} as name, {n} as v from d" for i, n in TEXT)
CTE["hist"] = union(
    f"select {i} as ordinal, {lit(n)} as name,"
    f" cast({n if FAMILY[t] == 'integer' else 'null'} as bigint) as value_int,"
    f" cast({n if FAMILY[t] == 'float' else 'null'} as double) as value_dbl,"
    f" cast({n if FAMILY[t] not in ('integer', 'float') else 'null'} as varchar) as value_str,"
    f" count(*) as cnt from d group by {n}"
    for i, n, t in COLUMNS)
CTE["counts"] = union(
    f"select {i} as ordinal, {lit(n)} as name, count(*) as rows, count(*)-count({n}) as missing_count,"
    f" count(distinct {n}) as unique_count, round((count(*)-count({n}))*100.0::double/count(*),2) as missing_pct,"
    f" round(count(distinct {n})*100.0::double/count(*),2) as unique_pct from d"
    for i, n, t in COLUMNS)
CTE["info"] = ("select max(rows) as rows, count(*) as columns, cast(sum(missing_count) as bigint) as missing_cells,"
               " round(cast(sum(missing_count) as double)/(max(rows)*count(*))*100,2) as missing_percentage from counts")
_names = ", ".join(n for _, n, _ in COLUMNS)
CTE["dups"] = (f"select cast(coalesce(sum(n),0) as bigint) as duplicate_rows from"
               f" (select count(*) as n from d group by {_names}) where n > 1")
CTE["mom"] = moments("nlong")
CTE["nrank"] = ranked("nlong")
CTE["ostat"] = (f"select ordinal, any_value(name) as name, any_value(nn) as nn, {nearest(0.01)} as q01, {nearest(0.25)} as q25,"
                f" {nearest(0.75)} as q75, {nearest(0.99)} as q99,"
                " (max(v) filter (where rk = (nn-1)//2) + max(v) filter (where rk = nn//2))/2 as median from nrank group by ordinal")
CTE["text"] = f"""
  select ordinal, any_value(name) as name, count(v) as nn, round(avg(length(v)),4) as avg_length,
    cast(count(*) filter (where {strip('v')} <> v) as bigint) as whitespace_issues,
    cast(count(*) filter (where {in_list(f"lower({strip('v')})", K.DISGUISED_MISSING)}) as bigint) as disguised_missing,
    cast(count(*) filter (where {looks_numeric('v')}) as bigint) as numeric_like,
    cast(count(*) filter (where {is_day('v', YMD_PATTERN, '%Y-%m-%d')}) as bigint) as ymd,
    cast(count(*) filter (where {is_day('v', DMY_PATTERN, '%d-%m-%Y')}) as bigint) as dmy
  from tlong group by ordinal"""
CTE["text2"] = ("select *, nn > 0 and numeric_like/cast(nn as double) > 0.1 and numeric_like/cast(nn as double) < 0.9 as mixed_type,"
                " nn > 0 and (ymd = nn or dmy = nn) as is_datetime from text")
CTE["tops"] = """
  select *, cast(row_number() over (partition by ordinal order by cnt desc, value_str nulls first) as integer) as rank
  from hist where ordinal in (%s) qualify row_number() over (partition by ordinal order by cnt desc, value_str nulls first) <= 5
""" % ", ".join(str(i) for i, _ in TEXT)
CTE["ids"] = (f"select c.ordinal, c.name, {any_of('c.name', K.ID_KEYWORDS)} or"
              " (rows-missing_count > 0 and unique_count = rows-missing_count) as is_id from counts c")
CTE["kinds"] = """
  select s.ordinal, s.name, s.dtype, case when family='boolean' then 'boolean' when family='temporal' then 'datetime'
    when family in ('integer','float') and unique_count <= 10 and unique_count/cast(rows as double) < 0.05 then 'numeric_categorical'
    when family in ('integer','float') then 'numeric' when family <> 'text' then 'unknown'
    when mixed_type then 'mixed_type' when unique_count <= 20 then 'categorical_low'
    when unique_count/cast(rows as double) > 0.9 then 'high_cardinality' else 'categorical' end as kind
  from schema_ s join counts c using (ordinal) left join text2 t using (ordinal)"""
CTE["structure"] = """
  select case when len(dt) > 0 then 'time-series' when len(idc) >= 2 then 'panel' else 'cross-sectional' end as type, dt, idc
  from (select coalesce(list(s.name order by s.ordinal) filter (where family='temporal' or coalesce(is_datetime,false)), []) as dt,
          coalesce(list(s.name order by s.ordinal) filter (where is_id), []) as idc
        from schema_ s join ids using (ordinal) left join text2 using (ordinal))"""

# ------------------------------------------------------------ sentinels, quality
CTE["oth"] = ranked("nlong", f"v is not null and v not in ({SENT})")
CTE["othq"] = (f"select ordinal, any_value(nn) as other, {nearest(0.01)} as p1, {nearest(0.99)} as p99 from oth group by ordinal")
CTE["cand"] = f"""
  select n.ordinal, any_value(n.name) as name, n.v as cand, count(*) as cnt, any_value(m.nn) as nn
  from nlong n join mom m on n.ordinal=m.ordinal join othq q on q.ordinal=n.ordinal
  where n.v in ({SENT}) and m.nn >= 10 and q.other >= 5 and (n.v < q.p1 or n.v > q.p99)
  group by n.ordinal, n.v having count(*)*100.0::double/any_value(m.nn) >= {K.SENTINEL_MIN_PCT}"""
CTE["sent"] = ("select ordinal, any_value(name) as name, any_value(nn) as nn, list(cand order by cand) as vals,"
               " list(cnt order by cand) as cnts from cand group by ordinal")
_p = "(missing_count*100.0::double/rows)"
_dp = "(disguised_missing*100.0::double/rows)"
_up = "(duplicate_rows*100.0::double/rows)"
QUALITY = {
    "qi1": finding("counts", f"{_p} >= 50", seq=seq(1, "ordinal"), type="'high_missingness'", severity="'high'",
                   column="name", percentage=f"round({_p},1)", message=f"printf('Column \"%s\" is %.1f%% empty.', name, {_p})"),
    "qi2": finding("counts", f"{_p} >= 20 and {_p} < 50", seq=seq(1, "ordinal"), type="'moderate_missingness'",
                   severity="'medium'", column="name", percentage=f"round({_p},1)",
                   message=f"printf('Column \"%s\" is %.1f%% empty.', name, {_p})"),
    "qi3": finding("counts", "unique_count <= 1", seq=seq(1, "ordinal", "1"), type="'constant_column'", severity="'high'",
                   column="name", message="printf('Column \"%s\" has a single value.', name)"),
    "qi4": finding("sent", "true", seq=seq(2, "ordinal"), type="'numeric_sentinel_values'", severity="'high'", column="name",
                   sentinel_values="vals", message="printf('Column \"%s\" contains placeholder values: %s.', name,"
                   " array_to_string(list_transform(vals, lambda x: printf('%.0f', x)), ', '))"),
    "qi5": finding("counts join schema_ s using (ordinal)", "family='text' and unique_count/cast(rows as double) > 0.9 and unique_count > 100",
                   seq=seq(3, "ordinal"), type="'high_cardinality'", severity="'medium'", column="s.name",
                   unique_count="unique_count", message="printf('Column \"%s\" has %d different texts.', s.name, unique_count)"),
    "qi6": finding("text2", "mixed_type", seq=seq(3, "ordinal", "1"), type="'mixed_types'", severity="'high'", column="name",
                   message="printf('Column \"%s\" mixes numbers and words.', name)"),
    "qi7": finding("text2 join (select ordinal, rows from counts) using (ordinal)", "disguised_missing > 0",
                   seq=seq(3, "ordinal", "2"), type="'disguised_missing'",
                   severity=f"case when {_dp} < 5 then 'medium' else 'high' end", column="name", count="disguised_missing",
                   percentage=f"round({_dp},1)", message="printf('Column \"%s\" has %d hidden nulls.', name, disguised_missing)"),
    "qi8": finding("text2", "whitespace_issues > 0", seq=seq(3, "ordinal", "3"), type="'whitespace_issues'", severity="'low'",
                   column="name", count="whitespace_issues",
                   message="printf('Column \"%s\" has %d padded values.', name, whitespace_issues)"),
    "qi9": finding("dups, info", "duplicate_rows > 0", seq=seq(4), type="'duplicate_rows'",
                   severity=f"case when {_up} < 5 then 'medium' else 'high' end", count="duplicate_rows",
                   percentage=f"round({_up},1)",
                   message=f"printf('%d rows have an identical copy (%.1f%%).', duplicate_rows, {_up})"),
    "qi10": finding("mom", "inf_count > 0", seq=seq(5, "ordinal"), type="'infinite_values'", severity="'high'", column="name",
                    count="inf_count", message="printf('Column \"%s\" has %d infinite values.', name, inf_count)"),
}
CTE.update(QUALITY)
CTE["quality"] = union(f"select * from {k}" for k in QUALITY)

# ------------------------------------------------------------ targets
_nu = "unique_count"
CTE["scores"] = f"""
  select *, case when named then 3 else 0 end + case when lst then 1 else 0 end
    + case when num and {_nu}=2 then 2 else 0 end + case when num and {_nu}<>2 and {_nu}<=10 then 1 else 0 end
    + case when family='text' and {_nu}<=10 then 2 else 0 end as score,
    case when {_nu}<=10 then 'classification' else 'regression' end as task_type,
    array_to_string(list_filter([case when named then 'named like a target' end,
      case when lst then 'stands last' end, case when num and {_nu}=2 then 'two numbers' end,
      case when num and {_nu}<>2 and {_nu}<=10 then 'few numbers' end,
      case when family='text' and {_nu}<=10 then 'few texts' end], lambda x: x is not null), ', ') as reasons
  from (select s.ordinal, s.name, family, {_nu}, {any_of('s.name', K.TARGET_KEYWORDS)} as named,
          s.ordinal = {NCOL - 1} as lst, family in ('integer','float') as num
        from schema_ s join counts c using (ordinal))"""
CTE["ratios"] = ("select ordinal, round(max(cnt)/cast(min(cnt) as double),2) as imbalance_ratio, count(*) as buckets,"
                 " max(cnt)/cast(sum(cnt) as double) as top_share from hist group by ordinal")
CTE["targets"] = """
  select cast(row_number() over (order by score desc, s.ordinal) as integer) as rank, s.ordinal, s.name as "column", score, task_type,
    unique_count as n_classes, case when task_type='classification' then imbalance_ratio end as imbalance_ratio, reasons
  from scores s join ratios using (ordinal) where score >= 2
  qualify row_number() over (order by score desc, s.ordinal) <= 3"""
CTE["dist"] = """
  select ordinal, name, coalesce(value_str,'None') as value, cnt,
    round(cnt*100.0::double/rows,2) as pct,
    case when cnt = max(cnt) over w and count(*) over w >= 2 and cnt*1.0::double/rows > 0.7 then 'critical'
         when cnt = max(cnt) over w and count(*) over w >= 2 and cnt*1.0::double/rows > 0.5 then 'high'
         else 'normal' end as flag
  from tops join (select ordinal, rows from counts) using (ordinal) window w as (partition by ordinal)"""

# ------------------------------------------------------------ statistics on scrubbed features
CTE["feat"] = ("select s.ordinal, s.name, case when family='text' then 'text' else 'numeric' end as role from schema_ s"
               " join ids using (ordinal) where family='text' or (family in ('integer','float') and not is_id)")
CTE["clong"] = """
  select n.rid, n.ordinal, n.name, case when c.cand is null then n.v end as v
  from nlong n join feat f on f.ordinal=n.ordinal left join cand c on c.ordinal=n.ordinal and c.cand=n.v"""
CTE["cmom"] = moments("clong")
CTE["crank"] = ranked("clong")
CTE["cstat"] = (f"select ordinal, any_value(name) as name, any_value(nn) as nn, {nearest(0.01)} as q01, {nearest(0.25)} as q25,"
                f" {nearest(0.75)} as q75, {nearest(0.99)} as q99 from crank group by ordinal")
CTE["pairs"] = """
  select i, j, col_a, col_b, n, case when n >= 3 and not infs and sx > 0 and sy > 0 then r end as r from (
    select a.ordinal as i, b.ordinal as j, any_value(a.name) as col_a, any_value(b.name) as col_b, count(*) as n,
      bool_or(isinf(a.v) or isinf(b.v)) as infs, max(a.v) - min(a.v) as sx, max(b.v) - min(b.v) as sy,
      covar_pop(case when isfinite(a.v) then a.v - coalesce(ma.mean,0) end, case when isfinite(b.v) then b.v - coalesce(mb.mean,0) end)
        / nullif(stddev_pop(case when isfinite(a.v) then a.v - coalesce(ma.mean,0) end)
                 * stddev_pop(case when isfinite(b.v) then b.v - coalesce(mb.mean,0) end), 0) as r
    from clong a join clong b on a.rid=b.rid and a.ordinal < b.ordinal
      join cmom ma on ma.ordinal=a.ordinal join cmom mb on mb.ordinal=b.ordinal
    where a.v is not null and b.v is not null group by a.ordinal, b.ordinal)"""
# every ordered pair of features: the line over all rows, then its residuals on each side of the median of x
CTE["cmed"] = "select ordinal, quantile_cont(v, 0.5) as med from clong where v is not null group by ordinal"
CTE["xyrows"] = """
  select a.ordinal as i, b.ordinal as j, a.name as x, b.name as y, a.v - coalesce(ma.mean,0) as vx, b.v - coalesce(mb.mean,0) as vy,
    isinf(a.v) or isinf(b.v) as infs, a.v >= m.med as hi
  from clong a join clong b on a.rid=b.rid and a.ordinal <> b.ordinal join cmom ma on ma.ordinal=a.ordinal
    join cmom mb on mb.ordinal=b.ordinal join cmed m on m.ordinal=a.ordinal where a.v is not null and b.v is not null"""
CTE["xyfit"] = """
  select i, j, count(*) as n, bool_or(infs) as infs, max(vx) - min(vx) as sx,
    regr_slope(vy, vx) filter (where not infs) as slope, var_pop(vy) filter (where not infs) as total from xyrows group by i, j"""
CTE["spreads"] = """
  select i, j, x, y, n, n_low, n_high,
    case when n >= 30 and not infs and sx > 0 and n_low > 0 and n_high > 0 and greatest(vh, vl) > 1e-10 * total then vh/(vl+1e-10) end as ratio
  from (select r.i, r.j, any_value(x) as x, any_value(y) as y, any_value(f.n) as n, any_value(f.infs) as infs, any_value(sx) as sx,
      any_value(total) as total, count(*) filter (where not hi) as n_low, count(*) filter (where hi) as n_high,
      var_pop(vy - slope*vx) filter (where hi and not r.infs) as vh, var_pop(vy - slope*vx) filter (where not hi and not r.infs) as vl
    from xyrows r join xyfit f on f.i=r.i and f.j=r.j group by r.i, r.j)"""
# every pair inside every group of the text columns of 2 to 10 values
CTE["groupings"] = ("select c.ordinal, s.name, unique_count as ng from counts c join schema_ s on s.ordinal=c.ordinal"
                    " where family='text' and unique_count between 2 and 10")
CTE["reversals"] = """
  select i, j, k, a, b, g."by", grp, n, r as group_r, (select any_value(p.r) from pairs p where p.i=g.i and p.j=g.j) as overall_r, ng from (
    select x.ordinal as i, y.ordinal as j, t.ordinal as k, any_value(x.name) as a, any_value(y.name) as b, any_value(t.name) as "by",
      t.v as grp, any_value(ng) as ng, count(*) as n,
      case when count(*) >= 3 and not bool_or(isinf(x.v) or isinf(y.v)) and max(x.v) > min(x.v) and max(y.v) > min(y.v) then
        corr(case when isfinite(x.v) then x.v - coalesce(mx.mean,0) end, case when isfinite(y.v) then y.v - coalesce(my.mean,0) end) end as r
    from clong x join clong y on x.rid=y.rid and x.ordinal < y.ordinal join tlong t on t.rid=x.rid join groupings u on u.ordinal=t.ordinal
      join cmom mx on mx.ordinal=x.ordinal join cmom my on my.ordinal=y.ordinal
    where x.v is not null and y.v is not null and t.v is not null group by x.ordinal, y.ordinal, t.ordinal, t.v) g"""
CTE["corr"] = f"""
  select cast(row_number() over (order by abs(round(r,3)) desc, i, j) as integer) as rank, col_a, col_b,
    round(r,3)+0.0::double as correlation, {bands('abs(r)', K.STRENGTH_LABELS, 'negligible')} as strength, n
  from pairs where r is not null qualify row_number() over (order by abs(round(r,3)) desc, i, j) <= 20"""
CTE["allcorr"] = CTE["corr"][: CTE["corr"].index(" qualify ")]
CTE["outl"] = """
  select c.ordinal, any_value(c.name) as name, count(*) as nn,
    cast(count(*) filter (where v < q25-1.5*(q75-q25) or v > q75+1.5*(q75-q25)) as bigint) as mild,
    cast(count(*) filter (where v < q25-3*(q75-q25) or v > q75+3*(q75-q25)) as bigint) as extreme
  from clong c join cstat s on s.ordinal=c.ordinal where v is not null and s.nn >= 10 and q75-q25 <> 0 group by c.ordinal"""
CTE["outsum"] = ('select ordinal, name as "column", mild as outlier_count, round(mild*100.0::double/nn,2) as outlier_pct from outl'
                 " where mild > 0 and ordinal in (select ordinal from feat where role='numeric')")
_s = "skewness"
CTE["shapes"] = f"""
  select ordinal, name as "column", round(skewness,3)+0.0::double as skewness, round(kurtosis,3)+0.0::double as kurtosis,
    case when abs({_s}) > {K.EXTREME_SKEW} then 'critically skewed' when {_s} > 2 then 'heavily right-skewed'
      when {_s} > 0.5 then 'right-skewed' when {_s} < -2 then 'heavily left-skewed' when {_s} < -0.5 then 'left-skewed'
      else 'roughly normal' end as shape
  from cmom where nn >= 10 and ordinal in (select ordinal from feat where role='numeric')"""
CTE["patterns"] = f"""
  select nnum > 0 as has_numeric_features, columns > 50 as high_dimensional, rows > 100000 as large_dataset,
    rows < 500 as small_dataset, ntext > nnum as many_categoricals, sk as skewed_columns, len(sk) > 0 as has_skewed_features,
    ex as extremely_skewed_columns, len(ex) > 0 as has_extreme_skewness
  from info, (select count(*) filter (where family='text') as ntext from schema_),
    (select count(*) as nnum, coalesce(list(name order by ordinal) filter (where abs(skewness) > 2 and abs(skewness) <= {K.EXTREME_SKEW}), []) as sk,
       coalesce(list(name order by ordinal) filter (where abs(skewness) > {K.EXTREME_SKEW}), []) as ex from cmom)"""
RED = {
    "st13": finding("(select t.\"column\" as col, top_share from targets t join ratios using (ordinal) where rank=1 and n_classes <= 20)",
                    "top_share >= 0.85", seq=seq(6), type="'class_imbalance'", severity="'critical'", column="col",
                    majority_pct="round(top_share*100,1)",
                    message="printf('%.1f%% of the rows of target \"%s\" belong to one class.', top_share*100, col)"),
    "st14": finding("(select i, j, k, a, b, \"by\" as g, count(*) filter (where n >= 10 and sign(group_r) <> sign(overall_r) and abs(group_r) > 0.2) as rev"
                    " from reversals group by all)", "rev >= 2", seq=f"cast({7 * 10**12} + (k*10000 + i)*10000 + j as bigint)",
                    type="'simpsons_paradox'", severity="'critical'", columns="[a, b, g]", count="rev",
                    message="printf('\"%s\" against \"%s\" reverses inside %d groups of \"%s\".', a, b, rev, g)"),
    "st15": finding("schema_ s, (select \"column\" as target from targets where rank=1)",
                    f"s.name <> target and {any_of('s.name', K.LEAKAGE_KEYWORDS)}", seq=seq(8, "ordinal"),
                    type="'data_leakage_risk'", severity="'critical'", column="s.name",
                    message="printf('The name \"%s\" suggests it may reveal the target \"%s\".', s.name, target)"),
}
CTE.update(RED)
CTE["redflags"] = union(f"select * from {k}" for k in RED)
_o = "(extreme*100.0::double/nn)"
WARN = {
    "st6": finding("pairs", "abs(r) >= 0.95", seq=seq(9, "i", "j"), type="'multicollinearity'", severity="'high'", var1="col_a",
                   var2="col_b", correlation="round(abs(r),3)",
                   message="printf('\"%s\" and \"%s\" are almost the same (|r| = %.2f).', col_a, col_b, abs(r))"),
    "st7": finding("pairs", "abs(r) >= 0.85 and abs(r) < 0.95", seq=seq(9, "i", "j"), type="'high_correlation'",
                   severity="'medium'", var1="col_a", var2="col_b", correlation="round(abs(r),3)",
                   message="printf('\"%s\" and \"%s\" move together (|r| = %.2f).', col_a, col_b, abs(r))"),
    "st8": finding("outl", f"{_o} >= 5", seq=seq(10, "ordinal"), type="'high_outliers'", severity="'medium'", column="name",
                   percentage=f"round({_o},1)", message=f"printf('%.1f%% of \"%s\" are extreme outliers.', {_o}, name)"),
    "st10": finding("spreads", "n_low >= 5 and n_high >= 5 and (ratio > 4 or ratio < 0.25)", seq=seq(11, "i", "j"), type="'heteroscedasticity'",
                    severity="'high'", columns="[x, y]",
                    message="printf('The spread of \"%s\" around its trend changes along \"%s\".', y, x)"),
    "st11": finding("cmom m join (select ordinal, unique_count as nu from counts) u using (ordinal)",
                    "nn >= 10 and std/(abs(mean)+1e-10) < 0.01 and nu > 1", seq=seq(12, "ordinal"),
                    type="'near_zero_variance'", severity="'medium'", column="name",
                    message="printf('Column \"%s\" barely varies.', name)"),
    "st12": finding("cmom m join (select ordinal, q01, q99 from cstat) q using (ordinal)",
                    f"nn >= 10 and abs(skewness) >= {K.EXTREME_SKEW}", seq=seq(13, "ordinal"), type="'extreme_skewness'",
                    severity="'high'", column="name", skewness="round(skewness,2)",
                    message="printf('\"%s\" is skewed to the %s (%.1f): %.1f against a usual range of %.1f to %.1f.', name,"
                            " case when skewness > 0 then 'right' else 'left' end, skewness,"
                            " case when skewness > 0 then mx else mn end, q01, q99)"),
}
CTE.update(WARN)
CTE["warnings"] = union(f"select * from {k}" for k in WARN)
CTE["findings"] = "select * from quality union all select * from redflags union all select * from warnings"

# ------------------------------------------------------------ recommendation
CTE["tasks"] = "select coalesce((select task_type from targets where rank=1), 'classification') as task_type"
CTE["traits"] = """
  select rows as n_rows, columns as n_cols, coalesce(imb,false) as has_imbalance, coalesce(mc,false) as has_multicollinearity,
    coalesce(outf,false) as has_outliers, missing_percentage > 5 as has_missing, missing_percentage as missing_pct,
    rows > 50000 as is_large, rows < 500 as is_small, columns > 50 as is_high_dimensional,
    many_categoricals as has_categoricals, has_skewed_features as has_skewed
  from info, patterns, (select bool_or(type='class_imbalance') as imb, bool_or(type='multicollinearity') as mc,
    bool_or(type='high_outliers') as outf from (select type from redflags union all select type from warnings))"""
CTE["models"] = "select * from (values " + ", ".join(
    f"({lit(t)}, {no}, {lit(n)}, {', '.join(str(bool(f)).lower() for f in fl)})" for t, no, n, fl in K.MODELS
) + ") m(task, rule_no, model, f_miss, f_imb, f_out, f_cat, f_small, f_large, f_int)"
_clean = "not (has_missing or has_imbalance or is_large or has_categoricals)"
CTE["mscore"] = f"""
  select task_type, cast(rule_no as integer) as rule_no, model, round(least(10.0::double, 5.0::double
     + case when has_missing then case when f_miss then 2.0::double else -1.5::double end else 0 end
     + case when has_imbalance and f_imb then 2 else 0 end
     + case when has_outliers then case when f_out then 1 else -1 end else 0 end
     + case when has_categoricals and f_cat then 1 else 0 end
     + case when is_large then case when f_large then 1.5::double else -2.5::double end else 0 end
     + case when is_large and contains(model,'LightGBM') then 0.5::double else 0 end
     + case when is_small and f_small then 0.5::double when not is_small and not f_small and not is_large then -0.5::double else 0 end
     + case when has_multicollinearity and model in ('Ridge Regression','Lasso Regression') then 1 else 0 end
     + case when is_high_dimensional and model='Lasso Regression' then 1 else 0 end
     + case when {_clean} and model in ('Logistic Regression','Ridge Regression') then 0.5::double else 0 end
     + case when f_small and f_large and not f_miss and not f_imb then -0.4::double else 0 end), 4) as score,
     array_to_string(list_filter([
       case when has_missing and f_miss then printf('takes the %.0f%% missing values as they are', missing_pct) end,
       case when has_imbalance and f_imb then 'can weight imbalanced classes' end,
       case when has_outliers and f_out then 'robust against the outliers found' end,
       case when has_categoricals and f_cat then 'takes categories without encoding' end,
       case when is_large and f_large then 'scales to this many rows' end,
       case when is_large and contains(model,'LightGBM') then 'histograms keep memory low at scale' end,
       case when has_multicollinearity and model in ('Ridge Regression','Lasso Regression') then 'regularisation copes with the collinear columns' end,
       case when is_high_dimensional and model='Lasso Regression' then 'selects among the many columns' end,
       case when {_clean} and model in ('Logistic Regression','Ridge Regression') then 'clean data favours a fast, explainable baseline' end
     ], lambda x: x is not null), '; ') as r0
  from models, traits, tasks where task = task_type"""
CTE["mrank"] = ("select *, case when r0 = '' then 'solid all-round choice' else r0 end as reasons,"
                " row_number() over (order by score desc, rule_no) as rk from mscore")
CTE["pick"] = ("select max(case when rk=1 then task_type end) as task_type, max(case when rk=1 then model end) as primary_model,"
               " max(case when rk=1 then round(score/10,2) end) as confidence, max(case when rk=1 then reasons end) as reasoning,"
               " string_agg(case when rk in (2,3) then model end, ', ' order by rk) as alternatives from mrank")

# ------------------------------------------------------------ findings processing
_w = f"({case_map('type', K.TYPE_WEIGHTS, '1')}) * ({case_map('severity', K.SEVERITY_WEIGHTS, '1')})"
CTE["frank"] = f"select *, {_w} as weight, row_number() over (partition by dataset order by {_w} desc, seq) as pos from findings"
CTE["fgrp"] = ("select *, count(*) over (partition by dataset, type) as n, min(pos) over (partition by dataset, type) as fp"
               " from frank")
_first = lambda c: f'min_by("{c}", pos)'
_sorted = "list_sort(list_distinct(flatten(list([var1, var2]))))"
_q = lambda names, k: f"array_to_string(list_transform({names}[1:{k}], lambda x: '\"' || x || '\"'), ', ')"
_more = lambda names, k: f"case when len({names}) > {k} then printf(' and %d more', len({names}) - {k}) else '' end"


def merged(where: str, cols: str, severity: str, message: str) -> str:
    return f"""
      select dataset, type, {severity} as severity, printf('%d columns', len(cols)) as "column", cols as columns, n as "count", true as aggregated,
        {message} as message, fp, fp as pos, cast(null as double) as percentage, cast(null as double) as correlation,
        cast(null as varchar) as var1, cast(null as varchar) as var2, cast(null as double) as skewness,
        cast(null as double) as majority_pct, cast(null as double[]) as sentinel_values, pairtext
      from (select dataset, type, any_value(n) as n, min(pos) as fp, {_first('severity')} as first_severity, {cols} as cols,
              string_agg(var1 || '~' || var2 || '~' || printf('%.3f', correlation), '|' order by pos) as pairtext,
              list(case when type='high_outliers' then printf('%.1f%%', percentage) else printf('skew %.0f', skewness) end
                   order by -coalesce(case when type='high_outliers' then percentage else abs(skewness) end,0), pos) as shown
            from fgrp where n >= 3 and {where} group by dataset, type)"""


CTE["fgen_pairs"] = merged("type in ('high_correlation','multicollinearity')", _sorted,
                           "case when type='multicollinearity' then 'high' else first_severity end",
                           f"printf('%d column pairs carry the same information: ', n) || {_q('cols', 6)} || {_more('cols', 6)} || '.'")
CTE["fgen_ranked"] = merged(
    "type in ('high_outliers','extreme_skewness')",
    'list("column" order by -coalesce(case when type=\'high_outliers\' then percentage else abs(skewness) end,0), pos)',
    "case when type='high_outliers' then 'medium' else 'high' end",
    "printf('%d columns are affected: ', n) || array_to_string(list_transform(list_zip(cols[1:3], shown[1:3]),"
    " lambda x: '\"' || x[1] || '\" (' || x[2] || ')'), ', ') || " + _more("cols", 3) + " || '.'")
CTE["fgen_listed"] = merged("type in ('near_zero_variance','whitespace_issues','disguised_missing')", 'list("column" order by pos)',
                            "'medium'", f"printf('%d columns are affected: ', n) || {_q('cols', 5)} || {_more('cols', 5)} || '.'")
CTE["fgen_other"] = merged(
    "\"column\" is not null and type not in ('high_correlation','multicollinearity','high_outliers','extreme_skewness',"
    "'near_zero_variance','whitespace_issues','disguised_missing')",
    'list_sort(list_distinct(list("column")))', "first_severity",
    f"printf('%d findings of this kind in ', n) || {_q('cols', 6)} || {_more('cols', 6)} || '.'")
CTE["fsingle"] = """
  select dataset, type, severity, "column", columns, "count", false as aggregated, message, fp, pos, percentage, correlation, var1, var2,
    skewness, majority_pct, sentinel_values, cast(null as varchar) as pairtext from fgrp where n < 3"""
# Types without any column keep their first finding.
CTE["fbare"] = """
  select dataset, type, severity, "column", columns, "count", false as aggregated, message, fp, fp as pos, percentage, correlation,
    var1, var2, skewness, majority_pct, sentinel_values, cast(null as varchar) as pairtext
  from (select *, max("column") over (partition by dataset, type) as named from fgrp) where n >= 3 and named is null and pos = fp
    and type not in ('high_correlation','multicollinearity','high_outliers','extreme_skewness',
    'near_zero_variance','whitespace_issues','disguised_missing')"""
_merges = ("fsingle", "fgen_pairs", "fgen_ranked", "fgen_listed", "fgen_other", "fbare")
CTE["fagg"] = ("select *, cast(row_number() over (partition by dataset order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2"
               " else 3 end, fp, pos) as integer) as position from (" + union(f"select * from {m}" for m in _merges) + ")")
_fam = "case " + " ".join(
    f"when {' or '.join(f'contains(lower(primary_model), {lit(w)})' for w in words)} then {lit(fam)}" for fam, words in K.MODEL_FAMILIES
) + " else 'unknown' end"
_U = ", ".join(lit(t) for t in K.UNIVERSAL_TYPES)
_L = ", ".join(lit(t) for t in K.LINEAR_ONLY_TYPES)
_C = ", ".join(lit(t) for t in K.CONTEXTUAL_TYPES)
PRIORITY = f"""case when severity='critical' then 'must-fix'
  when type in ('constant_column','infinite_values','numeric_sentinel_values','mixed_types','disguised_missing','data_leakage_risk') then 'must-fix'
  when type in ({_L}) then case when family in ('tree','svm') then 'nice-to-have' when severity='high' then 'must-fix' else 'should-fix' end
  when type in ('high_outliers','high_correlation','extreme_skewness') then case when family='tree' then 'nice-to-have' else 'should-fix' end
  when type in ('high_missingness','moderate_missingness') then case when severity='high' then 'must-fix' else 'should-fix' end
  when type='high_cardinality' then case when family='tree' then 'should-fix' else 'must-fix' end
  when severity='high' then 'should-fix' else 'informational' end"""
CTE["fmodel"] = f"""
  select a.*, primary_model as model, {_fam} as family, columns[1] as col1, columns[2] as col2, columns[3] as col3,
    coalesce(len(columns),0) as n_columns, {_q('columns', 3)} as top3, {_q('columns', 5)} as top5,
    array_to_string(list_transform(sentinel_values[1:4], lambda x: printf('%.0f', x)), ', ') as sentinel_text
  from fagg a join picks using (dataset)"""
CTE["picks"] = f"select {lit(DATASET)} as dataset, primary_model from pick"


def _template_case(rows, extra="null") -> str:
    whens = []
    for kind, fam, grp, fmt, cols in rows:
        cond = f"type={lit(kind)}" + (f" and family={lit(fam)}" if fam else "") + ("" if grp is None else f" and aggregated={str(grp).lower()}")
        whens.append(f"when {cond} then {printf(fmt, [chr(34) + c + chr(34) for c in cols])}")
    return "case " + " ".join(whens) + f" else {extra} end"


_kept = f"(severity='critical' or type in ({_U}))"
_lin = f"(not {_kept} and type in ({_L}) and family in ('tree','svm'))"
_eased = f"(not {_kept} and type='high_outliers' and family='tree' and severity='medium')"
CTE["frel"] = f"""
  select * replace (case when lowered then 'medium' else severity end as severity) from (
   select *, {_lin} and severity='high' as lowered,
    case when {_lin} and severity='high' or {_eased} then severity end as original_severity,
    case when {_lin} then case when family='tree' then 'nice-to-have' else 'should-fix' end
         when {_eased} then 'nice-to-have' else {PRIORITY} end as action_priority,
    case when {_kept} or {_lin} or type in ({_C}) then {_template_case(T.NOTES)} end as model_context_note from fmodel)"""
_words = "replace(type,'_',' ')"
_title = f"array_to_string(list_transform(string_split({_words},' '), lambda w: upper(w[1]) || w[2:]), ' ')"
CTE["fhead"] = ("select *, case when aggregated then "
                + _template_case([(k, None, None, f, c) for k, f, c in T.GROUP_HEADLINES], f"printf('%d %s issues', \"count\", {_words})")
                + " else " + _template_case([(k, None, None, f, c) for k, f, c in T.HEADLINES], f"'Issue: ' || {_title}")
                + " end as headline from frel")
CTE["split"] = ("select dataset, count(*) filter (where severity='critical') as critical, count(*) filter (where severity='high') as high,"
                " count(*) filter (where severity='medium') as medium, count(*) filter (where severity='low') as low,"
                " count(*) as total from frel group by dataset")
_pts = ("greatest(0.0::double, 100.0::double - critical*20 - high*10 - least(missing_percentage*2, 30.0::double)"
        " - case when duplicate_rows > 0 then 10 else 0 end)")
CTE["health"] = f"select round({_pts},2) as points, {bands(_pts, T.HEALTH_LABELS, T.HEALTH_WORST)} as label from split, info, dups"


# ------------------------------------------------------------ a second findings source, several datasets
ORDER_TYPES = (
    # type, severity, with a column
    ("high_outliers", "medium", True), ("extreme_skewness", "high", True), ("near_zero_variance", "medium", True),
    ("whitespace_issues", "low", True), ("disguised_missing", "high", True), ("mixed_types", "high", True),
    ("duplicate_rows", "medium", False),
)
ORDER_MODELS = (("F", "Random Forest"), ("O", "Ridge Regression"), ("P", "Support Vector Machine"))
ORDER_GROUPS = ("select o_orderstatus as dataset, o_orderpriority as col, count(*) as n, cast(substr(o_orderpriority,1,1) as bigint) as k"
                " from orders group by all")
ORDER_FINDINGS = {
    "findings": union(
        finding(f"({ORDER_GROUPS})", "true", dataset="dataset", seq=f"{no}*1000 + k", type=lit(t), severity=lit(s),
                column="col" if named else "null", percentage="round(n/10.0::double,1)", skewness="n*1.0::double",
                count="n", message="'seen ' || n || ' times'")
        for no, (t, s, named) in enumerate(ORDER_TYPES)),
    "picks": "select * from (values " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in ORDER_MODELS) + ") t(dataset, primary_model)",
}


def _deps(text: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"'(?:[^']|'')*'", " ", text)))
    return [n for n in names if n in words]


def sql(select: str, replace: dict[str, str] | None = None, book: dict[str, str] | None = None) -> str:
    """WITH clause of everything the statement refers to, directly or not, then the statement; `book` stands in for CTE."""
    cte = (CTE if book is None else book) | (replace or {})
    need: set[str] = set()

    def visit(text: str, out: list[str]) -> None:
        for n in _deps(text, cte):
            if n not in need:
                need.add(n)
                visit(cte[n], out)
                out.append(n)

    order: list[str] = []
    visit(select, order)
    if not order:
        return select
    return "with " + ",\n".join(f"{n} as materialized ({cte[n]})" for n in order) + "\n" + select


assert set(ADVICE) >= {t for t, _ in K.TYPE_WEIGHTS}
