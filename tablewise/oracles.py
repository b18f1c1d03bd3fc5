"""DuckDB oracle SQL for the registered queries (independent re-statements of
each operator's semantics in plain SQL over the supplied tables)."""

from __future__ import annotations

from tablewise.sources.fixtures import with_fixtures

# Schema facts of the inputs the oracles profile: (name, spark dtype, role).
LINEITEM_COLS = [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
                 ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
                 ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
                 ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
                 ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
                 ("l_shipdate", "timestamp_ntz", "categorical")]
DIRTY_COLS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
              ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
              ("o_orderpriority", "string", "categorical"), ("price_text", "string", "categorical"),
              ("date_text", "string", "categorical")]
FEATURE_COLS = [("o_orderkey", "bigint", "numeric"), ("o_orderpriority", "string", "categorical"),
                ("o_orderstatus", "string", "categorical"), ("c_mktsegment", "string", "categorical"),
                ("c_acctbal", "double", "numeric"), ("o_totalprice", "double", "numeric"),
                ("n_lines", "bigint", "numeric"), ("sum_qty", "double", "numeric"),
                ("avg_disc", "double", "numeric"), ("returned", "int", "numeric")]
INTEGRAL = {"bigint", "int"}


def _profile_sql(table: str, cols) -> str:
    parts = []
    for i, (c, dt, role) in enumerate(cols):
        txt = f"cast({c} as varchar)"
        samples = (f"(select string_agg({txt}, ', ' order by {c}) from "
                   f"(select distinct {c} from {table} where {c} is not null order by {c} limit 3))")
        if role == "numeric":
            qs = f"(select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table})"
            fence = (f"(select case when (select count(distinct {c}) from {table}) > 5 then q1 end as q1, "
                     f"case when (select count(distinct {c}) from {table}) > 5 then q3 end as q3 from {qs})")
            outl = (f"(select cast(count_if({c} < b.q1 - 1.5*(b.q3-b.q1) or {c} > b.q3 + 1.5*(b.q3-b.q1)) as bigint) "
                    f"from {table}, {fence} b)")
            qcols = (f"round(b.q1, 6) as q1, round(b.q3, 6) as q3, round(b.q1 - 1.5*(b.q3-b.q1), 6) as lower_bound, "
                     f"round(b.q3 + 1.5*(b.q3-b.q1), 6) as upper_bound, coalesce({outl}, 0) as outlier_count")
            src = f"{fence} b"
        else:
            qcols = ("cast(null as double) as q1, cast(null as double) as q3, cast(null as double) as lower_bound, "
                     "cast(null as double) as upper_bound, cast(0 as bigint) as outlier_count")
            src = "(select 1) b"
        parts.append(
            f"select {i} as position, '{c}' as column, '{dt}' as dtype, '{role}' as role, "
            f"(select cast(count_if({c} is null) as bigint) from {table}) as missing_count, "
            f"(select round(100.0 * count_if({c} is null) / count(*), 6) from {table}) as missing_pct, "
            f"(select cast(count(distinct {c}) as bigint) from {table}) as unique_count, "
            f"{samples} as sample_values, {qcols} from {src}")
    return "\n union all \n".join(parts)


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str):
    ORACLES[name] = with_fixtures(sql) if ("dirty_orders" in sql or "order_features" in sql) else sql


oracle("profile_lineitem", _profile_sql("lineitem", LINEITEM_COLS))
oracle("profile_dirty_orders", _profile_sql("dirty_orders", DIRTY_COLS))
oracle("missing_table", """
select "column", dtype, role, target_rank, missing_count, missing_pct from (
""" + "\n union all \n".join(
    f"select '{c}' as column, '{dt}' as dtype, '{role}' as role, "
    + ("cast(2 as integer)" if "price" in c else "cast(null as integer)") + " as target_rank, "
    f"cast(count_if({c} is null) as bigint) as missing_count, "
    f"round(100.0 * count_if({c} is null) / count(*), 2) as missing_pct from dirty_orders"
    for c, dt, role in DIRTY_COLS) + ")")
oracle("duplicate_rows", """
select cast(sum(n) as bigint) as total_rows, cast(7 as bigint) as total_cols,
       cast(sum(n - 1) as bigint) as duplicate_rows
from (select count(*) as n from dirty_orders
      group by o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, price_text, date_text)
""")

# --- cleaning ----------------------------------------------------------------------
from tablewise.functions.exprs import NUMERIC_PATTERN  # noqa: E402

_ALL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, price_text, date_text"


def _num(expr: str) -> str:
    return f"case when regexp_matches({expr}, '{NUMERIC_PATTERN}') then cast(trim({expr}) as double) end"


def _all_but(col: str, expr: str) -> str:
    return ", ".join(expr if c.strip() == col else c.strip() for c in _ALL.split(","))


oracle("clean_dedupe", f"select distinct {_ALL} from dirty_orders")
oracle("clean_drop_nulls", f"select {_ALL} from dirty_orders where o_totalprice is not null")
oracle("impute_mean", f"""
select {_all_but('o_totalprice', 'round(coalesce(o_totalprice, (select avg(o_totalprice) from dirty_orders)), 4) as o_totalprice')}
from dirty_orders""")
oracle("impute_median", f"""
select {_all_but('o_totalprice', 'round(coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from dirty_orders)), 4) as o_totalprice')}
from dirty_orders""")
_MODE_STATUS = ("(select o_orderstatus from dirty_orders where o_orderstatus is not null "
                "group by o_orderstatus order by count(*) desc, o_orderstatus limit 1)")
oracle("impute_mode", f"""
select {_all_but('o_orderstatus', f'coalesce(o_orderstatus, {_MODE_STATUS}) as o_orderstatus')}
from dirty_orders""")
oracle("impute_constant", f"""
select {_all_but('o_orderstatus', "coalesce(o_orderstatus, 'Unknown') as o_orderstatus")} from dirty_orders""")
_FENCE = """(select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
  (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from dirty_orders))"""
oracle("cap_iqr", f"""
select {_all_but('o_totalprice', 'round(case when o_totalprice is null then null else least(greatest(o_totalprice, f.lo), f.hi) end, 4) as o_totalprice')}
from dirty_orders, {_FENCE} f""")
oracle("remove_outliers", f"""
select {_ALL} from dirty_orders, {_FENCE} f
where not coalesce(o_totalprice < f.lo or o_totalprice > f.hi, false)""")
oracle("convert_types", f"""
select o_orderkey,
  coalesce(cast(trunc({_num('price_text')}) as bigint), 0) as price_int,
  {_num('price_text')} as price_float,
  cast(try_strptime(date_text, '%Y-%m-%d') as varchar) as date_value,
  cast(o_custkey as varchar) as custkey_text,
  o_orderpriority as priority_category
from dirty_orders""")

_PLAN_CTE = f"""
d0 as (select distinct {_ALL} from dirty_orders),
st as (select (select o_orderstatus from d0 where o_orderstatus is not null group by 1
               order by count(*) desc, 1 limit 1) as mode_status,
              (select quantile_cont(o_totalprice, 0.5) from d0) as med_price),
d1 as (select o_orderkey, o_custkey, coalesce(o_orderstatus, st.mode_status) as o_orderstatus,
              coalesce(o_totalprice, st.med_price) as o_totalprice, o_orderpriority,
              {_num('price_text')} as price_text,
              try_strptime(date_text, '%Y-%m-%d') as date_text
       from d0, st),
f as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
      (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from d1)),
pm as (select avg(price_text) as mean_price from d1),
d2 as (select o_orderkey, o_custkey, o_orderstatus,
              least(greatest(o_totalprice, f.lo), f.hi) as o_totalprice, o_orderpriority,
              coalesce(price_text, pm.mean_price) as price_text, date_text
       from d1, f, pm)
"""
oracle("apply_plan", f"""
with {_PLAN_CTE}
select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice, o_orderpriority,
       round(price_text, 4) as price_text, cast(date_text as varchar) as date_text
from d2 where date_text is not null""")
oracle("cleaning_report", f"""
with {_PLAN_CTE}
select * from (
  select 0 as seq, cast(null as varchar) as "column", 'drop_duplicates' as action,
         cast((select count(*) from dirty_orders) - (select count(*) from d0) as bigint) as affected_rows,
         cast(null as double) as lower_bound, cast(null as double) as upper_bound
  union all select 1, 'price_text', 'convert_float', null, null, null
  union all select 2, 'date_text', 'convert_datetime', null, null, null
  union all select 3, 'o_orderstatus', 'impute_mode', (select cast(count_if(o_orderstatus is null) as bigint) from d0), null, null
  union all select 4, 'o_totalprice', 'impute_median', (select cast(count_if(o_totalprice is null) as bigint) from d0), null, null
  union all select 5, 'price_text', 'impute_mean', (select cast(count_if(price_text is null) as bigint) from d1), null, null
  union all select 6, 'o_totalprice', 'cap_iqr',
         (select cast(count_if(o_totalprice < f.lo or o_totalprice > f.hi) as bigint) from d1, f),
         (select round(lo, 4) from f), (select round(hi, 4) from f)
  union all select 7, 'date_text', 'drop', (select cast(count_if(date_text is null) as bigint) from d1), null, null
)""")

# --- EDA -----------------------------------------------------------------------------
_LI_NUM = [c for c, dt, role in LINEITEM_COLS if role == "numeric"]
oracle("describe_lineitem", "\n union all \n".join(
    f"""select cast({i} as integer) as position, '{c}' as "column", count({c}) as count,
    round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(cast(min({c}) as double), 6) as min,
    round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50,
    round(quantile_cont({c}, 0.75), 6) as q75, round(cast(max({c}) as double), 6) as max,
    round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis from lineitem"""
    for i, c in enumerate(_LI_NUM)))
oracle("skew_lineitem", "\n union all \n".join(
    f"""select '{c}' as "column", round(skewness({c}), 6) as skewness from lineitem""" for c in _LI_NUM))
_ORD_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
_VC = " union all ".join(f"select '{c}' as \"column\", cast({c} as varchar) as value from orders" for c in _ORD_CAT)
oracle("top_values_orders", f"""
select "column", rank, value, count from (
  select "column", value, count(*) as count,
         cast(row_number() over (partition by "column" order by count(*) desc, value asc nulls last) as integer) as rank
  from ({_VC}) group by "column", value) where rank <= 5""")
oracle("cardinality_orders", f"""
select "column", cast(count(distinct value) as bigint) as cardinality from ({_VC}) group by "column" """)
_pairs = [(i, j) for i in range(len(_LI_NUM)) for j in range(len(_LI_NUM))]
oracle("correlation_matrix", "\n union all \n".join(
    f"""select cast({i} as integer) as i, cast({j} as integer) as j, '{_LI_NUM[i]}' as feature_1,
    '{_LI_NUM[j]}' as feature_2, round(case when isnan(r) then null else r end, 6) as correlation
    from (select corr(cast({_LI_NUM[j]} as double), cast({_LI_NUM[i]} as double)) as r from lineitem)"""
    for i, j in _pairs))
_F_NUM = [c for c, dt, role in FEATURE_COLS if role == "numeric"]
_fpairs = [(i, j) for i in range(len(_F_NUM)) for j in range(i + 1, len(_F_NUM))]
_FCORR = " union all ".join(
    f"select {i} as i, {j} as j, '{_F_NUM[i]}' as feature_1, '{_F_NUM[j]}' as feature_2, "
    f"corr(cast({_F_NUM[j]} as double), cast({_F_NUM[i]} as double)) as r from order_features"
    for i, j in _fpairs)
oracle("top_correlations", f"""
select cast(row_number() over (order by abs(round(r, 4)) desc, i, j) as integer) as rank,
       feature_1, feature_2, round(r, 4) as correlation
from ({_FCORR}) where abs(r) >= 0.4 order by abs(round(r, 4)) desc, i, j limit 10""")
oracle("target_info_numeric", """
select 'o_totalprice' as name, 'double' as dtype, cast(count(distinct o_totalprice) as bigint) as unique_count,
       round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std from orders""")
oracle("target_info_categorical", """
select 'o_orderpriority' as name, 'string' as dtype,
       (select cast(count(distinct o_orderpriority) as bigint) from orders) as unique_count,
       list(v order by rn) as top_categories, list(n order by rn) as top_counts
from (select o_orderpriority as v, count(*) as n,
             row_number() over (order by count(*) desc, o_orderpriority) as rn
      from orders where o_orderpriority is not null group by 1) where rn <= 3""")
oracle("class_balance", """
select cast(o_orderstatus as varchar) as class, count(*) as count,
       round(count(*) / sum(count(*)) over (), 6) as share,
       round(max(count(*)) over () / min(count(*)) over (), 6) as imbalance_ratio
from orders where o_orderstatus is not null group by 1""")
_F_ALL = [c for c, dt, role in FEATURE_COLS]
_F_STATS = " union all ".join(
    f"select {k} as pos, '{c}' as col, '{role}' as role, count(distinct {c}) as nu, "
    + (f"skewness({c}) as g, kurtosis({c}) as k, min({c}) as mn " if role == "numeric" else
       "null::double as g, null::double as k, null::double as mn ")
    + "from order_features" for k, (c, dt, role) in enumerate(FEATURE_COLS))
oracle("distribution_labels", f"""
select col as "column", case when nu = 2 then 'Binary' when role = 'categorical' then 'Categorical'
  when g is null then 'Normal' when abs(g) < 0.5 and k < -1.0 then 'Uniform'
  when g > 0.5 then 'Skewed-Right' when g < -0.5 then 'Skewed-Left' else 'Normal' end as distribution
from ({_F_STATS})""")
_imb = """(select 'class_imbalance' as kind, 'returned' as "column", round(max(n) / sum(n), 4) as evidence
  from (select returned, count(*) as n from order_features where returned is not null group by 1)
  having max(n) / sum(n) >= 0.7)"""
oracle("key_findings", f"""
select 'high_correlation' as kind, feature_1 || ',' || feature_2 as "column", round(r, 4) as evidence
from ({_FCORR}) where abs(r) >= 0.7
union all
select 'skewed_distribution', col, round(g, 4) from ({_F_STATS}) where role = 'numeric' and abs(g) > 1
union all select * from {_imb}""")
_F_NT = [(k, c) for k, (c, dt, role) in enumerate(FEATURE_COLS) if role == "numeric" and c != "returned"]
_npairs = [(i, j) for i in range(len(_F_NT)) for j in range(i + 1, len(_F_NT))]
oracle("suggest_features", f"""
select case when g > 1 and mn >= 0 then col || '_log1p' when nu > 50 then col || '_bin' else col || '_z' end as feature,
       case when g > 1 and mn >= 0 then 'log1p' when nu > 50 then 'quantile_bin' else 'zscore' end as kind,
       col as source_1, cast(null as varchar) as source_2
from ({_F_STATS}) where role = 'numeric' and col <> 'returned' and (g > 1 and mn >= 0 or nu > 2)
union all
select a || '_per_' || b, 'ratio', a, b from (""" + " union all ".join(
    f"select '{_F_NT[i][1]}' as a, '{_F_NT[j][1]}' as b, corr(cast({_F_NT[j][1]} as double), cast({_F_NT[i][1]} as double)) as r from order_features"
    for i, j in _npairs) + ") where abs(r) >= 0.7")

# --- chart data ----------------------------------------------------------------------
_fall = [(i, j) for i in range(len(_F_NUM)) for j in range(len(_F_NUM))]
oracle("heatmap_features", "\n union all \n".join(
    f"""select cast({i} as integer) as i, cast({j} as integer) as j, '{_F_NUM[i]}' as feature_1,
    '{_F_NUM[j]}' as feature_2, round(case when isnan(r) then null else r end, 6) as correlation
    from (select corr(cast({_F_NUM[j]} as double), cast({_F_NUM[i]} as double)) as r from order_features)"""
    for i, j in _fall))
oracle("histogram_price", """
with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi,
                  (max(l_extendedprice) - min(l_extendedprice)) / 30 as w from lineitem),
b as (select cast(least(floor((l_extendedprice - r.lo) / r.w), 29) as integer) as bin, count(*) as c
      from lineitem, r where l_extendedprice is not null group by 1)
select cast(g.range as integer) as bin, round(r.lo + g.range * r.w, 6) as lower,
       round(r.lo + (g.range + 1) * r.w, 6) as upper, cast(coalesce(b.c, 0) as bigint) as count
from range(30) g, r left join b on b.bin = g.range""")
oracle("density_price", """
with s as (select count(o_totalprice) as n, stddev_samp(o_totalprice) as sd, min(o_totalprice) as lo,
                  max(o_totalprice) as hi from orders),
p as (select n, sd * pow(n, -1.0 / 5.0) as bw, lo from s, (select 1)),
g as (select n, bw, lo - 3.0 * bw as start, ((select hi from s) + 3.0 * bw - (lo - 3.0 * bw)) / 199 as step from p),
f as (select o_totalprice as v, count(*) as c from orders where o_totalprice is not null group by 1)
select cast(pt.range as integer) as point, round(g.start + pt.range * g.step, 4) as x,
       round(sum(f.c * exp(-pow((g.start + pt.range * g.step - f.v) / g.bw, 2) / 2)) / (g.n * g.bw * sqrt(2 * pi())), 14) as density
from range(200) pt, g, f group by pt.range, g.start, g.step, g.n, g.bw""")
oracle("box_by_flag", """
with qq as (select l_returnflag as grp, quantile_cont(l_extendedprice, 0.25) as q1,
                   quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.75) as q3
            from lineitem where l_extendedprice is not null and l_returnflag is not null group by 1),
fe as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from qq)
select grp as "group", round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
       round(lower_fence, 6) as lower_fence, round(upper_fence, 6) as upper_fence, count(*) as count,
       round(min(case when v between lower_fence and upper_fence then v end), 6) as whisker_low,
       round(max(case when v between lower_fence and upper_fence then v end), 6) as whisker_high,
       cast(count_if(not (v between lower_fence and upper_fence)) as bigint) as outliers
from fe join (select l_returnflag as g2, l_extendedprice as v from lineitem where l_extendedprice is not null) d
  on d.g2 = fe.grp
group by grp, q1, median, q3, lower_fence, upper_fence""")
oracle("box_outliers_events", """
with fe as (select event_type as grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
            from events where value is not null and event_type is not null group by 1)
select e.event_type as "group", e.value as value from events e join fe on e.event_type = fe.grp
where e.value < q1 - 1.5 * (q3 - q1) or e.value > q3 + 1.5 * (q3 - q1)""")
oracle("bar_priority", """
select o_orderpriority, count(*) as count from orders where o_orderpriority is not null group by 1""")
oracle("trendline", """
select round(regr_slope(l_extendedprice, l_quantity), 6) as slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
       cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem""")
oracle("strongest_pair", f"""
select feature_1, feature_2, round(r, 6) as correlation from ({_FCORR})
where r is not null and not isnan(r) order by abs(r) desc, i, j limit 1""")
oracle("scatter_points", """
select n_lines as x, sum_qty as y, o_orderpriority as color from order_features""")
oracle("chart_manifest", f"""
select * from (
  select 'correlation_heatmap' as name, 'heatmap' as type, cast(null as varchar) as x,
         cast(null as varchar) as y, cast(null as varchar) as "group"
  union all select 'distribution_o_orderkey', 'histogram', 'o_orderkey', null, null
  union all select 'boxplot_o_orderkey', 'boxplot', g, 'o_orderkey', g
     from (select case when count(distinct o_orderpriority) <= 10 then 'o_orderpriority' end as g from order_features)
  union all select * from (select 'scatterplot_' || feature_1 || '_' || feature_2, 'scatterplot', feature_1, feature_2,
     (select case when count(distinct o_orderpriority) <= 8 then 'o_orderpriority' end from order_features)
     from ({_FCORR}) where r is not null order by abs(r) desc, i, j limit 1))
union all select 'bar_o_orderpriority', 'bar', 'o_orderpriority', 'count', null""")

# --- ML preparation and metrics ------------------------------------------------------
oracle("label_encode", """
select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as double) as label
from orders where o_orderpriority is not null""")
_SC = ["c_acctbal", "o_totalprice", "sum_qty", "avg_disc"]
oracle("standard_scale", "with m as (select " + ", ".join(
    f"quantile_cont({c}, 0.5) as med_{c}" for c in _SC) + " from order_features), s as (select " + ", ".join(
    f"avg(coalesce({c}, med_{c})) as mu_{c}, stddev_pop(coalesce({c}, med_{c})) as sd_{c}" for c in _SC)
    + " from order_features, m) select o_orderkey, " + ", ".join(
    f"round((coalesce({c}, med_{c}) - mu_{c}) / case when sd_{c} = 0 then 1 else sd_{c} end, 6) as {c}" for c in _SC)
    + " from order_features, m, s")
oracle("one_hot", """
with cats as (select distinct c_mktsegment as v from order_features where c_mktsegment is not null)
select o.o_orderkey, 'c_mktsegment_' || cats.v as feature,
       cast(case when o.c_mktsegment = cats.v then 1.0 else 0.0 end as double) as value
from order_features o, cats""")
oracle("hash_split", """
select o_orderkey, case when ('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint % 100 < 80
                        then 'train' else 'test' end as split from orders""")
_FP = """(select returned as label, cast(n_lines > 4 as integer) as prediction, avg_disc as score
          from order_features)"""
oracle("classification_metrics", f"""
with conf as (select label as y, prediction as p, count(*) as n from {_FP} group by 1, 2),
cls as (select y as c from conf union select p from conf),
per as (select c, coalesce((select sum(n) from conf where y = c), 0) as support,
               coalesce((select sum(n) from conf where p = c), 0) as predicted,
               coalesce((select sum(n) from conf where y = c and p = c), 0) as tp from cls),
pr as (select *, case when predicted = 0 then 0.0 else tp / predicted end as prec,
              case when support = 0 then 0.0 else tp / support end as rec from per)
select round(sum(tp) / sum(support), 6) as accuracy,
       round(sum(prec * support) / sum(support), 6) as precision,
       round(sum(rec * support) / sum(support), 6) as recall,
       round(sum(case when prec + rec = 0 then 0.0 else 2 * prec * rec / (prec + rec) end * support)
             / sum(support), 6) as f1_score
from pr""")
_AUC = """select round(sum(pos * (coalesce(nb, 0) + neg * 0.5)) / (sum(pos) * sum(neg)), 6) as roc_auc
from (select *, sum(neg) over (order by score rows between unbounded preceding and 1 preceding) as nb
      from (select score, count_if(label = 1) as pos, count_if(label <> 1) as neg from {src}
            where score is not null and label is not null group by score))"""
oracle("roc_auc_binary", _AUC.format(src=_FP))
oracle("roc_auc_ovr", """
with lab as (select dense_rank() over (order by o_orderstatus) - 1 as y, avg_disc as s0, n_lines / 7.0 as s1,
                    returned * 0.5 + avg_disc as s2 from order_features where o_orderstatus is not null),
ex as (select y, 0 as cls, s0 as score from lab union all select y, 1, s1 from lab union all select y, 2, s2 from lab),
g as (select cls, score, count_if(y = cls) as pos, count_if(y <> cls) as neg from ex group by 1, 2),
per as (select cls, sum(pos * (coalesce(nb, 0) + neg * 0.5)) / (sum(pos) * sum(neg)) as auc
        from (select *, sum(neg) over (partition by cls order by score
                                       rows between unbounded preceding and 1 preceding) as nb from g)
        group by cls)
select cast(cls as integer) as cls, round(auc, 6) as roc_auc from per
union all select cast(null as integer), round(avg(auc), 6) from per""")
oracle("regression_metrics", """
select round(avg((y - p) * (y - p)), 4) as mse, round(sqrt(avg((y - p) * (y - p))), 4) as rmse,
       round(avg(abs(y - p)), 4) as mae,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 4) as r2_score
from (select o_totalprice as y, sum_qty * 1500.0 as p from order_features)""")

# --- result tables --------------------------------------------------------------------
oracle("dataset_summary", f"""
with {_PLAN_CTE}
select (select count(*) from dirty_orders) as original_rows,
       (select count(*) from d2 where date_text is not null) as cleaned_rows,
       cast(7 as bigint) as columns, cast(4 as bigint) as numeric_columns, cast(3 as bigint) as categorical_columns,
       'o_totalprice' as target""")

# --- cleaning plan recommendation (rules restated in SQL) --------------------------------
_DT = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%m-%Y"]
_TEXT = [c for c, dt, role in DIRTY_COLS if dt == "string"]
_PARSE = " union all ".join(
    f"select '{c}' as pcol, count({c}) as n, count_if(regexp_matches({c}, '{NUMERIC_PATTERN}')) as nf, "
    f"count_if(regexp_matches({c}, '^\\s*[+-]?\\d+\\s*$')) as ni, "
    f"count(coalesce({', '.join(f'try_strptime({c}, {chr(39)}{f}{chr(39)})' for f in _DT)})) as nd from dirty_orders"
    for c in _TEXT)
oracle("recommend_plan", f"""
with p as ({_profile_sql("dirty_orders", DIRTY_COLS)}),
t as ({_PARSE}),
j as (select p.*, t.n, t.nf, t.ni, t.nd,
        case when t.n > 0 and t.nf >= 0.9 * t.n then (case when t.ni = t.nf and t.nf = t.n then 'int' else 'float' end)
             when t.n > 0 and t.nd >= 0.9 * t.n then 'datetime' else 'none' end as conv
      from p left join t on t.pcol = p."column"),
k as (select *, (missing_count > 0 or (conv = 'float' and nf < n) or (conv = 'datetime' and nd < n)) as has_missing,
        case when conv in ('int', 'float') then 'numeric' else role end as role2 from j),
plan as (select position, "column" as column_name,
        case when has_missing and conv <> 'int' then
             (case when role2 = 'numeric' then 'impute_median' else 'impute_mode' end) else 'none' end
          as missing_value_action,
        cast(null as varchar) as missing_value_constant,
        case when outlier_count > 0 and role = 'numeric' then 'cap_iqr' else 'none' end as outlier_action,
        conv as type_conversion
      from k)
select column_name, missing_value_action, missing_value_constant, outlier_action, type_conversion,
       (select sum(n) - count(*) > 0 from (select count(*) as n from dirty_orders
          group by o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, price_text, date_text))
         as drop_duplicates
from plan where missing_value_action <> 'none' or outlier_action <> 'none' or type_conversion <> 'none'""")

# --- remaining single operators -------------------------------------------------------
oracle("preview_orders", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate,
       o_orderpriority from orders order by o_orderkey limit 5""")
oracle("constant_columns", " union all ".join(
    f"select '{c}' as \"column\", min({c}) <> max({c}) as non_constant from lineitem" for c in _LI_NUM))
oracle("eda_numeric_summary", " union all ".join(
    f"""select '{c}' as "column", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
    round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max,
    round(skewness({c}), 6) as skewness from lineitem""" for c in _LI_NUM))

# --- engineered features (E14), long form ------------------------------------------------
_KIND = f"""(select col, case when g > 1 and mn >= 0 then 'log1p' when nu > 50 then 'quantile_bin'
                      when nu > 2 then 'zscore' end as kind
            from ({_F_STATS}) where role = 'numeric' and col <> 'returned')"""
_NT = [c for k, c in _F_NT]
_VALS = " union all ".join(
    f"select o_orderkey, '{c}' as col, cast({c} as double) as x, "
    f"(select list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) from order_features) as cuts, "
    f"(select avg({c}) from order_features) as mu, (select stddev_pop({c}) from order_features) as sd "
    f"from order_features" for c in _NT)
oracle("apply_features", f"""
select v.o_orderkey,
       v.col || case k.kind when 'log1p' then '_log1p' when 'quantile_bin' then '_bin' else '_z' end as feature,
       round(case k.kind when 'log1p' then ln(1 + v.x)
                         when 'quantile_bin' then cast(len(list_filter(v.cuts, lambda c: c < v.x)) as double)
                         else case when v.sd is null or v.sd = 0 then 0.0 else (v.x - v.mu) / v.sd end end, 6) as value
from ({_VALS}) v join {_KIND} k on k.col = v.col where k.kind is not null
union all
select o.o_orderkey, r.a || '_per_' || r.b as feature,
       round(case """ + " ".join(
    f"when r.a = '{_F_NT[i][1]}' and r.b = '{_F_NT[j][1]}' then "
    f"case when cast(o.{_F_NT[j][1]} as double) = 0 then null else cast(o.{_F_NT[i][1]} as double) / cast(o.{_F_NT[j][1]} as double) end"
    for i, j in _npairs) + f""" end, 6) as value
from order_features o, (""" + " union all ".join(
    f"select '{_F_NT[i][1]}' as a, '{_F_NT[j][1]}' as b, corr(cast({_F_NT[j][1]} as double), cast({_F_NT[i][1]} as double)) as r from order_features"
    for i, j in _npairs) + ") r where abs(r.r) >= 0.7")
oracle("skew_events", """select 'value' as "column", round(skewness(value), 6) as skewness from events""")

from tablewise.functions.exprs import NA_TOKENS  # noqa: E402

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)
oracle("csv_roundtrip", f"""
select o_orderkey, o_custkey,
       case when o_orderstatus in ({_NA}) then null else o_orderstatus end as o_orderstatus,
       o_totalprice,
       case when o_orderpriority in ({_NA}) then null else o_orderpriority end as o_orderpriority,
       case when price_text in ({_NA}) then null else price_text end as price_text,
       case when date_text in ({_NA}) then null else date_text end as date_text
from dirty_orders""")


# --- vocabularies, boosted trees, quantiles of many groups ------------------------------
oracle("vocabulary_codes", """
with v as (select 'o_orderpriority' as "column", o_orderpriority as value from orders
           union all select 'customer', cast(o_custkey as varchar) from orders)
select "column", value, row_number() over (partition by "column" order by value) - 1 as code, count(*) as n
from v where value is not null group by "column", value""")
oracle("one_hot_sparse", """
with f as (select o.o_orderkey, cast(r.o_custkey as varchar) as customer, o.c_mktsegment from order_features o join orders r using (o_orderkey)),
a as (select customer as v, row_number() over (order by customer) as slot from (select distinct customer from f where customer is not null)),
b as (select c_mktsegment as v, row_number() over (order by c_mktsegment) + (select count(*) from a) as slot from (select distinct c_mktsegment from f where c_mktsegment is not null))
select o_orderkey, slot, 'customer_' || v as name from f join a on f.customer = a.v
union all select o_orderkey, slot, 'c_mktsegment_' || v from f join b on f.c_mktsegment = b.v""")


def _boosting_sql(rounds: int) -> str:
    """Rounds of one-split boosting: gains of all thresholds by sums, margins updated row by row."""
    out = ["""with d as (select row_number() over () as id, cast(n_lines as double) as a, cast(returned as double) as b,
            floor(sum_qty / 100) as c, o_totalprice / 100000 as y from order_features
            where n_lines is not null and returned is not null and sum_qty is not null and o_totalprice is not null),
        x as (select id, 'a' as f, a as v from d union all select id, 'b', b from d union all select id, 'c', c from d),
        cuts as (select distinct f, v as t from (select f, v, max(v) over (partition by f) as top from x) where v < top),
        m0 as (select id, y, (select avg(y) from d) as m from d)"""]
    for r in range(rounds):
        out.append(f"""s{r} as (select f, t, sum(case when v <= t then m - y else 0 end) as gl, count(*) filter (v <= t) as hl, sum(m - y) as g, count(*) as h
            from x join m{r} using (id) join cuts using (f) group by f, t),
        b{r} as (select f, t, gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1) as gain, -0.3 * gl / (hl + 1) as wl, -0.3 * (g - gl) / (h - hl + 1) as wr
            from s{r} order by gain desc, f, t limit 1),
        m{r + 1} as (select m{r}.id, y, m + case when v <= t then wl else wr end as m from m{r} join x using (id) join b{r} using (f))""")
    rows = " union all ".join(f"""select cast({r} as integer) as round, f as feature, round(t, 6) as threshold, round(gain, 6) as gain, round(wl, 6) as left_value,
            round(wr, 6) as right_value, round((select avg((m - y) ** 2) / 2 from m{r}), 6) as loss from b{r}""" for r in range(rounds))
    return ", ".join(out) + " " + rows


oracle("boosted_rounds", _boosting_sql(3))
oracle("quartiles_by_order", """
select cast(l_orderkey as varchar) as "group", round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
       round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3
from lineitem where l_orderkey is not null group by l_orderkey""")
