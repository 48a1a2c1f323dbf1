"""Sources, formulas, scaling, encoding, replicates and profiles."""

from pyspark.sql import functions as F

from isoplane.functions.formulas import derive_columns, log10_columns
from isoplane.functions.scalars import clip, rounded
from isoplane.operators import encoding, profiling, replicates, scaling
from isoplane.operators.ranking import with_rank
from isoplane.plans import gp
from isoplane.registry import query
from isoplane.registry.shared import shown, table
from isoplane.sources import tables

LINE = ["l_orderkey", "l_linenumber"]
CATS = ["l_returnflag", "l_linestatus"]


@query("scan_lineitem", """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
           l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') as l_shipdate
    from lineitem""")
def scan_lineitem(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query("column_listing", """
    select position::int as position, name, type, n_values from (
      select 1 as position, 'c_custkey' as name, 'bigint' as type, count(c_custkey) as n_values from customer
      union all select 2, 'c_name', 'string', count(c_name) from customer
      union all select 3, 'c_nationkey', 'int', count(c_nationkey) from customer
      union all select 4, 'c_acctbal', 'double', count(c_acctbal) from customer
      union all select 5, 'c_mktsegment', 'string', count(c_mktsegment) from customer)""")
def column_listing(spark, sf):
    return tables.list_columns(table(spark, sf, "customer"))


@query("classify_columns", """
    select 'num' as role, 'o_orderkey' as name, count(o_orderkey) as n_values from orders
    union all select 'num', 'o_custkey', count(o_custkey) from orders
    union all select 'cat', 'o_orderstatus', count(o_orderstatus) from orders
    union all select 'cat', 'o_orderdate', count(o_orderdate) from orders
    union all select 'cat', 'o_orderpriority', count(o_orderpriority) from orders""")
def classify_columns(spark, sf):
    df = table(spark, sf, "orders")
    roles = tables.classify_columns(df, "o_totalprice")
    role = F.when(F.col("name").isin(roles["num_cols"]), "num").when(F.col("name").isin(roles["cat_cols"]), "cat")
    return tables.list_columns(df).select(role.alias("role"), "name", "n_values").where("role is not null")


@query("derive_columns", """
    select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 8) + 0.0 as charge,
           round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 8) + 0.0 as taxed,
           round(l_extendedprice / l_quantity, 8) + 0.0 as unit_price
    from lineitem""")
def derive(spark, sf):
    df = derive_columns(table(spark, sf, "lineitem"), [
        "charge = l_extendedprice * (1 - l_discount)", "taxed = charge * (1 + l_tax)",
        "no formula here", "unit_price = l_extendedprice / df['l_quantity']"])
    return shown(df.select(*LINE, "charge", "taxed", "unit_price"), 8, *LINE)


@query("derive_arith", """
    select c_custkey, floor(c_custkey / 7)::bigint as whole, (c_custkey + 7 * floor(c_custkey / -7))::bigint as signed,
           round(c_acctbal - 7 * floor(c_acctbal / 7), 6) + 0.0 as remainder,
           round(floor(c_acctbal / 7), 6) + 0.0 as parts,
           round(c_acctbal / nullif(c_nationkey - 3, 0), 6) + 0.0 as ratio,
           pow(c_nationkey, 2)::double as squared, round(-c_acctbal + c_nationkey, 6) + 0.0 as flipped
    from customer""")
def derive_arith(spark, sf):
    df = derive_columns(table(spark, sf, "customer"), [
        "whole = c_custkey // 7", "signed = c_custkey % -7", "remainder = c_acctbal % 7",
        "parts = c_acctbal // 7", "ratio = c_acctbal / (c_nationkey - 3)", "squared = c_nationkey ** 2",
        "flipped = -c_acctbal + c_nationkey"])
    return shown(df.select("c_custkey", "whole", "signed", "remainder", "parts", "ratio", "squared", "flipped"),
                 6, "c_custkey", "whole", "signed", "squared")


@query("derive_predicates", """
    select l_orderkey, l_linenumber, (l_quantity > 25 and l_discount <= 0.05)::int as bulk,
           (not (l_returnflag = 'N') or l_tax <> 0.02)::int as other,
           (l_quantity >= 10 and l_quantity < 20 and l_linestatus = 'O')::int as middle,
           round(case when l_quantity >= 10 then l_extendedprice else 0 end, 4) + 0.0 as counted
    from lineitem""")
def derive_predicates(spark, sf):
    df = derive_columns(table(spark, sf, "lineitem"), [
        "bulk = (l_quantity > 25) & (l_discount <= 0.05)",
        "other = ~(l_returnflag == 'N') | (l_tax != 0.02)",
        "middle = (l_quantity >= 10) & (l_quantity < 20) & (l_linestatus == 'O')",
        "counted = (l_quantity >= 10) * l_extendedprice"])
    return df.select(*LINE, *[F.col(c).cast("int").alias(c) for c in ("bulk", "other", "middle")],
                     rounded(F.col("counted"), 4).alias("counted"))


# name: (formula, SQL)
NUMPY_CASES = {
    "f_log": ("np.log(x)", "case when x > 0 then ln(x) end"),
    "f_log10": ("np.log10(x)", "case when x > 0 then log10(x) end"),
    "f_log2": ("np.log2(x)", "case when x > 0 then log2(x) end"),
    "f_log1p": ("np.log1p(x)", "case when x > -1 then ln(1 + x) end"),
    "f_exp": ("np.exp(x / 1000)", "exp(x / 1000)"),
    "f_expm1": ("np.expm1(x / 1000)", "exp(x / 1000) - 1"),
    "f_sqrt": ("np.sqrt(x)", "case when x >= 0 then sqrt(x) end"),
    "f_cbrt": ("np.cbrt(x)", "cbrt(x)"),
    "f_square": ("np.square(x)", "x * x"),
    "f_abs": ("np.abs(x)", "abs(x)"),
    "f_sign": ("np.sign(x)", "sign(x)::double"),
    "f_power": ("np.power(x / 1000, 3)", "pow(x / 1000, 3)"),
    "f_floor": ("np.floor(x)", "floor(x)"),
    "f_ceil": ("np.ceil(x)", "ceil(x)"),
    "f_round": ("np.round(n / 2)", "round_even(n / 2, 0)"),
    "f_minimum": ("np.minimum(x, n)", "least(x, n)::double"),
    "f_maximum": ("np.maximum(x, n)", "greatest(x, n)::double"),
    "f_clip": ("np.clip(x, 0, 5000)", "greatest(0, least(x, 5000))::double"),
    "f_where": ("np.where(x > n, x, n)", "case when x > n then x else n::double end"),
    "f_isnan": ("np.isnan(np.sqrt(x))", "x < 0"),
    "f_sin": ("np.sin(n)", "sin(n)"),
    "f_cos": ("np.cos(n)", "cos(n)"),
    "f_tan": ("np.tan(n)", "tan(n)"),
    "f_arcsin": ("np.arcsin(n / 12)", "case when n <= 12 then asin(least(n, 12) / 12) end"),
    "f_arccos": ("np.arccos(n / 12)", "case when n <= 12 then acos(least(n, 12) / 12) end"),
    "f_arctan": ("np.arctan(x)", "atan(x)"),
    "f_arctan2": ("np.arctan2(x, n)", "atan2(x, n)"),
    "f_sinh": ("np.sinh(n / 10)", "sinh(n / 10)"),
    "f_cosh": ("np.cosh(n / 10)", "cosh(n / 10)"),
    "f_tanh": ("np.tanh(n / 10)", "tanh(n / 10)"),
    "f_deg2rad": ("np.deg2rad(x)", "radians(x)"),
    "f_rad2deg": ("np.rad2deg(n)", "degrees(n)"),
    "f_hypot": ("np.hypot(x, n)", "sqrt(x * x + n * n)"),
}


@query("derive_numpy_fns", "with c as (select c_custkey, c_acctbal x, c_nationkey n from customer) select c_custkey, "
       + ", ".join(f"({q})::int as {k}" if k == "f_isnan" else f"round({q}, 6) + 0.0 as {k}"
                   for k, (_, q) in NUMPY_CASES.items()) + " from c")
def derive_numpy_fns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("n"))
    df = derive_columns(df, [f"{k} = {f}" for k, (f, _) in NUMPY_CASES.items()]).drop("x", "n")
    return shown(df.withColumn("f_isnan", F.col("f_isnan").cast("int")), 6, "c_custkey", "f_isnan")


@query("derive_with_aggregates", """
    with s as (select avg(l_extendedprice) m, min(l_quantity) lo, max(l_quantity) hi, avg(l_tax) t,
                      stddev_samp(l_tax) ts, stddev_pop(l_tax) tp, sum(l_quantity) q, median(l_extendedprice) md
               from lineitem)
    select l_orderkey, l_linenumber, round(l_extendedprice - m, 4) + 0.0 as centred,
           round((l_quantity - lo) / (hi - lo), 6) + 0.0 as unit, round((l_tax - t) / ts, 6) + 0.0 as z_sample,
           round((l_tax - t) / tp, 6) + 0.0 as z_pop, round(1e6 * l_quantity / q, 6) + 0.0 as share,
           (l_extendedprice > md)::int as above
    from lineitem, s""")
def derive_with_aggregates(spark, sf):
    df = derive_columns(table(spark, sf, "lineitem"), [
        "centred = l_extendedprice - np.mean(l_extendedprice)",
        "unit = (l_quantity - l_quantity.min()) / (l_quantity.max() - l_quantity.min())",
        "z_sample = (l_tax - l_tax.mean()) / l_tax.std()",
        "z_pop = (l_tax - np.mean(l_tax)) / np.std(l_tax)",
        "share = 1e6 * l_quantity / l_quantity.sum()",
        "above = l_extendedprice > np.median(l_extendedprice)"])
    df = df.withColumn("above", F.col("above").cast("int"))
    return shown(df.select(*LINE, "centred", "unit", "z_sample", "z_pop", "share", "above"),
                 6, *LINE, "above", centred=4)


@query("derive_rank", """
    with r as (select *, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as p,
                      rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as q from lineitem)
    select l_orderkey, l_linenumber, round(p, 1)::double as price_rank, round((q - 1) / (max(q) over () - 1), 6) + 0.0 as share from r""")
def derive_rank(spark, sf):
    """Ranks of a column with few ties and of one with many, inside formulas."""
    df = derive_columns(table(spark, sf, "lineitem"), [
        "price_rank = l_extendedprice.rank()", "share = (l_quantity.rank() - 1) / (l_quantity.rank().max() - 1)"])
    return shown(df.select(*LINE, "price_rank", "share"), 6, *LINE, price_rank=1)


@query("complete_cases", """
    select l_quantity, l_discount, l_extendedprice from lineitem
    where l_quantity is not null and l_discount is not null and l_extendedprice is not null""")
def complete_cases(spark, sf):
    return tables.complete_cases(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")


@query("log10_features", """
    select o_orderkey, round(log10(o_totalprice), 6) + 0.0 as o_totalprice from orders""")
def log10_features(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return shown(log10_columns(df, ["o_totalprice"]), 6, "o_orderkey")


@query("filter_combo", """
    select l_orderkey, l_linenumber, l_extendedprice from lineitem
    where l_returnflag = 'R' and l_linestatus = 'F'""")
def filter_combo(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.where(encoding.matches({"l_returnflag": "R", "l_linestatus": "F"})).select(*LINE, "l_extendedprice")


@query("clip_score", """
    select c_custkey, greatest(least(c_acctbal / 50, 100), 0)::double as both_sides,
           greatest(c_acctbal, 0)::double as floored from customer""")
def clip_score(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", clip(b / 50, 0.0, 100.0).alias("both_sides"), clip(b, lo=0.0).alias("floored"))


SCALED = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("scaler_fit", " union all ".join(
    f"select '{c}' as \"column\", round(avg({c}), 7) + 0.0 as mean, round(stddev_pop({c}), 7) + 0.0 as scale from lineitem"
    for c in SCALED))
def scaler_fit(spark, sf):
    return shown(scaling.fit_scaler(table(spark, sf, "lineitem"), SCALED), 7, "column")


@query("scaler_transform", "with s as (select " + ", ".join(
    f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in SCALED) + " from lineitem) select l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 as {c}" for c in SCALED) + " from lineitem, s")
def scaler_transform(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, *SCALED)
    return shown(scaling.scale_columns(df, SCALED), 6, *LINE)


@query("scaler_inverse", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round({c}, 6) + 0.0 as {c}" for c in SCALED) + " from lineitem")
def scaler_inverse(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, *SCALED)
    return shown(scaling.unscale_columns(scaling.scale_columns(df, SCALED), SCALED, df), 6, *LINE)


STATUS, PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "select o_orderkey, " + ", ".join(
    [f"(o_orderstatus = '{v}')::int as \"o_orderstatus_{v}\"" for v in STATUS]
    + [f"(o_orderpriority = '{v}')::int as \"o_orderpriority_{v}\"" for v in PRIORITY]) + " from orders")
def one_hot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encoding.one_hot(df, ["o_orderstatus", "o_orderpriority"])


@query("feature_vector", """
    select l_orderkey, l_linenumber, concat_ws(',', (l_quantity * 100)::bigint, round(l_discount * 100)::bigint,
      (l_returnflag = 'A')::int * 100, (l_returnflag = 'N')::int * 100, (l_returnflag = 'R')::int * 100) as features
    from lineitem""")
def feature_vector(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE, "l_quantity", "l_discount", "l_returnflag")
    levels = encoding.category_levels(df, ["l_returnflag"])
    names = ["l_quantity", "l_discount", *encoding.dummy_names(levels)]
    vector = encoding.feature_vector(names)
    text = F.transform(vector, lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return encoding.one_hot(df, ["l_returnflag"], levels).select(*LINE, F.concat_ws(",", text).alias("features"))


COMBO_SQL = """
    select row_number() over (order by label)::int as combo_id, label from (
      select distinct 'l_returnflag=' || l_returnflag || ', l_linestatus=' || l_linestatus as label from lineitem)"""


@query("category_combos", COMBO_SQL)
def category_combos(spark, sf):
    return encoding.category_combos(table(spark, sf, "lineitem"), CATS).select("combo_id", "label")


@query("combos_with_all", f"""
    with c as ({COMBO_SQL}) select 0 as combo_id, 'All' as label, 0 as n_fixed
    union all select combo_id, label, 2 from c""")
def combos_with_all(spark, sf):
    ones = F.aggregate(F.map_values("fixed"), F.lit(0), lambda a, v: a + v)
    return encoding.category_combos(table(spark, sf, "lineitem"), CATS, include_all=True).select(
        "combo_id", "label", ones.alias("n_fixed"))


COND = ["l_discount", "l_tax"]
# Zeros in the tables carry either sign; both are one condition, shown unsigned.
LINEITEM = "(select * replace (l_discount + 0.0 as l_discount, l_tax + 0.0 as l_tax) from lineitem)"
# Replicates of the logarithm: its means are no short decimals, so rounding them has no ties.
LOGGED = LINEITEM.replace("select *", "select ln(l_extendedprice) as log_price, *")


def logged(spark, sf):
    return derive_columns(table(spark, sf, "lineitem"), ["log_price = np.log(l_extendedprice)"])


GROUP_SQL = f"""
    select l_discount, l_tax, round(avg(log_price), 9) + 0.0 as mean,
           round(stddev_samp(log_price), 9) + 0.0 as std, count(*) as count, count(log_price) as n_valid
    from {LOGGED} group by all"""


@query("replicate_groups", GROUP_SQL + " having count(*) >= 2")
def replicate_groups(spark, sf):
    return shown(replicates.replicate_groups(logged(spark, sf), COND, "log_price"),
                 9, *COND, "count", "n_valid")


WIDE = ["l_quantity", "l_discount", "l_tax", "l_suppkey"]


@query("replicate_min_count", f"""
    select l_quantity, l_discount, l_tax, l_suppkey, round(avg(log_price), 9) + 0.0 as mean,
           round(stddev_samp(log_price), 9) + 0.0 as std, count(*) as count
    from {LOGGED} group by all having count(*) >= 2""")
def replicate_min_count(spark, sf):
    out = replicates.replicate_groups(logged(spark, sf), WIDE, "log_price")
    return shown(out.drop("n_valid"), 9, *WIDE, "count")


@query("replicate_dropped", f"""
    select l_quantity, l_discount, l_tax, l_suppkey, count(*) as count
    from {LOGGED} group by all having count(*) < 2""")
def replicate_dropped(spark, sf):
    return replicates.dropped_groups(logged(spark, sf), WIDE, "log_price")


TRIM = f"""
    with s as (select l_discount, l_tax, avg(log_price) m, stddev_samp(log_price) s, count(*) n
               from {LOGGED} group by all),
         f as (select li.*, m, s, n, n > 2 and s > 0 and abs(log_price - m) > 1.5 * s as out
               from {LOGGED} li join s using (l_discount, l_tax))"""


@query("replicate_outlier_trim", TRIM + """
    select l_discount, l_tax, round(avg(log_price), 9) + 0.0 as mean,
           round(stddev_samp(log_price), 9) + 0.0 as std, count(*) as count, count(log_price) as n_valid
    from f where not out group by all having count(*) >= 2""")
def replicate_outlier_trim(spark, sf):
    out = replicates.replicate_groups(logged(spark, sf), COND, "log_price", outlier_sd=1.5)
    return shown(out, 9, *COND, "count", "n_valid")


@query("replicate_outlier_flags", TRIM + """
    select l_orderkey, l_linenumber, round(case when n > 2 and s > 0 then (log_price - m) / s end, 6) + 0.0 as z,
           out::int as is_outlier from f""")
def replicate_outlier_flags(spark, sf):
    out = replicates.flag_outliers(logged(spark, sf), COND, "log_price", 1.5)
    return out.select(*LINE, rounded(F.col("z"), 6).alias("z"), F.col("is_outlier").cast("int").alias("is_outlier"))


@query("replicate_blocked", f"""
    select l_returnflag, l_discount, l_tax, round(avg(log_price), 9) + 0.0 as mean,
           round(stddev_samp(log_price), 9) + 0.0 as std, count(*) as count, count(log_price) as n_valid
    from {LOGGED} group by all having count(*) >= 2""")
def replicate_blocked(spark, sf):
    out = replicates.replicate_groups(logged(spark, sf), COND, "log_price", block="l_returnflag")
    return shown(out, 9, "l_returnflag", *COND, "count", "n_valid")


@query("column_ranges", " union all ".join(
    f"select '{c}' as \"column\", min({c}) + 0.0 as min, max({c}) + 0.0 as max from lineitem" for c in SCALED))
def column_ranges(spark, sf):
    return shown(profiling.column_ranges(table(spark, sf, "lineitem"), SCALED), 6, "column")


@query("column_medians", " union all ".join(
    f"select '{c}' as \"column\", round(median({c}), 6) + 0.0 as median from lineitem" for c in SCALED))
def column_medians(spark, sf):
    return shown(profiling.column_medians(table(spark, sf, "lineitem"), SCALED), 6, "column")


@query("distinct_values", "select distinct l_quantity from lineitem")
def distinct_values(spark, sf):
    return profiling.distinct_values(table(spark, sf, "lineitem"), "l_quantity")


def _histogram_sql(name, column, bins):
    return f"""
    with s as (select min({column}) lo, max({column}) hi from {name}),
         e as (select i::int as bin, lo + (i - 1) * ((hi - lo) / {bins}) as lo,
                      case when i = {bins} then hi else lo + i * ((hi - lo) / {bins}) end as hi
               from s, range(1, {bins + 1}) t(i))
    select bin, round(lo, 6) + 0.0 as lo, round(hi, 6) + 0.0 as hi,
           (select count(*) from {name} where {column} >= e.lo
              and ({column} < e.hi or (bin = {bins} and {column} <= e.hi))) as count
    from e"""


@query("histogram_20", _histogram_sql("part", "p_retailprice", 20))
def histogram_20(spark, sf):
    return shown(profiling.histogram(table(spark, sf, "part"), "p_retailprice", 20), 6, "bin", "count")


@query("histogram_30", _histogram_sql("customer", "c_acctbal", 30))
def histogram_30(spark, sf):
    return shown(profiling.histogram(table(spark, sf, "customer"), "c_acctbal", 30), 6, "bin", "count")


PARAMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
CORR = "(" + " union all ".join(
    f"select '{p}' as parameter, corr({p}, l_extendedprice) as correlation from lineitem" for p in PARAMS) + ")"


@query("parameter_correlation", f"select parameter, round(correlation, 8) + 0.0 as correlation from {CORR}")
def parameter_correlation(spark, sf):
    return shown(profiling.parameter_correlation(table(spark, sf, "lineitem"), PARAMS, "l_extendedprice"), 8, "parameter")


@query("top2_parameters", f"""
    select parameter, round(correlation, 8) + 0.0 as correlation from {CORR}
    order by abs(correlation) desc, parameter limit 2""")
def top2_parameters(spark, sf):
    found = profiling.parameter_correlation(table(spark, sf, "lineitem"), PARAMS, "l_extendedprice")
    return shown(profiling.top_parameters(found, 2), 8, "parameter")


@query("score_summary", """
    select round(avg(o_totalprice), 7) + 0.0 as mean, max(o_totalprice) as best, min(o_totalprice) as lowest,
           count(o_totalprice) as count from orders""")
def score_summary(spark, sf):
    return shown(profiling.score_summary(table(spark, sf, "orders"), "o_totalprice"), 7, "best", "lowest", "count")


@query("best_condition", """
    select o_orderkey, o_totalprice, o_orderpriority from orders
    order by o_totalprice desc, o_orderkey limit 1""")
def best_condition(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return profiling.best_row(df, "o_totalprice", "o_orderkey")


@query("top10_candidates", """
    select o_orderkey, least(o_totalprice, 300000)::double as score from orders
    order by score desc, o_orderkey limit 10""")
def top10_candidates(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", clip(F.col("o_totalprice"), 0.0, 300000.0).alias("score"))
    return profiling.top_rows(df, "score", "o_orderkey", 10)


@query("score_sorted", """
    select row_number() over (order by o_totalprice, o_orderkey) as rank, o_orderkey, o_totalprice from orders""")
def score_sorted(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_rank(df, "o_totalprice", "o_orderkey").select("rank", "o_orderkey", "o_totalprice")


@query("contour_bands", """
    with s as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem)
    select band, count(*) as n, min(l_extendedprice) as lowest, max(l_extendedprice) as highest from (
      select least(floor((l_extendedprice - lo) * 40 / (hi - lo)) + 1, 40)::int as band, l_extendedprice from lineitem, s)
    group by band""")
def contour_bands(spark, sf):
    v = F.col("l_extendedprice")
    return profiling.equal_bands(table(spark, sf, "lineitem"), "l_extendedprice", 40).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"))


SCALED_GROUPS = f"""
    with s as (select avg(l_extendedprice) m, stddev_pop(l_extendedprice) s from lineitem),
         g as (select l_discount, l_tax, stddev_samp((l_extendedprice - m) / s) as std, count(*) as n
               from {LINEITEM}, s group by l_discount, l_tax having count(*) >= 2)"""
NOISE_SQL = {"std": "std * std", "sem": "std * std / n", "constant": "0.05::double"}


def _noise_query(model):
    @query(f"noise_{model}", SCALED_GROUPS + f" select l_discount, l_tax, round({NOISE_SQL[model]}, 9) + 0.0 as noise from g")
    def noise(spark, sf):
        df = scaling.scale_columns(table(spark, sf, "lineitem"), ["l_extendedprice"])
        summary = replicates.replicate_groups(df, COND, "l_extendedprice")
        return shown(summary.select(*COND, gp.noise_column(model).alias("noise")), 9, *COND)


for _model in NOISE_SQL:
    _noise_query(_model)


@query("condition_collapse", f"""
    with s as (select avg(l_extendedprice) m, stddev_pop(l_extendedprice) s from lineitem)
    select l_quantity, l_discount, round(avg((l_extendedprice - m) / s), 6) + 0.0 as mean, count(*) as count,
           round(var_pop((l_extendedprice - m) / s) * count(*), 6) + 0.0 as within, round(0.05 / count(*), 9) + 0.0 as noise
    from {LINEITEM}, s group by l_quantity, l_discount""")
def condition_collapse(spark, sf):
    df = scaling.scale_columns(table(spark, sf, "lineitem"), ["l_extendedprice"])
    return shown(gp.condition_collapse(df, ["l_quantity", "l_discount"], "l_extendedprice"),
                 6, "l_quantity", "l_discount", "count", noise=9)
