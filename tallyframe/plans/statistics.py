"""Many statistics per group, key sets, summaries, correlations and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.dates import day_text
from tallyframe.operators.aggregates import (
    corr_long,
    describe_exact,
    long_stats,
    match_rate,
    members_list,
    multi_stat,
    multi_stat_sets,
    wide_matrix,
    table_stats,
)
from tallyframe.operators.profile import profile
from tallyframe.plans.registry import query, rnd, rounded
from tallyframe.sources.tables import table

FULL = ["sum", "std", "mean", "median", "min", "max", "mad"]

_SQL_STATS = {
    "count": "count({c})",
    "nunique": "count(distinct {c})",
    "sum": "sum({c})::double",
    "mean": "avg({c})",
    "std": "stddev_samp({c})",
    "median": "quantile_cont({c}::double, 0.5)",
    "min": "min({c})::double",
    "max": "max({c})::double",
}


def _sql_stat(c: str, s: str, digits: int) -> str:
    shown = _SQL_STATS[s].format(c=c)
    whole = s in ("count", "nunique")
    return f"{shown} as {c}_{s}" if whole else _rounded_sql(shown, f"{c}_{s}", digits)


def _rounded_sql(expression: str, name: str, digits: int) -> str:
    """Sums to the cent, everything else to the given digits."""
    return f"{rnd(expression, 2 if name.endswith('_sum') else digits)} as {name}"


def _sql_multi(
    source: str, keys: list[str], stats: dict[str, list[str]], digits: int = 4
) -> str:
    """Statistics of one key set; the mean deviation needs the group's mean on each row."""
    plain = ", ".join(_sql_stat(c, s, digits) for c, names in stats.items() for s in names if s != "mad")
    means = ", ".join(
        f"avg({c}) over (partition by {', '.join(keys)}) as mean_{c}" for c in stats
    )
    mads = ", ".join(
        _rounded_sql(f"avg(abs({c} - mean_{c}))", f"{c}_mad", digits)
        for c, names in stats.items()
        if "mad" in names
    )
    here = " and ".join(f"{k} is not null" for k in keys)
    every = ", ".join(x for x in (plain, mads) if x)
    return f"""select {', '.join(keys)}, {every}
      from (select *, {means} from ({source}) where {here}) group by {', '.join(keys)}"""


def _shown(df, stats, digits=4):
    """Whole numbers as doubles, sums to the cent and some digits of everything else."""
    rest = [
        f"{c}_{s}" for c, names in stats.items() for s in names if s not in ("count", "nunique")
    ]
    sums = [n for n in rest if n.endswith("_sum")]
    doubles = df.withColumns({n: F.col(n).cast("double") for n in rest})
    return rounded(rounded(doubles, 2, *sums), digits, *[n for n in rest if n not in sums])


BY_FLAG = {"l_orderkey": ["nunique", "count"], "l_quantity": FULL, "l_extendedprice": FULL}


@query(
    "multi_stat_by_key",
    _sql_multi(
        "select l_returnflag, l_orderkey, l_quantity, l_extendedprice from lineitem",
        ["l_returnflag"],
        BY_FLAG,
    ),
)
def multi_stat_by_key(spark, sf):
    return _shown(multi_stat(table(spark, sf, "lineitem"), ["l_returnflag"], BY_FLAG), BY_FLAG)


REVIEW = {"p_partkey": ["nunique", "count"], "p_size": FULL, "p_retailprice": FULL}
SETS = [
    ["brand"],
    ["kind"],
    ["priced"],
    ["brand", "kind", "priced"],
    ["brand", "kind"],
    ["brand", "priced"],
]
_PARTS = """
  select p_partkey, p_size / 7.0::double as p_size, p_retailprice / 7.0::double as p_retailprice,
         p_brand as brand,
         case when p_size = 3 then null else p_type end as kind,
         case when p_retailprice > 1000 then 'high' else 'low' end as priced from part"""


def _set_sql(keys: list[str]) -> str:
    stats = ", ".join(f"{c}_{s}" for c, names in REVIEW.items() for s in names)
    shown = ", ".join(k if k in keys else f"null::varchar as {k}" for k in SETS[3])
    inner = _sql_multi(_PARTS, keys, REVIEW, 6)
    return f"select '{'+'.join(keys)}' as key_set, {shown}, {stats} from ({inner})"


@query("multi_stat_grouping_sets", " union all ".join(_set_sql(s) for s in SETS))
def multi_stat_grouping_sets(spark, sf):
    """The same statistics for six key sets from one scan; rows with a null key are left out."""
    priced = F.when(F.col("p_retailprice") > 1000, "high").otherwise("low")
    kind = F.when(F.col("p_size") == 3, None).otherwise(F.col("p_type"))
    parts = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") / 7.0).alias("p_size"),
        (F.col("p_retailprice") / 7.0).alias("p_retailprice"),
        F.col("p_brand").alias("brand"),
        kind.alias("kind"),
        priced.alias("priced"),
    )
    return _shown(multi_stat_sets(parts, SETS, REVIEW), REVIEW, 6)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _whole_sql(c: str) -> str:
    return f"""
    select '{c}' as "column", count(distinct {c}) as nunique, count({c}) as count,
           {rnd(f'stddev_samp({c})', 4)} as std, {rnd(f'avg({c})', 4)} as mean,
           min({c})::double as low, max({c})::double as high,
           null::varchar as first, null::varchar as last,
           {rnd(f'quantile_cont({c}::double, 0.5)', 4)} as median,
           {rnd(f'avg(abs({c} - (select avg({c}) from lineitem)))', 4)} as mad
    from lineitem"""


@query(
    "table_stats",
    " union all ".join(_whole_sql(c) for c in ("l_quantity", "l_extendedprice"))
    + """
    union all
    select 'l_returnflag', count(distinct l_returnflag), count(l_returnflag), null, null,
           null, null, min(l_returnflag), max(l_returnflag), null, null from lineitem""",
)
def whole_table_stats(spark, sf):
    out = table_stats(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]
    )
    out = out.select(
        "column", "nunique", "count", "std", "mean",
        F.col("min").try_cast("double").alias("low"),
        F.col("max").try_cast("double").alias("high"),
        F.when(F.col("mean").isNull(), F.col("min")).alias("first"),
        F.when(F.col("mean").isNull(), F.col("max")).alias("last"),
        "median", "mad",
    )
    return rounded(out, 4, "std", "mean", "median", "mad")


_DOC_TEXTS, _DOC_NUMBERS = ["text", "lang", "source"], ["doc_id", "n_chars"]


@query(
    "table_profile",
    " union all ".join(
        f"""
    select '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls,
           count(distinct {c}) as "distinct", {moments}, {ends} from documents"""
        for c, moments, ends in [
            *[(c, "null::double as mean, null::double as std, null::double as low, "
               "null::double as high", f'min({c}) as "first", max({c}) as "last"')
              for c in _DOC_TEXTS],
            *[(c, f"{rnd(f'avg({c})', 4)} as mean, {rnd(f'stddev_samp({c})', 4)} as std, "
               f"min({c})::double as low, max({c})::double as high",
               'null::varchar as "first", null::varchar as "last"') for c in _DOC_NUMBERS],
        ]
    ),
)
def table_profile(spark, sf):
    """Every column of the documents in one scan, with the smallest and the largest text."""
    out = profile(table(spark, sf, "documents"), [*_DOC_TEXTS, *_DOC_NUMBERS])
    return rounded(out, 4, "mean", "std")


@query(
    "describe_exact",
    " union all ".join(
        f"""
    select '{c}' as "column", count({c}) as count, {rnd(f'avg({c})', 4)} as mean,
           {rnd(f'stddev_samp({c})', 4)} as std, min({c})::double as min,
           {rnd(f'quantile_cont({c}::double, 0.25)', 4)} as q25,
           {rnd(f'quantile_cont({c}::double, 0.5)', 4)} as q50,
           {rnd(f'quantile_cont({c}::double, 0.75)', 4)} as q75, max({c})::double as max
    from lineitem"""
        for c in MEASURES
    ),
)
def describe_lines(spark, sf):
    out = describe_exact(table(spark, sf, "lineitem"), MEASURES)
    return rounded(out, 4, "mean", "std", "q25", "q50", "q75")


@query(
    "mad_by_key",
    _sql_multi(
        "select l_suppkey, l_quantity, l_discount from lineitem",
        ["l_suppkey"],
        {"l_quantity": ["mad", "median"], "l_discount": ["mad"]},
    ),
)
def mad_by_key(spark, sf):
    """Mean, not median, absolute deviation from the mean of the group."""
    stats = {"l_quantity": ["mad", "median"], "l_discount": ["mad"]}
    return _shown(multi_stat(table(spark, sf, "lineitem"), ["l_suppkey"], stats), stats)


@query(
    "group_basic_stats",
    _sql_multi(
        "select l_returnflag, l_linestatus, l_quantity, l_tax, l_partkey from lineitem",
        ["l_returnflag", "l_linestatus"],
        {
            "l_quantity": ["count", "sum", "mean", "median", "std"],
            "l_tax": ["min", "max", "mean"],
            "l_partkey": ["nunique"],
        },
    ),
)
def group_basic_stats(spark, sf):
    stats = {
        "l_quantity": ["count", "sum", "mean", "median", "std"],
        "l_tax": ["min", "max", "mean"],
        "l_partkey": ["nunique"],
    }
    lines = table(spark, sf, "lineitem")
    return _shown(multi_stat(lines, ["l_returnflag", "l_linestatus"], stats), stats)


@query(
    "count_all_columns",
    """
    select source, lang, count(doc_id) as doc_id, count(text) as text, count(quality) as quality,
           count(toxic) as toxic
    from documents left join labels using (doc_id) group by all""",
)
def count_all_columns(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    named = {c: "count" for c in ("doc_id", "text", "quality", "toxic")}
    out = docs.groupBy("source", "lang").agg(named)
    return out.withColumnsRenamed({f"count({c})": c for c in named})


@query(
    "product_by_key",
    f"""
    select l_orderkey, {rnd('product((1 - l_discount) / 0.97)', 8)} as kept from lineitem group by 1""",
)
def product_by_key(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", ((1 - F.col("l_discount")) / 0.97).alias("kept")
    )
    out = multi_stat(lines, ["l_orderkey"], {"kept": ["prod"]})
    return rounded(out.withColumnRenamed("kept_prod", "kept"), 8, "kept")


_CORR = {"price": "l_extendedprice", "quantity": "l_quantity", "tax": "tax"}


@query(
    "corr_matrix_long",
    "with lines as (select *, case when l_returnflag = 'R' then null else l_tax end as tax "
    "from lineitem) "
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, {rnd(f'corr({x}, {y})', 6)} as r from lines"
        for a, x in _CORR.items()
        for b, y in _CORR.items()
    ),
)
def corr_matrix_long(spark, sf):
    """Every pair of columns; rows where one of the two is missing do not count for the pair."""
    tax = F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_tax"))
    lines = table(spark, sf, "lineitem").withColumn("tax", tax)
    named = lines.select(*[F.col(c).alias(a) for a, c in _CORR.items()])
    return rounded(corr_long(named, list(_CORR)), 6, "r")


@query(
    "match_rate",
    f"""
    select l_linestatus, {rnd("avg((l_returnflag = 'R' and l_discount > 0)::int)", 8)} as rate
    from lineitem group by 1""",
)
def match_rate_by_status(spark, sf):
    """How often two columns agree; a missing value agrees with nothing."""
    a = F.when(F.col("l_discount") > 0, F.col("l_returnflag"))
    out = table(spark, sf, "lineitem").groupBy("l_linestatus").agg(
        match_rate(a, F.lit("R")).alias("rate")
    )
    return rounded(out, 8, "rate")


@query(
    "stats_long_transpose",
    " union all ".join(
        f"select p_brand, '{n}' as statistic, {rnd(e, 4)} as value from part group by 1"
        for n, e in {
            "p_size_min": "min(p_size)::double",
            "p_size_max": "max(p_size)::double",
            "p_retailprice_mean": "avg(p_retailprice)",
        }.items()
    ),
)
def stats_long_transpose(spark, sf):
    """Statistics as rows instead of columns."""
    stats = multi_stat(
        table(spark, sf, "part"),
        ["p_brand"],
        {"p_size": ["min", "max"], "p_retailprice": ["mean"]},
    )
    out = long_stats(stats, "p_brand", ["p_size_min", "p_size_max", "p_retailprice_mean"])
    return rounded(out, 4, "value")


@query(
    "wide_pivot_first",
    f"""
    select * from (
      pivot (select event_type, strftime(ts, '%Y-%m-%d') as day, sum(value) as total
             from events group by all)
      on day using {rnd('max(total)', 4)} group by event_type)""",
)
def wide_pivot_first(spark, sf):
    """Entities as rows and all days as columns, by the last of them."""
    daily = (
        table(spark, sf, "events")
        .groupBy("event_type", day_text(F.col("ts")).alias("day"))
        .agg(F.sum("value").alias("total"))
    )
    wide = wide_matrix(rounded(daily, 4, "total"), "event_type", "day", "total", block=16)
    return wide.orderBy(F.col(f"`{wide.columns[-1]}`").desc())


@query(
    "members_list",
    """
    select r_name, 0::bigint as part, string_agg(n_name, ',' order by n_name) as members
    from nation join region on n_regionkey = r_regionkey group by 1""",
)
def members_of_regions(spark, sf):
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    lists = members_list(nations, "r_name", "n_name")
    return lists.select("r_name", "part", F.array_join("members", ",").alias("members"))
