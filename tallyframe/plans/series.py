"""Cumulative series: checks, preparation, ranking, growth, forecast and threshold dates.

Entities are users, their parents the five event types; a day's cumulative value is the running
sum of the daily totals.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.dates import day_text
from tallyframe.operators import forecast as FC
from tallyframe.operators.aggregates import describe_exact, multi_stat
from tallyframe.operators.ranges import dense_rank_all
from tallyframe.operators.series import (
    cumulative_check,
    gap_counts,
    match_rates,
    on_last_day,
    prepare_series,
    quality_report,
)
from tallyframe.plans.registry import query, rnd, rounded
from tallyframe.sources.tables import staged, table

DECAY = 0.97


def daily(spark, sf):
    """One row per user and day with the day's total and largest value; not cumulative."""
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak"))
    )


DAILY = """
with daily as (
  select user_id, ts::date as day, round(sum(value), 4) as total, max(value) as peak
  from events group by all)
"""


@query(
    "cumulative_check",
    DAILY
    + """
    , latest as (select * from daily where day = (select max(day) from daily)),
    top as (select user_id, max(total) as total, max(peak) as peak from daily group by 1)
    select user_id, latest.total as total_last, latest.peak as peak_last, top.total as total_max,
           top.peak as peak_max, latest.total = top.total as total_agrees,
           latest.peak = top.peak as peak_agrees
    from latest join top using (user_id)""",
)
def check_cumulative(spark, sf):
    return cumulative_check(daily(spark, sf), "user_id", "day", ["total", "peak"])


@query(
    "cumulative_match_rates",
    DAILY
    + f"""
    , latest as (select * from daily where day = (select max(day) from daily)),
    top as (select user_id, max(total) as total, max(peak) as peak from daily group by 1)
    select {rnd('avg((latest.total = top.total)::int)', 8)} as total_rate,
           {rnd('avg((latest.peak = top.peak)::int)', 8)} as peak_rate
    from latest join top using (user_id)""",
)
def cumulative_match_rates(spark, sf):
    measures = ["total", "peak"]
    check = cumulative_check(daily(spark, sf), "user_id", "day", measures)
    return rounded(match_rates(check, measures), 8, "total_rate", "peak_rate")


def _prepared_sql(source: str, entity: str, date: str, measures: list[str]) -> str:
    """SQL of the prepared series, with windows over the whole entity."""
    over = f"over (partition by {entity} order by {date})"
    runs = ", ".join(f"max({m}) {over} as {m}" for m in measures)
    prev = ", ".join(f"coalesce(lag({m}) {over}, {m}) as prev_{m}" for m in measures)
    out = ", ".join(
        f"{m}, ln(1 + {m}) as log_{m}, prev_{m}, ln(1 + prev_{m}) as prev_log_{m}, "
        f"{m} - prev_{m} as delta_{m}, ln(1 + {m}) - ln(1 + prev_{m}) as delta_log_{m}"
        for m in measures
    )
    return f"""
      select {entity}, {date}, prev_date,
             date_diff('day', prev_date::date, {date}::date) as gap_days, {out}
      from (select *, {prev}, coalesce(lag({date}) {over}, {date}) as prev_date
            from (select {entity}, {date}, {runs} from {source}))"""


_VALUES = [
    f"{a}{m}"
    for m in ("total", "peak")
    for a in ("", "log_", "prev_", "prev_log_", "delta_", "delta_log_")
]
_ROUNDED = ", ".join(f"{rnd(v, 6)} as {v}" for v in _VALUES)


@query(
    "series_prepare",
    DAILY
    + f"""
    select user_id, strftime(day, '%Y-%m-%d') as day, strftime(prev_date, '%Y-%m-%d') as prev_date,
           gap_days, {_ROUNDED}
    from ({_prepared_sql('daily', 'user_id', 'day', ['total', 'peak'])})""",
)
def series_prepare(spark, sf):
    """Running maximum, logs, previous row and changes per user; one row per user and day."""
    out = prepare_series(daily(spark, sf), ["user_id"], "day", ["total", "peak"])
    out = out.withColumns(
        {
            "day": day_text(F.col("day")),
            "prev_date": day_text(F.col("prev_date")),
            "gap_days": F.col("gap_days").cast("bigint"),
        }
    )
    return rounded(out, 6, *_VALUES)


_FINE = [
    f"{a}value" for a in ("", "log_", "prev_", "prev_log_", "delta_", "delta_log_")
]


@query(
    "series_prepare_by_chunk",
    f"""
    select event_type, epoch_us(ts)::bigint as at, epoch_us(prev_date)::bigint as prev_at,
           gap_days, {', '.join(f'{rnd(v, 6)} as {v}' for v in _FINE)}
    from ({_prepared_sql('events', 'event_type', 'ts', ['value'])})""",
)
def series_prepare_by_chunk(spark, sf):
    """The same on every single event of five hot entities, each split into days."""
    events = table(spark, sf, "events").select("event_type", "ts", "value")
    out = prepare_series(events, ["event_type"], "ts", ["value"], chunk=F.to_date("ts"))
    micros = {
        n: F.unix_micros(F.col(c).cast("timestamp")) for n, c in
        (("at", "ts"), ("prev_at", "prev_date"))
    }
    out = out.withColumns({**micros, "gap_days": F.col("gap_days").cast("bigint")})
    return rounded(out.drop("ts", "prev_date"), 6, *_FINE)


@query(
    "series_prepare_ties",
    f"""
    with rows as (
      select event_id, case when user_id % 3 = 0 then 'busy' else event_type end as entity,
             date_trunc('hour', ts) as tick, value from events),
    ticks as (select entity, tick, max(value) as value from rows group by all),
    scanned as ({_prepared_sql('ticks', 'entity', 'tick', ['value'])})
    select event_id, entity, epoch_us(tick)::bigint as at, epoch_us(prev_date)::bigint as prev_at,
           gap_days, {', '.join(f'{rnd(f"scanned.{v}", 6)} as {v}' for v in _FINE)}
    from rows join scanned using (entity, tick)""",
)
def series_prepare_ties(spark, sf):
    """Many events of one hour, and an entity that holds a third of all of them."""
    busy = F.when(F.col("user_id") % 3 == 0, F.lit("busy")).otherwise(F.col("event_type"))
    events = table(spark, sf, "events").select(
        "event_id",
        busy.alias("entity"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"),
        "value",
    )
    out = prepare_series(events, ["entity"], "at", ["value"], rows_per_chunk=1_000)
    micros = {
        "prev_at": F.unix_micros("prev_date"),
        "at": F.unix_micros("at"),
        "gap_days": F.col("gap_days").cast("bigint"),
    }
    return rounded(out.withColumns(micros).drop("prev_date"), 6, *_FINE)


@query(
    "date_gap_counts",
    DAILY
    + f"""
    select user_id, gap_days, count(*) as rows
    from ({_prepared_sql('daily', 'user_id', 'day', ['total', 'peak'])})
    group by all having count(*) between 2 and 68""",
)
def date_gap_counts(spark, sf):
    prepared = prepare_series(daily(spark, sf), ["user_id"], "day", ["total", "peak"])
    out = gap_counts(prepared, ["user_id"], 2, 68)
    return out.withColumn("gap_days", F.col("gap_days").cast("bigint"))


@query(
    "quality_report",
    """
    with rows as (
      select c_custkey, n_name as parent,
             case when c_mktsegment = 'FURNITURE' then '' else c_mktsegment end as child,
             c_mktsegment as entity, o_orderdate::date as day,
             round(sum(o_totalprice), 2) as spent
      from orders join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey group by all),
    latest as (
      select entity, max(spent) as v from rows
      where day = (select max(day) from rows) group by 1),
    top as (select entity, max(spent) as v from rows group by 1)
    select 'ambiguous_key' as "check", entity as subject, count(distinct parent)::double as value
    from rows group by entity having count(distinct parent) > 1
    union all
    select 'partly_missing', parent, count(distinct child)::double from rows group by parent
    having count(distinct child) > 1 and max((child = '')::int) = 1
    union all
    select 'match_rate', 'spent', avg((latest.v = top.v)::int) from latest join top using (entity)
    """,
)
def report_quality(spark, sf):
    segment = F.col("c_mktsegment")
    rows = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            "c_custkey",
            F.col("n_name").alias("parent"),
            F.when(segment == "FURNITURE", "").otherwise(segment).alias("child"),
            segment.alias("entity"),
            F.to_date("o_orderdate").alias("day"),
        )
        .agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )
    return quality_report(rows, "parent", "child", "entity", "day", ["spent"])


def cumulative(spark, sf):
    """Cumulative cases and losses per (event type, user): running sums over the known days.

    The window runs over one row per day, so its partitions are bounded by the calendar.
    """
    so_far = (
        W.partitionBy("event_type", "user_id")
        .orderBy("day")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    rows = (
        table(spark, sf, "events")
        .groupBy("event_type", "user_id", F.to_date("ts").alias("day"))
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("cents"), F.count("value").alias("m"))
    )
    return rows.select(
        "event_type",
        "user_id",
        "day",
        F.sum("cents").over(so_far).cast("double").alias("cases"),
        (F.sum("m").over(so_far) - 1).cast("double").alias("losses"),
    )


def clean(spark, sf):
    return prepare_series(
        cumulative(spark, sf), ["event_type", "user_id"], "day", ["cases", "losses"]
    )


CUMULATIVE = """
with per_day as (
  select event_type, user_id, ts::date as day, sum(value::decimal(18,2)) as cents,
         count(value) as m
  from events group by all),
cumulative as (
  select event_type, user_id, day,
         (sum(cents) over w)::double as cases, (sum(m) over w - 1)::double as losses
  from per_day window w as (partition by event_type, user_id order by day)),
clean as (
  select *, ln(1 + cases) as log_cases, ln(1 + losses) as log_losses,
         cases - prev_cases as delta_cases, losses - prev_losses as delta_losses,
         ln(1 + cases) - ln(1 + prev_cases) as delta_log_cases,
         ln(1 + losses) - ln(1 + prev_losses) as delta_log_losses
  from (select *, coalesce(lag(cases) over w, cases) as prev_cases,
               coalesce(lag(losses) over w, losses) as prev_losses
        from cumulative window w as (partition by event_type, user_id order by day)))
"""

RANKED = (
    CUMULATIVE
    + """
, totals as (
  select user_id, round(sum(cases), 2) as cases, sum(losses) as losses from clean
  where cases > 0 and day = (select max(day) from clean where cases > 0) group by 1),
ranked as (
  select *, dense_rank() over (order by cases desc) as case_rank,
         dense_rank() over (order by losses desc) as loss_rank from totals)
"""
)


def _ranked(rows):
    """Totals per user on the last day, ranked by either measure over all users."""
    totals = (
        on_last_day(rows, "day")
        .groupBy("user_id")
        .agg(F.round(F.sum("cases"), 2).alias("cases"), F.sum("losses").alias("losses"))
    )
    totals = staged(totals, "totals")  # read several times by the ranking
    by_cases = dense_rank_all(totals, "cases", "case_rank")
    return dense_rank_all(by_cases, "losses", "loss_rank")


@query(
    "rank_last_day",
    RANKED + "select * from ranked order by case_rank, loss_rank, user_id limit 10",
)
def rank_last_day(spark, sf):
    rows = cumulative(spark, sf).filter(F.col("cases") > 0)
    return _ranked(rows).orderBy("case_rank", "loss_rank", "user_id").limit(10)


@query("rank_all_users", RANKED + "select user_id, cases, losses, case_rank, loss_rank from ranked")
def rank_all_users(spark, sf):
    return _ranked(cumulative(spark, sf).filter(F.col("cases") > 0))


_DELTAS = ["delta_cases", "delta_losses", "delta_log_cases", "delta_log_losses"]
_GROWN = [f"{d}_{s}" for d in _DELTAS for s in ("mean", "median")]


@query(
    "growth_top10_stats",
    RANKED
    + ", grown as (select user_id, "
    + ", ".join(
        f"avg({d}) as {d}_mean, quantile_cont({d}, 0.5) as {d}_median" for d in _DELTAS
    )
    + " from clean join ranked using (user_id) where case_rank <= 10 and clean.cases > 0 "
    + "group by 1) "
    + " union all ".join(
        f"""
        select '{g}' as "column", count({g}) as count, {rnd(f'avg({g})', 5)} as mean,
               {rnd(f'stddev_samp({g})', 5)} as std, {rnd(f'min({g})', 5)} as min,
               {rnd(f'quantile_cont({g}, 0.25)', 5)} as q25,
               {rnd(f'quantile_cont({g}, 0.5)', 5)} as q50,
               {rnd(f'quantile_cont({g}, 0.75)', 5)} as q75, {rnd(f'max({g})', 5)} as max
        from grown"""
        for g in _GROWN
    ),
)
def growth_top10_stats(spark, sf):
    """Mean and median change per day of the ten highest users, and a summary of these."""
    rows = staged(clean(spark, sf), "clean").filter(F.col("cases") > 0)
    top = _ranked(rows.select("user_id", "day", "cases", "losses")).filter("case_rank <= 10")
    kept = rows.select("user_id", *_DELTAS).join(top.select("user_id"), "user_id")
    grown = multi_stat(kept, ["user_id"], {d: ["mean", "median"] for d in _DELTAS})
    grown = staged(grown, "grown")
    out = describe_exact(grown, _GROWN)
    return rounded(out, 5, "mean", "std", "min", "q25", "q50", "q75", "max")


FEATURES = (
    CUMULATIVE
    + """
, a as (select user_id, avg(delta_log_cases) as growth, avg(delta_cases) as change,
               sum(cases) as cases from clean where cases > 0 group by 1),
b as (select user_id, avg(delta_log_losses) as loss_growth, avg(delta_losses) as loss_change,
             sum(losses) as losses from clean where cases > 0 and losses > 0 group by 1),
features as (
  select user_id, growth, change, cases, coalesce(loss_growth, 0) as loss_growth,
         coalesce(loss_change, 0) as loss_change, coalesce(losses, 0) as losses
  from a left join b using (user_id))
"""
)


@query(
    "entity_features",
    FEATURES
    + f"""
    select user_id, {rnd('growth', 6)} as growth, {rnd('change', 6)} as change,
           {rnd('cases', 2)} as cases, {rnd('loss_growth', 6)} as loss_growth,
           {rnd('loss_change', 6)} as loss_change, losses
    from features""",
)
def entity_features_query(spark, sf):
    out = entity_features(clean(spark, sf))
    return rounded(rounded(out, 6, "growth", "change", "loss_growth", "loss_change"), 2, "cases")


def entity_features(rows):
    """Mean changes and sums per user; the losses only over rows that have some, else 0.

    One pass: the aggregates of the losses skip the rows without any.
    """
    lossy = F.col("losses") > 0
    known = rows.filter(F.col("cases") > 0)
    return (
        known.groupBy("user_id")
        .agg(
            F.avg("delta_log_cases").alias("growth"),
            F.avg("delta_cases").alias("change"),
            F.sum("cases").alias("cases"),
            F.avg(F.when(lossy, F.col("delta_log_losses"))).alias("loss_growth"),
            F.avg(F.when(lossy, F.col("delta_losses"))).alias("loss_change"),
            F.sum(F.when(lossy, F.col("losses"))).alias("losses"),
        )
        .fillna(0)
    )


# A stand-in for cluster labels, so that SQL can say the same: the key modulo 8.
_LOGS = ["log_cases", "delta_log_cases", "log_losses", "delta_log_losses"]

GROWTH = (
    CUMULATIVE
    + f"""
, labelled as (select *, user_id % 8 as cluster from clean where losses > 0),
products as (
  select cluster, user_id, day, {', '.join(f'product({c}) as {c}' for c in _LOGS)}
  from labelled group by all),
spread as (
  select cluster, day, {', '.join(f'stddev_samp({c}) as {c}' for c in _LOGS)}
  from products group by all),
by_cluster as (
  select cluster, {', '.join(f'avg({c}) as {c}' for c in _LOGS)} from spread group by 1),
own as (
  select user_id, cluster, {', '.join(f'avg({c}) as {c}' for c in _LOGS)}
  from labelled group by all),
chosen as (
  select user_id, cluster, {', '.join(f'greatest(own.{c}, by_cluster.{c}) as {c}' for c in _LOGS)}
  from own left join by_cluster using (cluster))
"""
)


def _labelled(spark, sf):
    rows = clean(spark, sf).filter(F.col("losses") > 0)
    return rows.withColumn("cluster", F.col("user_id") % 8)


def chosen(labelled):
    by_cluster = FC.cluster_growth(labelled, "cluster", "user_id", "day", _LOGS)
    own = FC.own_growth(labelled, "cluster", "user_id", _LOGS)
    return FC.chosen_growth(own, by_cluster, "cluster", _LOGS)


@query(
    "product_std_mean_chain",
    GROWTH + f"select cluster, {', '.join(f'{rnd(c, 4)} as {c}' for c in _LOGS)} from by_cluster",
)
def product_std_mean_chain(spark, sf):
    out = FC.cluster_growth(_labelled(spark, sf), "cluster", "user_id", "day", _LOGS)
    return rounded(out, 4, *_LOGS)


@query(
    "growth_params_choice",
    GROWTH
    + f"select user_id, cluster, {', '.join(f'{rnd(c, 4)} as {c}' for c in _LOGS)} from chosen",
)
def growth_params_choice(spark, sf):
    return rounded(chosen(_labelled(spark, sf)), 4, *_LOGS)


FORECAST = (
    CUMULATIVE
    + """
, series as (
  select user_id, day, ln(1 + sum(cases)) as log_cases, ln(1 + sum(losses)) as log_losses
  from (select user_id, day, sum(cents) over w as cases, sum(m) over w as losses
        from (select user_id, ts::date as day, sum(value::decimal(18,2))::double as cents,
                     count(value) as m
              from events group by all)
        window w as (partition by user_id order by day))
  group by all),
growth as (
  select user_id, avg(log_cases - prev_cases) as case_growth,
         avg(log_losses - prev_losses) as loss_growth
  from (select *, coalesce(lag(log_cases) over w, log_cases) as prev_cases,
               coalesce(lag(log_losses) over w, log_losses) as prev_losses
        from series window w as (partition by user_id order by day)) group by 1),
bounds as (select max(day) as train_end from series),
last_rows as (
  select * from (
    select * from series qualify row_number() over (partition by user_id order by day desc) = 1)
  join growth using (user_id), bounds),
predicted as (
  select user_id, day, log_cases, log_losses from series
  union all
  select user_id, (day + n::int)::date,
         log_cases + case_growth * (1 - pow(0.97, n)) / (1 - 0.97),
         log_losses + loss_growth * (1 - pow(0.97, n)) / (1 - 0.97)
  from (select *, unnest(generate_series(1, 31 + (train_end - day))) as n from last_rows))
"""
)


def whole_series(spark, sf):
    """Log cumulative value and count per user and day."""
    so_far = W.partitionBy("user_id").orderBy("day").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    rows = (
        table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("cents"), F.count("value").alias("m"))
    ).select(
        "user_id",
        "day",
        F.sum("cents").over(so_far).cast("double").alias("cases"),
        F.sum("m").over(so_far).cast("double").alias("losses"),
    )
    return prepare_series(rows, ["user_id"], "day", ["cases", "losses"])


def _forecast(spark, sf):
    series = whole_series(spark, sf)
    growth = series.groupBy("user_id").agg(
        F.avg("delta_log_cases").alias("case_growth"),
        F.avg("delta_log_losses").alias("loss_growth"),
    )
    end = series.agg(F.max("day").alias("end"))
    return FC.forecast(
        series,
        ["user_id"],
        "day",
        growth,
        {"log_cases": "case_growth", "log_losses": "loss_growth"},
        DECAY,
        None,
        F.date_add(end.scalar(), 31),
    )


@query(
    "decay_forecast",
    FORECAST
    + f"""
    select user_id, strftime(day, '%Y-%m-%d') as day, {rnd('log_cases', 6)} as log_cases,
           {rnd('log_losses', 6)} as log_losses from predicted""",
)
def decay_forecast(spark, sf):
    """History and the days up to 31 after the table's last, of every user, in closed form."""
    out = _forecast(spark, sf).withColumn("day", day_text(F.col("day")))
    return rounded(out, 6, "log_cases", "log_losses")


@query(
    "forecast_submission",
    FORECAST
    + f"""
    , wanted as (
      select user_id * 100 + n as forecast_id, user_id, (train_end - 10 + n::int)::date as day
      from (select distinct user_id from events), bounds,
           (select unnest(generate_series(1, 40)) as n))
    select forecast_id, {rnd('exp(coalesce(log_cases, 0)) - 1', 3)} as cases,
           {rnd('exp(coalesce(log_losses, 0)) - 1', 3)} as losses
    from wanted w asof left join predicted p on w.user_id = p.user_id and w.day >= p.day""",
)
def forecast_submission(spark, sf):
    """Counts for every wanted id: 40 days per user from nine days before the end.

    A day without a row has the count of the last one before; before the first row there is none.
    """
    end = table(spark, sf, "events").agg(F.max(F.to_date("ts")).alias("end"))
    wanted = (
        table(spark, sf, "events")
        .select("user_id")
        .distinct()
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40))))
        .select(
            (F.col("user_id") * 100 + F.col("n")).alias("forecast_id"),
            "user_id",
            F.date_add(F.date_sub(end.scalar(), 10), F.col("n")).alias("day"),
        )
    )
    every_day = FC.carried_days(_forecast(spark, sf), ["user_id"], "day")
    counts = FC.from_logs(every_day, keep=["user_id"])
    out = wanted.join(counts, ["user_id", "day"], "left").select(
        "forecast_id",
        F.coalesce("log_cases", F.lit(0.0)).alias("cases"),
        F.coalesce("log_losses", F.lit(0.0)).alias("losses"),
    )
    return rounded(out, 3, "cases", "losses")


def _first_step_sql(value: str, change: str, threshold: int) -> str:
    """The first step at which the rounded count is reached: the solved step or a neighbour."""
    lift = f"(ln(1 + {threshold} - 0.5) - {value})"
    guess = f"""case when {change} > 0 and 1 - {lift} * (1 - 0.97) / {change} > 0 then
        ceil(ln(1 - {lift} * (1 - 0.97) / {change}) / ln(0.97)) end"""
    count = f"exp({value} + {change} * (1 - pow(0.97, n)) / (1 - 0.97)) - 1"
    return f"""list_min(list_filter([1, g - 2, g - 1, g, g + 1, g + 2],
        lambda n: n >= 1 and round_even({count}, 0) >= {threshold})) from (select *, {guess} as g"""


@query(
    "threshold_dates",
    FORECAST
    + f"""
    , by_cases as (
      select user_id, day, {_first_step_sql('log_cases', 'case_growth', 6000)} from last_rows)),
    by_losses as (
      select user_id, {_first_step_sql('log_losses', 'loss_growth', 400)} from last_rows))
    select user_id, strftime(day + c.n::int, '%Y-%m-%d') as cases_day,
           strftime(day + l.n::int, '%Y-%m-%d') as losses_day
    from by_cases c(user_id, day, n) join by_losses l(user_id, n) using (user_id)""",
)
def threshold_dates(spark, sf):
    """The first day on which each user's forecast reaches 6000 cases, and 400 losses."""
    series = whole_series(spark, sf)
    growth = series.groupBy("user_id").agg(
        F.avg("delta_log_cases").alias("case_growth"),
        F.avg("delta_log_losses").alias("loss_growth"),
    )
    last = FC.last_rows_of(series, ["user_id"], "day", ["log_cases", "log_losses"])
    last = last.join(growth, "user_id")
    out = FC.threshold_date(last, "day", "log_cases", "case_growth", DECAY, 6000, "cases_day")
    out = FC.threshold_date(out, "day", "log_losses", "loss_growth", DECAY, 400, "losses_day")
    days = [day_text(F.col(c)).alias(c) for c in ("cases_day", "losses_day")]
    return out.select("user_id", *days)
