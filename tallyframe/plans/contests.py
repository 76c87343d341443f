"""Outcome shares, opponents, places and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import flag, number_in, or_default, part_at
from tallyframe.operators.aggregates import pivot_agg, share_of, share_within
from tallyframe.operators.joins import lookup_join
from tallyframe.operators.outcomes import opponents, takes_part
from tallyframe.operators.ranges import top_dense
from tallyframe.plans.registry import query, rnd, rounded
from tallyframe.sources.tables import table

TEAM = "NATION_3"
OUTCOMES = ["lose", "tie", "win"]


def games(spark, sf):
    """A line item is a contest of the customer's nation (side a) with the supplier's (side b)."""
    nation = table(spark, sf, "nation")
    side_a = nation.select(F.col("n_nationkey").alias("na"), F.col("n_name").alias("side_a"))
    side_b = nation.select(F.col("n_nationkey").alias("nb"), F.col("n_name").alias("side_b"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"
    )
    outcome = flag(
        [(F.col("l_returnflag") == "R", "win"), (F.col("l_returnflag") == "N", "tie")], "lose"
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(side_a, F.col("c_nationkey") == F.col("na"))
        .join(side_b, F.col("s_nationkey") == F.col("nb"))
        .select("l_orderkey", "l_linenumber", "side_a", "side_b", outcome.alias("outcome"))
    )


GAMES = """
with games as (
  select l_orderkey, l_linenumber, a.n_name as side_a, b.n_name as side_b,
         case l_returnflag when 'R' then 'win' when 'N' then 'tie' else 'lose' end as outcome
  from lineitem
  join orders on l_orderkey = o_orderkey
  join supplier on l_suppkey = s_suppkey
  join customer on o_custkey = c_custkey
  join nation a on c_nationkey = a.n_nationkey
  join nation b on s_nationkey = b.n_nationkey)
"""


@query(
    "outcome_share",
    f"""
    with picked as (
      select c_nationkey, c_mktsegment, o_orderpriority,
             case when o_orderstatus = 'F' then 'win'
                  when o_orderstatus = 'O' then 'tie' else 'lose' end as outcome
      from orders join customer on o_custkey = c_custkey
      where c_mktsegment = 'BUILDING' or o_orderpriority = '1-URGENT')
    select outcome, count(*) as n,
           {rnd('count(*) * 100.0 / (select count(*) from (select distinct * from picked))', 6)}
             as percentage
    from picked group by outcome""",
)
def outcome_share(spark, sf):
    """Share of each outcome among the picked rows, over the number of distinct rows."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    outcome = flag(
        [(F.col("o_orderstatus") == "F", "win"), (F.col("o_orderstatus") == "O", "tie")], "lose"
    )
    picked = (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .filter((F.col("c_mktsegment") == "BUILDING") | (F.col("o_orderpriority") == "1-URGENT"))
        .select("c_nationkey", "c_mktsegment", "o_orderpriority", outcome.alias("outcome"))
    )
    return rounded(share_of(picked, "outcome", "distinct"), 6, "percentage")


@query(
    "outcome_share_home_away",
    f"""
    with places as (
      select distinct s_nationkey as place,
             case when s_acctbal > 5000 then 'home' else 'away' end as home_flag
      from supplier join nation on s_nationkey = n_nationkey
      join region on n_regionkey = r_regionkey where r_name <> 'ASIA'),
    played as (
      select case l_returnflag when 'R' then 'win' when 'N' then 'tie' else 'lose' end as outcome,
             coalesce(home_flag, 'away') as home_flag
      from lineitem join supplier on l_suppkey = s_suppkey
      left join places on s_nationkey = place),
    counts as (select outcome, home_flag, count(*) as n from played group by all),
    totals as (select home_flag, sum(n) as total from counts group by all)
    select counts.home_flag, outcome, n, cast(total as bigint) as total,
           {rnd('n * 100.0 / total', 6)} as percentage
    from counts join totals using (home_flag) order by 1, 2""",
)
def outcome_share_home_away(spark, sf):
    """Shares at home and away; a place with both flags counts twice, an unknown one is away."""
    suppliers = table(spark, sf, "supplier")
    known = (
        suppliers.join(
            table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("r_name") != "ASIA")
    )
    places = known.select(
        F.col("s_nationkey").alias("place"),
        flag([(F.col("s_acctbal") > 5000, "home")], "away").alias("home_flag"),
    ).distinct()
    outcome = flag(
        [(F.col("l_returnflag") == "R", "win"), (F.col("l_returnflag") == "N", "tie")], "lose"
    )
    # Counts per supplier and outcome are all that has to meet the lookups.
    per_supplier = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    per_place = (
        per_supplier.join(
            suppliers.select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .groupBy("s_nationkey", "outcome")
        .agg(F.sum("m").alias("m"))
    )
    played = lookup_join(per_place, places, {"s_nationkey": "place"}).withColumn(
        "home_flag", or_default(F.col("home_flag"), "away")
    )
    counts = played.groupBy("home_flag", "outcome").agg(F.sum("m").alias("n"))
    shares = rounded(share_within(counts, ["home_flag"]), 6, "percentage")
    return shares.orderBy("home_flag", "outcome")


@query(
    "pair_counts_either_side",
    GAMES
    + f"""
    select team, count(l_linenumber) as n from (
      select side_b as team, l_linenumber from games where side_a = '{TEAM}'
      union all
      select side_a, l_linenumber from games where side_b = '{TEAM}')
    group by team order by team""",
)
def pair_counts_either_side(spark, sf):
    met = opponents(games(spark, sf), "side_a", "side_b", TEAM, "team")
    return met.groupBy("team").agg(F.count("l_linenumber").alias("n")).orderBy("team")


@query(
    "pair_outcomes_pivot",
    GAMES
    + f"""
    , met as (
      select side_b as team, outcome from games where side_a = '{TEAM}'
      union all
      select side_a, outcome from games where side_b = '{TEAM}')
    select team,
           nullif(count(*) filter (outcome = 'lose'), 0)::double as lose,
           nullif(count(*) filter (outcome = 'tie'), 0)::double as tie,
           nullif(count(*) filter (outcome = 'win'), 0)::double as win
    from met group by team order by team""",
)
def pair_outcomes_pivot(spark, sf):
    """Counts per opponent with the outcomes as columns; an outcome that never came is null."""
    met = opponents(games(spark, sf), "side_a", "side_b", TEAM, "team")
    counts = met.groupBy("team", "outcome").agg(F.count("l_linenumber").alias("n"))
    wide = pivot_agg(counts, ["team"], "outcome", OUTCOMES, F.sum("n").cast("double"))
    return wide.orderBy("team")


@query(
    "top5_places_by_flag",
    """
    with counts as (
      select n_name as place,
             case when c_mktsegment = 'BUILDING' then 'home' else 'away' end as home_flag,
             count(*) as n
      from orders join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey group by all),
    ranked as (
      select *, dense_rank() over (partition by home_flag order by n desc) as rank from counts)
    select place, home_flag, n, rank from ranked where rank <= 5""",
)
def top5_places_by_flag(spark, sf):
    """The five highest counts per flag with all ties."""
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        flag([(F.col("c_mktsegment") == "BUILDING", "home")], "away").alias("home_flag"),
    )
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("m")
    )
    counts = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("place", "home_flag")
        .agg(F.sum("m").alias("n"))
    )
    return top_dense(counts, ["home_flag"], "n", 5, "rank")


@query(
    "avg_margin_by_year_pivot",
    f"""
    with played as (
      select strftime(l_shipdate, '%Y') as year, l_quantity as margin,
             case l_returnflag when 'R' then 'win' when 'N' then 'tie' else 'lose' end as outcome
      from lineitem where l_linestatus = 'F' and l_tax > 0.0)
    select year,
           coalesce({rnd("avg(margin) filter (outcome = 'lose')", 2)}, 0) as lose,
           coalesce({rnd("avg(margin) filter (outcome = 'tie')", 2)}, 0) as tie,
           coalesce({rnd("avg(margin) filter (outcome = 'win')", 2)}, 0) as win
    from played group by year order by year""",
)
def avg_margin_by_year_pivot(spark, sf):
    """Margins and dates arrive as text and are taken apart again.

    A margin reads "23 runs", "4 wickets" or a single word; only the first kind counts.
    """
    unit = flag([(F.col("l_linestatus") == "F", " runs")], " wickets")
    amount = F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_tax") > 0.0, amount).otherwise("forfeited").alias("margin"),
        F.date_format("l_shipdate", "MMM d, yyyy").alias("day"),
        flag(
            [(F.col("l_returnflag") == "R", "win"), (F.col("l_returnflag") == "N", "tie")],
            "lose",
        ).alias("outcome"),
    )
    runs = (
        lines.withColumn("amount", number_in(part_at(F.col("margin"), " ", 0)))
        .filter(part_at(F.col("margin"), " ", 1) == "runs")
        .withColumn("year", F.trim(part_at(F.col("day"), ",", 1)))
    )
    return pivot_agg(runs, ["year"], "outcome", OUTCOMES, F.avg("amount"), 2, 0).orderBy("year")


@query(
    "filter_or",
    GAMES
    + f"""
    select l_orderkey, l_linenumber, side_a, side_b, outcome from games
    where side_a = '{TEAM}' or side_b = '{TEAM}'""",
)
def filter_or(spark, sf):
    return games(spark, sf).filter(takes_part("side_a", "side_b", TEAM))
