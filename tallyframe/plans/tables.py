"""Projections, filters, joins, set operations and text or date functions on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tallyframe.functions import columns as C
from tallyframe.functions import dates as D
from tallyframe.operators import joins as J
from tallyframe.operators.aggregates import column_profile, share_within, sum_of_counts
from tallyframe.operators.ranges import top_dense
from tallyframe.operators.series import ambiguous_keys, on_last_day, partly_missing, with_location
from tallyframe.plans.registry import query, rnd, rounded
from tallyframe.session import shared_path
from tallyframe.sources.tables import last_rows, read_csv, staged, table, write_csv


def _within(spark, sf, keep_unmatched):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.to_date("o_orderdate").alias("order_day")
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("line_key"),
        F.to_date("l_shipdate").alias("ship_day"),
        F.col("l_returnflag").alias("name"),
    )
    return J.count_within_days(
        orders, lines, {"order_key": "line_key"}, "order_day", "ship_day", "name", 1, 10,
        keep_unmatched,
    )


_DAYS = "date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date))"


@query(
    "within_days_left_on",
    f"""
    select l_returnflag as name, count(o_orderkey) as n
    from orders left join lineitem on o_orderkey = l_orderkey and l_shipdate >= o_orderdate
      and {_DAYS} between 1 and 10
    group by 1""",
)
def within_days_left_on(spark, sf):
    """Range inside the join: orders without a shipment stay, under a null name."""
    return _within(spark, sf, keep_unmatched=True)


@query(
    "within_days_left_filter",
    f"""
    select l_returnflag as name, count(o_orderkey) as n
    from orders left join lineitem on o_orderkey = l_orderkey
    where l_shipdate >= o_orderdate and {_DAYS} between 1 and 10
    group by 1""",
)
def within_days_left_filter(spark, sf):
    """Range after the join: it rejects nulls, so orders without a shipment go."""
    return _within(spark, sf, keep_unmatched=False)


@query(
    "day_range_pairs",
    f"""
    select o_orderkey, l_linenumber::double as l_linenumber,
           strftime(l_shipdate, '%Y-%m-%d') as ship_day
    from orders left join lineitem on o_orderkey = l_orderkey and {_DAYS} between 1 and 10""",
)
def day_range_pairs(spark, sf):
    """The pairs themselves, with unmatched orders kept."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("order_day")
    )
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("double").alias("l_linenumber"),
        F.to_date("l_shipdate").alias("ship"),
    )
    pairs = J.day_range_join(
        orders, lines, {"o_orderkey": "l_orderkey"}, "order_day", "ship", 1, 10
    )
    return pairs.select("o_orderkey", "l_linenumber", D.day_text(F.col("ship")).alias("ship_day"))


@query(
    "latest_per_group_join",
    """
    select o_orderkey, o_custkey, strftime(latest, '%Y-%m-%d') as latest
    from orders join (select o_custkey, max(o_orderdate) as latest from orders group by 1)
      using (o_custkey)""",
)
def latest_per_group_join(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = J.with_group_max(orders, ["o_custkey"], "o_orderdate", "latest")
    return out.select("o_orderkey", "o_custkey", D.day_text(F.col("latest")).alias("latest"))


@query(
    "latest_per_group_window",
    """
    select o_orderkey, o_custkey, latest = o_orderdate as is_latest from (
      select o_orderkey, o_custkey, o_orderdate,
             max(o_orderdate) over (partition by o_custkey) as latest from orders)""",
)
def latest_per_group_window(spark, sf):
    """The maximum over a row's whole group, computed without holding the group in one task."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = J.with_group_max(orders, ["o_custkey"], "o_orderdate", "latest")
    return out.select(
        "o_orderkey", "o_custkey", (F.col("latest") == F.col("o_orderdate")).alias("is_latest")
    )


@query(
    "date_text_roundtrip",
    """
    select o_orderkey, epoch(o_orderdate)::bigint as seconds,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as stamp,
           strftime(o_orderdate, '%Y-%m-%d') as day,
           date_diff('day', cast(o_orderdate as date) + 2, cast(o_orderdate as date)) as signed,
           date_diff('day', cast(o_orderdate as date) + 2, cast(o_orderdate as date))
             between 1 and 10 as within,
           cast(null as double) as as_number
    from orders""",
)
def date_text_roundtrip(spark, sf):
    text = F.date_format("o_orderdate", D.STAMP_FORMAT)
    day = D.day_of(F.col("stamp"))
    later = F.date_add(day, 2)
    return (
        table(spark, sf, "orders")
        .withColumn("seconds", D.epoch_seconds(text))
        .withColumn("stamp", D.stamp_text(F.col("seconds")))
        .select(
            "o_orderkey",
            "seconds",
            "stamp",
            D.day_text(day).alias("day"),
            F.datediff(day, later).cast("bigint").alias("signed"),
            D.days_within(day, later, 1, 10).alias("within"),
            F.col("stamp").try_cast("float").cast("double").alias("as_number"),
        )
    )


_LABELLED = "documents left join labels using (doc_id)"


@query(
    "csv_roundtrip_keep_empty",
    f"""
    select doc_id, md5(text) as digest, length(text) as chars, source,
           coalesce(quality::varchar, '') as quality
    from {_LABELLED}""",
)
def csv_roundtrip_keep_empty(spark, sf):
    """Whole texts with quotes and line breaks, and missing labels, through a CSV folder."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    path = shared_path(spark, "documents-csv")
    write_csv(docs.select("doc_id", "text", "source", F.col("quality").cast("string")), path)
    schema = (
        StructType()
        .add("doc_id", LongType())
        .add("text", StringType())
        .add("source", StringType())
        .add("quality", StringType())
    )
    back = read_csv(spark, path, schema, keep_empty=True)
    chars = F.char_length("text").cast("bigint")
    return back.select(
        "doc_id", F.md5("text").alias("digest"), chars.alias("chars"), "source", "quality"
    )


@query(
    "csv_missing_tokens",
    f"""
    select doc_id, source, quality::double as quality, toxic::double as toxic
    from {_LABELLED}""",
)
def csv_missing_tokens(spark, sf):
    """Missing numbers written as "NA" come back as nulls of the declared type."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    path = shared_path(spark, "labels-csv")
    as_text = [C.or_default(F.col(c).cast("string"), "NA").alias(c) for c in ("quality", "toxic")]
    write_csv(docs.select("doc_id", "source", *as_text), path)
    schema = (
        StructType()
        .add("doc_id", LongType())
        .add("source", StringType())
        .add("quality", "double")
        .add("toxic", "double")
    )
    return read_csv(spark, path, schema)


_TYPES = (
    "order_key:bigint price:double ship_day:date priority:string rank:bigint half:double "
    "mixed:string huge:double never:string"
)


@query(
    "csv_inferred_types",
    f"""
    select o_orderkey as order_key, o_totalprice as price, o_orderdate::date::varchar as ship_day,
           o_orderpriority as priority,
           case when o_orderkey % 7 <> 0 then o_custkey end as rank, o_orderkey / 2.0::double as half,
           case when o_orderkey % 100 = 1 then 'x' else o_custkey::varchar end as mixed,
           o_orderkey * 1e19::double as huge, null::varchar as never, '{_TYPES}' as types
    from orders""",
)
def csv_inferred_types(spark, sf):
    """A written file read without a schema; the types come from all its rows."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    whole = (key / 2).cast("decimal(20,1)").cast("string")
    out = table(spark, sf, "orders").select(
        key.alias("order_key"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").cast("string").alias("ship_day"),
        F.col("o_orderpriority").alias("priority"),
        F.when(key % 7 == 0, "N/A").otherwise(customer).alias("rank"),
        F.when(key % 2 == 0, (key / 2).cast("bigint").cast("string")).otherwise(whole).alias("half"),
        F.when(key % 100 == 1, "x").otherwise(customer).alias("mixed"),
        F.concat(key.cast("string"), F.lit("0" * 19)).alias("huge"),
        F.lit("NA").alias("never"),
    )
    path = shared_path(spark, "orders-csv")
    write_csv(out, path)
    back = read_csv(spark, path, line_breaks=False)
    types = " ".join(f"{n}:{t}" for n, t in back.dtypes)
    return back.withColumns({"types": F.lit(types), "ship_day": F.col("ship_day").cast("string")})


@query(
    "flag_when_otherwise",
    """
    select o_orderkey,
           case when o_orderstatus = 'F' then 'done'
                when o_orderstatus = 'O' or o_orderpriority = '5-LOW' then 'open'
                else 'part' end as state,
           case when o_totalprice > 200000 then 'large' else 'small' end as size
    from orders""",
)
def flag_when_otherwise(spark, sf):
    status = F.col("o_orderstatus")
    state = C.flag(
        [
            (status == "F", "done"),
            ((status == "O") | (F.col("o_orderpriority") == "5-LOW"), "open"),
        ],
        "part",
    )
    size = C.flag([(F.col("o_totalprice") > 200000, "large")], "small")
    return table(spark, sf, "orders").select("o_orderkey", state.alias("state"), size.alias("size"))


@query(
    "null_to_default",
    f"select doc_id, coalesce(quality::varchar, 'unknown') as quality from {_LABELLED}",
)
def null_to_default(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    out = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    quality = C.or_default(F.col("quality").cast("string"), "unknown")
    return out.select("doc_id", quality.alias("quality"))


@query(
    "fill_numeric_zero",
    f"""
    select doc_id, coalesce(quality, 0)::int as quality, coalesce(toxic, 0)::int as toxic
    from {_LABELLED}""",
)
def fill_numeric_zero(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return J.left_join_fill(docs, table(spark, sf, "labels"), "doc_id")


@query(
    "filter_between",
    "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 1 and 10",
)
def filter_between(spark, sf):
    lines = table(spark, sf, "lineitem").filter(F.col("l_quantity").between(1, 10))
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_isin",
    """
    select p_partkey, p_size, p_brand from part
    where p_size between 2 and 40 and p_brand in ('Brand#1', 'Brand#2', 'Brand#3')""",
)
def filter_isin(spark, sf):
    brands = ["Brand#1", "Brand#2", "Brand#3"]
    picked = F.col("p_size").isin(list(range(2, 41))) & F.col("p_brand").isin(brands)
    return table(spark, sf, "part").filter(picked).select("p_partkey", "p_size", "p_brand")


@query(
    "filter_comparisons",
    """
    select o_orderkey, o_totalprice from orders
    where o_totalprice > 1000 and o_totalprice <= 250000 and o_orderstatus <> 'P'
      and o_orderdate >= timestamp '1996-01-01'""",
)
def filter_comparisons(spark, sf):
    price = F.col("o_totalprice")
    return (
        table(spark, sf, "orders")
        .filter(price > 1000)
        .filter(price <= 250000)
        .filter(F.col("o_orderstatus") != "P")
        .filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "filter_conjunction",
    """
    select l_orderkey, l_linenumber from lineitem
    where l_discount >= 0.05 and l_returnflag = 'R' and l_linestatus = 'O'""",
)
def filter_conjunction(spark, sf):
    both = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    lines = table(spark, sf, "lineitem").filter((F.col("l_discount") >= 0.05) & both)
    return lines.select("l_orderkey", "l_linenumber")


@query(
    "null_test",
    f"select doc_id, source from {_LABELLED} where quality is null",
)
def null_test(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    out = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return out.filter(F.col("quality").isNull()).select("doc_id", "source")


@query(
    "project_rename_alias",
    """
    select o.o_orderkey as order_key, c.c_name as customer_name, 'order' as kind,
           o.o_totalprice as price
    from orders o join customer c on o.o_custkey = c.c_custkey""",
)
def project_rename_alias(spark, sf):
    orders = table(spark, sf, "orders").alias("o")
    customers = table(spark, sf, "customer").alias("c")
    return (
        orders.join(customers, F.col("o.o_custkey") == F.col("c.c_custkey"))
        .select("o.o_orderkey", "c.c_name", F.lit("order"), "o.o_totalprice")
        .toDF("order_key", "customer_name", "kind", "total")
        .withColumnRenamed("total", "price")
    )


@query(
    "row_impute",
    """
    select c_custkey,
           case when c_mktsegment = 'BUILDING' then 'NATION_' || c_nationkey
                else c_mktsegment end as segment
    from customer""",
)
def row_impute(spark, sf):
    """An empty text takes the value of another column of its row."""
    blank = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    nations = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.withColumn("blank", blank).select(
        "c_custkey", C.or_other_if_empty(F.col("blank"), F.col("n_name")).alias("segment")
    )


@query(
    "fill_from_sibling",
    f"""
    select doc_id, chars, coalesce(quality * 10, chars)::double as prev_chars,
           coalesce(toxic, doc_id)::bigint as prev_doc_id
    from (select doc_id, n_chars as chars, quality, toxic from {_LABELLED})""",
)
def fill_from_sibling(spark, sf):
    """Every ``prev_x`` that is null takes ``x``, by the names of the columns."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id",
        F.col("n_chars").alias("chars"),
        (F.col("quality") * 10).cast("double").alias("prev_chars"),
        F.col("toxic").cast("bigint").alias("prev_doc_id"),
    )
    return C.fill_from_sibling(rows, "prev_")


@query(
    "semi_join_keys",
    """
    select o_orderkey, o_custkey from orders
    where o_custkey in (select c_custkey from customer where c_acctbal > 9000)""",
)
def semi_join_keys(spark, sf):
    rich = table(spark, sf, "customer").filter(F.col("c_acctbal") > 9000)
    keys = rich.select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return J.keep_members(orders, keys, "o_custkey")


@query(
    "lookup_left_join",
    f"select doc_id, lang, quality::double as quality from {_LABELLED}",
)
def lookup_left_join(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("quality")
    )
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return J.lookup_join(docs, labels, {"doc_id": "labelled"})


@query(
    "inner_merge_suffix",
    """
    select a.o_custkey as cust, a.n as n_x, b.n as n_y, a.total as total
    from (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total
          from orders where o_orderstatus = 'F' group by 1) a
    join (select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1) b
      using (o_custkey)""",
)
def inner_merge_suffix(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "cust")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    done = orders.filter(F.col("o_orderstatus") == "F").groupBy("cust").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).cast("double").alias("total")
    )
    still = orders.filter(F.col("o_orderstatus") == "O").groupBy("cust").agg(
        F.count(F.lit(1)).alias("n")
    )
    return J.merge(done, still, "cust")


@query(
    "topk_key_join",
    """
    with spent as (
      select o_custkey, sum(o_totalprice::decimal(18,2))::double as spent from orders group by 1),
    ranked as (select *, dense_rank() over (order by spent desc) as rank from spent)
    select o_orderkey, o_custkey, spent, rank from orders join ranked using (o_custkey)
    where rank <= 10""",
)
def topk_key_join(spark, sf):
    """All orders of the ten customers who spent most, ties included."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    spent = orders.groupBy("o_custkey").agg(F.sum(money).cast("double").alias("spent"))
    top = top_dense(spent.withColumn("all", F.lit(0)), ["all"], "spent", 10, "rank")
    return orders.join(top, "o_custkey").select("o_orderkey", "o_custkey", "spent", "rank")


@query(
    "union_reaggregate",
    """
    select user_id, count(*)::bigint as n from events
    where event_type = 'click' or event_type = 'view' group by 1""",
)
def union_reaggregate(spark, sf):
    """Counts of two branches, stacked and added up."""
    events = table(spark, sf, "events")
    parts = [
        events.filter(F.col("event_type") == kind)
        .groupBy("user_id")
        .agg(F.count("event_id").alias("n"))
        for kind in ("click", "view")
    ]
    return sum_of_counts(parts, "user_id")


@query(
    "union_by_name",
    """
    select user_id, event_type, value from events where event_type = 'error'
    union all
    select user_id, event_type, value from events where event_type = 'signup'""",
)
def union_by_name(spark, sf):
    events = table(spark, sf, "events")
    a = events.filter(F.col("event_type") == "error").select("user_id", "event_type", "value")
    b = events.filter(F.col("event_type") == "signup").select("value", "user_id", "event_type")
    return a.unionByName(b)


@query("distinct_rows", "select distinct user_id, event_type from events")
def distinct_rows(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@query(
    "distinct_counts_having",
    """
    select p_brand, count(distinct p_type) as p_type, count(distinct p_size) as p_size,
           (select count(*) from (select distinct p_brand, p_type, p_size from part))
             as distinct_rows
    from part group by 1 having count(distinct p_size) > 1""",
)
def distinct_counts_having(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    n = parts.distinct().agg(F.count(F.lit(1)).alias("n"))
    counts = parts.groupBy("p_brand").agg(
        *[F.countDistinct(c).alias(c) for c in ("p_type", "p_size")]
    )
    return counts.filter(F.col("p_size") > 1).withColumn("distinct_rows", n.scalar())


@query(
    "column_profile",
    f"""
    with rows as (select lang, source, quality, toxic, text from {_LABELLED})
    """
    + " union all ".join(
        f"""
        select '{c}' as "column", count(distinct {c}) + max(({c} is null)::int)::bigint
                 as distinct_values,
               max(({c}::varchar = '')::int)::bigint as has_empty from rows"""
        for c in ("lang", "source", "quality", "toxic", "text")
    ),
)
def profile_columns(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return column_profile(docs, ["lang", "source", "quality", "toxic", "text"])


@query(
    "key_ambiguity",
    """
    select p_name, count(distinct p_brand) as parents from part group by 1
    having count(distinct p_brand) > 1""",
)
def key_ambiguity(spark, sf):
    return ambiguous_keys(table(spark, sf, "part"), "p_name", "p_brand")


@query(
    "partial_missing_children",
    """
    select p_brand, count(distinct child) as children
    from (select p_brand, case when p_size = 7 then '' else p_type end as child from part)
    group by 1 having count(distinct child) > 1 and max((child = '')::int) = 1""",
)
def partial_missing_children(spark, sf):
    child = F.when(F.col("p_size") == 7, "").otherwise(F.col("p_type"))
    parts = table(spark, sf, "part").select("p_brand", child.alias("child"))
    return partly_missing(parts, "p_brand", "child")


@query(
    "rows_of_partial_parents",
    """
    with parts as (
      select p_partkey, p_brand, case when p_size = 7 then '' else p_type end as child from part),
    partial as (
      select p_brand from parts group by 1
      having count(distinct child) > 1 and max((child = '')::int) = 1)
    select p_brand, child, count(p_partkey) as parts from parts
    where p_brand in (select p_brand from partial) group by all""",
)
def rows_of_partial_parents(spark, sf):
    """Row counts per child, for parents that lack the name of one child."""
    child = F.when(F.col("p_size") == 7, "").otherwise(F.col("p_type"))
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", child.alias("child"))
    kept = J.keep_members(parts, partly_missing(parts, "p_brand", "child"), "p_brand")
    return kept.groupBy("p_brand", "child").agg(F.count("p_partkey").alias("parts"))


@query(
    "impute_location_key",
    """
    select c_custkey, n_name as parent,
           case when c_mktsegment = 'FURNITURE' then n_name else c_mktsegment end as child,
           n_name || '-' || case when c_mktsegment = 'FURNITURE' then n_name
                                 else c_mktsegment end as location
    from customer join nation on c_nationkey = n_nationkey""",
)
def impute_location_key(spark, sf):
    blank = F.when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_mktsegment"))
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("parent"), blank.alias("child"))
    )
    return with_location(rows, "parent", "child")


@query(
    "strip_quotes",
    """select doc_id, md5(replace(text, '"', '')) as digest,
              length(replace(text, '"', '')) as chars from documents""",
)
def strip_quotes(spark, sf):
    bare = C.without(F.col("text"), '"')
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(bare).alias("digest"), F.char_length(bare).cast("bigint").alias("chars")
    )


@query(
    "numeric_scalars",
    f"""
    select l_orderkey, l_linenumber,
           {rnd('l_extendedprice - l_quantity', 4)} as difference,
           {rnd('ln(1 + l_quantity)', 8)} as log_q,
           {rnd('exp(l_tax) - 1', 8)} as l_tax_back,
           {rnd('pow(0.97, l_linenumber)', 8)} as decay,
           {rnd('round_even(l_quantity / 2, 0)', 0)} as half_even,
           {rnd('l_quantity / 2 + 0.1', 0)} as nearest,
           trunc(l_extendedprice - 50000)::bigint as truncated,
           case when l_discount = 0 then null
                else {rnd('l_tax * 100.0 / l_discount', 6)} end as share
    from lineitem""",
)
def numeric_scalars(spark, sf):
    lines = table(spark, sf, "lineitem")
    out = lines.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("difference"),
        F.log1p("l_quantity").alias("log_q"),
        F.col("l_tax").alias("l_tax_back"),
        F.pow(F.lit(0.97), F.col("l_linenumber")).alias("decay"),
        F.bround(F.col("l_quantity") / 2, 0).alias("half_even"),
        F.round(F.col("l_quantity") / 2 + 0.1, 0).alias("nearest"),
        (F.col("l_extendedprice") - 50000).cast("int").cast("bigint").alias("truncated"),
        C.percent(F.col("l_tax"), F.col("l_discount")).alias("share"),
    )
    others = [c for c in out.columns if c != "l_tax_back"]
    out = C.map_numbers(out, F.expm1, others)
    out = rounded(out, 4, "difference")
    out = rounded(out, 8, "log_q", "l_tax_back", "decay")
    return rounded(out, 6, "share")


@query(
    "string_scalars",
    """
    select p_partkey, split_part(p_name, ' ', 1) as first_word,
           nullif(split_part(p_name, ' ', 2), '') as second_word,
           cast(null as varchar) as fifth_word,
           trim('  ' || p_type || ' ') as trimmed,
           replace(p_brand, 'Brand#', '') as brand_no,
           p_brand || '-' || p_type as key,
           upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) as capital
    from part""",
)
def string_scalars(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        C.part_at(name, " ", 0).alias("first_word"),
        C.part_at(name, " ", 1).alias("second_word"),
        C.part_at(name, " ", 4).alias("fifth_word"),
        F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
        C.without(F.col("p_brand"), "Brand#").alias("brand_no"),
        C.joined_key(F.col("p_brand"), F.col("p_type")).alias("key"),
        F.initcap("p_type").alias("capital"),
    )


@query(
    "date_scalars",
    """
    select o_orderkey, strftime(o_orderdate::date + 3, '%Y-%m-%d') as plus3,
           strftime(o_orderdate::date - 1, '%Y-%m-%d') as minus1,
           strftime(o_orderdate, '%Y-%m') as month,
           date_diff('day', date '1995-01-01', o_orderdate::date) as days
    from orders""",
)
def date_scalars(spark, sf):
    day = D.parse_day(D.day_text(F.col("o_orderdate")))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        D.day_text(F.date_add(day, 3)).alias("plus3"),
        D.day_text(F.date_sub(day, 1)).alias("minus1"),
        F.date_format(day, "yyyy-MM").alias("month"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"),
    )


@query(
    "date_series",
    """
    with bounds as (
      select o_orderstatus, min(o_orderdate)::date as a, max(o_orderdate)::date as b
      from orders group by 1)
    select o_orderstatus, strftime(d, '%Y-%m-%d') as day
    from bounds, unnest(generate_series(a, b, interval 1 day)) as u(d)""",
)
def date_series(spark, sf):
    """Every day between the first and the last order of a status."""
    bounds = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")
    )
    days = D.each_day(bounds, F.col("a"), F.col("b"), "d")
    return days.select("o_orderstatus", D.day_text(F.col("d")).alias("day"))


@query(
    "last_day_rows",
    """
    select event_id, user_id from events
    where ts::date = (select max(ts::date) from events)""",
)
def last_day_rows(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return on_last_day(events, "day").select("event_id", "user_id")


@query(
    "share_with_total",
    f"""
    with counts as (
      select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)
    select o_orderpriority, o_orderstatus, n,
           sum(n) over (partition by o_orderpriority)::bigint as total,
           {rnd('n * 100.0 / sum(n) over (partition by o_orderpriority)', 6)} as percentage,
           {rnd('n * 100.0 / sum(n) over ()', 6)} as percentage_of_all
    from counts""",
)
def share_with_total(spark, sf):
    orders = table(spark, sf, "orders")
    n_all = orders.agg(F.count(F.lit(1)).alias("n"))
    counts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    shares = share_within(counts, ["o_orderpriority"])
    out = shares.withColumn("percentage_of_all", C.percent(F.col("n"), n_all.scalar()))
    return rounded(out, 6, "percentage", "percentage_of_all")


@query(
    "left_join_fill_zero",
    """
    select c_custkey, coalesce(n, 0)::bigint as n, coalesce(spent, 0)::double as spent
    from customer left join (
      select o_custkey, count(*) as n, sum(o_totalprice::decimal(18,2))::double as spent
      from orders group by 1) on c_custkey = o_custkey""",
)
def left_join_fill_zero(spark, sf):
    money = F.col("o_totalprice").cast("decimal(18,2)")
    totals = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(money).cast("double").alias("spent"))
    )
    return J.left_join_fill(table(spark, sf, "customer").select("c_custkey"), totals, "c_custkey")


@query(
    "left_join_series",
    f"""
    select strftime(day, '%Y-%m-%d') as day, {rnd('clicks', 4)} as clicks,
           {rnd('buys', 4)} as buys
    from (select ts::date as day, sum(value) as clicks from events
          where event_type = 'click' group by 1)
    left join (select ts::date as day, sum(value) as buys from events
               where event_type = 'purchase' group by 1) using (day)""",
)
def left_join_series(spark, sf):
    """Two daily measures, each staged as a table of its own, side by side."""
    daily = (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("day"), "event_type")
        .agg(F.sum("value").alias("total"))
    )
    kept = staged(daily, "daily")
    clicks = kept.filter(F.col("event_type") == "click").select(
        "day", F.col("total").alias("clicks")
    )
    buys = kept.filter(F.col("event_type") == "purchase").select(
        "day", F.col("total").alias("buys")
    )
    out = clicks.join(buys, "day", "left").withColumn("day", D.day_text(F.col("day")))
    return rounded(out, 4, "clicks", "buys")


@query(
    "topk_sorted",
    """
    select o_orderkey, o_orderpriority, o_totalprice from orders
    order by o_orderpriority, o_totalprice desc, o_orderkey limit 10""",
)
def topk_sorted(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query(
    "topk_desc",
    """
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders
    order by o_orderdate desc, o_orderkey desc limit 10""",
)
def topk_desc(spark, sf):
    """The last ten rows in order of date and key."""
    tail = last_rows(table(spark, sf, "orders"), 10, "o_orderdate", "o_orderkey")
    return tail.select("o_orderkey", D.day_text(F.col("o_orderdate")).alias("day"))


@query(
    "before_first_case",
    "select user_id, event_id, value from events where value > 50",
)
def before_first_case(spark, sf):
    return table(spark, sf, "events").filter(F.col("value") > 50).select(
        "user_id", "event_id", "value"
    )


@query(
    "entity_key_bounds",
    """
    select strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day,
           count(*) as rows, 6::bigint as columns, count(distinct user_id) as users
    from events""",
)
def entity_key_bounds(spark, sf):
    events = table(spark, sf, "events")
    return events.agg(
        D.day_text(F.min("ts")).alias("first_day"),
        D.day_text(F.max("ts")).alias("last_day"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(events.columns)).cast("bigint").alias("columns"),
        F.countDistinct("user_id").alias("users"),
    )
