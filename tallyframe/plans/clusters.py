"""Standardised features, clusterings, boxes and image regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.dates import day_text
from tallyframe.operators.aggregates import members_list
from tallyframe.operators.boxes import cluster_boxes, crop_rects, point_regions
from tallyframe.operators.dbscan import dbscan
from tallyframe.operators.density import dbscan_space
from tallyframe.operators.forecast import forecast
from tallyframe.operators.features import principal_pair, standardise
from tallyframe.operators.kmeans import OVERSAMPLE, ROUNDS, STEPS, elbow, kmeans
from tallyframe.operators.linkage import linkage
from tallyframe.plans.registry import query, rnd, rounded
from tallyframe.plans.series import (
    DECAY,
    FEATURES,
    GROWTH,
    chosen,
    clean,
    entity_features,
    whole_series,
)
from tallyframe.session import shared_path
from tallyframe.sources.image_files import (
    crop_files,
    image_table,
    replace_images,
    write_text_archives,
)
from tallyframe.sources.images import crop_pixels, to_grey
from tallyframe.sources.tables import staged, table

DIMENSIONS = 64

# SQL of the clusterings: one row per step and group with the list of its clusters, of which the
# nearest two are joined.
_PAIR = """(select min({{'d': {distance}, 'a': a, 'b': b}})
    from (select unnest(clusters) as a) x, (select unnest(clusters) as b) y where a.id < b.id)"""
_OTHERS = "[x for x in clusters if x.id <> p.a.id and x.id <> p.b.id]"
_WARD_PAIR = _PAIR.format(
    distance="sqrt(2 * a.n * b.n / (a.n + b.n)) * list_distance(a.c, b.c)"
)
_WARD_JOIN = f"""list_append({_OTHERS},
    {{'id': p.a.id, 'n': p.a.n + p.b.n,
     'c': [(p.a.c[i] * p.a.n + p.b.c[i] * p.b.n) / (p.a.n + p.b.n)
           for i in range(1, len(p.a.c) + 1)]}})"""
_MEAN_PAIR = _PAIR.format(
    distance="list_avg(flatten([[list_distance(u, v) for u in a.m] for v in b.m]))"
)
_MEAN_JOIN = f"""list_append({_OTHERS},
    {{'id': p.a.id, 'ids': p.a.ids || p.b.ids, 'm': p.a.m || p.b.m}})"""
_FEATURES = ["lines", "quantity", "discount"]


@query(
    "standardise_features",
    f"""
    with f as (
      select l_suppkey, count(*)::double as lines, sum(l_quantity) as quantity,
             round(avg(l_discount), 6) as discount
      from lineitem group by 1)
    select l_suppkey,
           {', '.join(
               f"{rnd(f'({c} - avg({c}) over ()) / stddev_pop({c}) over ()', 5)} as {c}"
               for c in _FEATURES)}
    from f""",
)
def standardise_features(spark, sf):
    features = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("lines"),
            F.sum("l_quantity").alias("quantity"),
            F.round(F.avg("l_discount"), 6).alias("discount"),
        )
    )
    return rounded(standardise(features, _FEATURES), 5, *_FEATURES)


@query(
    "standardise_by_group",
    f"""
    select vec_id, label,
           {', '.join(
               f"{rnd(f'(x{i} - avg(x{i}) over w) / stddev_pop(x{i}) over w', 5)} as x{i}"
               for i in (0, 1))}
    from (select vec_id, label, embedding[1]::double as x0, embedding[2]::double as x1
          from embeddings)
    window w as (partition by label)""",
)
def standardise_by_group(spark, sf):
    return rounded(standardise(_plane(spark, sf), ["x0", "x1"], ["label"]), 5, "x0", "x1")


def _plane(spark, sf):
    """The first two coordinates of each vector."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", e[0].cast("double").alias("x0"), e[1].cast("double").alias("x1")
    )


def _space(spark, sf):
    """All coordinates as columns."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[e[i].cast("double").alias(f"e{i}") for i in range(DIMENSIONS)]
    )


_E = [f"e{i}" for i in range(DIMENSIONS)]


# K-means step by step: (key, e) of ``points`` are drawn as seeds, put in order, and moved. ``tail``
# reads the models (k, m) in ``models``.
def _kmeans_sql(points: str, least_k: int, most_k: int, tail: str) -> str:
    return f"""
    with recursive points as ({points}),
    turns as (
      select key, e, turn,
        (('0x' || substr(md5(key || ':' || turn), 1, 13))::bigint + 1.0::double) / 4503599627370496 as u
      from points, range({ROUNDS + 1}) as t(turn)),
    draws(turn, s) as (
      select 0, [e] from (select e from turns where turn = 0 order by u, key limit 1)
      union all
      select turn + 1, any_value(s) || list(e order by place)
      from (
        select d.turn, s, e, row_number() over (order by -ln(u) / cost, key) as place
        from (
          select draws.turn, s, e, key, u,
            list_min([list_distance(c, e) for c in s]) ** 2 as cost
          from draws join turns on turns.turn = draws.turn + 1) d
        where cost > 0)
      where place <= {OVERSAMPLE * most_k} group by turn),
    drawn as (select s from draws order by turn desc limit 1),
    attracted as (
      select list_position(d, list_min(d)) as i, count(*)::double as n
      from (select [list_distance(c, e) for c in s] as d from points, drawn) group by 1),
    weighed as (
      select s, [coalesce(m[i], 0) for i in range(1, len(s) + 1)] as w
      from drawn, (select map_from_entries(list((i, n))) as m from attracted)),
    chosen(ids, away) as (
      select [list_position(w, list_max(w))],
        [list_distance(c, s[list_position(w, list_max(w))]) ** 2 for c in s] from weighed
      union all
      select list_append(ids, i),
        [least(away[j], list_distance(s[j], s[i]) ** 2) for j in range(1, len(s) + 1)]
      from (
        select ids, away, s, list_position(v, list_max(v)) as i
        from (select *, [w[j] * away[j] for j in range(1, len(w) + 1)] as v from chosen, weighed
              where len(ids) < {most_k}) where list_max(v) > 0)),
    moves(step, k, m) as (
      select 0, k, [s[i] for i in ids[:k]]
      from range({least_k}, {most_k + 1}) as t(k), weighed,
        (select ids from chosen order by len(ids) desc limit 1)
      union all
      select step + 1, k, [coalesce(found[i], m[i]) for i in range(1, len(m) + 1)]
      from moves join (
        select k, map_from_entries(list((i, c))) as found
        from (
          select k, i, list(x order by j) as c
          from (
            select k, i, j, avg(x) as x
            from (
              select k, list_position(d, list_min(d)) as i, unnest(e) as x,
                generate_subscripts(e, 1) as j
              from (select k, e, [list_distance(c, e) for c in m] as d from moves, points))
            group by all)
          group by all)
        group by k) using (k)
      where step < {STEPS}),
    models as (select k, m from moves where step = {STEPS})
    {tail}"""


@query(
    "kmeans_labels",
    _kmeans_sql(
        "select vec_id as key, embedding::double[] as e from embeddings",
        8,
        8,
        """, labelled as (
      select key, list_position(d, list_min(d)) as i
      from (select key, [list_distance(c, e) for c in m] as d from points, models))
    select key as vec_id, (dense_rank() over (order by first) - 1)::int as cluster
    from (select key, min(key) over (partition by i) as first from labelled)""",
    ),
)
def kmeans_labels(spark, sf):
    return kmeans(_space(spark, sf), "vec_id", _E, 8).select("vec_id", "cluster")


@query(
    "elbow_table",
    _kmeans_sql(
        "select vec_id as key, embedding::double[] as e from embeddings",
        1,
        24,
        f"""select k::int as k, {rnd('sum(d ** 2)', 6)} as inertia
    from (select k, list_min([list_distance(c, e) for c in m]) as d from points, models)
    group by 1""",
    ),
)
def elbow_table(spark, sf):
    return rounded(elbow(_space(spark, sf), "vec_id", _E, 24), 6, "inertia")


# Powers of a matrix by repeated squaring leave its first axis; taking that out leaves the second.
def _axis_sql(name: str, matrix: str) -> str:
    return f"""
    {name}_power(step, m) as (
      select 0, a from {matrix}
      union all
      select step + 1, [[list_dot_product(r, c) / t for c in m] for r in m]
      from (select *, list_sum([m[i][i] * m[i][i] for i in range(1, len(m) + 1)]) as t
            from {name}_power) where step < 24),
    {name}_row as (
      select r from (select unnest(m) as r from {name}_power where step = 24)
      order by list_dot_product(r, r) desc limit 1),
    {name} as (
      select [z / sqrt(list_dot_product(r, r))
                * case when list_max(r) >= -list_min(r) then 1 else -1 end for z in r] as v
      from {name}_row)"""


@query(
    "pca_2d",
    f"""
    with recursive x as (
      select vec_id, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as i
      from embeddings),
    centred as (select vec_id, i, v - avg(v) over (partition by i) as v from x),
    vectors as (select vec_id, list(v order by i) as e from centred group by 1),
    cells as (
      select p.i, q.i as j, sum(p.v * q.v) / (count(*) - 1) as c
      from centred p join centred q using (vec_id) group by all),
    matrix as (
      select list(r order by i) as a
      from (select i, list(c order by j) as r from cells group by 1)),
    {_axis_sql('first_axis', 'matrix')},
    rest as (
      select [[a[i][j] - l * v[i] * v[j] for j in range(1, len(v) + 1)]
              for i in range(1, len(v) + 1)] as a
      from (select a, v, list_dot_product(v, [list_dot_product(r, v) for r in a]) as l
            from matrix, first_axis)),
    {_axis_sql('second_axis', 'rest')}
    select vec_id, {rnd('list_dot_product(e, first_axis.v)', 5)} as pca1,
           {rnd('list_dot_product(e, second_axis.v)', 5)} as pca2
    from vectors, first_axis, second_axis""",
)
def pca_2d(spark, sf):
    pairs = principal_pair(_space(spark, sf), _E).select("vec_id", "pca1", "pca2")
    return rounded(pairs, 5, "pca1", "pca2")


# The matrix of all distances, of which each step rewrites one row and column (Ward's recurrence).
@query(
    "ward_labels",
    """
    with recursive e as (
      select row_number() over (order by vec_id) as i, vec_id, embedding::double[] as e
      from embeddings),
    rows as (
      select a.i, list(case when a.i = b.i then 'inf'::double else list_distance(a.e, b.e) end
                       order by b.i) as r
      from e a, e b group by a.i),
    steps(step, size, label, d) as (
      select 0, (select list(1.0::double order by i) from e), (select list(i order by i) from e),
             (select list(r order by i) from rows)
      union all
      select step + 1,
        [case when k = i then size[i] + size[j] else size[k] end for k in range(1, len(size) + 1)],
        [case when x = j then i else x end for x in label],
        [case when k = j then [r * 0 + 'inf'::double for r in d[1]] when k = i then new
              else list_concat(d[k][:i - 1], [new[k]], d[k][i + 1:j - 1], ['inf'::double], d[k][j + 1:])
              end for k in range(1, len(size) + 1)]
      from (
        select *, [case when k = i or k = j or d[i][k] = 'inf'::double then 'inf'::double else
            sqrt(((size[i] + size[k]) * d[i][k] ** 2 + (size[j] + size[k]) * d[j][k] ** 2
                  - size[k] * m ** 2) / (size[i] + size[j] + size[k])) end
          for k in range(1, len(size) + 1)] as new
        from (
          select *, list_position(d[i], m) as j
          from (
            select *, list_min(lows) as m, list_position(lows, list_min(lows)) as i
            from (select *, [list_min(r) for r in d] as lows from steps
                  where step < len(size) - 8)))))
    select e.vec_id, least_key.vec_id as cluster
    from (select label from steps order by step desc limit 1) last, e
    join e least_key on least_key.i = last.label[e.i]""",
)
def ward_labels(spark, sf):
    labelled, _ = linkage(_space(spark, sf), "vec_id", _E, "ward", 8)
    return labelled.select("vec_id", "cluster")


@query(
    "ward_merges",
    f"""
    with recursive steps(label, clusters, lo, hi, height, size) as (
      select label,
             list({{'id': vec_id, 'n': 1.0::double, 'c': embedding::double[]}} order by vec_id),
             null::bigint, null::bigint, null::double, null::bigint
      from embeddings group by label
      union all
      select label, {_WARD_JOIN}, p.a.id, p.b.id, p.d, (p.a.n + p.b.n)::bigint
      from (select label, clusters, {_WARD_PAIR} as p from steps where len(clusters) > 1))
    select label::varchar as label, lo, hi, {rnd('height', 6)} as height, size
    from steps where lo is not null""",
)
def ward_merges(spark, sf):
    """The merge table of every label's vectors."""
    _, merges = linkage(_space(spark, sf), "vec_id", _E, "ward", 2, "label")
    return rounded(merges.withColumnRenamed("grp", "label"), 6, "height")


@query(
    "average_linkage_labels",
    f"""
    with recursive steps(label, clusters) as (
      select label,
             list({{'id': vec_id, 'ids': [vec_id], 'm': [embedding::double[]]}} order by vec_id)
      from embeddings group by label
      union all
      select label, {_MEAN_JOIN}
      from (select label, clusters, {_MEAN_PAIR} as p from steps where len(clusters) > 4))
    select label, x.id as cluster, unnest(x.ids) as vec_id
    from (select label, unnest(clusters) as x from steps where len(clusters) = 4)""",
)
def average_linkage_labels(spark, sf):
    labelled, _ = linkage(_space(spark, sf), "vec_id", _E, "average", 4, "label")
    return labelled.select("vec_id", "label", "cluster")


@query(
    "dbscan_labels",
    """
    with recursive scaled as (
      select vec_id, (x0 - avg(x0) over ()) / stddev_pop(x0) over () as x,
             (x1 - avg(x1) over ()) / stddev_pop(x1) over () as y
      from (select vec_id, embedding[1]::double as x0, embedding[2]::double as x1
            from embeddings)),
    near as (
      select a.vec_id as a, b.vec_id as b from scaled a, scaled b
      where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.25),
    core as (select a from near group by 1 having count(*) >= 10),
    core_near as (select near.a, near.b from near join core on near.b = core.a),
    reach(root, id) as (
      select a, a from core
      union
      select root, n.b from reach join core_near n on n.a = id join core c on c.a = n.a),
    named as (select id, min(root) as cluster from reach group by 1),
    border as (
      select n.a as id, min(cluster) as cluster from core_near n join named on named.id = n.b
      where n.a not in (select a from core) group by 1)
    select vec_id, coalesce(named.cluster, border.cluster, -1) as cluster,
           named.id is not null as is_core
    from embeddings left join named on named.id = vec_id left join border on border.id = vec_id
    """,
)
def dbscan_labels(spark, sf):
    scaled = standardise(_plane(spark, sf), ["x0", "x1"])
    out = dbscan(scaled, "vec_id", "x0", "x1", 0.25, 10)
    return out.select(
        "vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core"
    )


@query(
    "dbscan_space_labels",
    """
    with recursive e as (select vec_id, embedding::double[] as e from embeddings),
    near as (
      select a.vec_id as a, b.vec_id as b from e a, e b where list_distance(a.e, b.e) <= 1.15),
    core as (select a from near group by 1 having count(*) >= 5),
    core_near as (select near.a, near.b from near join core on near.b = core.a),
    reach(root, id) as (
      select a, a from core
      union
      select root, n.b from reach join core_near n on n.a = id join core c on c.a = n.a),
    named as (select id, min(root) as cluster from reach group by 1),
    border as (
      select n.a as id, min(cluster) as cluster from core_near n join named on named.id = n.b
      where n.a not in (select a from core) group by 1)
    select vec_id, coalesce(named.cluster, border.cluster, -1) as cluster,
           named.id is not null as is_core
    from embeddings left join named on named.id = vec_id left join border on border.id = vec_id
    """,
)
def dbscan_space_labels(spark, sf):
    """Density clusters over all coordinates of the vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = dbscan_space(vectors, "vec_id", "embedding", 1.15, 5)
    return out.select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "is_core")


@query(
    "point_regions",
    f"""
    with recursive points as (
      select vec_id, label, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y
      from embeddings),
    scaled as (
      select vec_id, label, (x - avg(x) over w) / stddev_pop(x) over w as x,
             (y - avg(y) over w) / stddev_pop(y) over w as y
      from points window w as (partition by label)),
    near as (
      select a.label, a.vec_id as a, b.vec_id as b from scaled a join scaled b using (label)
      where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5),
    core as (select label, a from near group by all having count(*) >= 5),
    reach(label, root, id) as (
      select label, a, a from core
      union
      select r.label, root, n.b from reach r join near n on n.a = r.id
      join core c on c.a = n.b),
    wanted as (
      select label, count(distinct cluster) as k
      from (select label, id, min(root) as cluster from reach group by all) group by 1),
    steps(label, k, clusters) as (
      select label, k, list({{'id': vec_id, 'ids': [vec_id], 'm': [[x, y]]}} order by vec_id)
      from points join wanted using (label) group by all
      union all
      select label, k, {_MEAN_JOIN}
      from (select label, k, clusters, {_MEAN_PAIR} as p from steps where len(clusters) > k)),
    boxes as (
      select label, c.id as cluster, len(c.ids) as points,
             list_min([q[1] for q in c.m]) as x0, list_max([q[1] for q in c.m]) as x1,
             list_min([q[2] for q in c.m]) as y0, list_max([q[2] for q in c.m]) as y1
      from (select label, unnest(clusters) as c from steps where len(clusters) = k))
    select label, cluster, points, trunc(x0 - (x1 - x0) / 20)::int as "left",
           trunc(y0 - (y1 - y0) / 20)::int as top,
           trunc((x1 - x0) * 1.1::double)::int as width,
           trunc((y1 - y0) * 1.1::double)::int as height
    from boxes""",
)
def regions(spark, sf):
    """Crop rectangles around the point clusters of each group, coordinates in thousandths."""
    points = _plane(spark, sf).withColumns(
        {"x0": F.col("x0") * 1000, "x1": F.col("x1") * 1000}
    )
    found = point_regions(points, "label", "vec_id", "x0", "x1", eps=0.5, min_samples=5)
    return found.select("label", "cluster", "points", "left", "top", "width", "height")


_NAMES = ["growth", "change", "cases", "loss_growth", "loss_change", "losses"]


_ENTITY_WARD = (
    FEATURES.replace("with per_day", "with recursive per_day", 1)
    + f"""
    , scaled as (
      select user_id, {', '.join(
          f"case when stddev_pop({c}) over () > 0 then "
          f"({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end as {c}"
          for c in _NAMES)} from features),
    steps(clusters) as (
      select list({{'id': user_id, 'ids': [user_id], 'n': 1.0::double,
                    'c': [{', '.join(_NAMES)}]}} order by user_id) from scaled
      union all
      select list_append({_OTHERS},
        {{'id': p.a.id, 'ids': p.a.ids || p.b.ids, 'n': p.a.n + p.b.n,
          'c': [(p.a.c[i] * p.a.n + p.b.c[i] * p.b.n) / (p.a.n + p.b.n)
                for i in range(1, len(p.a.c) + 1)]}})
      from (select clusters, {_WARD_PAIR} as p from steps where len(clusters) > 8))
    select x.id as cluster, unnest(x.ids) as user_id
    from (select unnest(clusters) as x from steps where len(clusters) = 8)"""
)


@query("entity_ward_clusters", _ENTITY_WARD)
def entity_ward_clusters(spark, sf):
    """Users clustered by Ward's linkage of their standardised growth features."""
    features = staged(entity_features(clean(spark, sf)), "features")
    labelled, _ = linkage(standardise(features, _NAMES), "user_id", _NAMES, "ward", 8)
    return labelled.select("cluster", "user_id")


# Ward clusters of the users, their growth, the larger of own and cluster's, and the forecast.
_CHAIN = (
    FEATURES.replace("with per_day", "with recursive per_day", 1)
    + f"""
    , scaled as (
      select user_id, {', '.join(
          f"case when stddev_pop({c}) over () > 0 then "
          f"({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end as {c}"
          for c in _NAMES)} from features),
    steps(clusters) as (
      select list({{'id': user_id, 'ids': [user_id], 'n': 1.0::double,
                    'c': [{', '.join(_NAMES)}]}} order by user_id) from scaled
      union all
      select list_append({_OTHERS},
        {{'id': p.a.id, 'ids': p.a.ids || p.b.ids, 'n': p.a.n + p.b.n,
          'c': [(p.a.c[i] * p.a.n + p.b.c[i] * p.b.n) / (p.a.n + p.b.n)
                for i in range(1, len(p.a.c) + 1)]}})
      from (select clusters, {_WARD_PAIR} as p from steps where len(clusters) > 8)),
    wards as (
      select x.id as ward, unnest(x.ids) as user_id
      from (select unnest(clusters) as x from steps where len(clusters) = 8)),
    labelled as (select clean.*, ward as cluster from clean join wards using (user_id) where losses > 0)
    """
    + ", " + GROWTH[GROWTH.index("products as") :]
    + """
    , whole as (
      select user_id, day, ln(1 + sum(cases)) as log_cases, ln(1 + sum(losses)) as log_losses
      from (select user_id, day, sum(cents) over w as cases, sum(m) over w as losses
            from (select user_id, day, sum(cents)::double as cents, sum(m) as m from per_day group by all)
            window w as (partition by user_id order by day))
      group by all),
    ends as (
      select * from (
        select * from whole qualify row_number() over (partition by user_id order by day desc) = 1),
        (select max(day) as train_end from whole))
    """
)


@query(
    "cluster_growth_forecast",
    _CHAIN
    + f"""
    select user_id, cluster, strftime(day + n::int, '%Y-%m-%d') as day,
           {rnd('e.log_cases + coalesce(c.delta_log_cases, 0) * (1 - pow(0.97, n)) / (1 - 0.97)', 6)}
             as log_cases,
           {rnd('e.log_losses + coalesce(c.delta_log_losses, 0) * (1 - pow(0.97, n)) / (1 - 0.97)', 6)}
             as log_losses
    from (select *, unnest(generate_series(1, 31 + (train_end - day))) as n from ends) e
    left join chosen c using (user_id)""",
)
def cluster_growth_forecast(spark, sf):
    """Clusters of users, their growth, the choice per user, and every user's forecast from it."""
    rows = staged(clean(spark, sf), "clean")
    scaled = staged(standardise(entity_features(rows), _NAMES), "scaled")
    wards, _ = linkage(scaled, "user_id", _NAMES, "ward", 8)
    labelled = rows.filter("losses > 0").join(wards.select("user_id", "cluster"), "user_id")
    growth = staged(chosen(labelled), "growth")
    history = staged(whole_series(spark, sf).select("user_id", "day", "log_cases", "log_losses"), "history")
    end = history.agg(F.max("day").alias("end"))
    ahead = forecast(
        history,
        ["user_id"],
        "day",
        growth.select("user_id", "delta_log_cases", "delta_log_losses"),
        {"log_cases": "delta_log_cases", "log_losses": "delta_log_losses"},
        DECAY,
        None,
        F.date_add(end.scalar(), 31),
    )
    known = history.select("user_id", "day")
    out = ahead.join(known, ["user_id", "day"], "left_anti").join(
        growth.select("user_id", "cluster"), "user_id", "left"
    )
    return rounded(out.withColumn("day", day_text(F.col("day"))), 6, "log_cases", "log_losses")


@query(
    "entity_clusters",
    _kmeans_sql(
        FEATURES
        + f"""
    , scaled as (
      select user_id, {', '.join(
          f"case when stddev_pop({c}) over () > 0 then "
          f"({c} - avg({c}) over ()) / stddev_pop({c}) over () else 0 end as {c}"
          for c in _NAMES)} from features)
    select user_id as key, [{', '.join(_NAMES)}]::double[] as e from scaled""",
        8,
        8,
        f""", labelled as (
      select key, list_position(d, list_min(d)) as i
      from (select key, [list_distance(c, e) for c in m] as d from points, models)),
    numbered as (
      select key, (dense_rank() over (order by first) - 1)::bigint as cluster
      from (select key, min(key) over (partition by i) as first from labelled))
    select 'kmeans' as method, cluster, 0::bigint as part,
           string_agg(key::varchar, ',' order by key) as members from numbered group by cluster
    union all
    select 'ward', cluster, 0::bigint, string_agg(user_id::varchar, ',' order by user_id)
    from ({_ENTITY_WARD}) group by cluster""",
    ),
)
def entity_clusters(spark, sf):
    """Users clustered by their standardised growth features, both ways, as lists of members."""
    features = staged(entity_features(clean(spark, sf)), "features")
    scaled = staged(standardise(features, _NAMES), "scaled")
    parts = []
    by_means = kmeans(scaled, "user_id", _NAMES, 8)
    by_ward, _ = linkage(scaled, "user_id", _NAMES, "ward", 8)
    for method, labelled in (("kmeans", by_means), ("ward", by_ward)):
        lists = members_list(labelled, "cluster", "user_id")
        parts.append(
            lists.select(
                F.lit(method).alias("method"),
                F.col("cluster").cast("bigint").alias("cluster"),
                "part",
                F.array_join(F.col("members").cast("array<string>"), ",").alias("members"),
            )
        )
    return parts[0].unionByName(parts[1])


_BOX = """
  select label, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1
  from (select label, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y
        from embeddings) group by 1"""


def _boxes(spark, sf):
    points = _plane(spark, sf).select(
        "label", (F.col("x0") * 1000).alias("x"), (F.col("x1") * 1000).alias("y")
    )
    return cluster_boxes(points, ["label"], "x", "y")


@query(
    "cluster_boxes",
    "select label, "
    + ", ".join(f"{rnd(c, 6)} as {c}" for c in ("x0", "x1", "y0", "y1"))
    + f", {rnd('x1', 6)} as third_corner_x, {rnd('y1', 6)} as third_corner_y from ({_BOX})",
)
def boxes_by_label(spark, sf):
    third = F.col("corners")[2]
    out = _boxes(spark, sf).withColumns(
        {"third_corner_x": third[0], "third_corner_y": third[1]}
    )
    return rounded(out.drop("corners"), 6, "x0", "x1", "y0", "y1", "third_corner_x",
                   "third_corner_y")


@query(
    "crop_rects",
    f"""
    select label, trunc(x0 - (x1 - x0) / 20)::int as "left",
           trunc(y0 - (y1 - y0) / 20)::int as top,
           trunc((x1 - x0) * 1.1::double)::int as width,
           trunc((y1 - y0) * 1.1::double)::int as height
    from ({_BOX})""",
)
def rects_by_label(spark, sf):
    return crop_rects(_boxes(spark, sf)).select("label", "left", "top", "width", "height")


@query(
    "image_crop_grey",
    """
    with bytes as (
      select vec_id, label,
             [least(255, floor(abs(v::double) * 1000))::int for v in embedding] as b
      from embeddings),
    cut as (
      select vec_id, label, [b[i + 1] for i in range(64)
                             if i % 8 >= label % 4 and i % 8 < label % 4 + 4
                                and i // 8 >= label % 3 and i // 8 < label % 3 + 5] as b
      from bytes)
    select vec_id::varchar as image_id, 4 as width, 5 as height,
           array_to_string([printf('%02X', floor(
             0.114::double * v + 0.587::double * (255 - v) + 0.299::double * (v * 7 % 256) + 0.5
           )::int) for v in b], '') as grey
    from cut""",
)
def image_crop_grey(spark, sf):
    """Vectors shown as images of 8 by 8 pixels; a part of each is cut out and turned grey."""
    e = table(spark, sf, "embeddings")

    def two_digits(value):
        return F.lpad(F.hex(value.cast("bigint")), 2, "0")

    level = F.transform(
        "embedding",
        lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1000).cast("int")),
    )
    pixels = F.transform(
        F.col("level"),
        lambda b: F.concat(two_digits(b), two_digits(255 - b), two_digits(b * 7 % 256)),
    )
    images = e.withColumn("level", level).select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(3).alias("n_channels"),
        F.unhex(F.array_join(pixels, "")).alias("data"),
    )
    rects = e.select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.col("label").alias("cluster"),
        (F.col("label") % 4).alias("left"),
        (F.col("label") % 3).alias("top"),
        F.lit(4).alias("width"),
        F.lit(5).alias("height"),
    )
    grey = to_grey(crop_pixels(images, rects))
    return grey.select("image_id", "width", "height", F.hex("data").alias("grey"))


_BYTES = """
    with recursive bytes as (
      select vec_id, label,
             [least(255, floor(abs(v::double) * 1000))::int for v in embedding] as b
      from embeddings)"""


@query(
    "image_files_to_crops",
    f"""{_BYTES},
    marked as (
      select vec_id, key, key % 8 as x, key // 8 as y
      from (select vec_id, b, unnest(range(64)) as key from bytes where vec_id % 9 <> 4)
      where b[key + 1] >= 150),
    reach(vec_id, root, key) as (
      select vec_id, key, key from marked
      union
      select r.vec_id, r.root, m.key from reach r
      join marked c on c.vec_id = r.vec_id and c.key = r.key
      join marked m on m.vec_id = c.vec_id and abs(m.x - c.x) + abs(m.y - c.y) = 1),
    named as (select vec_id, key, min(root) as cluster from reach group by all),
    boxes as (
      select vec_id, cluster, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1
      from named join marked using (vec_id, key) group by all)
    select vec_id, cluster, x0::int as "left", y0::int as top, (x1 - x0 + 1)::int as width,
           (y1 - y0 + 1)::int as height,
           array_to_string([printf('%02X', b[i + 1]) for i in range(64)
                            if i % 8 between x0 and x1 and i // 8 between y0 and y1], '') as grey,
           null::varchar as reason
    from boxes join bytes using (vec_id)
    union all
    select vec_id, null, null, null, null, null, null, 'unknown format'
    from bytes where vec_id % 9 = 4""",
)
def image_files_to_crops(spark, sf):
    """Vectors written as image files, some of them unreadable, and what is bright cut out of them."""
    level = F.transform(
        "embedding",
        lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1000).cast("int")),
    )
    start = F.when(F.col("vec_id") % 9 == 4, "??").otherwise("P2")
    text = F.concat(start, F.lit("\n8 8\n255\n"), F.array_join(level, " "))
    number = F.coalesce(F.col("vec_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = table(spark, sf, "embeddings").select(
        F.concat(F.lit("vec_id="), number, F.lit("/image.pgm")).alias("name"),
        F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).alias("line"),
    )
    # rows of one number are lines of one file
    value = F.array_join(F.sort_array(F.collect_list("line")), "")
    path = shared_path(spark, "image-files")
    write_text_archives(lines.groupBy("name").agg(value.alias("value")), path)
    crops, unread = crop_files(spark, path, 150)
    number = F.regexp_extract("image_id", r"vec_id=(\d+)", 1).cast("bigint").alias("vec_id")
    shown = crops.select(
        number, "cluster", "left", "top", "width", "height", F.hex("data").alias("grey")
    )
    return shown.unionByName(unread.select(number, "reason"), allowMissingColumns=True)


@query(
    "image_run_replaces_its_own",
    f"""{_BYTES}
    select vec_id::varchar as image_id, case when label < 5 then 'second' else 'first' end as run,
           array_to_string([printf('%02X', case when label < 5 then 255 - x else x end) for x in b],
                           '') as pixels
    from bytes where label <> 3""",
)
def image_run_replaces_its_own(spark, sf):
    """A second run brings some images anew and has lost others; the rest of the table stays."""
    level = F.transform(
        "embedding",
        lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1000).cast("int")),
    )
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("image_id"), "label", level.alias("b")
    )

    def run(rows, name, value):
        digits = F.transform("b", lambda x: F.lpad(F.hex(value(x).cast("bigint")), 2, "0"))
        return rows.select(
            "image_id", F.lit(name).alias("run"), F.unhex(F.array_join(digits, "")).alias("data")
        )

    path = shared_path(spark, "image-table")
    replace_images(run(e, "first", lambda x: x), path, slots=16)
    again = e.filter("label < 5")
    second = run(again.filter("label <> 3"), "second", lambda x: 255 - x)
    replace_images(second, path, again, slots=16)
    return image_table(spark, path).select("image_id", "run", F.hex("data").alias("pixels"))
