"""SQL for the registered queries, written for DuckDB over the same tables."""

LISTINGS = """
listings as (
  select o.o_orderkey as id,
    case when o.o_orderkey % 50 = 7 then null else concat('listing ', cast(o.o_orderkey as varchar)) end as name,
    o.o_custkey as host_id, c.c_name as host_name,
    r.r_name as neighbourhood_group, n.n_name as neighbourhood,
    cast(40.5 as double) + (o.o_orderkey % 420) / cast(1000 as double) as latitude,
    cast(-74.25 as double) + (o.o_custkey % 540) / cast(1000 as double) as longitude,
    o.o_orderstatus as room_type,
    cast(coalesce(l.price, 0) as bigint) as price, cast(coalesce(l.min_nights, 1) as int) as minimum_nights,
    coalesce(l.n, 0) as number_of_reviews,
    case when l.n is not null then cast(o.o_orderdate as date) end as last_review,
    round(l.n / cast(7 as double), 2) as reviews_per_month,
    count(*) over (partition by o.o_custkey) as calculated_host_listings_count,
    cast(o.o_orderkey % 366 as int) as availability_365
  from orders o
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
  left join (select l_orderkey, count(*) as n, cast(min(l_quantity) as int) as min_nights,
               cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as price
             from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
)"""

BASE = f"""with {LISTINGS},
priced as (
  select * replace (coalesce(reviews_per_month, 0) as reviews_per_month) from listings
  where name is not null and host_name is not null and price > 0
),
cap as (
  select quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) as cap from priced
),
capped as (select * from priced where price <= (select cap from cap)),
recent as (
  select *, cast(coalesce(greatest(date_diff('day', last_review, (select max(last_review) from capped)), 0), 3650) as int)
    as days_since_last_review from capped
),
bucketed as (
  select *,
    case when number_of_reviews > 0 then 1 else 0 end as has_reviews,
    case when minimum_nights >= 30 then 1 else 0 end as is_long_stay,
    case when calculated_host_listings_count > 1 then 1 else 0 end as is_professional_host,
    case when days_since_last_review <= -1 then 'nan' when days_since_last_review <= 30 then 'last_30_days'
      when days_since_last_review <= 180 then 'last_6_months' when days_since_last_review <= 365 then 'last_year'
      when days_since_last_review <= 3651 then 'older_or_none' else 'nan' end as review_recency_bucket,
    case when minimum_nights <= 0 then 'nan' when minimum_nights <= 1 then 'one_night'
      when minimum_nights <= 3 then 'two_to_three' when minimum_nights <= 7 then 'four_to_seven'
      when minimum_nights <= 30 then 'eight_to_thirty' else 'over_thirty' end as minimum_nights_bucket,
    case when availability_365 <= -1 then 'nan' when availability_365 <= 0 then 'unavailable'
      when availability_365 <= 30 then 'low' when availability_365 <= 180 then 'seasonal'
      when availability_365 <= 365 then 'high' else 'nan' end as availability_bucket,
    case when calculated_host_listings_count <= 0 then 'nan' when calculated_host_listings_count <= 1 then 'single_listing'
      when calculated_host_listings_count <= 5 then 'small_portfolio'
      when calculated_host_listings_count <= 20 then 'medium_portfolio' else 'large_portfolio' end as host_listing_count_bucket,
    ln(1 + minimum_nights) as log_minimum_nights,
    ln(1 + calculated_host_listings_count) as log_host_listing_count,
    cast(round_even(latitude * 100, 0) / 100 as varchar) || '_' || cast(round_even(longitude * 100, 0) / 100 as varchar) as geo_cell
  from recent
),
featured as (
  select *,
    room_type || '__' || neighbourhood_group as room_type_neighbourhood_group,
    room_type || '__' || availability_bucket as room_type_availability_bucket,
    room_type || '__' || minimum_nights_bucket as room_type_minimum_nights_bucket,
    room_type || '__' || neighbourhood as room_type_neighbourhood
  from bucketed
),
hashed as (
  select *, md5('42:' || cast(id as varchar)) as h, ln(1 + price) as label,
    ('0x' || substr(md5('42:' || cast(id as varchar)), 1, 8))::bigint as u
  from featured
),
split_rows as (select *, case when u % 1000 < 200 then 'test' else 'train' end as split from hashed),
train as (select * from split_rows where split = 'train'),
test as (select * from split_rows where split = 'test'),
folded as (select *, cast(ntile(5) over (order by h, id) - 1 as int) as fold from train),
g as (select avg(label) as g, regr_slope(label, number_of_reviews) as slope,
        regr_intercept(label, number_of_reviews) as intercept from train),
tm as (select room_type_neighbourhood as k, (avg(label) * count(*) + (select g from g) * 10) / (count(*) + 10) as m
       from train group by 1),
preds as (
  select t.id, t.neighbourhood_group, t.room_type, t.price, t.label, x.model, x.prediction
  from (select t.*, coalesce(tm.m, g.g) as tme, g.intercept + g.slope * t.number_of_reviews as ols, g.g as mean_label
        from test t cross join g left join tm on tm.k = t.room_type_neighbourhood) t,
    lateral (select 'tme' as model, t.tme as prediction union all select 'ols', t.ols union all select 'mean', t.mean_label) x
),
fold_ids as (select unnest([0, 1, 2, 3, 4])::int as fold),
fold_g as (
  select f.fold, avg(label) as g, regr_slope(label, number_of_reviews) as slope,
    regr_intercept(label, number_of_reviews) as intercept
  from fold_ids f join folded t on t.fold <> f.fold group by 1
),
fold_tm as (
  select f.fold, t.room_type_neighbourhood as k, (avg(label) * count(*) + any_value(fg.g) * 10) / (count(*) + 10) as m
  from fold_ids f join folded t on t.fold <> f.fold join fold_g fg on fg.fold = f.fold group by 1, 2
),
oof as (
  select t.id, t.fold, t.label, coalesce(m.m, fg.g) as tme, fg.intercept + fg.slope * t.number_of_reviews as ols, fg.g as mean_label
  from folded t join fold_g fg on fg.fold = t.fold
  left join fold_tm m on m.fold = t.fold and m.k = t.room_type_neighbourhood
),
oof_long as (
  select id, fold, label, 'tme' as model, 1 as position, tme as prediction from oof
  union all select id, fold, label, 'ols', 2, ols from oof
  union all select id, fold, label, 'mean', 3, mean_label from oof
),
cv as (
  select model, cast(position as int) as position, avg(rmse) as cv_rmse_log from (
    select model, position, fold, sqrt(avg((label - prediction) * (label - prediction))) as rmse
    from oof_long group by 1, 2, 3) group by 1, 2
),
res0 as (
  select *, label as actual_log_price, prediction as predicted_log_price,
    exp(label) - 1 as actual_price, exp(prediction) - 1 as predicted_price from preds
),
res as (
  select *, actual_log_price - predicted_log_price as log_residual,
    abs(actual_log_price - predicted_log_price) as absolute_log_residual,
    actual_price - predicted_price as dollar_residual, abs(actual_price - predicted_price) as absolute_error,
    predicted_price / greatest(actual_price, 1.0) as predicted_to_actual_ratio,
    abs(actual_price - predicted_price) / greatest(actual_price, 1.0) as absolute_percentage_error
  from res0
),
resm as (select * from res where model = 'tme'),
trial_draws as (
  select t.trial, m.model,
    ('0x' || substr(md5('42:' || t.trial || ':' || m.model), 1, 8))::bigint / cast(4294967296 as double) as weight
  from (select unnest(range(15))::int as trial) t, (select unnest(['tme', 'ols', 'mean']) as model) m
),
trial_weights as (
  select trial, max(case when model = 'tme' then weight end) / sum(weight) as w1,
    max(case when model = 'ols' then weight end) / sum(weight) as w2,
    max(case when model = 'mean' then weight end) / sum(weight) as w3
  from trial_draws group by 1
),
trial_scores as (
  select trial, avg(rmse) as cv_rmse_log from (
    select w.trial, o.fold, sqrt(avg(power(w.w1 * o.tme + w.w2 * o.ols + w.w3 * o.mean_label - o.label, 2))) as rmse
    from oof o, trial_weights w group by 1, 2) group by 1
)
"""

SUMMARY = """count(*) as rows, round(quantile_cont(actual_price, 0.5), 3) as actual_median,
  round(quantile_cont(predicted_price, 0.5), 3) as predicted_median, round(avg(absolute_error), 3) as mae,
  round(sqrt(avg(dollar_residual * dollar_residual)), 3) as rmse, round(avg(dollar_residual), 3) as bias,
  round(sqrt(avg(log_residual * log_residual)), 3) as log_rmse, round(avg(absolute_log_residual), 3) as mean_abs_log_error,
  round(quantile_cont(predicted_to_actual_ratio, 0.5), 3) as prediction_ratio,
  round(avg(absolute_percentage_error), 3) as mape"""


def _bands(source: str, column: str, bands: int, name: str) -> str:
    """CTEs ``name_e`` (edges) and ``name`` (source rows with b, lo, hi)."""
    probs = ", ".join(repr(i / bands) for i in range(bands + 1))
    return f""", {name}_e as (
  select list_sort(list_distinct(quantile_cont({column}, [{probs}]))) as e from {source}
), {name} as (
  select s.*, e[b + 1] as lo, e[b + 2] as hi from (
    select s.*, e, cast(len(list_filter(e[2:len(e) - 1], lambda x: x < s.{column})) as int) as b from {source} s, {name}_e) s
)
"""


def _query(body: str) -> str:
    return BASE + body


def _embedding_neighbours(k: int) -> str:
    return f"""with pairs as (
  select a.vec_id as query_id, b.vec_id as base_id, cast(b.label as double) as label,
    list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as distance
  from embeddings a join embeddings b on a.vec_id <> b.vec_id
), nn as (
  select query_id, cast(row_number() over (partition by query_id order by distance, base_id) as int) as rank, base_id,
    distance, label from pairs qualify rank <= {k}
)
"""


BANDS3 = _bands("resm", "actual_price", 3, "b3") + """, banded as (
  select *, case b when 0 then 'Low' when 1 then 'Mid' else 'High' end as price_band from b3
)
"""
BAND_MEANS = BANDS3 + """, band_means as (
  select price_band, round(avg(actual_price), 3) as actual_mean, round(avg(predicted_price), 3) as predicted_mean,
    round(quantile_cont(actual_price, 0.9), 3) as actual_p90, round(quantile_cont(predicted_price, 0.9), 3) as predicted_p90
  from banded group by 1
)
"""
BANDS5 = _bands("resm", "actual_price", 5, "b5") + f""", bands as (
  select b as band, round(lo, 3) as band_lo, round(hi, 3) as band_hi, {SUMMARY} from b5 group by b, lo, hi
)
"""
STRATA = _bands("train", "label", 5, "ls") + """, strata as (
  select *, room_type as rt, neighbourhood_group || '__' || room_type || '__p' || cast(b as varchar) as stratum from ls
), counts as (select stratum, count(*) as n from strata group by 1),
shares as (
  select stratum, n, floor(n * 800 / t) as base, round(n * 800 / t - floor(n * 800 / t), 9) as rem
  from (select stratum, n, cast(sum(n) over () as double) as t from counts)
), alloc as (
  select stratum, n, cast(least(n, base + case when row_number() over (order by rem desc, stratum)
    <= 800 - sum(base) over () then 1 else 0 end) as bigint) as allocation from shares
), picked as (
  select s.* from (select *, row_number() over (partition by stratum order by h, id) as pick from strata) s
  join alloc a using (stratum) where pick <= allocation
)
"""
TOP_NEIGHBOURHOODS = """, topn as (
  select neighbourhood, arg_min(neighbourhood_group, id) as neighbourhood_group, count(*) as rows,
    median(price) as median_price
  from capped group by 1 having count(*) >= 30 order by median_price desc, neighbourhood limit 15
)
"""
ACTIVITY = """, steps as (
  select date_trunc('month', last_review) as m, number_of_reviews as n,
    case when reviews_per_month = 0 then 1.0 else reviews_per_month end as r
  from capped where last_review is not null and number_of_reviews > 0
), walked as (
  select m, n, r, unnest(range(cast(ceil(n / r) as bigint))) as i from steps
), activity as (
  select cast(year(m - to_months(cast(i as int))) as int) as year, cast(month(m - to_months(cast(i as int))) as int) as month,
    sum(least(r, n - i * r)) as reviews from walked group by 1, 2
)
"""
MONTHS = ", ".join(
    f"round(sum(case when month = {m} then reviews else 0 end), 4) as m{m:02d}" for m in range(1, 13)
)


def _histogram(source: str, value: str, bins: int, lo: str, hi: str, extra: str = "") -> str:
    return f""", v as (select {value} as x from {source}), ends as (select min(x) as lo, max(x) as hi from v),
c as (select least(cast(floor((x - lo) * {bins} / (hi - lo)) as int), {bins - 1}) as bin, count(*) as n from v, ends group by 1),
edges as (select b.bin, lo + bin * ((hi - lo) / {bins}) as lo, lo + (bin + 1) * ((hi - lo) / {bins}) as hi
  from (select unnest(range({bins}))::int as bin) b, ends)
select e.bin, {lo} as bin_lo, {hi} as bin_hi, coalesce(c.n, 0) as rows {extra} from edges e left join c on c.bin = e.bin
"""


def _density(group: str, column: str, points: int, cut: float, x_digits: int, digits: int) -> str:
    return f""", st as (
  select {group} as k, count(*) as n, min({column}) as a, max({column}) as b,
    stddev_samp({column}) * power(count(*), -0.2) as h from capped group by 1 having count(*) > 10
), grid as (
  select st.*, i as point, a - {cut} * h + i * ((b - a + 2 * {cut} * h) / {points - 1}) as x
  from st, (select unnest(range({points}))::int as i)
), cnt as (select {group} as k, {column} as v, count(*) as c from capped group by 1, 2)
select g.k as {group}, point, round(any_value(x), {x_digits}) as x,
  round(sum(c * exp(-((x - v) / h) * ((x - v) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), {digits}) as density
from grid g join cnt on cnt.k = g.k group by g.k, point
"""


def _describe(columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round(cast(min({c}) as double), 4) as min, round(quantile_cont(cast({c} as double), 0.25), 4) as q25,
  round(quantile_cont(cast({c} as double), 0.5), 4) as q50, round(quantile_cont(cast({c} as double), 0.75), 4) as q75,
  round(cast(max({c}) as double), 4) as max from capped"""
        for c in columns
    )


def _correlations(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as r from {source}"
        for a in columns
        for b in columns
    )


def _scaled(columns: list[str], centre: bool) -> str:
    def one(c: str) -> str:
        shift = f" - avg({c}) over ()" if centre else ""
        return f"round(({c}{shift}) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) as {c}"

    return "select id, " + ", ".join(one(c) for c in columns)


def _indicators(column: str, prefix: str, values: list[str]) -> str:
    return ", ".join(f"case when {column} = '{v}' then 1 else 0 end as \"{prefix}_{v}\"" for v in values)


LISTING_COLUMNS = [
    ("id", "bigint"), ("name", "string"), ("host_id", "bigint"), ("host_name", "string"),
    ("neighbourhood_group", "string"), ("neighbourhood", "string"), ("latitude", "double"), ("longitude", "double"),
    ("room_type", "string"), ("price", "bigint"), ("minimum_nights", "int"), ("number_of_reviews", "bigint"),
    ("last_review", "date"), ("reviews_per_month", "double"), ("calculated_host_listings_count", "bigint"),
    ("availability_365", "int"),
]
FEATURE_TABLE = """select * exclude (name, host_id, host_name, last_review) replace (
  round(log_minimum_nights, 9) as log_minimum_nights, round(log_host_listing_count, 9) as log_host_listing_count) from featured"""
MEAN_PRICE = "round(avg(price), 3) as mean_price, round(median(price), 3) as median_price"
RESIDUALS = ["actual_log_price", "predicted_log_price", "log_residual", "absolute_log_residual", "actual_price",
             "predicted_price", "dollar_residual", "absolute_error", "predicted_to_actual_ratio",
             "absolute_percentage_error"]
SCALED = ["minimum_nights", "number_of_reviews", "reviews_per_month", "availability_365"]
STATS = ["price", "minimum_nights", "number_of_reviews", "availability_365"]
ENCODED = ["price_log", "minimum_nights", "number_of_reviews", "calculated_host_listings_count", "availability_365",
           "days_since_last_review", "room_F", "room_O", "room_P"]
ROOMS = ["F", "O", "P"]
BOROUGHS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


# Queries whose SQL states what must hold of a fit, by model.
FITS = {"fit_elastic_net": "ElasticNet", "fit_gbt": "XGBoost", "fit_rff_svr": "SVM",
        "fit_random_forest": "RandomForest"}


def _oracles() -> dict[str, str]:
    body = {
        **{query: f"""select '{model}' as model, count(*) as rows, count(*) as finite, true as beats_mean,
            true as rmse_at_least_mae from test""" for query, model in FITS.items()},
        "checkpoint_roundtrip": "select id, true as same from test",
        "clean_nulls": """select id, coalesce(reviews_per_month, 0) as reviews_per_month,
            coalesce(cast(last_review as varchar), 'No reviews') as last_review from listings""",
        "clean_required": "select id, name, host_name, price from priced",
        "iqr_cap_filter": "select id, price from capped",
        "clean_listings": FEATURE_TABLE,
        "engineered_features": FEATURE_TABLE,
        "median_impute": """, holed as (select id, reviews_per_month,
            case when number_of_reviews > 0 then minimum_nights end as minimum_nights,
            case when number_of_reviews > 0 then number_of_reviews end as number_of_reviews from listings)
          select id, """ + ", ".join(
            f"round(cast(coalesce({c}, (select median({c}) from holed)) as double), 6) as {c}"
            for c in ("reviews_per_month", "minimum_nights", "number_of_reviews")) + " from holed",
        "zero_price_rows": """select id, host_id, room_type, price from listings
            where name is not null and host_name is not null and price = 0""",
        "price_cap_audit": """, scoped as (
            select 'positive_price_rows_before_cap' as scope, price from priced
            union all select case when price <= (select cap from cap) then 'included_after_iqr_cap'
              else 'excluded_above_iqr_cap' end, price from priced)
          select scope, count(*) as rows, round(count(*) / (select cast(count(*) as double) from priced), 6) as share,
            cast(min(price) as double) as min_price, round(median(price), 3) as median_price,
            round(avg(price), 3) as mean_price, cast(max(price) as double) as max_price from scoped group by 1""",
        "cap_excluded_by_segment": """select neighbourhood_group, room_type, count(*) as rows,
            round(median(price), 3) as median_price, round(avg(price), 3) as mean_price
          from priced where price > (select cap from cap) group by 1, 2""",
        "price_quantiles": """select round(quantile_cont(price, 0.25), 4) as q1, round(quantile_cont(price, 0.5), 4) as median,
            round(quantile_cont(price, 0.75), 4) as q3, round(quantile_cont(price, 0.9), 4) as p90 from priced""",
        "finite_check": """select count(*) as rows, count(*) filter (where not isfinite(exp(prediction) - 1)) as not_finite
          from preds""",
        "log_target": "select id, round(ln(1 + price), 9) as label from capped",
        "geo_cell": """select id, cast(round_even(latitude * 100, 0) / 100 as varchar) || '_'
            || cast(round_even(longitude * 100, 0) / 100 as varchar) as geo_cell from listings""",
        "geo_points": "select id, room_type, latitude, longitude, price from capped",
        "review_recency": """select id, cast(days_since_last_review as int) as days_since_last_review, has_reviews,
            review_recency_bucket from featured""",
        "review_recency_first_eda": """select id, cast(case when last_review is null then 9999
            else days_since_last_review end as int) as days_since_last_review from featured""",
        "flags": """select id, case when number_of_reviews > 0 then 1 else 0 end as has_reviews,
            case when minimum_nights >= 30 then 1 else 0 end as is_long_stay,
            case when calculated_host_listings_count > 1 then 1 else 0 end as is_professional_host from listings""",
        "hash_split": "select id, split from split_rows",
        "hash_split_exact": """select id, case when row_number() over (order by h, id) <= ceil(0.2 * count(*) over ())
            then 'test' else 'train' end as split from hashed""",
        "kfold_assign": "select id, cast(ntile(5) over (order by h, id) - 1 as int) as fold from hashed",
        "fraction_sample": """select id, price from (select id, price, row_number() over (order by h, id) as r,
            count(*) over () as n from hashed) where r <= round_even(0.35 * n, 0)""",
        "stratified_alloc": STRATA + "select stratum, n, allocation from alloc",
        "stratified_sample": STRATA + "select id, neighbourhood_group, room_type, price from picked",
        "group_capped_sample": """select id, room_type from (select id, room_type,
            row_number() over (partition by room_type order by h, id) as r from hashed where number_of_reviews > 0)
          where r <= 8000""",
        "semi_display_rows": "select id, name, host_name, price, reviews_per_month, last_review from capped",
        "anti_unsampled": STRATA + "select id, price from train where id not in (select id from picked)",
        "target_mean_encode": """, tn as (select neighbourhood as k,
            (avg(label) * count(*) + (select g from g) * 10) / (count(*) + 10) as m from train group by 1)
          select s.id, round(coalesce(tn.m, g.g), 6) as neighbourhood_target_mean,
            round(coalesce(tm.m, g.g), 6) as room_type_neighbourhood_target_mean
          from split_rows s cross join g left join tn on tn.k = s.neighbourhood
          left join tm on tm.k = s.room_type_neighbourhood""",
        "target_mean_by_fold": " union all ".join(
            f"""select f.fold, '{c}' as feature, t.{c} as category, count(*) as rows,
              round((avg(label) * count(*) + any_value(fg.g) * 10) / (count(*) + 10), 6) as target_mean
            from fold_ids f join folded t on t.fold <> f.fold join fold_g fg on fg.fold = f.fold group by 1, 2, 3"""
            for c in ("neighbourhood", "room_type")),
        "dummies_drop_first": f"select id, {_indicators('room_type', 'room_type', ROOMS[1:])} from capped",
        "dummies_full": f"""select id, {_indicators('room_type', 'room', ROOMS)},
            {_indicators('neighbourhood_group', 'borough', BOROUGHS)} from capped""",
        "standard_scale": _scaled(SCALED, True) + " from capped",
        "scale_no_mean": _scaled([*SCALED, "constant"], False) + " from (select *, cast(1 as double) as constant from capped)",
        "qcut_bands": _bands("capped", "price", 3, "a3") + _bands("capped", "price", 5, "a5") + _bands("capped", "price", 10, "a10")
        + "select a3.id, a3.price, " + ", ".join(
            f"a{b}.b as band{b}, round(cast(a{b}.lo as double), 4) as band{b}_lo, round(cast(a{b}.hi as double), 4) as band{b}_hi"
            for b in (3, 5, 10)) + " from a3 join a5 using (id) join a10 using (id)",
        "residual_frame": "select id, model, " + ", ".join(f"round({c}, 4) as {c}" for c in RESIDUALS) + " from res",
        "segment_summary": f"select model, room_type, {SUMMARY} from res group by 1, 2 having count(*) >= 30",
        "segment_summary_borough": f"select neighbourhood_group, {SUMMARY} from resm group by 1 having count(*) >= 30",
        "price_band_summary": BANDS5 + "select * from bands",
        "price_decile_summary": _bands("resm", "actual_price", 10, "b10") + """
          select b as decile, count(*) as rows, round(any_value(lo), 3) as decile_lo, round(any_value(hi), 3) as decile_hi,
            round(avg(actual_price), 3) as actual_mean, round(avg(predicted_price), 3) as predicted_mean,
            round(avg(dollar_residual), 3) as residual_mean, round(avg(absolute_error), 3) as mae,
            round(sqrt(avg(log_residual * log_residual)), 3) as log_rmse,
            round(avg(absolute_percentage_error), 3) as mape,
            round(quantile_cont(predicted_to_actual_ratio, 0.5), 3) as prediction_ratio_median from b10 group by 1""",
        "band_warning": BANDS5 + """select case
            when count(*) = 0 then 'No price-band rows available for high-end compression check.'
            when arg_max(bias, (actual_median, band)) > 0 and arg_max(prediction_ratio, (actual_median, band)) < 1 then
              format('Top actual-price band is underpredicted: median predicted/actual ratio is {:.3f}, mean residual is ${:,.2f}.',
                arg_max(prediction_ratio, (actual_median, band)), arg_max(bias, (actual_median, band)))
            else 'Top actual-price band does not show median underprediction in this run.' end as warning from bands""",
        "band_mean_p90": BAND_MEANS + "select * from band_means",
        "band_unpivot": BAND_MEANS + " union all ".join(
            f"select price_band, '{s}' as series, {s.lower()}_{x} as price, '{x}' as statistic from band_means"
            for s in ("Actual", "Predicted") for x in ("mean", "p90")),
        "scatter_by_band": BANDS3 + """select id, round(actual_price, 3) as actual_price,
            round(predicted_price, 3) as predicted_price, price_band from banded""",
        "mispriced_topk": BANDS3 + """, gaps as (select id, price_band, actual_price, predicted_price,
            predicted_price - actual_price as gap from banded),
          both_sides as (
            (select *, 'under_priced_candidate' as pricing_direction from gaps order by gap desc, id limit 20)
            union all (select *, 'over_priced_candidate' from gaps order by gap, id limit 20))
          select id, price_band, round(actual_price, 3) as actual_price, round(predicted_price, 3) as predicted_price,
            round(gap, 3) as pricing_gap, round(abs(gap), 3) as absolute_gap,
            round(case when actual_price > 0 then gap / actual_price * 100 end, 3) as percent_gap, pricing_direction
          from both_sides""",
        "dollar_metrics": """select model, count(*) as rows, round(avg(absolute_error), 4) as mae,
            round(sqrt(avg(dollar_residual * dollar_residual)), 4) as rmse,
            round(1 - sum(dollar_residual * dollar_residual) / (var_pop(actual_price) * count(*)), 6) as r2
          from res group by 1""",
        "ols_single": """select round(regr_slope(label, number_of_reviews), 8) as slope,
            round(regr_intercept(label, number_of_reviews), 8) as intercept,
            round(regr_r2(label, number_of_reviews), 8) as r2 from train""",
        "vote_equal": """select id, round(any_value(label), 6) as label, round(avg(prediction), 6) as prediction
          from preds group by 1""",
        "vote_weighted": """select id, round(any_value(label), 6) as label,
            round(sum(prediction * case model when 'tme' then 3.0 when 'ols' then 1.0 else 0.5 end) / 4.5, 6) as prediction
          from preds group by 1""",
        "weight_search": "select trial, round(cv_rmse_log, 7) as cv_rmse_log from trial_scores",
        "trial_best_so_far": """select 'VotingEnsembleWeighted' as model, trial, round(cv_rmse_log, 7) as value,
            min(round(cv_rmse_log, 7)) over (order by trial) as best from trial_scores""",
        "cv_scores": "select model, position, round(cv_rmse_log, 7) as cv_rmse_log from cv",
        "ensemble_candidates": """, near as (select * from cv where cv_rmse_log <= 1.03 * (select min(cv_rmse_log) from cv))
          select model, position, round(cv_rmse_log, 7) as cv_rmse_log from (
            select * from near where (select count(*) from near) >= 2
            union all (select * from cv where (select count(*) from near) < 2 order by cv_rmse_log, position limit 2))""",
        "model_comparison": """select r.model, round(cv.cv_rmse_log, 6) as cv_rmse_log,
            round(avg(absolute_error), 4) as test_mae_dollars,
            round(sqrt(avg(dollar_residual * dollar_residual)), 4) as test_rmse_dollars,
            round(1 - sum(dollar_residual * dollar_residual) / (var_pop(actual_price) * count(*)), 6) as test_r2,
            '{"feature":"' || case r.model when 'tme' then 'room_type_neighbourhood' when 'ols' then 'number_of_reviews'
              else 'none' end || '","seed":"42"}' as best_params_json
          from res r join cv on cv.model = r.model group by r.model, cv.cv_rmse_log""",
        "scan_listings": "select * replace (cast(last_review as varchar) as last_review) from listings",
        "fit_ols_single": """select round(regr_slope(label, number_of_reviews), 6) as slope,
            round(regr_intercept(label, number_of_reviews), 6) as intercept from train""",
        "one_hot_unknown": """, cells as (select geo_cell, row_number() over (order by geo_cell) - 1 as place
            from (select distinct geo_cell from train))
          select t.id, t.geo_cell, cast(coalesce(c.place, -1) as int) as place
          from test t left join cells c on c.geo_cell = t.geo_cell""",
        "stack_oof_matrix": """select id, fold, round(label, 6) as label, round(tme, 6) as tme, round(ols, 6) as ols,
            round(mean_label, 6) as mean from oof""",
        "top_hosts": "select host_name, count(*) as rows from capped group by 1 order by 2 desc, 1 limit 10",
        "borough_share": """select neighbourhood_group, count(*) as rows,
            round(count(*) / cast((select count(*) from capped) as double) * 100, 4) as percent from capped group by 1""",
        "min_nights_counts": "select minimum_nights, count(*) as rows from capped where minimum_nights <= 30 group by 1",
        "price_by_room_type": f"select room_type, count(*) as rows, {MEAN_PRICE} from capped group by 1",
        "price_by_borough": f"select neighbourhood_group, count(*) as rows, {MEAN_PRICE} from capped group by 1",
        "room_by_borough": "select neighbourhood_group, room_type, count(*) as rows from capped group by 1, 2",
        "room_mix_share": "select neighbourhood_group, " + ", ".join(
            f"round(count(*) filter (where room_type = '{r}') * 100.0::double / count(*), 4) as {r}" for r in ROOMS)
        + " from capped group by 1",
        "top_neighbourhoods": TOP_NEIGHBOURHOODS + """select neighbourhood, neighbourhood_group, rows,
            round(median_price, 3) as median_price from topn""",
        "present_boroughs": TOP_NEIGHBOURHOODS + """select distinct neighbourhood_group from capped
          where neighbourhood in (select neighbourhood from topn)""",
        "review_activity": ACTIVITY + "select year, month, round(reviews, 4) as reviews from activity",
        "review_heatmap": ACTIVITY + f""", totals as (select year, sum(reviews) as t from activity group by 1)
          select year, {MONTHS} from activity join totals using (year)
          where t >= 0.01 * (select max(t) from totals) group by year""",
        "ecdf_by_room": """select room_type, price, round(row_number() over (partition by room_type order by price, id)
            / cast(count(*) over (partition by room_type) as double), 9) as cdf from capped""",
        "ecdf_steps": """, c as (select room_type, price, count(*) as rows from capped group by 1, 2)
          select room_type, price, rows,
            cast(sum(rows) over (partition by room_type order by price) - rows as bigint) as below,
            cast(sum(rows) over (partition by room_type) as bigint) as total from c""",
        "hist_equal_width": _histogram("capped", "cast(price as double)", 50, "round(e.lo, 4)", "round(e.hi, 4)"),
        "hist_log_price": _histogram("capped", "ln(1 + price)", 50, "round(e.lo, 6)", "round(e.hi, 6)"),
        "hist_log_width": _histogram(
            "capped where reviews_per_month > 0", "log10(reviews_per_month)", 44, "round(power(10, e.lo), 6)",
            "round(power(10, e.hi), 6)",
            ", (select round(median(reviews_per_month), 6) from capped where reviews_per_month > 0) as median"),
        "kde_by_room": _density("room_type", "availability_365", 200, 3.0, 6, 9),
        "violin_density": _density("neighbourhood_group", "price", 100, 2.0, 3, 12),
        "violin_quartiles": """select neighbourhood_group, count(*) as rows, round(quantile_cont(price, 0.25), 3) as q1,
            round(quantile_cont(price, 0.5), 3) as median, round(quantile_cont(price, 0.75), 3) as q3 from capped group by 1""",
        "box_stats": """, q as (select room_type, count(*) as rows, quantile_cont(price, 0.25) as q1,
            quantile_cont(price, 0.5) as median, quantile_cont(price, 0.75) as q3 from capped group by 1),
          j as (select q.*, cast(c.price as double) as x,
            c.price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
            from capped c join q on q.room_type = c.room_type)
          select room_type, rows, round(q1, 3) as q1, round(median, 3) as median, round(q3, 3) as q3,
            round(least(min(x) filter (where inside), q1), 3) as whisker_lo,
            round(greatest(max(x) filter (where inside), q3), 3) as whisker_hi,
            count(*) filter (where not inside) as outliers
          from j group by room_type, rows, q1, median, q3""",
        "describe_numeric": _describe([*STATS, "reviews_per_month"]),
        "null_counts": " union all ".join(
            f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls from listings" for c, _ in LISTING_COLUMNS),
        "profile_table": " union all ".join(
            f"select {i}::int as position, '{c}' as \"column\", '{t}' as type, count({c}) as present, count(*) as rows from listings"
            for i, (c, t) in enumerate(LISTING_COLUMNS)),
        "first_rows": "select * from listings order by id limit 5",
        "corr_matrix": _correlations("capped", STATS),
        "corr_matrix_encoded": f""", enc as (select * replace (case when last_review is null then 9999
            else days_since_last_review end as days_since_last_review), ln(1 + price) as price_log,
            {_indicators('room_type', 'room', ROOMS)} from featured) """ + _correlations("enc", ENCODED),
        "geo_density": "select geo_cell, room_type, count(*) as rows from featured group by 1, 2",
        "jitter_points": """select id, room_type, number_of_reviews, price,
            round(number_of_reviews * power(10, (('0x' || substr(md5('101:' || id), 1, 8))::bigint
              / cast(4294967296 as double) * 2 - 1) * 0.04), 4) as x,
            round(price * power(10, (('0x' || substr(md5('202:' || id), 1, 8))::bigint
              / cast(4294967296 as double) * 2 - 1) * 0.02), 4) as y
          from (select *, row_number() over (partition by room_type order by h, id) as r from hashed
                where number_of_reviews > 0) where r <= 8000""",
    }
    oracles = {name: _query(text) for name, text in body.items()}
    raw_buckets = {"cut_buckets": "id, minimum_nights_bucket, availability_bucket, host_listing_count_bucket",
                   "interaction_keys": "id, room_type_neighbourhood_group, room_type_availability_bucket, "
                                       "room_type_minimum_nights_bucket, room_type_neighbourhood"}
    # The same bucket expressions over all listings, not only the capped ones.
    everything = BASE.replace("capped as (select * from priced where price <= (select cap from cap))", "capped as (select * from listings)")
    oracles.update({name: f"{everything} select {columns} from featured" for name, columns in raw_buckets.items()})
    oracles["results_table"] = oracles["model_comparison"]
    oracles["clip_bounds"] = """select c_custkey as id, greatest(c_acctbal, 0.0) as at_least_zero,
        greatest(c_acctbal, 1.0) as at_least_one, least(greatest(c_acctbal, 100.0), 5000.0) as both_sides from customer"""
    oracles["params_json"] = """select event_id, '{"event_type":"' || event_type || '","k":"'
        || json_extract_string(props, '$.k') || '"}' as params_json from events"""
    # The report read back is the table that was written.
    oracles["mispriced_report"] = oracles["mispriced_topk"]
    oracles["event_value_quantiles"] = "select event_type, " + ", ".join(
        f"round(quantile_cont(value, {p}), 6) as {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p90", 0.9))
    ) + " from events group by 1"
    oracles["knn_exact"] = _embedding_neighbours(5) + "select query_id, rank, base_id, round(distance, 6) as distance, label from nn"
    oracles["knn_uniform"] = _embedding_neighbours(10) + """select query_id, round(avg(label), 6) as prediction
        from nn group by 1"""
    oracles["knn_distance_weighted"] = _embedding_neighbours(10) + """select query_id,
        round(case when min(distance) = 0 then avg(label) filter (where distance = 0)
          else sum(label / distance) / sum(1 / distance) end, 6) as prediction from nn group by 1"""
    return oracles


ORACLES = _oracles()
