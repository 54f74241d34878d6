"""The registered queries as DuckDB SQL, written apart from the operators: join spines, self joins, recursion."""

from __future__ import annotations

from .adapters import ACTIVITIES, STREAMS, sql_of

_ACTS = f"activities as ({sql_of(ACTIVITIES)})"
_STREAMS = f"streams as ({sql_of(STREAMS)})"
_TYPES = "('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"
_NP = "case when weighted_average_watts > 0 then weighted_average_watts when average_watts > 0 then average_watts else 0 end"
_DURATION = "case when moving_time > 0 then moving_time / cast(60 as double) end"
_HRSS = "case when moving_time > 0 and average_heartrate > 50 and average_heartrate <= 190 then moving_time / cast(60 as double) * (average_heartrate - 50) / 140 end"
_TSS = f"case when moving_time > 0 and {_NP} > 0 then cast(moving_time as double) * ({_NP}) * (({_NP}) / 250.0) / (250.0 * 3600) * 100 end"


def _days(load: str, fetch: str, end: str, missing: str = "zero", types: str = _TYPES) -> str:
    """CTEs up to days(athlete_id, date, daily_load): a spine joined with daily sums."""
    value = "coalesce(d.daily, 0)" if missing == "zero" else "case when d.n is null then 0 else d.daily end"
    return f"""{_ACTS},
scoped as (select *, {load} as load from activities where date <= date '{end}' and type in {types}),
bounds as (select athlete_id, greatest(min(date), date '{fetch}') as first_day from scoped group by athlete_id having max(date) >= date '{fetch}'),
spine as (select athlete_id, cast(unnest(generate_series(cast(first_day as timestamp), timestamp '{end} 00:00:00', interval 1 day)) as date) as date from bounds),
daily as (select athlete_id, date, sum(load) as daily, count(*) as n from scoped where date >= date '{fetch}' group by athlete_id, date),
days as (select s.athlete_id, s.date, cast({value} as double) as daily_load, d.n as n from spine s left join daily d on s.athlete_id = d.athlete_id and s.date = d.date)"""


def _mean(x: str, k: int) -> str:
    frame = f"over (partition by athlete_id order by date rows between {k - 1} preceding and current row)"
    return f"case when count({x}) {frame} = {k} then avg({x}) {frame} end"


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


_RA = f"ra as (select athlete_id, date, daily_load, {_mean('daily_load', 7)} as atl, {_mean('daily_load', 28)} as ctl from days)"


def _acwr(load: str, missing: str = "zero", types: str = _TYPES) -> str:
    return f"""{_days(load, '1994-12-04', '2001-08-01', missing, types)},
{_RA},
series as (select athlete_id, date, atl, ctl, case when ctl > 0.01 then atl / ctl end as acwr from ra where date >= date '1995-01-01'),
smooth as (select *, {_mean('acwr', 7)} as acwr_smooth from series)"""


_EWMA_STATE = """
numbered as (select *, row_number() over (partition by athlete_id order by date) as i from days),
state as (
  select athlete_id, date, i, daily_load, daily_load as a, daily_load as c from numbered where i = 1
  union all
  select n.athlete_id, n.date, n.i, n.daily_load,
    case when n.daily_load is null then s.a when s.a is null then n.daily_load else {aa} * n.daily_load + (1 - {aa}) * s.a end,
    case when n.daily_load is null then s.c when s.c is null then n.daily_load else {ac} * n.daily_load + (1 - {ac}) * s.c end
  from state s join numbered n on n.athlete_id = s.athlete_id and n.i = s.i + 1
),
ewma as (select athlete_id, date, case when daily_load is not null then a end as atl, case when daily_load is not null then c end as ctl from state),
ewma_ratio as (select *, case when ctl > 0.01 then atl / ctl end as acwr from ewma)"""
_EWMA = _EWMA_STATE.format(aa="(1 - exp(-ln(2) / 3.5))", ac="(1 - exp(-ln(2) / 14))")


def _bands(source: str, by: str = "") -> str:
    ps = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    group = "date" + (f", {by}" if by else "")
    each = " union all ".join(f"select {group}, n_athletes, '{n}' as percentile, {n} as value from wide" for n in ps)
    return f"""athletes as (select {group}, athlete_id, avg(acwr_smooth) as v from {source} group by {group}, athlete_id),
wide as (select {group}, count(v) as n_athletes, {', '.join(f'quantile_cont(v, {p}) as {n}' for n, p in ps.items())} from athletes group by {group} having count(v) >= 5),
bands as ({each})"""


_SPORTS = "sports as (select distinct athlete_id, sport from activities), with_sport as (select s.*, sport from smooth s left join sports using (athlete_id))"
_EF_BASE = f"base as (select *, moving_time / cast(60 as double) as minutes from activities where date between date '1995-01-01' and date '2001-08-01' and type in {_TYPES} and average_heartrate > 0)"
_NULLS = "cast(null as double) as quality_score, cast(null as double) as hr_coverage, cast(null as double) as steady_duration_minutes, cast(null as integer) as n_steady_blocks, cast(null as double) as sampling_interval_seconds"
_SPEED = "case when distance > 0 and moving_time > 0 then distance / moving_time / average_heartrate end"


def _stream_rows(output: str, filtered: bool, flagged: bool, min_minutes: int = 4, streams: str = _STREAMS) -> str:
    """CTEs of the stream path with a self join for the rolling variation: one row per activity in `verdict`."""
    low, high = ("0", "2000") if output == "watts" else ("0.5", "15")
    odd = f"(out <= {low} or out >= {high} or heartrate <= 50 or heartrate >= 220)" if flagged else "false"
    return f"""{streams},
pairs as (select *, lag(time_s) over w as t0, lag(heartrate) over w as h0 from streams window w as (partition by athlete_id, activity_id order by time_s, seq_no)),
cover as (select athlete_id, activity_id, sum(case when heartrate > 0 and h0 > 0 then time_s - t0 else 0 end) / sum(time_s - t0) as coverage, median(case when time_s > t0 then time_s - t0 end) as dt, count(heartrate) as n1 from pairs group by athlete_id, activity_id),
valid as (select *, {output} as out from streams where heartrate > 0 and {output} > 0),
marked as (select *, {odd} as odd from valid),
scores as (select athlete_id, activity_id, count(*) as n2, count(*) filter (where odd) as n_odd from marked group by athlete_id, activity_id),
kept as (select *, row_number() over w as rn, lag(time_s) over w as tp from marked where {'not odd' if filtered else 'true'} window w as (partition by athlete_id, activity_id order by time_s, seq_no)),
sizes as (select athlete_id, activity_id, count(*) as n3, median(case when time_s > tp then time_s - tp end) as dt3, (max(time_s) - min(time_s)) / 60 as span from kept group by athlete_id, activity_id),
windows as (select s.*, c.coverage, c.dt, c.n1, greatest(60, cast(ceil(60 / c.dt) as bigint)) as floor_rows, cast(floor(n3 / 4.0) as bigint) as cap from sizes s join cover c using (athlete_id, activity_id)),
ks as (select *, case when cap < floor_rows then cap else greatest(least(cast(ceil(300 / dt3) as bigint), cap), floor_rows) end as k from windows),
roll as (
  select a.athlete_id, a.activity_id, a.rn, count(*) as n, avg(b.out) as m, stddev_samp(b.out) as sd, any_value(ks.k) as k
  from kept a join ks on a.athlete_id = ks.athlete_id and a.activity_id = ks.activity_id
  join kept b on a.athlete_id = b.athlete_id and a.activity_id = b.activity_id and b.rn between a.rn - cast(floor((ks.k - 1) / 2.0) as bigint) and a.rn + cast(floor(ks.k / 2.0) as bigint)
  group by a.athlete_id, a.activity_id, a.rn),
steadied as (select a.*, coalesce(r.n = r.k and r.sd / r.m < 0.08, false) as steady from kept a left join roll r on a.athlete_id = r.athlete_id and a.activity_id = r.activity_id and a.rn = r.rn),
islands as (select *, rn - row_number() over (partition by athlete_id, activity_id, steady order by rn) as island from steadied),
runs as (select athlete_id, activity_id, island, min(rn) as first_rn, (max(time_s) - min(time_s)) / 60 as minutes, min(time_s) as t_first, max(time_s) as t_last, count(*) as n from islands where steady group by athlete_id, activity_id, island),
good as (select *, row_number() over (partition by athlete_id, activity_id order by minutes desc, first_rn) as place, count(*) over (partition by athlete_id, activity_id) as n_blocks from runs where minutes >= {min_minutes} and n >= 100),
best as (select * from good where place = 1),
chosen as (select i.*, b.minutes, b.n_blocks, i.time_s <= (b.t_first + b.t_last) / 2 as early from islands i join best b on i.athlete_id = b.athlete_id and i.activity_id = b.activity_id and i.island = b.island where i.steady),
medians as (select athlete_id, activity_id, any_value(minutes) as minutes, any_value(n_blocks) as n_blocks, median(out / heartrate) as ef, median(case when early then out / heartrate end) as ef1, median(case when not early then out / heartrate end) as ef2 from chosen group by athlete_id, activity_id),
verdict as (select c.athlete_id, c.activity_id, c.coverage, c.dt, c.n1, coalesce(s.n2, 0) as n2, s.n_odd, coalesce(z.n3, 0) as n3, z.span, exists (select 1 from runs r where r.athlete_id = c.athlete_id and r.activity_id = c.activity_id) as any_steady, m.minutes, m.n_blocks, m.ef, m.ef1, m.ef2
  from cover c left join scores s using (athlete_id, activity_id) left join sizes z using (athlete_id, activity_id) left join medians m using (athlete_id, activity_id))"""


#: speed from the distance between samples with a heart rate
_DERIVED = f"""raw as ({sql_of(STREAMS)}),
known as (select activity_id, seq_no, coalesce((distance - lag(distance) over w) / (time_s - lag(time_s) over w), 0) as speed from raw where heartrate is not null window w as (partition by activity_id order by time_s, seq_no)),
streams as (select raw.*, known.speed from raw left join known on raw.activity_id = known.activity_id and raw.seq_no = known.seq_no)"""


def _ef_stream(output: str, metric: str, filtered: bool, flagged: bool, streams: str = _STREAMS) -> str:
    score = "1 - n_odd / cast(n2 as double)" if flagged else "1.0"
    return f"""with {_stream_rows(output, filtered, flagged, streams=streams)},
judged as (select *, case when coverage < 0.9 then 'insufficient_hr_data' when n1 < 100 then 'insufficient_data_points' when n2 < 100 then 'insufficient_valid_data' when n3 < 100 then 'insufficient_data_after_quality_filter'
  when span < 4 then 'too_short' when not any_steady then 'non_steady' when minutes is null then 'insufficient_steady_duration' else 'ok' end as status from verdict)
select athlete_id, activity_id, round(case when status = 'ok' then ef end, 6) as ef_value, status, '{metric}' as ef_metric_requested, '{metric}' as ef_metric_used,
  round(case when status in ('insufficient_hr_data', 'insufficient_data_points', 'insufficient_valid_data') then null else {score} end, 6) as quality_score, round(coverage, 6) as hr_coverage,
  round(case when status = 'ok' then minutes end, 6) as steady_duration_minutes, cast(case when status = 'ok' then n_blocks end as integer) as n_steady_blocks, round(dt, 6) as sampling_interval_seconds from judged"""


_DECOUPLING = f"""with {_stream_rows('velocity_smooth', False, True)},
judged as (select *, case when coverage < 0.9 then 'insufficient_hr_data' when n1 < 100 then 'insufficient_data_points' when n2 < 100 then 'insufficient_valid_data' when not any_steady then 'non_steady'
  when minutes is null then 'insufficient_steady_duration' when ef1 is null or ef2 is null then 'non_steady' else 'ok' end as status from verdict)
select athlete_id, activity_id, round(case when status = 'ok' then (ef1 - ef2) / ef1 * 100 end, 6) as decoupling, status,
  round(case when status in ('insufficient_hr_data', 'insufficient_data_points', 'insufficient_valid_data') then null else 1 - n_odd / cast(n2 as double) end, 6) as quality_score, round(coverage, 6) as hr_coverage,
  round(case when status in ('insufficient_hr_data', 'insufficient_data_points', 'insufficient_valid_data') then null else minutes end, 6) as steady_duration_minutes, round(dt, 6) as sampling_interval_seconds from judged"""


def _flags(limit: str) -> str:
    return f"""{_STREAMS},
steps as (select *, time_s - lag(time_s) over w as dt, abs(heartrate - lag(heartrate) over w) as dh, abs(watts - lag(watts) over w) as dp, abs(velocity_smooth - lag(velocity_smooth) over w) as dv, row_number() over w as rn, count(*) over (partition by activity_id) as n
  from streams window w as (partition by activity_id order by seq_no)),
flagged as (select *, coalesce(heartrate < 30 or heartrate > 220, false) or coalesce(dh / dt > 10, false) as flag_hr_spike, coalesce(watts < 0 or watts > 1500, false) or coalesce(dp / dt > 300, false) as flag_pw_spike,
  coalesce(velocity_smooth > {limit}, false) or coalesce(dv / dt > 3, false) as flag_gps_drift from steps),
anyflag as (select *, flag_hr_spike or flag_pw_spike or flag_gps_drift as flag_any from flagged),
roll as (select a.activity_id, a.seq_no, count(*) as c, avg(b.watts) as m, stddev_samp(b.watts) as sd from steps a join steps b on a.activity_id = b.activity_id and b.rn between a.rn - 59 and a.rn + 60 group by a.activity_id, a.seq_no),
done as (select f.*, coalesce(r.c = 120 and r.sd / r.m < 0.08, false) and not f.flag_any as is_steady_state, 1 - avg(case when f.flag_any then 1.0 else 0.0 end) over (partition by f.activity_id) as quality_score
  from anyflag f join roll r on f.activity_id = r.activity_id and f.seq_no = r.seq_no)"""


def _best_efforts(digits: int = 6) -> str:
    return f"""with {_STREAMS},
tops as (select athlete_id, activity_id, time_s, distance as d, max(distance) over (partition by activity_id order by time_s rows between unbounded preceding and 1 preceding) as top from streams),
segs as (select *, sum(case when top is null or d > top then 1 else 0 end) over (partition by activity_id order by time_s rows between unbounded preceding and current row) as seg from tops),
recs as (select athlete_id, activity_id, seg, max(d) as d, min(time_s) as t_first, max(time_s) as t_last from segs group by athlete_id, activity_id, seg),
gains as (select *, coalesce(t_first - lag(t_last) over (partition by activity_id order by seg), 0) as gain from recs),
knots as (select athlete_id, activity_id, d, sum(gain) over (partition by activity_id order by seg rows between unbounded preceding and current row) as t,
  lead(d) over (partition by activity_id order by seg) as d2, min(d) over (partition by activity_id) as d_min, max(d) over (partition by activity_id) as d_max, count(*) over (partition by activity_id) as n from gains),
knots2 as (select *, lead(t) over (partition by activity_id order by d) as t2 from knots where n >= 10),
targets as (select unnest([400.0, 1000.0, 2000.0]) as x),
starts as (select k.activity_id, x, d as s from knots2 k, targets where d + x <= d_max and d_max - d_min >= x union select k.activity_id, x, d - x as s from knots2 k, targets where d - x >= d_min and d_max - d_min >= x),
timed as (select c.activity_id, c.x, c.s,
    a.t + case when c.s > a.d then (a.t2 - a.t) * (c.s - a.d) / (a.d2 - a.d) else 0 end as ta,
    b.t + case when c.s + c.x > b.d and b.d2 is not null then (b.t2 - b.t) * (c.s + c.x - b.d) / (b.d2 - b.d) else 0 end as tb
  from starts c join knots2 a on a.activity_id = c.activity_id and a.d <= c.s and (a.d2 > c.s or a.d2 is null)
  join knots2 b on b.activity_id = c.activity_id and b.d <= c.s + c.x and (b.d2 > c.s + c.x or b.d2 is null)),
ranked as (select *, row_number() over (partition by activity_id, x order by tb - ta, s) as place from timed where tb - ta > 0)
select activity_id % 3 as athlete_id, activity_id, cast(x as double) as distance, round(tb - ta, {digits}) as time_seconds, round(s, 6) as start_distance, round(s + x, 6) as end_distance from ranked where place = 1"""


_STREAM_ACTS = f"""with {_STREAMS}, acts as (select athlete_id, activity_id, date '2000-01-01' + cast(activity_id * 7 % 400 as integer) as date, case when activity_id % 5 = 1 then 'Ride' else 'Run' end as type, cast(max(time_s) as integer) as moving_time, max(distance) as d
  from streams group by athlete_id, activity_id)"""


def _metrics() -> str:
    missing = "moving_time is null or moving_time <= 0"
    rows = {
        "duration_mins": (_DURATION, f"case when {missing} then 'missing_duration' else 'ok' end"),
        "distance_km": ("distance / 1000", "case when distance is null then 'missing_distance' else 'ok' end"),
        "elapsed_time_mins": ("case when elapsed_time > 0 then elapsed_time / cast(60 as double) end", "case when elapsed_time is null or elapsed_time <= 0 then 'missing_elapsed_time' else 'ok' end"),
        "elevation_gain_m": ("elevation_gain", "case when elevation_gain is null then 'missing_elevation_gain' else 'ok' end"),
        "hrss": (_HRSS, f"case when {missing} then 'missing_duration' when average_heartrate is null or average_heartrate <= 0 then 'missing_heart_rate' when average_heartrate <= 50 or average_heartrate > 190 then 'hr_out_of_range' else 'ok' end"),
        "tss": (_TSS, f"case when {missing} then 'missing_duration' when {_NP} <= 0 then 'missing_power' else 'ok' end"),
    }
    return f"with {_ACTS} " + " union all ".join(f"select id, '{m}' as metric, round({v}, 6) as load, {s} as load_status from activities" for m, (v, s) in rows.items())


_HRSS_STATUS = "case when moving_time is null or moving_time <= 0 then 'missing_duration' when average_heartrate is null or average_heartrate <= 0 then 'missing_heart_rate' when average_heartrate <= 50 or average_heartrate > 190 then 'hr_out_of_range' else 'ok' end"


def oracle_sql() -> dict[str, str]:
    series = _round("atl", "ctl", "acwr", "acwr_smooth")
    return {
        "load_metrics_all": _metrics(),
        "load_thresholds": f"""with {_ACTS}, s as (
  select 'tss' as metric, case when moving_time > 0 then 'missing_ftp' else 'missing_duration' end as load_status from activities
  union all select 'hrss', case when moving_time > 0 then 'missing_threshold_hr' else 'missing_duration' end from activities
  union all select 'pulse', 'unsupported_metric' from activities) select metric, load_status, count(*) as n from s group by metric, load_status""",
        "load_status_histogram": f"with {_ACTS}, s as (select {_HRSS_STATUS} as load_status from activities) select load_status, count(*) as n from s where load_status <> 'ok' group by load_status order by n desc, load_status limit 3",
        "daily_load": f"with {_ACTS} select athlete_id, date, round(sum({_TSS}), 6) as daily_load, count(*) as n_activities from activities group by athlete_id, date",
        "acwr_duration": f"with {_acwr(_DURATION)} select athlete_id, date, {series} from smooth",
        "acwr_missing_na": f"with {_acwr(_HRSS, 'na', "('1-URGENT')")} select athlete_id, date, {series} from smooth",
        "acwr_ewma_ra": f"with {_days(_DURATION, '1994-12-04', '2001-08-01')}, {_RA}, s as (select *, case when ctl > 0.01 then atl / ctl end as acwr from ra), t as (select *, {_mean('acwr', 7)} as acwr_smooth from s) select athlete_id, date, {series} from t where date >= date '1995-01-01'",
        "acwr_ewma": f"with recursive {_days(_HRSS, '1994-11-06', '2001-08-01', 'na')}, {_EWMA}, t as (select *, {_mean('acwr', 7)} as acwr_smooth from ewma_ratio) select athlete_id, date, {series} from t where date >= date '1995-01-01'",
        "bootstrap_resample_fixed_starts": f"""with {_days(_DURATION, '1995-01-01', '2001-08-01')}, n as (select athlete_id, date, daily_load, row_number() over (partition by athlete_id order by date) - 1 as i, count(*) over (partition by athlete_id) as size from days)
select cast(a.athlete_id as bigint) as athlete_id, a.i as place, round(b.daily_load, 6) as daily_load from n a join n b on a.athlete_id = b.athlete_id and b.i = (cast(floor(a.i / 7) as bigint) * 37 + a.athlete_id) % (a.size - 6) + a.i % 7""",
        "bootstrap_bands_by_day": f"""with recursive {_days(_DURATION, '1995-01-01', '2001-08-01')}, {_EWMA}, t as (select *, {_mean('acwr', 7)} as v from ewma_ratio)
select athlete_id, date, round(v, 6) as acwr_lower, round(v, 6) as acwr_upper from t where date >= date '2000-01-01'""",
        "exposure": f"with {_days(_DURATION, '2001-05-10', '2001-08-01')}, s as (select athlete_id, date, daily_load, {_mean('daily_load', 7)} as atl, {_mean('daily_load', 42)} as ctl from days) select athlete_id, date, {_round('daily_load', 'atl', 'ctl')}, round(case when ctl > 0 then atl / ctl end, 6) as acwr from s where date >= date '2001-06-21'",
        "acwr_zones": f"with {_acwr(_DURATION)}, z as (select case when acwr is null then null when acwr < 0.8 then 'low' when acwr < 1.3 then 'reference' when acwr <= 1.5 then 'elevated' else 'high' end as zone from smooth) select zone, count(*) as n from z group by zone",
        "history_warnings": f"""with {_ACTS}, s as (select athlete_id, date, {_HRSS} as load from activities where date <= date '1995-06-30'),
b as (select athlete_id, min(date) as first_available, count(*) filter (where load is null and date >= date '1994-12-04') as n_unknown from s group by athlete_id),
w as (select *, case when first_available > date '1994-12-04' then greatest(0, date_diff('day', date '1995-01-01', least(cast(first_available + interval 26 day as date), date '1995-06-30')) + 1) else 0 end as affected_days from b)
select athlete_id, first_available, cast(affected_days as integer) as affected_days, n_unknown from w where affected_days > 0 or n_unknown > 0""",
        "rest_days": f"with {_days(_DURATION, '1995-01-01', '2001-08-01')} select athlete_id, count(*) as n_days, count(*) filter (where n is null) as n_rest from days group by athlete_id",
        "cohort_bands": f"with {_acwr(_DURATION)}, {_SPORTS}, {_bands('with_sport', 'sport')} select date, sport, n_athletes, percentile, round(value, 6) as value from bands",
        "cohort_wide": f"with {_acwr(_DURATION)}, {_bands('smooth')} select date, {_round('p05', 'p25', 'p50', 'p75', 'p95')} from wide",
        "cohort_overlay": f"with {_acwr(_DURATION)}, {_bands('smooth')} select s.date, {_round('acwr_smooth', 'p05', 'p25', 'p50', 'p75', 'p95')}, athlete_id from smooth s left join wide w on s.date = w.date",
        "duplicate_bands": f"with {_acwr(_DURATION)}, {_SPORTS}, {_bands('with_sport', 'sport')} select date, percentile, count(*) as n from bands group by date, percentile having count(*) > 1",
        "ef_summary_speed": f"""with {_ACTS}, {_EF_BASE}, v as (select *, {_SPEED} as value, average_heartrate < 50 or average_heartrate > 220 as odd from base where minutes >= 20)
select athlete_id, id as activity_id, date, type as activity_type, round(case when not odd and value > 0 then value end, 6) as ef_value, case when odd then 'poor_hr_quality' when value > 0 then 'no_streams' else 'calculation_failed' end as status,
  'speed_hr' as ef_metric_requested, 'speed_hr' as ef_metric_used, {_NULLS} from v""",
        "ef_summary_gap": f"""with {_ACTS}, {_EF_BASE}, v as (select *, case when average_gap > 0 then average_gap / average_heartrate else {_SPEED} end as value, average_gap is null and ({_SPEED}) is not null as fell, average_heartrate < 50 or average_heartrate > 220 as odd from base where minutes >= 20)
select athlete_id, id as activity_id, date, type as activity_type, round(case when value > 0 then value end, 6) as ef_value,
  case when value is null or value <= 0 then 'calculation_failed' when fell then 'gap_stream_unavailable_fallback_to_speed' when odd then 'poor_hr_quality_flagged' else 'no_streams' end as status,
  'gap_hr' as ef_metric_requested, case when fell then 'speed_hr' else 'gap_hr' end as ef_metric_used, {_NULLS} from v""",
        "ef_summary_power": f"""with {_ACTS}, {_EF_BASE}, v as (select *, case when {_NP} > 0 then ({_NP}) / average_heartrate end as value from base where minutes >= 10)
select athlete_id, id as activity_id, date, type as activity_type, round(case when minutes >= 20 then value end, 6) as ef_value, case when minutes < 20 then 'too_short' when value > 0 then 'no_streams' else 'calculation_failed' end as status,
  'power_hr' as ef_metric_requested, 'power_hr' as ef_metric_used, {_NULLS} from v""",
        "ef_stream": _ef_stream("velocity_smooth", "speed_hr", True, True),
        "ef_stream_power": _ef_stream("watts", "power_hr", False, False),
        "decoupling_stream": _DECOUPLING,
        "flag_quality": f"with {_flags('25')} select activity_id, seq_no, flag_hr_spike, flag_pw_spike, flag_gps_drift, flag_any, is_steady_state, round(quality_score, 6) as quality_score from done",
        "quality_summary": f"""with {_flags('7')}, t as (select activity_id % 3 as athlete_id, activity_id, count(*) as total_points, count(*) filter (where flag_any) as flagged_points, count(*) filter (where is_steady_state) as steady_state_points,
  count(*) filter (where flag_hr_spike) as h, count(*) filter (where flag_pw_spike) as p, count(*) filter (where flag_gps_drift) as g, max(quality_score) as q from done group by activity_id)
select athlete_id, activity_id, total_points, flagged_points, round_even(100.0 * flagged_points / total_points, 2) as flagged_pct, steady_state_points, round_even(100.0 * steady_state_points / total_points, 2) as steady_state_pct,
  round_even(q, 3) as quality_score, round_even(100.0 * h / total_points, 2) as hr_spike_pct, round_even(100.0 * p / total_points, 2) as pw_spike_pct, round_even(100.0 * g / total_points, 2) as gps_drift_pct from t""",
        "hr_coverage": f"with {_STREAMS}, p as (select *, lag(time_s) over w as t0, lag(heartrate) over w as h0 from streams window w as (partition by activity_id order by time_s)) select athlete_id, activity_id, round(sum(case when heartrate > 0 and h0 > 0 then time_s - t0 else 0 end) / sum(time_s - t0), 6) as coverage from p group by athlete_id, activity_id",
        "sampling_interval": f"with {_STREAMS}, p as (select *, (time_s - lag(time_s) over (partition by activity_id order by time_s)) * (activity_id % 4 + 1) / 2 as gap from streams) select athlete_id, activity_id, round(median(gap), 6) as sampling_interval_seconds from p group by athlete_id, activity_id",
        "rolling_variation": f"""with {_STREAMS}, s as (select activity_id, seq_no, velocity_smooth as v, activity_id % 10 * 7 + 20 as k from streams),
r as (select a.activity_id, a.seq_no, any_value(a.k) as k, count(*) as n, stddev_samp(b.v) / avg(b.v) as cv from s a join s b on a.activity_id = b.activity_id and b.seq_no between a.seq_no - cast(floor((a.k - 1) / 2.0) as bigint) and a.seq_no + cast(floor(a.k / 2.0) as bigint) group by a.activity_id, a.seq_no)
select activity_id, seq_no, round(case when n = k then cv end, 6) as cv from r""",
        "steady_blocks": f"""with {_STREAMS}, s as (select activity_id, time_s, seq_no - row_number() over (partition by activity_id order by seq_no) as island from streams where velocity_smooth between 3 and 3.3)
select activity_id, count(*) as n, round((max(time_s) - min(time_s)) / 60, 6) as minutes from s group by activity_id, island having count(*) >= 20""",
        "best_efforts": _best_efforts(),
        "pb_progression": f"""with {_ACTS}, e as (select athlete_id, id as activity_id, date as activity_date, moving_time * cast(10000 as double) / distance as time_seconds from activities where distance >= 10000 and moving_time > 0),
c as (select *, min(time_seconds) over (partition by athlete_id order by activity_date, activity_id rows between unbounded preceding and current row) as best from e)
select athlete_id, activity_id, activity_date, cast(10000 as double) as distance, round(time_seconds, 6) as time_seconds, round(best, 6) as cumulative_pb_seconds, time_seconds = best as is_pb, '10k' as distance_label, 'moving' as time_basis from c""",
        "labels_and_periods": """select cast(distance as double) as distance, label, period from (values (1000.0, '1k', '4M 10S'), (5000.0, '5k', '20M 50S'), (10000.0, '10k', '41M 40S'), (21097.5, '21.1k', '1H 27M 54.38S'), (42195.0, 'Marathon', '2H 55M 48.75S'), (3000.0, '3000m', '12M 30S'), (400.0, '400m', '1M 40S')) as t(distance, label, period)""",
        "haversine_track": f"""with {_STREAMS}, p as (select activity_id, seq_no, radians(seq_no * 0.0001 + 1.3) as a, radians(seq_no % 50 * 0.0002 + 103.8) as o from streams),
q as (select *, lag(a) over w as a0, lag(o) over w as o0 from p window w as (partition by activity_id order by seq_no)),
l as (select activity_id, 2 * 6371000 * asin(sqrt(pow(sin((a - a0) / 2), 2) + cos(a0) * cos(a) * pow(sin((o - o0) / 2), 2))) as leg from q)
select activity_id, round(sum(leg), 6) as meters, round(max(leg), 6) as longest from l group by activity_id""",
        "ef_stream_from_distance": _ef_stream("speed", "speed_hr", True, True, _DERIVED),
        "decoupling_of_activities": f"""{_STREAM_ACTS} select athlete_id, activity_id, date, decoupling, status, quality_score, hr_coverage, steady_duration_minutes, sampling_interval_seconds
from acts join ({_DECOUPLING}) x using (athlete_id, activity_id) where type = 'Run' and date <= date '2000-12-31' and moving_time >= 990""",
        "pbs_of_activities": f"""{_STREAM_ACTS}, e as (select athlete_id, activity_id, date as activity_date, x.distance as distance, time_seconds from acts join ({_best_efforts(12)}) x using (athlete_id, activity_id) where type = 'Run' and date <= date '2000-12-31'),
c as (select *, min(time_seconds) over (partition by athlete_id, distance order by activity_date, activity_id rows between unbounded preceding and current row) as best from e)
select athlete_id, activity_id, activity_date, distance, round(time_seconds, 6) as time_seconds, round(best, 6) as cumulative_pb_seconds, time_seconds = best as is_pb, case distance when 400 then '400m' when 1000 then '1k' else '2000m' end as distance_label, 'moving' as time_basis from c""",
        "export_load": f"""with {_ACTS} select id, 'a "long", way ' || id as name, type, type as sport_type, date, strftime(make_timestamp((id * 61 % 86400) * 1000000), '%H:%M:%S') as clock, round(case when id % 103 <> 0 then distance end, 6) as distance,
  cast(moving_time as integer) as moving_time, cast(elapsed_time as integer) as elapsed_time, average_heartrate, cast(null as double) as max_watts from activities where id % 101 <> 0 and date between date '1995-01-01' and date '2001-08-01' and type in {_TYPES}""",
        "export_tracks": f"""with {_STREAMS}, p as (select *, radians(seq_no * 0.0001 + 1.3) as a, radians(seq_no % 50 * 0.0002 + 103.8) as o from streams),
q as (select *, lag(a) over w as a0, lag(o) over w as o0, lag(distance) over w as d0 from p window w as (partition by activity_id order by seq_no)),
l as (select *, 2 * 6371000 * asin(sqrt(pow(sin((a - a0) / 2), 2) + cos(a0) * cos(a) * pow(sin((o - o0) / 2), 2))) as leg from q)
select activity_id, case when activity_id % 2 = 0 then 'gpx' else 'tcx' end as format, 'ok' as parse_status, count(*) as n, count(heartrate) as n_heart, sum(heartrate) as heart, case when activity_id % 2 = 1 then sum(watts) end as watts,
  round(case when activity_id % 2 = 0 then sum(leg) else max(distance) end, 6) as distance, round(case when activity_id % 2 = 0 then max(leg) else max(distance - d0) end, 6) as speed, cast(max(time_s) - min(time_s) as double) as seconds from l group by activity_id""",
        "chart_acwr_line": f"with {_acwr(_DURATION)} select athlete_id, date, {series} from smooth where acwr_smooth is not null",
        "chart_cohort_bands": f"with {_acwr(_DURATION)}, {_bands('smooth')} select date, {_round('p05', 'p25', 'p50', 'p75', 'p95')} from wide",
        "chart_exposure_latest": f"with {_days(_DURATION, '2001-05-10', '2001-08-01')}, s as (select athlete_id, date, daily_load, {_mean('daily_load', 7)} as atl, {_mean('daily_load', 42)} as ctl from days) select athlete_id, date, {_round('daily_load', 'atl', 'ctl')}, round(case when ctl > 0 then atl / ctl end, 6) as acwr from s where date = date '2001-08-01'",
        "chart_ef_trend": f"""with {_ACTS}, {_EF_BASE}, v as (select type as activity_type, date_diff('day', date '1970-01-01', date) as x, {_SPEED} as y from base where minutes >= 20 and average_heartrate between 50 and 220),
f as (select activity_type, regr_slope(y, x) as a, regr_intercept(y, x) as b, min(x) as low, max(x) as high from v where y > 0 group by activity_type),
g as (select activity_type, a, b, low as x from f union all select activity_type, a, b, high from f)
select activity_type, cast(x as double) as x, round(b + a * x, 6) as fitted, date '1970-01-01' + cast(x as integer) as date from g""",
        "monthly_ef": f"with {_ACTS}, {_EF_BASE}, v as (select date, type, {_SPEED} as value from base where minutes >= 20 and average_heartrate between 50 and 220) select cast(date_trunc('month', date) as date) as month, type as activity_type, round(avg(value), 6) as mean_ef, count(*) as n from v where value > 0 group by cast(date_trunc('month', date) as date), type",
        "type_counts": f"with {_ACTS} select type, count(*) as n, min(date) as first_day, max(date) as last_day from activities group by type",
        "activity_date_type_filter": f"with {_ACTS} select id, type, date, distance from activities where type in ('1-URGENT', '2-HIGH') and date between date '2000-01-01' and date '2000-12-31'",
        "topk_longest": f"with {_ACTS} select id, athlete_id, distance from activities where distance is not null order by distance desc, id limit 25",
        "union_methods": f"""with recursive {_days(_DURATION, '1994-11-06', '2001-08-01')}, {_EWMA}, {_RA}, both_ as (
  select 'exponential weights' as method, acwr, date from ewma_ratio union all select 'rolling means', case when ctl > 0.01 then atl / ctl end, date from ra)
select method, count(*) as n, count(acwr) as n_known, round(avg(acwr), 6) as mean_acwr from both_ where date >= date '1995-01-01' group by method""",
        "lm_trend": f"with {_ACTS}, {_EF_BASE}, v as (select type, date_diff('day', date '1995-01-01', date) as x, {_SPEED} as y from base where minutes >= 20 and average_heartrate between 50 and 220) select type as activity_type, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as n from v where y > 0 group by type",
    }
