"""Activities and sensor streams made from the driver's tables; the same SQL text runs in both engines.

Only whole-number arithmetic and its quotients are used, so values agree to the last bit.  Nulls and zeros are spread so that
every load status occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACTIVITIES = """
select c.c_nationkey as athlete_id, r.r_name as sport, o.o_orderpriority as type, cast(o.o_orderdate as date) as date, o.o_orderkey as id,
  case when o.o_orderkey % 53 = 0 then null when o.o_orderkey % 71 = 0 then 0 else 600 + (o.o_orderkey * 37) % 5400 end as moving_time,
  case when o.o_orderkey % 59 = 0 then null else 900 + (o.o_orderkey * 41) % 6000 end as elapsed_time,
  case when o.o_orderkey % 47 = 0 then null else cast(1000 + (o.o_orderkey * 43) % 20000 as double) end as distance,
  case when o.o_orderkey % 11 = 0 then null when o.o_orderkey % 83 = 0 then cast(0 as double) else cast(45 + (o.o_orderkey * 13) % 160 as double) end as average_heartrate,
  case when o.o_orderkey % 7 = 0 then null else cast((o.o_orderkey * 17) % 350 as double) end as average_watts,
  case when o.o_orderkey % 5 = 0 then null when o.o_orderkey % 17 = 0 then cast(0 as double) else cast(120 + (o.o_orderkey * 19) % 200 as double) end as weighted_average_watts,
  case when o.o_orderkey % 13 = 0 then null else cast((o.o_orderkey * 29) % 900 as double) end as elevation_gain,
  case when o.o_orderkey % 9 = 0 then null else cast(200 + (o.o_orderkey * 31) % 200 as double) / cast(100 as double) end as average_gap
from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""

#: one sample a second. The events of 15 users are an activity, about 1000 samples at any scale, so that more data are more
#: activities. By the last digit of the activity: some are unsteady, some have no heart rate for most of the time; spikes are spread
STREAMS = """
select activity_id % 3 as athlete_id, activity_id, seq_no, cast(seq_no as double) as time_s,
  case when event_id % 97 = 0 or (activity_id % 10 = 4 and seq_no % 10 < 6) then null when event_id % 211 = 0 then cast(250 as double) else cast(130 + (event_id * 31) % 25 as double) end as heartrate,
  cast(180 + (event_id * 17) % 40 as double) as watts, cast(v as double) / cast(500 as double) as velocity_smooth,
  cast(sum(v) over (partition by activity_id order by seq_no rows between unbounded preceding and current row) as double) / cast(500 as double) as distance
from (
  select u as activity_id, event_id, row_number() over (partition by u order by ts, event_id) - 1 as seq_no,
    case when event_id % 307 = 0 then 12000 when u % 10 in (0, 3, 6) then 500 + (event_id * 7919) % 3000 when event_id % 101 = 0 then 0 else 1500 + (event_id * 7919) % 100 end as v
  from (select cast(floor(user_id / 15) as bigint) as u, event_id, ts from {events}) x
) e
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACTIVITIES, **{t: _table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")})


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STREAMS, events=_table(spark, sf_dir, "events"))


def sql_of(text: str) -> str:
    """The adapter for an engine that has the tables under their own names."""
    return text.format(**{t: t for t in ("orders", "customer", "nation", "region", "events")})
