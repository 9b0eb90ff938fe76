"""Queries over events: live logs, trials, step metrics, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates, merging, turns
from ..session import table
from .registry import query


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("props_extract", "select event_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k, case when json_valid(props) then len(json_keys(props)) end::int as n_keys from events")
def props_extract(spark, sf_dir):
    """Fields out of JSON text."""
    return _events(spark, sf_dir).select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.json_object_keys("props").alias("keys")).select("event_id", "event_type", "k", F.when(F.col("keys").isNotNull(), F.size("keys")).alias("n_keys"))


@query("state_asof", """
select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as state_before from events
""")
def state_asof(spark, sf_dir):
    """The user's latest purchase value before each event."""
    e = _events(spark, sf_dir).withColumn("state", F.when(F.col("event_type") == "purchase", F.col("value")))
    return turns.state_as_of(e, "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "state_before")


@query("state_around", """
select event_id, coalesce(last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), -1.0)::double as state_before,
  coalesce(last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), -1.0)::double as state_after from events
""")
def state_around(spark, sf_dir):
    """J4."""
    e = _events(spark, sf_dir).withColumn("state", F.when(F.col("value") > 50, F.col("value")))
    return turns.state_around(e, "user_id", ["ts", "event_id"], "state", F.lit(-1.0)).select("event_id", "state_before", "state_after")


@query("trial_stats", """
select event_type, count(*)::bigint as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd_pop, round(stddev_samp(value), 6) as sd_samp, round(min(value), 6) as lowest, round(max(value), 6) as highest, round(max(value) - min(value), 6) as spread from events group by event_type
""")
def trial_stats(spark, sf_dir):
    return aggregates.trial_stats(_events(spark, sf_dir), "event_type", "value")


@query("item_flips", """
with v as (select user_id, event_id, value > 50 as vote from events), f as (select user_id, arg_min(vote, event_id) as first_vote, count(*) as n, count(*) filter (where vote) as yes from v group by user_id)
select user_id, n::bigint as n, (case when first_vote then n - yes else yes end)::bigint as flips, yes * 2 > n as majority from f
""")
def item_flips(spark, sf_dir):
    """A24, A25."""
    return aggregates.flips(_events(spark, sf_dir).withColumn("vote", F.col("value") > 50), "user_id", "event_id", "vote")


@query("ensemble_mean", """
with e as (select user_id % 20 as grp, case when event_id % 500 = 0 then null else [value, value / 2, value * value] end as s from events), p as (select grp, unnest(s) as score, generate_subscripts(s, 1) - 1 as item from e where s is not null),
f as (select grp, count(*) filter (where s is null) as failed from e group by grp)
select grp, item::int as item, round(case when any_value(failed) = 0 then avg(score) end, 6) as mean, any_value(failed)::bigint as n_failed from p join f using (grp) group by grp, item
""")
def ensemble_mean(spark, sf_dir):
    """Null where a call of the group failed."""
    v = F.col("value")
    e = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("grp"), F.when(F.col("event_id") % 500 != 0, F.array(v, v / 2, v * v)).alias("s"))
    return aggregates.ensemble_mean(e, "grp", "s")


@query("ensemble_partial", """
with e as (select user_id % 20 as grp, case when event_id % 500 = 0 then null else [value, value / 2] end as s from events), p as (select grp, unnest(s) as score, generate_subscripts(s, 1) - 1 as item from e where s is not null),
f as (select grp, count(*) filter (where s is null) as failed from e group by grp)
select grp, item::int as item, round(avg(score), 6) as mean, any_value(failed)::bigint as n_failed from p join f using (grp) group by grp, item
""")
def ensemble_partial(spark, sf_dir):
    """A27."""
    v = F.col("value")
    e = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("grp"), F.when(F.col("event_id") % 500 != 0, F.array(v, v / 2)).alias("s"))
    return aggregates.ensemble_mean(e, "grp", "s", strict=False)


_PAIRED_SQL = """
b as (select user_id, avg(value) as base from events where event_type = 'click' group by user_id), c as (select user_id, avg(value) as cand from events where event_type = 'view' group by user_id),
p as (select user_id, round(base, 6) as base, round(cand, 6) as cand, round(cand - base, 6) as delta from b join c using (user_id))"""


def _paired(spark, sf_dir):
    mean = lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    p = aggregates.paired(mean("click"), mean("view"), ["user_id"], "v")
    return p.select("user_id", *(F.round(c, 6).alias(c) for c in ("base", "cand", "delta")))


@query("paired_delta", f"with {_PAIRED_SQL} select * from p")
def paired_delta(spark, sf_dir):
    """Click means against view means per user."""
    return _paired(spark, sf_dir)


@query("topk_delta", f"with {_PAIRED_SQL} (select *, 'regression' as side from p order by delta, user_id limit 10) union all (select *, 'boost' as side from p order by delta desc, user_id limit 10)")
def topk_delta(spark, sf_dir):
    return aggregates.extremes(_paired(spark, sf_dir), 10, "user_id")


@query("ranked_by_sign", f"with {_PAIRED_SQL} select *, case when delta > 0 then 'boost' else 'regression' end as side, row_number() over (partition by delta > 0 order by abs(delta) desc, user_id)::int as rank from p where delta <> 0")
def ranked_by_sign(spark, sf_dir):
    return aggregates.by_sign(_paired(spark, sf_dir), "user_id")


@query("win_loss", f"""
with {_PAIRED_SQL} select count(*)::bigint as n, count(*) filter (where delta > 0)::bigint as wins, count(*) filter (where delta < 0)::bigint as losses, count(*) filter (where abs(delta) < 1e-9)::bigint as ties, round(avg(delta), 6) as mean_delta, round(stddev_pop(delta), 6) as sd_delta, round(max(abs(delta)), 6) as max_abs_delta from p
""")
def win_loss(spark, sf_dir):
    return aggregates.win_loss(_paired(spark, sf_dir))


@query("smoothed_metric", """
select event_id, event_type, round(avg(value) over (partition by event_type order by event_id rows between 9 preceding and current row), 6) as smoothed from events
""")
def smoothed_metric(spark, sf_dir):
    out = turns.smoothed(_events(spark, sf_dir), ["event_type"], "event_id", "value", 10)
    return out.select("event_id", "event_type", F.round("smoothed", 6).alias("smoothed"))


_STEPS_SQL = "s as (select dayofyear(ts)::int as step, avg(value) as reward from events group by 1)"


def _steps(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.dayofyear("ts").alias("step")).agg(F.avg("value").alias("reward"))


@query("segment_avg", f"""
with {_STEPS_SQL}, w as (select greatest(5, floor(max(step) / 6)) as width from s)
select floor((step - 1) / width)::bigint as segment, min(step) as from_step, max(step) as to_step, round(avg(reward), 6) as mean from s, w group by 1
""")
def segment_avg(spark, sf_dir):
    return aggregates.segments(_steps(spark, sf_dir), "step", "reward", 6, 5)


@query("best_worst", """
with s as (select event_type, event_id as step, value from events), t as (select event_type, max(value) as best, min(value) as worst from s group by event_type)
select event_type, min(step) filter (where value = best) as best_step, any_value(best) as best, min(step) filter (where value = worst) as worst_step, any_value(worst) as worst from s join t using (event_type) group by event_type
""")
def best_worst(spark, sf_dir):
    return aggregates.best_worst(_events(spark, sf_dir), ["event_type"], "event_id", "value")


@query("islands", """
with i as (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as island from events)
select event_type, min(event_id) as first_id, max(event_id) as last_id, count(*)::bigint as n from i group by event_type, island
""")
def islands(spark, sf_dir):
    """Runs of consecutive event ids of one type."""
    i = turns.islands(_events(spark, sf_dir), ["event_type"], "event_id")
    return i.groupBy("event_type", "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).drop("island")


@query("stuck_runs", """
with n as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from n)
select event_id, row_number() over (partition by user_id, run order by ts, event_id)::int as repeats, row_number() over (partition by user_id, run order by ts, event_id) >= 3 as stuck from r
""")
def stuck_runs(spark, sf_dir):
    return turns.stuck(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "repeats", "stuck")


@query("session_ends", """
with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as k, event_type as seen, value > 250 as stops, event_id % 97 = 0 as failed from events),
f as (select distinct user_id, 0::bigint as k, '' as seen, 0::bigint as run, null::varchar as reason from events
  union all select o.user_id, o.k, o.seen, case when o.seen = f.seen then f.run + 1 else 1 end,
    case when failed then 'error' when stops then 'user_stop' when o.seen = f.seen and f.run + 1 >= 3 then 'stuck_loop' when o.k >= 25 then 'max_turns' end
  from f join o on o.user_id = f.user_id and o.k = f.k + 1 where f.reason is null)
select user_id, count(*)::bigint as n_turns, any_value(f.k) as end_turn, any_value(f.reason) as reason from events left join (select user_id, k, reason from f where reason is not null) f using (user_id) group by user_id
""")
def session_ends_(spark, sf_dir):
    """Why each user's events end as a session: failure, stop, a third repeat or the limit."""
    from ..operators.session_ends import session_ends

    return session_ends(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type"), F.lit(""), F.col("value") > 250, F.col("event_id") % 97 == 0, 3, 25)


@query("latest_record", """
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def latest_record(spark, sf_dir):
    return turns.latest(_events(spark, sf_dir), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("overlay_state", """
with l as (select user_id, event_type, arg_max(value, event_id) as v from events group by all)
select user_id, string_agg(event_type || '=' || round(v, 2)::varchar, ',' order by event_type) as state from l group by user_id
""")
def overlay_state(spark, sf_dir):
    """The last value of each name, as one state per user."""
    state = merging.overlay_all(_events(spark, sf_dir).withColumn("value", F.round("value", 2)), "user_id", "event_id", "event_type", "value")
    return state.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("state")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("state"))


@query("last_per_turn", "select user_id, strftime(ts, '%Y-%m-%d') as day, arg_max(value, event_id) as value from events group by all")
def last_per_turn(spark, sf_dir):
    """The last event of each user and day."""
    return turns.last_per_turn(_events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["user_id", "day"], "event_id", "value")


@query("stream_windows", """
select date_trunc('day', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2
""")
def stream_windows(spark, sf_dir):
    """Tumbling windows, run as a stream over what is there."""
    from ..streaming import live

    stream = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.drained(live.windowed(stream, "ts", ["event_type"], "value"), _folder(spark, "windows"), _folder(spark, "windows-log"))


@query("stream_latest", """
select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1
""")
def stream_latest(spark, sf_dir):
    """Keyed upsert of a stream, read back as the latest row per key."""
    from ..streaming import live

    schema = _schema(spark, sf_dir)
    target = _folder(spark, "latest")
    live.latest_by_batch(_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], f"{target}/rows", f"{target}/log")
    rows = spark.read.schema(schema).parquet(f"{target}/rows/*")
    return turns.latest(rows, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "value")


@query("activity_sessions", """
with g as (select user_id, ts, case when ts <= lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end as new from events), r as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as started, max(ts) + interval 6 hour as ended, count(*)::bigint as n from r group by user_id, s
""")
def activity_sessions(spark, sf_dir):
    from ..streaming import live

    return live.session_gaps(_events(spark, sf_dir), "ts", "user_id", "6 hours")


def _schema(spark, sf_dir):
    return _events(spark, sf_dir).schema


def _stream(spark, sf_dir):
    """The events' files as a stream, whether the table is a file or a folder of files."""
    from ..streaming import live

    return live.files(spark, sf_dir, _schema(spark, sf_dir), "{events.parquet,part-*.parquet}") if _is_file(spark, sf_dir) else live.files(spark, f"{sf_dir}/events.parquet", _schema(spark, sf_dir))


def _is_file(spark, sf_dir):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def _folder(spark, name):
    """A fresh folder below the shared one; only a local master may do with a temporary one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='turnloom-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"
