"""Streams with state: each query writes its input in several files out of order, runs the stream and returns its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import framing, live, stateful
from .event_queries import _events, _folder
from .registry import query

#: Batches that an input is dealt into, in as many files each as let all cores write them.
BATCHES = 3


def _as_stream(spark, df, name, *last):
    """The rows as a stream of files in an order of their own; the rows of ``last``, if any, come when all others have.

    A row of ``last`` comes once in each file of its batch.
    """
    folder, files = _folder(spark, name), max(1, spark.sparkContext.defaultParallelism // BATCHES)
    df.repartition(BATCHES * files, F.xxhash64(*df.columns)).write.parquet(f"{folder}/a")
    reader = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files))
    for k, row in enumerate(last):
        spark.range(0, files, 1, files).toDF("_file").crossJoin(F.broadcast(row)).select(*df.columns).write.parquet(f"{folder}/z{k}")
    return reader.parquet(folder)


def _run(stream, name):
    spark = stream.sparkSession
    with stateful.state_store(spark):
        return live.drained(stream, _folder(spark, name), _folder(spark, f"{name}-log"), "append")


_LINES = """
with s as (select conv_id, string_agg('{"turn":' || turn || '}' || chr(10) || coalesce(text, ''), chr(10) order by turn, role, text) as t from conversations group by conv_id),
l as (select conv_id, unnest(string_split(t, chr(10))) as line, unnest(generate_series(0, len(string_split(t, chr(10))) - 1)) as line_no from s)
select conv_id::varchar as session, line_no::bigint as line_no, line from l where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
"""


def _chunks(spark, sf_dir):
    """Each conversation's log, cut every few bytes, mid-character too: (session, at, data, last)."""
    turns = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit("}\n"), F.coalesce("text", F.lit("")))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "\n").alias("t"))
    cut = whole.select(F.col("conv_id").cast("string").alias("session"), F.encode("t", "UTF-8").alias("b"), (50 + F.pmod(F.xxhash64("conv_id"), F.lit(400))).cast("int").alias("step"))
    n = F.greatest(F.lit(1), F.ceil(F.length("b") / F.col("step"))).cast("int")
    at = cut.select("session", "b", "step", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    return at.select("session", F.col("at").cast("long").alias("at"), F.substring(F.col("b"), F.col("at") * F.col("step") + 1, F.col("step")).alias("data"), (F.col("at") == F.col("n") - 1).alias("last"))


@query("line_framing", _LINES)
def line_framing(spark, sf_dir):
    """Lines of logs that came in chunks."""
    return framing.framed(_chunks(spark, sf_dir), "session", "at", "data")


@query("stream_framing", _LINES)
def stream_framing(spark, sf_dir):
    """The same on a stream, with the chunks of a session in any order."""
    return _run(stateful.framed_stream(_as_stream(spark, _chunks(spark, sf_dir), "chunks")), "framed")


def _far(spark, schema, **values):
    """One row far beyond all others, which moves the watermark."""
    row = {**values, "ts": "2200-01-01 00:00:00"}
    return spark.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))


@query("stream_state_before", """
with kinds as (select distinct event_type as name from events),
b as (select e.user_id, e.event_id, k.name, last_value(case when event_type = k.name then value end ignore nulls) over (partition by user_id, k.name order by ts, event_id rows between unbounded preceding and 1 preceding) as v from events e cross join kinds k)
select user_id as key, event_id as id, coalesce(string_agg(name || '=' || printf('%.2f', v), ',' order by name) filter (where v is not null), '') as before from b group by all
""")
def stream_state_before(spark, sf_dir):
    """Each user's last values before each event, on a stream whose events come out of order."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("id"), F.col("event_type").alias("name"), F.col("value").cast("double").alias("value"))
    end = _far(spark, e.schema, key=-1, id=-1, name="end", value=0.0)
    return _run(stateful.state_before(_as_stream(spark, e, "state-in", end, end), "9000 days"), "state")


@query("token_checks", """
with e as (select user_id::varchar as token, ts, case when event_id % 5 = 0 then event_type end as form from events),
m as (select a.token, a.ts, c.form, c.ts as made, row_number() over (partition by a.id order by c.ts desc, c.form desc) as rn from (select *, row_number() over () as id from e where form is null) a left join e c on c.token = a.token and c.form is not null and c.ts <= a.ts)
select token, ts, case when ts <= made + interval 12 hour then form end as form from m where rn = 1
""")
def token_checks(spark, sf_dir):
    """Tokens that expire after twelve hours, made and asked for on a stream."""
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("form"))
    folder = _folder(spark, "tokens-in")
    e.write.parquet(folder)
    return _run(stateful.validated_tokens(spark.readStream.schema(e.schema).parquet(folder), 12 * 3_600_000), "tokens")


@query("stream_calls", """
with s as (select event_id as call_id, case when event_id % 4 <> 0 then event_id - event_id % 4 end as parent_id, case when event_id % 2 = 0 then 'module' else 'lm' end as kind, ts as started, event_id % 5 as how from events)
select call_id, parent_id, kind, started, case when how < 3 then started + interval 20 minute end as ended, case when how >= 3 then 'unfinished' when call_id % 7 = 0 then 'failed' else 'done' end as status from s
""")
def stream_calls(spark, sf_dir):
    """Starts and ends of calls as an outer join of streams: of five calls one never ends, and one too late."""
    e = _events(spark, sf_dir).select(F.col("event_id").cast("long").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"))
    i = F.col("call_id")
    kind = F.when(i % 2 == 0, "module").otherwise("lm")
    parent = F.when(i % 4 != 0, i - i % 4).alias("parent_id")
    starts = e.select("call_id", parent, F.concat(kind, F.lit("_start")).alias("phase"), "ts", F.lit(False).alias("failed"))
    after = F.when(i % 5 == 3, F.expr("interval 3 hours")).otherwise(F.expr("interval 20 minutes"))
    ends = e.where(i % 5 != 4).select("call_id", parent, F.concat(kind, F.lit("_end")).alias("phase"), (F.col("ts") + after).alias("ts"), (i % 7 == 0).alias("failed"))
    log = starts.unionByName(ends)
    far = _far(spark, log.schema, call_id=-1, phase="far_end", failed=False)
    stream = live.calls(_as_stream(spark, log, "phases", far, far), "1 hour", "9000 days")
    return _run(stream, "calls")
