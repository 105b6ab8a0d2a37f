"""The recording operators as queries over plain tables, each with its SQL.

Events stand in for a record stream (a user is a file, an event type a message kind),
conversations for texts in parts, dimension tables for profile dictionaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import operators as op
from . import plans
from .basetypes import TYPES
from .catalogue import Catalogue
from .sources import recording, sink

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, sf_dir: str) -> DataFrame:
    """events with whole micros, and seconds of the recording epoch."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("secs", F.floor(F.col("us") / 1_000_000).cast("long") - fn.EPOCH)


E = f"(SELECT *, epoch_us(ts) AS us, (epoch_us(ts) // 1000000 - {fn.EPOCH})::BIGINT AS secs FROM events)"


@query("""SELECT user_id, event_id, sum(CASE WHEN p IS NULL THEN v ELSE (v - p + 256) % 256 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total
FROM (SELECT *, event_id % 256 AS v, lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def accumulate_u8(spark, d):
    e = table(spark, d, "events").withColumn("v", F.col("event_id") % 256)
    return op.unwrap(e, ["user_id"], ["ts", "event_id"], "v", 8, "total").select("user_id", "event_id", "total")


def on_wire(pos: int, mesg_num: int, fdn: int, base: str, tag: str = "int", kind: str = "field", ddi: int | None = None, **parts):
    """A field as it goes on the wire, for ``written``."""
    kinds = {"i": "decimal(20,0)", "f": "double", "s": "string", "b": "binary", "ai": "array<decimal(20,0)>", "af": "array<double>"}
    own = [F.lit(pos).alias("pos"), F.lit(mesg_num).alias("mesg_num"), F.lit(kind).alias("kind"), F.lit(fdn).alias("fdn"), F.lit(ddi).cast("int").alias("ddi"), F.lit(base).alias("base_type"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag")]
    return F.struct(*own, *[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def written(rows: DataFrame) -> DataFrame:
    """The field table of recordings that hold ``rows`` (path, chain_idx, seq, fields: an array of ``on_wire``), written and read again."""
    wire = rows.select(F.col("path").cast("string").alias("path"), F.col("chain_idx"), F.col("seq").cast("long").alias("seq"), F.explode("fields").alias("w")).select("path", "chain_idx", "seq", "w.*")
    return recording.decoded(recording.dealt(recording.segments(sink.chained(sink.encoded_segments(wire), "FAILFAST"))))


#: Where the messages of these recordings carry the event's number: a field that no profile knows.
ID = 200


def of_events(spark, d, fields, chain=None) -> DataFrame:
    """Recordings, one a user, with a message for each event in order of event_id; ``fields`` without the number."""
    e = table(spark, d, "events")
    number = on_wire(99, fields[0][0], ID, "uint32", i=F.col("event_id"))
    return written(e.select(F.col("user_id").alias("path"), (F.lit(0) if chain is None else chain).alias("chain_idx"), (F.col("event_id") + 1).alias("seq"), F.array(*[on_wire(k, *f[:-1], **f[-1]) for k, f in enumerate(fields)], number).alias("fields")))


@query(f"""WITH a AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN secs END AS x, secs % 32 AS o FROM {E}),
b AS (SELECT *, count(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT *, CASE WHEN x IS NOT NULL THEN 0 ELSE (o - coalesce(lag(o) OVER (PARTITION BY user_id, g ORDER BY ts, event_id), 0) + 32) % 32 END AS step FROM b)
SELECT user_id, event_id, (coalesce(first_value(x) OVER w, 0) + sum(step) OVER w)::BIGINT AS stamp FROM c WINDOW w AS (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def compressed_timestamp(spark, d):
    e = events(spark, d).withColumn("x", F.when(F.col("event_id") % 7 == 0, F.col("secs"))).withColumn("o", F.col("secs") % 32)
    return op.compressed_timestamps(e, ["user_id"], ["ts", "event_id"], "x", "o", "stamp").select("user_id", "event_id", "stamp")


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) AS whole FROM conversations GROUP BY conv_id")
def memo_glob_text(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return op.joined_parts(c, ["conv_id"], ["turn", "role", "text"], "text", "whole")


@query("""SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) AS notes FROM conversations GROUP BY conv_id""")
def memo_glob_target(spark, d):
    """Texts written in parts after the message they belong to, and put into it on reading."""
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    parts = c.withColumn("n", n).select("conv_id", "n", F.posexplode_outer(F.regexp_extract_all("text", F.lit("(?s).{1,60}"), F.lit(0))).alias("k", "part"))
    part = F.col("n").cast("long") * 100_000 + F.coalesce("k", F.lit(0))
    data = F.coalesce("part", F.lit("")).cast("binary")
    memo = F.array(on_wire(0, 145, 250, "uint32", i=part), on_wire(1, 145, 0, "byte", "bytes", b=data), on_wire(2, 145, 1, "uint16", i=F.lit(27)), on_wire(3, 145, 2, "uint16", i=F.lit(0)), on_wire(4, 145, 3, "uint8", i=F.lit(8)))
    memos = parts.where("part is not null").select(F.col("conv_id").alias("path"), F.lit(0).alias("chain_idx"), part.alias("seq"), memo.alias("fields"))
    steps = c.select("conv_id").distinct().select(F.col("conv_id").alias("path"), F.lit(0).alias("chain_idx"), F.lit(0).cast("long").alias("seq"), F.array(on_wire(0, 27, 254, "uint16", i=F.lit(0))).alias("fields"))
    messages = plans.decode(written(steps.unionByName(memos)), options=plans.Options(decode_memo_glob=True))
    found = plans.wide(messages, "workout_step", ["message_index", "notes"])
    return found.select(F.col("path").cast("long").alias("conv_id"), F.coalesce("notes.s", F.lit("")).alias("notes"))


@query(f"""WITH a AS (SELECT user_id, us, event_id, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {E} WHERE event_type = 'click'),
b AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE least(ceil(abs(n - us) / 250000.0)::BIGINT - 1, 20) END AS k FROM a)
SELECT user_id, us + i * 250000 AS us, event_id, i > 0 AS filled FROM b, LATERAL unnest(generate_series(0, greatest(k, 0))) AS t(i)""")
def hr_gap_fill(spark, d):
    e = events(spark, d).where("event_type = 'click'")
    return op.gap_filled(e, ["user_id"], ["ts", "event_id"], "us", "event_id")


@query(f"""WITH r AS (SELECT user_id, event_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM {E} WHERE event_type = 'view'),
q AS (SELECT *, CASE WHEN p IS NULL OR p = us THEN us - 1000000 ELSE p END AS start, coalesce(p = us, false) AS same FROM r),
s AS (SELECT user_id, us AS tm, event_id % 100 + 60 AS bpm FROM {E} WHERE event_type = 'click')
SELECT q.user_id, q.event_id, CASE WHEN any_value(same) THEN max_by(bpm, tm)::BIGINT ELSE round(avg(bpm))::BIGINT END AS hr
FROM q LEFT JOIN s ON s.user_id = q.user_id AND s.tm > q.start AND s.tm <= q.us GROUP BY q.user_id, q.event_id""")
def hr_merge(spark, d):
    e = events(spark, d)
    samples = e.where("event_type = 'click'").select("user_id", "us", (F.col("event_id") % 100 + 60).alias("bpm"))
    records = e.where("event_type = 'view'").select("user_id", "event_id", "us")
    return op.ranged_mean(records, samples, ["user_id"], "us", ["event_id"], "bpm", "hr").select("user_id", "event_id", "hr")


_STEP = "xor((c >> 4), [0,52225,55297,5120,61441,15360,10240,58369,40961,27648,30720,46081,20480,39937,34817,17408][((xor(c, {n})) & 15) + 1])"


@query("""WITH RECURSIVE t AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
f AS (SELECT item_id, h, 1 AS k, 0::INT AS c FROM t UNION ALL
 SELECT item_id, h, k + 2, """ + _STEP.format(n="x.hi").replace("(xor(c, x.hi))", "(xor(x.lo, x.hi))").replace("(c >> 4)", "(x.lo >> 4)") + """::INT
 FROM (SELECT *, struct_pack(hi := ('0x' || substr(h, k, 1))::INT, lo := """ + _STEP.format(n="('0x' || substr(h, k + 1, 1))::INT") + """::INT) AS x FROM f WHERE k <= length(h)))
SELECT item_id, c AS crc FROM f WHERE k > length(h)""")
def crc16_text(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", fn.crc16_expr(F.col("text").cast("binary")).alias("crc"))


@query("""SELECT event_id, i::INT AS lane, ((event_id * 2654435761 % 4294967296) >> (i * 8)) & 255 AS raw FROM events, LATERAL unnest(generate_series(0, 3)) AS t(i)""")
def unpack_bits(spark, d):
    packed = F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(1 << 32))
    lanes = F.array(*[fn.lane(packed, 8 * i, 8) for i in range(4)])
    return table(spark, d, "events").select("event_id", F.posexplode(lanes).alias("lane", "raw"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 100 / 5.0 - 500, 6) AS altitude FROM lineitem")
def scale_offset(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.scaled(F.col("l_quantity") * 100, F.lit(5.0), F.lit(500.0)), 6).alias("altitude"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN floor(l_extendedprice * 2 + 0.5) <= 65535 THEN floor(l_extendedprice * 2 + 0.5)::BIGINT END AS raw FROM lineitem")
def unscale_round(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.unscaled(F.col("l_extendedprice"), F.lit(2.0), F.lit(0.0), F.lit(0), F.lit(65535)).alias("raw"))


@query("SELECT o_orderkey, CASE o_custkey % 5 WHEN 1 THEN 'device' WHEN 2 THEN 'settings' WHEN 3 THEN 'sport' WHEN 4 THEN 'activity' ELSE 'unknown' END AS file FROM orders")
def enum_resolve(spark, d):
    names = Catalogue.built_in().table(spark, "enums").where("type = 'file'").select("value", "name")
    o = table(spark, d, "orders").withColumn("code", F.col("o_custkey") % 5)
    return o.join(F.broadcast(names), F.col("code") == F.col("value"), "left").select("o_orderkey", F.coalesce("name", F.lit("unknown")).alias("file"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 5 END::BIGINT AS code FROM events")
def enum_reverse(spark, d):
    """Names of an enumeration, written as their numbers."""
    sport = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "cycling").otherwise("swimming")
    e = table(spark, d, "events")
    field = lambda pos, fdn, name, v: F.struct(F.lit(pos).alias("pos"), F.lit(fdn).alias("fdn"), F.lit(name).alias("name"), v.alias("value"))
    fields = F.array(field(0, 5, "sport", plans.value(F.lit("enum"), s=sport)), field(1, ID, "unknown", plans.value(F.lit("uint"), i=F.col("event_id"), u=F.col("event_id"))))
    rows = e.select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("chain_idx"), F.col("event_id").alias("seq"), F.explode(fields).alias("x"))
    rows = rows.select("path", "chain_idx", "seq", F.lit(18).alias("mesg_num"), F.lit("field").alias("kind"), F.lit(None).cast("int").alias("ddi"), F.lit(0).alias("sub_pos"), "x.*")
    back = recording.decoded(recording.dealt(recording.segments(sink.encoded(rows))))
    found = plans.wide(plans.decode(back, options=plans.Options(convert_types_to_strings=False)), "session", ["sport", "unknown"])
    return found.select(F.col("unknown.i").alias("event_id"), F.col("sport.i").alias("code"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'timer_trigger' WHEN 'view' THEN 'battery_level' ELSE 'data' END AS name,
 CASE WHEN event_type = 'click' AND event_id % 1000 <= 2 THEN ['manual', 'auto', 'fitness_equipment'][event_id % 1000 + 1] END AS label,
 round(CASE WHEN event_type = 'click' AND event_id % 1000 <= 2 THEN NULL WHEN event_type = 'view' THEN event_id % 1000 / 1000.0 ELSE event_id % 1000 END, 6) AS scaled FROM events""")
def subfield_select(spark, d):
    """A field that its sibling gives another name, type and scale."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 11).otherwise(9)
    m = plans.decode(of_events(spark, d, [(21, 3, "uint32", {"i": F.col("event_id") % 1000}), (21, 0, "enum", {"i": kind})]))
    names = ["timer_trigger", "battery_level", "data"]
    w = plans.wide(m, "event", ["unknown", *names])
    name = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    number = F.coalesce(*[F.coalesce(F.col(f"{n}.f"), F.col(f"{n}.i").cast("double")) for n in names])
    return w.select(F.col("unknown.i").alias("event_id"), name.alias("name"), F.col("timer_trigger.s").alias("label"), F.round(number, 6).alias("scaled"))


@query("""SELECT event_id, x & 255 AS rear_gear_num, (x >> 8) & 255 AS rear_gear, (x >> 16) & 255 AS front_gear_num, x >> 24 AS front_gear
FROM (SELECT event_id, event_id * 2654435761 % 4294967295 AS x FROM events)""")
def subfield_lanes(spark, d):
    """The lanes that a sub-field packs into a whole number."""
    packed = F.pmod(F.col("event_id") * F.lit(2654435761), F.lit((1 << 32) - 1))
    m = plans.decode(of_events(spark, d, [(21, 0, "enum", {"i": F.lit(42)}), (21, 3, "uint32", {"i": packed})]))
    names = ["rear_gear_num", "rear_gear", "front_gear_num", "front_gear"]
    return plans.wide(m, "event", ["unknown", *names]).select(F.col("unknown.i").alias("event_id"), *[F.col(f"{n}.i").alias(n) for n in names])


@query("""SELECT event_id, s / 1000.0 AS speed, sum(CASE WHEN p IS NULL THEN v ELSE (v - p + 4096) % 4096 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 100.0 AS distance
FROM (SELECT user_id, event_id, event_id % 4095 AS s, event_id * 7 % 4096 AS v, lag(event_id * 7 % 4096) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)""")
def byte_lanes(spark, d):
    """Lanes of packed bytes, one of which is a counter."""
    h = F.lpad(F.hex((F.col("event_id") % 4095) + (F.col("event_id") * 7 % 4096) * 4096), 6, "0")
    low_first = F.unhex(F.concat(F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))
    m = plans.decode(of_events(spark, d, [(20, 8, "byte", "bytes", {"b": low_first})]))
    w = plans.wide(m, "record", ["unknown", "speed", "distance"])
    return w.select(F.col("unknown.i").alias("event_id"), F.col("speed.f").alias("speed"), F.col("distance.f").alias("distance"))


@query("SELECT event_id, event_id % 60000 / 10.0 + 1 AS watts FROM events")
def developer_fields(spark, d):
    """Fields that a recording declares itself, with a scale and an offset below zero."""
    e = table(spark, d, "events")
    declared = [(0, "uint8", "int", {"i": F.lit(0)}), (1, "uint8", "int", {"i": F.lit(7)}), (2, "uint8", "int", {"i": F.lit(0x84)}), (3, "string", "string", {"s": F.lit("watts")}), (6, "uint8", "int", {"i": F.lit(10)}), (7, "sint8", "int", {"i": F.lit(-1)})]
    heads = e.select("user_id").distinct().select(F.col("user_id").alias("path"), F.lit(0).alias("chain_idx"), F.lit(-1).cast("long").alias("seq"), F.array(*[on_wire(k, 206, fdn, base, tag, **parts) for k, (fdn, base, tag, parts) in enumerate(declared)]).alias("fields"))
    rows = e.select(F.col("user_id").alias("path"), F.lit(0).alias("chain_idx"), F.col("event_id").alias("seq"), F.array(on_wire(0, 20, ID, "uint32", i=F.col("event_id")), on_wire(1, 20, 7, "uint16", kind="dev", ddi=0, i=F.col("event_id") % 60000)).alias("fields"))
    w = plans.wide(plans.decode(written(heads.unionByName(rows))), "record", ["unknown", "watts"])
    return w.select(F.col("unknown.i").alias("event_id"), F.col("watts.f").alias("watts"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'record' ELSE 'unknown' END AS mesg_name, CASE WHEN event_type = 'click' THEN 'heart_rate' ELSE 'unknown' END AS name, event_id % 250 AS value FROM events""")
def profile_lookup_unknown(spark, d):
    """Messages and fields with and without a name in the profile; the others pass through."""
    e = table(spark, d, "events")
    known = F.col("event_type") == "click"
    fields = lambda mesg: F.array(on_wire(0, mesg, 3, "uint8", i=F.col("event_id") % 250), on_wire(1, mesg, ID, "uint32", i=F.col("event_id")))
    rows = e.select(F.col("user_id").alias("path"), F.lit(0).alias("chain_idx"), F.col("event_id").alias("seq"), F.when(known, fields(20)).otherwise(fields(60000)).alias("fields"))
    m = plans.decode(written(rows))
    one = lambda fdn, part: F.max(F.when(F.col("fdn") == fdn, part))
    return m.groupBy(*plans.HEAD).agg(one(ID, F.col("value.i")).alias("event_id"), F.first("mesg_name").alias("mesg_name"), one(3, F.col("name")).alias("name"), one(3, F.col("value.i")).alias("value")).drop(*plans.HEAD)


@query("SELECT event_id FROM events WHERE user_id % 200 IN (" + ",".join(str(n) for n, _ in Catalogue.built_in().messages if n < 200) + ")")
def data_only(spark, d):
    e = table(spark, d, "events").withColumn("mesg_num", (F.col("user_id") % 200).cast("int"))
    return op.data_only(e, Catalogue.built_in().table(spark, "messages")).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 20 <> 0")
def skip_header(spark, d):
    return op.skip_header(table(spark, d, "events").withColumn("mesg_num", F.col("user_id") % 20)).select("event_id")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS config FROM events""")
def devfield_asof(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    states = e.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("event_id").alias("config_id"))
    return op.as_of(e, states, ["user_id"], ["ts", "event_id"], "config_id", "config").select("user_id", "event_id", "config")


def _arrays(spark, d) -> DataFrame:
    """Arrays of which every fifth holds nothing but what means no value, and every third one such element."""
    n = F.col("event_id")
    none = F.lit(255).cast("long")
    x = F.when(n % 5 == 0, F.array(none, none, none)).when(n % 3 == 0, F.array(n % 200, none, n % 7)).otherwise(F.array(n % 200, n % 9, n % 7))
    return of_events(spark, d, [(60000, 7, "uint8", "ints", {"ai": x})])


def _by_event(fields: DataFrame, *parts) -> DataFrame:
    number = F.max(F.when(F.col("fdn") == ID, F.col("i"))).alias("event_id")
    return fields.groupBy("path", "chain_idx", "seq").agg(number, *parts).drop("path", "chain_idx", "seq")


@query("SELECT event_id, event_id % 5 = 0 AS invalid FROM events")
def invalid_all_elements(spark, d):
    return _by_event(_arrays(spark, d), F.max(F.when(F.col("fdn") == 7, F.col("tag") == "invalid")).alias("invalid"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN concat_ws(',', event_id % 200, 255, event_id % 7) ELSE concat_ws(',', event_id % 200, event_id % 9, event_id % 7) END AS kept FROM events")
def array_partial_invalid(spark, d):
    return _by_event(_arrays(spark, d), F.max(F.when(F.col("fdn") == 7, F.array_join(F.col("ai").cast("array<string>"), ","))).alias("kept"))


@query(f"SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000 - {fn.EPOCH})::BIGINT AS secs FROM orders")
def datetime_to_secs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.from_timestamp(F.col("o_orderdate")).alias("secs"))


@query(f"SELECT l_orderkey, l_linenumber, epoch_us(make_timestamp((l_partkey * 1000 + {fn.EPOCH}) * 1000000)) AS us FROM lineitem")
def secs_to_datetime(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.unix_micros(fn.to_timestamp(F.col("l_partkey") * 1000)).alias("us"))


@query("SELECT user_id, event_type, arg_min(event_id, struct_pack(ts := ts, e := event_id)) AS first_id FROM events GROUP BY ALL")
def first_match_field(spark, d):
    e = table(spark, d, "events").withColumn("first_id", F.col("event_id"))
    return op.first_by(e, ["user_id", "event_type"], ["ts", "event_id"], ["first_id"])


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1")
def dedupe_first_fdn(spark, d):
    return op.dedupe_first(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], ["l_linenumber"])


@query("SELECT CASE event_type WHEN 'click' THEN 'record' WHEN 'view' THEN 'lap' ELSE 'unknown' END AS mesg_name, count(*) AS n FROM events GROUP BY ALL")
def message_counts(spark, d):
    """Messages of mixed recordings by name; records without fields count as well."""
    e = table(spark, d, "events")
    kind = lambda mesg: F.array(on_wire(0, mesg, ID, "uint32", i=F.col("event_id")))
    rows = e.select(F.col("user_id").alias("path"), F.lit(0).alias("chain_idx"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", kind(20)).when(F.col("event_type") == "view", kind(19)).otherwise(F.array(on_wire(0, 60000, 0, "enum", "none", "empty"))).alias("fields"))
    return plans.message_counts(plans.decode(written(rows)))


@query("""WITH e AS (SELECT *, (event_type <> 'click' AND max(event_type = 'click') OVER (PARTITION BY user_id))::INT AS chain_idx FROM events)
SELECT chain_idx, event_id, chain_idx > 0 AND row_number() OVER (PARTITION BY user_id, chain_idx ORDER BY event_id) = 1 AS starts_new_chain FROM e""")
def chain_concat(spark, d):
    """Recordings of two segments: where the second begins, as the scan says."""
    f = of_events(spark, d, [(20, 3, "uint8", {"i": F.col("event_id") % 250})], (F.col("event_type") != "click").cast("int"))
    return f.where(F.col("fdn") == ID).select("chain_idx", F.col("i").alias("event_id"), "starts_new_chain")


@query(f"""WITH a AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN secs END AS x, secs % 32 AS o FROM {E} WHERE secs BETWEEN 0 AND 4294967294),
b AS (SELECT *, count(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT *, CASE WHEN x IS NOT NULL THEN 0 ELSE (o - coalesce(lag(o) OVER (PARTITION BY user_id, g ORDER BY event_id), 0) + 32) % 32 END AS step FROM b)
SELECT event_id, (coalesce(first_value(x) OVER w, 0) + sum(step) OVER w)::BIGINT AS stamp FROM c WINDOW w AS (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def compressed_scan(spark, d):
    """Records whose headers hold five bits of the time: bytes put together here, read by the scan."""
    e = events(spark, d).where("secs between 0 and 4294967294")
    little = lambda x, n: F.concat(*[F.lpad(F.hex(F.call_function("shiftright", x, F.lit(8 * k)).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(n)])
    explicit = F.concat(F.lit("00"), little(F.col("secs"), 4), little(F.col("event_id"), 4))
    packed = F.concat(F.hex(F.lit(128) + F.col("secs") % 32), little(F.col("event_id"), 4))
    row = F.when(F.col("event_id") % 7 == 0, explicit).otherwise(packed)
    parts = F.array_sort(F.collect_list(F.struct("event_id", row.alias("row"))))
    body = e.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.concat(F.lit("40000014000" + "2FD0486" + f"{ID:02X}0486"), F.array_join(F.transform(parts, lambda p: p["row"]), "")).alias("body"))
    size = (F.length("body") / 2).cast("long")
    content = F.unhex(F.concat(F.lit("0C20D052"), little(size, 4), F.lit("2E464954"), "body", F.lit("0000")))
    f = recording.decoded(recording.dealt(recording.segments(body.select("path", content.alias("content")))))
    return _by_event(f, F.max(F.when(F.col("fdn") == 253, F.col("i"))).alias("stamp"))


@query("SELECT conv_id, turn, text AS kept, text AS cut FROM conversations")
def valid_utf8(spark, d):
    c = table(spark, d, "conversations")
    padded = F.concat(F.col("text").cast("binary"), F.lit(b"\0\0"))
    return c.select("conv_id", "turn", fn.text_trimmed(padded).alias("kept"), fn.text(padded).alias("cut"))


@query("SELECT i AS tag, CASE WHEN i >= 128 THEN 'compressed' WHEN i & 64 > 0 THEN 'definition' ELSE 'data' END AS kind, (CASE WHEN i >= 128 THEN (i >> 5) & 3 ELSE i & 15 END)::INT AS local FROM (SELECT DISTINCT (event_id % 256)::INT AS i FROM events)")
def record_tags(spark, d):
    t = table(spark, d, "events").select((F.col("event_id") % 256).cast("int").alias("tag")).distinct()
    return t.select("tag", fn.record_tag(F.col("tag")).alias("r")).select("tag", "r.kind", "r.local")


@query("SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 5")
def top_records(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").orderBy("ts", "event_id").limit(5).select("event_id", "value")


@query("""SELECT * FROM (VALUES (0, 'enum', 1, 0), (1, 'sint8', 1, 1), (2, 'uint8', 1, 2), (3, 'sint16', 2, 131), (4, 'uint16', 2, 132), (5, 'sint32', 4, 133), (6, 'uint32', 4, 134),
(7, 'string', 1, 7), (8, 'float32', 4, 136), (9, 'float64', 8, 137), (10, 'uint8z', 1, 10), (11, 'uint16z', 2, 139), (12, 'uint32z', 4, 140), (13, 'byte', 1, 13), (14, 'sint64', 8, 142), (15, 'uint64', 8, 143), (16, 'uint64z', 8, 144)) t(code, name, size, wire)""")
def base_types(spark, d):
    return spark.createDataFrame([(t.code, t.name, t.size, t.wire) for t in TYPES], "code int, name string, size int, wire int")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'file_id' WHEN 1 THEN 'session' WHEN 2 THEN 'lap' WHEN 3 THEN 'record' WHEN 4 THEN 'hr' ELSE 'memo_glob' END AS mesg_name,
 [0, 18, 19, 20, 132, 145][event_id % 6 + 1] AS mesg_num FROM events""")
def profile_catalogue(spark, d):
    """Message numbers to names and back, by the dictionary."""
    messages = F.broadcast(Catalogue.built_in().table(spark, "messages"))
    e = table(spark, d, "events").withColumn("n", F.element_at(F.array(*map(F.lit, (0, 18, 19, 20, 132, 145))), (F.col("event_id") % 6 + 1).cast("int")))
    named = e.join(messages, F.col("n") == F.col("mesg_num")).select("event_id", "mesg_name")
    return named.join(messages, "mesg_name").select("event_id", "mesg_name", "mesg_num")


def recordings(spark, d) -> DataFrame:
    """Binary files, one a user, made from events: path, content."""
    e = events(spark, d).where("secs between 0 and 4294967295")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    base = e.select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("chain_idx"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "secs", "value", "event_id")
    field = lambda pos, fdn, name, v: F.struct(F.lit(pos).alias("pos"), F.lit(fdn).alias("fdn"), F.lit(name).alias("name"), v.alias("value"))
    counter = F.col("event_id") % 255  # 255 would be no value
    # A record holds its serial number in a field as well, so that rows can be told apart.
    fields = F.array(
        field(0, 253, "timestamp", plans.value(F.lit("datetime"), t=fn.to_timestamp(F.col("secs")))),
        field(1, 5, "distance", plans.value(F.lit("float"), f=F.floor(F.abs("value") * 100) / 100)),
        field(2, 18, "cycles", plans.value(F.lit("uint"), i=counter, u=counter)),
        field(3, 29, "accumulated_power", plans.value(F.lit("uint"), i=F.col("event_id"), u=F.col("event_id"))),
    )
    rows = base.withColumn("x", F.explode(fields)).select("path", "chain_idx", "seq", F.lit(20).alias("mesg_num"), F.lit("field").alias("kind"), F.lit(None).cast("int").alias("ddi"), F.lit(0).alias("sub_pos"), "x.*")
    return sink.encoded(rows)


@query(f"""SELECT user_id, event_id, secs, floor(abs(value) * 100)::BIGINT AS distance_cm,
 sum(CASE WHEN p IS NULL THEN v ELSE (v - p + 256) % 256 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cycles
FROM (SELECT *, event_id % 255 AS v, lag(event_id % 255) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {E} WHERE secs BETWEEN 0 AND 4294967295)""")
def roundtrip_records(spark, d):
    """Events written to binary recordings, read back, decoded: the flagship."""
    fields = plans.staged(recording.decoded(recording.dealt(recording.segments(recordings(spark, d)))), "roundtrip")
    messages = plans.decode(fields, options=plans.Options(expand_components=False))
    rec = plans.wide(messages, "record", ["timestamp", "distance", "cycles", "accumulated_power"])
    secs = F.unix_seconds(F.col("timestamp.t")) - fn.EPOCH
    return rec.select(F.col("path").cast("long").alias("user_id"), F.col("accumulated_power.i").alias("event_id"), secs.alias("secs"), F.round(F.col("distance.f") * 100).cast("long").alias("distance_cm"), F.col("cycles.i").alias("cycles"))


@query(f"""SELECT user_id AS path, true AS sniffed, 14 AS header_size, (18 + 14 * count(*))::BIGINT AS data_size, (34 + 14 * count(*))::BIGINT AS total_size, NULL AS code, false AS damaged
FROM {E} WHERE secs BETWEEN 0 AND 4294967295 GROUP BY user_id
UNION ALL SELECT -1 - user_id, true, 14, (18 + 14 * count(*))::BIGINT, (34 + 14 * count(*))::BIGINT, 'FileCrcMismatch', true FROM {E} WHERE secs BETWEEN 0 AND 4294967295 GROUP BY user_id""")
def integrity_check(spark, d):
    """Headers and checksums of recordings, and of the same with their last data byte changed."""
    files = plans.staged(recordings(spark, d), "integrity").select(F.col("path").cast("long").alias("path"), "content", F.lit(False).alias("damaged"))
    n = F.octet_length("content")
    other = F.concat(F.substring("content", F.lit(1), n - 3), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring("content", n - 2, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))), 2, "0")), F.substring("content", n - 1, F.lit(2)))
    both = files.unionByName(files.select((-1 - F.col("path")).alias("path"), other.alias("content"), F.lit(True).alias("damaged")))
    h = recording.header(F.col("content"))
    return both.select("path", recording.is_recording(F.col("content")).alias("sniffed"), h["header_size"].cast("int").alias("header_size"), h["data_size"].alias("data_size"), h["total_size"].alias("total_size"), recording.integrity("content")["code"].alias("code"), "damaged")


@query("""WITH e AS (SELECT user_id, event_id % 23 AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
p AS (SELECT *, lag(r) OVER (PARTITION BY user_id, kind ORDER BY r) AS before FROM e),
f AS (SELECT p.user_id, p.r, p.before IS NULL OR (SELECT count(DISTINCT o.kind) FROM e o WHERE o.user_id = p.user_id AND o.r > p.before AND o.r < p.r) >= 16 AS defined FROM p)
SELECT user_id AS path, (14 + 2 + 5 * count(*) + 9 * count(*) FILTER (defined))::BIGINT AS size FROM f GROUP BY user_id""")
def lru_slots(spark, d):
    """Recordings of more message kinds than slots: their sizes, which say how many definitions were written."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("chain_idx"), F.col("event_id").alias("seq"), F.lit(0).alias("pos"), (F.lit(40000) + F.pmod("event_id", F.lit(23))).cast("int").alias("mesg_num"), F.lit("field").alias("kind"), F.lit(1).alias("fdn"), F.lit(None).cast("int").alias("ddi"), F.lit("unknown").alias("name"), F.lit(0).alias("sub_pos"), plans.value(F.lit("uint"), i=F.col("event_id"), u=F.col("event_id")).alias("value"))
    return sink.encoded(e).select(F.col("path").cast("long").alias("path"), F.octet_length("content").cast("long").alias("size"))
