"""Whole plans: a field table to typed messages."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..basetypes import BY_CODE, BY_NAME
from ..catalogue import Catalogue
from ..errors import RecordingError
from ..sources.wire import decode_value
from ..staging import staged

HEAD = ["path", "chain_idx", "seq"]
VALUE = "struct<tag:string,i:bigint,u:decimal(20,0),f:double,s:string,b:binary,t:timestamp,ai:array<bigint>,af:array<double>>"


@dataclass(frozen=True)
class Options:
    """Each option adds a stage to the plan or leaves it out. ``semantics``: "corrected", or "reference" for its quirks."""

    apply_scale_and_offset: bool = True
    expand_components: bool = True
    expand_subfields: bool = True
    convert_types_to_strings: bool = True
    convert_datetime: bool = True
    decode_memo_glob: bool = False
    merge_heart_rates: bool = False
    skip_header: bool = False
    data_only: bool = False
    semantics: str = "corrected"


def value(tag: Column, **parts: Column) -> Column:
    """A value struct; what is not given is null."""
    kinds = {"i": "bigint", "u": "decimal(20,0)", "f": "double", "s": "string", "b": "binary", "t": "timestamp", "ai": "array<bigint>", "af": "array<double>"}
    return F.struct(tag.alias("tag"), *[parts.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def as_f64(v: Column) -> Column:
    return F.when(v["tag"].isin("float", "sint", "uint"), F.coalesce(v["f"], v["i"].cast("double"), v["u"].cast("double")))


def as_i64(v: Column) -> Column:
    return F.when(v["tag"].isin("sint", "uint"), v["i"])


def as_u64(v: Column) -> Column:
    return F.when(v["tag"].isin("sint", "uint") & (F.coalesce(v["u"], v["i"]) >= 0), F.coalesce(v["u"], v["i"].cast("decimal(20,0)")))


def as_unsigned(v: Column, bits: int) -> Column:
    """The value as a whole number of ``bits`` bits, null where it is none or does not fit."""
    x = F.coalesce(v["u"], v["i"].cast("decimal(20,0)"))
    return F.when(v["tag"].isin("sint", "uint") & x.between(0, F.lit(str((1 << bits) - 1)).cast("decimal(20,0)")), x.cast("decimal(20,0)" if bits > 62 else "long"))


def as_f64s(v: Column) -> Column:
    """The value as an array of doubles: a scalar as one of length 1; null for what holds no numbers."""
    return F.coalesce(v["af"], F.transform(v["ai"], lambda x: x.cast("double")), F.when(as_f64(v).isNotNull(), F.array(as_f64(v))))


def as_str(v: Column) -> Column:
    return F.when(v["tag"].isin("string", "enum"), v["s"])


def as_datetime(v: Column) -> Column:
    return v["t"]


def field(messages: DataFrame, name: str) -> DataFrame:
    """The first field of a name in each message: path, chain_idx, seq, value."""
    return op.first_by(messages.where(F.col("name") == name), HEAD, ["pos", "sub_pos"], ["value"])


def with_profile(fields: DataFrame, catalogue: Catalogue, options: Options) -> DataFrame:
    """Message and field names, types and scales; sub-fields chosen by their siblings."""
    spark = fields.sparkSession
    std = fields.where("kind in ('field', 'empty')")
    mesgs = F.broadcast(catalogue.table(spark, "messages").withColumnRenamed("mesg_num", "m0"))
    infos = catalogue.table(spark, "fields").toDF("m1", "f1", "p_name", "type", "scale", "offset", "units", "accumulate", "bits")
    out = std.join(mesgs, F.col("mesg_num") == F.col("m0"), "left").join(F.broadcast(infos), (F.col("mesg_num") == F.col("m1")) & (F.col("fdn") == F.col("f1")), "left")
    out = out.drop("m0", "m1", "f1").withColumn("mesg_name", F.coalesce("mesg_name", F.lit("unknown"))).withColumn("name", F.when(F.col("kind") == "field", F.coalesce("p_name", F.lit("unknown")))).withColumn("sub_pos", F.lit(0))
    if not options.expand_subfields or not catalogue.subfields:
        return out.withColumn("subfield", F.lit(""))
    # The alternatives of a field come with it; what they refer to is looked up among the values of its message.
    subs = catalogue.table(spark, "subfields")
    each = F.struct("ord", "ref_fdn", F.col("value").alias("ref_value"), F.col("name").alias("s_name"), F.col("type").alias("s_type"), F.col("scale").alias("s_scale"), F.col("offset").alias("s_offset"), F.col("units").alias("s_units"))
    of_field = F.broadcast(subs.groupBy(F.col("mesg_num").alias("m2"), F.col("fdn").alias("f2")).agg(F.array_sort(F.collect_list(each)).alias("may")))
    is_ref = F.broadcast(subs.select(F.col("mesg_num").alias("m3"), F.col("ref_fdn").alias("f3"), F.lit(True).alias("is_ref")).distinct())
    concerned = sorted({row[0] for row in catalogue.subfields})
    plain, some = out.where(~F.col("mesg_num").isin(concerned) | (F.col("kind") == "empty")), out.where(F.col("mesg_num").isin(concerned) & (F.col("kind") == "field"))
    some = some.join(of_field, (F.col("mesg_num") == F.col("m2")) & (F.col("fdn") == F.col("f2")), "left").join(is_ref, (F.col("mesg_num") == F.col("m3")) & (F.col("fdn") == F.col("f3")), "left")
    values = F.collect_list(F.when(F.col("is_ref") & F.col("i").isNotNull(), F.struct("fdn", "i"))).over(Window.partitionBy(*HEAD))
    some = some.withColumn("refs", values)
    met = F.filter("may", lambda a: F.exists("refs", lambda r: (r["fdn"] == a["ref_fdn"]) & (r["i"] == a["ref_value"])))
    some = some.withColumn("sub", F.try_element_at(met, F.lit(1))).drop("m2", "f2", "m3", "f3", "may", "is_ref", "refs")
    has = F.col("sub").isNotNull()
    own = options.semantics == "corrected"  # a sub-field's own scale, or its parent's
    for c, x in (("name", "s_name"), ("type", "s_type"), *((("scale", "s_scale"), ("offset", "s_offset"), ("units", "s_units")) if own else ())):
        some = some.withColumn(c, F.when(has, F.col(f"sub.{x}")).otherwise(F.col(c)))
    some = some.withColumn("subfield", F.coalesce("sub.s_name", F.lit(""))).drop("sub")
    return plain.withColumn("subfield", F.lit("")).unionByName(some)


def lanes_of(named: DataFrame, catalogue: Catalogue, options: Options) -> DataFrame:
    """Rows of the lanes that packed fields hold, right after their parents."""
    spark = named.sparkSession
    lanes = catalogue.table(spark, "lanes").toDF("m4", "f4", "l_sub", "l_ord", "l_name", "l_shift", "l_bits", "l_acc")
    packed = lanes.groupBy("m4", "f4", "l_sub").agg(F.array_sort(F.collect_list(F.struct("l_ord", "l_name", "l_shift", "l_bits", "l_acc"))).alias("lanes"))
    match = (F.col("mesg_num") == F.col("m4")) & (F.col("fdn") == F.col("f4")) & ((F.col("l_sub") == "") | (F.col("l_sub") == F.col("subfield")))
    out = named.where("tag in ('uint', 'sint', 'bytes')").join(F.broadcast(packed), match).withColumn("lane", F.explode("lanes"))
    if options.semantics != "corrected":
        out = out.where("i is not null or octet_length(b) = 1")  # packed bytes are not expanded there
    shift, bits = F.col("lane.l_shift"), F.col("lane.l_bits")
    number = F.when(F.col("b").isNotNull(), fn.byte_lane(F.col("b"), shift, bits)).otherwise(F.when(shift < 64, fn.lane(F.col("i"), shift, bits)).otherwise(F.lit(0)))
    out = out.where(F.col("b").isNull() | (shift + bits <= 8 * F.octet_length("b")))
    cleared = out.select(
        *HEAD, "starts_new_chain", "mesg_num", "pos", "kind", F.lit(0).alias("fdn"), "ddi", F.lit("uint64").alias("base_type"), F.lit("uint").alias("tag"),
        number.alias("i"), number.cast("decimal(20,0)").alias("u"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("binary").alias("b"),
        F.lit(None).cast("array<bigint>").alias("ai"), F.lit(None).cast("array<double>").alias("af"), F.lit(None).cast("binary").alias("wire"), "mesg_name",
        F.col("lane.l_name").alias("name"), (F.col("lane.l_ord") + 1 + F.when(F.col("l_sub") == "", 0).otherwise(100)).alias("sub_pos"), F.col("lane.l_acc").alias("accumulate"), F.col("lane.l_bits").alias("bits"),
    )
    if options.semantics != "corrected":
        return cleared.withColumns({"type": F.lit("uint64"), "scale": F.lit(1.0), "offset": F.lit(0.0), "units": F.lit(None).cast("string"), "p_name": F.col("name"), "subfield": F.lit("")})
    aims = catalogue.table(spark, "fields").select(F.col("mesg_num").alias("m5"), F.col("fdn").alias("t_fdn"), F.col("name").alias("t_name"), "type", "scale", "offset", "units")
    met = cleared.join(F.broadcast(aims), (F.col("mesg_num") == F.col("m5")) & (F.col("name") == F.col("t_name")), "left")
    return met.withColumns({"type": F.coalesce("type", F.lit("uint64")), "scale": F.coalesce("scale", F.lit(1.0)), "offset": F.coalesce("offset", F.lit(0.0)), "fdn": F.coalesce("t_fdn", F.lit(0)), "p_name": F.col("name"), "subfield": F.lit("")}).drop("m5", "t_fdn", "t_name")


def counted(rows: DataFrame, catalogue: Catalogue, options: Options) -> DataFrame:
    """Undo the wrap-around of counters: fields that are marked so, and accumulating lanes.

    Only counters, and in corrected mode plain values of the fields they lead to, go
    through the window; a plain value sets the total that later lanes add to.
    """
    key = F.col("name") if options.semantics == "corrected" else F.coalesce(F.when(F.col("sub_pos") > 0, F.col("p_name")), F.col("name"))
    targets = sorted({(m, n) for m, _, _, _, n, _, _, acc in catalogue.lanes if acc}) if options.semantics == "corrected" else []
    is_target = F.lit(False)
    for m, n in targets:
        is_target = is_target | ((F.col("mesg_num") == m) & (F.col("name") == n))
    counter = F.coalesce("accumulate", F.lit(False)) & F.col("i").isNotNull() & ~(is_target & (F.col("sub_pos") == 0))
    anchor = is_target & (F.col("sub_pos") == 0) & F.col("i").isNotNull()
    marked = rows.withColumn("__counter", counter).withColumn("__anchor", anchor).withColumn("__key", key)
    rest, some = marked.where("not __counter and not __anchor"), marked.where("__counter or __anchor")
    order = ["seq", "pos", "sub_pos"]
    w = Window.partitionBy("path", "chain_idx", "mesg_num", "__key").orderBy(*order)
    some = some.withColumn("__since", F.count(F.when(F.col("__anchor"), 1)).over(w.rowsBetween(*op.RUN)))
    within = Window.partitionBy("path", "chain_idx", "mesg_num", "__key", "__since").orderBy(*order)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.coalesce("bits", F.lit(32)), F.lit(62)))
    before = F.lag("i").over(within)
    step = F.when(before.isNull() | F.col("__anchor"), F.col("i")).otherwise(F.pmod(F.col("i") - before, size))
    some = some.withColumn("__step", step).withColumn("i", F.sum("__step").over(within.rowsBetween(*op.RUN))).withColumn("u", F.col("i").cast("decimal(20,0)")).drop("__step", "__since")
    return rest.unionByName(some).drop("__counter", "__anchor", "__key")


def typed_value(rows: DataFrame, catalogue: Catalogue, options: Options) -> DataFrame:
    """Values by precedence: invalid, time, enumeration, scale, as they are."""
    spark = rows.sparkSession
    out, case = rows, F.when(F.col("tag") == "invalid", value(F.lit("invalid")))
    if options.convert_datetime:
        case = case.when(F.col("type").isin("date_time", "local_date_time") & F.col("i").between(0, fn.U32), value(F.lit("datetime"), t=fn.to_timestamp(F.col("i"))))
    if options.convert_types_to_strings:
        enums = catalogue.table(spark, "enums").toDF("e_type", "e_value", "e_name")
        out = out.join(F.broadcast(enums), (F.col("type") == F.col("e_type")) & (F.col("i") == F.col("e_value")), "left")
        case = case.when(F.col("e_name").isNotNull(), value(F.lit("enum"), s=F.col("e_name")))
    if options.apply_scale_and_offset:
        uneven = (F.coalesce("scale", F.lit(1.0)) != 1.0) | (F.coalesce("offset", F.lit(0.0)) != 0.0)
        raw = F.coalesce("f", F.col("i").cast("double"), F.col("u").cast("double"))
        if options.semantics != "corrected":  # signed scalars lose their sign there
            width = F.create_map(*[x for t in BY_NAME.values() if t.low < 0 for x in (F.lit(t.name), F.lit(float(1 << 8 * t.size)))])
            raw = F.when(raw < 0, raw + F.coalesce(F.element_at(width, F.col("base_type")), F.lit(0.0))).otherwise(raw)
        scaled = lambda x: fn.scaled(x, F.col("scale"), F.col("offset"))
        case = case.when(uneven & raw.isNotNull(), value(F.lit("float"), f=scaled(raw)))
        case = case.when(uneven & F.col("ai").isNotNull(), value(F.lit("array"), af=F.transform("ai", scaled))).when(uneven & F.col("af").isNotNull(), value(F.lit("array"), af=F.transform("af", scaled)))
    case = case.otherwise(value(F.col("tag"), **{k: F.col(k) for k in ("i", "u", "f", "s", "b", "ai", "af")}))
    return out.withColumn("value", case)


def _decoded_dev(raw: pd.Series, code: pd.Series) -> pd.DataFrame:
    """Developer bytes by their registered base type, lowest byte first; as bytes where they do not fit it."""
    out = []
    for data, c in zip(raw, code, strict=True):
        data = bytes(data)
        base = BY_CODE.get(int(c) & 0x1F) if c == c and c is not None else None
        try:
            out.append(decode_value(base, data, "<") if base else ("bytes", None, None, None, data, None, None))
        except RecordingError:
            out.append(("bytes", None, None, None, data, None, None))
    return pd.DataFrame(out, columns=["tag", "i", "f", "s", "b", "ai", "af"]).astype({"i": "Int64"})


def decoded_dev(raw: Column, code: Column) -> Column:
    return F.pandas_udf(_decoded_dev, "tag string, i long, f double, s string, b binary, ai array<long>, af array<double>")(raw, code)


def registry(fields: DataFrame, options: Options) -> DataFrame:
    """Developer fields as they are declared: path, ddi, fdn, chain_idx, seq, info."""
    number = lambda n: F.max(F.when(F.col("fdn") == n, F.col("i")))
    words = lambda n: F.max(F.when(F.col("fdn") == n, F.col("s")))
    offset = number(7) if options.semantics == "corrected" else F.max(F.when((F.col("fdn") == 7) & (F.col("base_type") == "uint8"), F.col("i")))
    rows = fields.where("kind = 'field' and mesg_num = 206").groupBy(*HEAD).agg(
        F.coalesce(number(0), F.lit(0)).cast("int").alias("ddi"), F.coalesce(number(1), F.lit(0)).cast("int").alias("d_fdn"), number(2).alias("code"),
        F.coalesce(words(3), F.lit("unknown")).alias("d_name"), number(6).cast("double").alias("d_scale"), offset.cast("double").alias("d_offset"), words(8).alias("d_units"),
    )
    known = rows.where(F.col("code").bitwiseAND(F.lit(31)).isin(*BY_CODE))
    return known.select("path", "ddi", F.col("d_fdn").alias("fdn"), "chain_idx", "seq", F.struct("code", "d_name", "d_scale", "d_offset", "d_units").alias("info"))


def developer_fields(fields: DataFrame, catalogue: Catalogue, options: Options) -> DataFrame:
    """Developer fields, each by the declaration in force when it was written; undeclared ones stay bytes."""
    uses = fields.where("kind = 'dev'").drop("i", "u", "f", "s", "ai", "af", "tag")
    found = op.as_of(uses, registry(fields, options), ["path", "ddi", "fdn"], ["chain_idx", "seq"], "info", "info")
    named = found.withColumn("v", decoded_dev(F.col("b"), F.col("info.code").cast("int")))
    mesgs = F.broadcast(catalogue.table(fields.sparkSession, "messages").withColumnRenamed("mesg_num", "m0"))
    named = named.join(mesgs, F.col("mesg_num") == F.col("m0"), "left").drop("m0").withColumn("mesg_name", F.coalesce("mesg_name", F.lit("unknown")))
    v = F.col("v")
    raw = F.coalesce(v["f"], v["i"].cast("double"))
    scale, offset = F.coalesce("info.d_scale", F.lit(1.0)), F.coalesce("info.d_offset", F.lit(0.0))
    uneven = (scale != 1.0) | (offset != 0.0)
    case = F.when(v["tag"] == "invalid", value(F.lit("invalid")))
    if options.apply_scale_and_offset:
        case = case.when(uneven & raw.isNotNull(), value(F.lit("float"), f=fn.scaled(raw, scale, offset))).when(uneven & v["ai"].isNotNull(), value(F.lit("array"), af=F.transform(v["ai"], lambda x: fn.scaled(x, scale, offset))))
    case = case.otherwise(value(v["tag"], **{k: v[k] for k in ("i", "f", "s", "b", "ai", "af")}, u=F.when(v["tag"] == "uint", v["i"])))
    return named.select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name", "pos", F.lit(0).alias("sub_pos"), F.coalesce("info.d_name", F.lit("developer_field")).alias("name"), "kind", "fdn", "ddi", case.alias("value"), F.col("info.d_units").alias("units"))


OUT = [*HEAD, "starts_new_chain", "mesg_num", "mesg_name", "pos", "sub_pos", "name", "kind", "fdn", "ddi", "value", "units"]


def decode(fields: DataFrame, catalogue: Catalogue | None = None, options: Options | None = None) -> DataFrame:
    """Typed messages of a field table, a row for each field, in order (path, chain_idx, seq, pos, sub_pos)."""
    catalogue, options = catalogue or Catalogue.built_in(), options or Options()
    spark = fields.sparkSession
    # Each of these is read by several branches below; bytes are split and decoded once.
    fields = staged(fields, "fields")
    named = staged(with_profile(fields, catalogue, options), "named")
    if options.expand_components:
        named = named.unionByName(lanes_of(named, catalogue, options), allowMissingColumns=True)
    typed = typed_value(counted(named, catalogue, options), catalogue, options).select(*OUT)
    out = typed.unionByName(developer_fields(fields, catalogue, options).select(*OUT))
    if options.skip_header:
        out = op.skip_header(out)
    if options.data_only:
        out = op.data_only(out, catalogue.table(spark, "messages")).select(*OUT)
    if options.decode_memo_glob or options.merge_heart_rates:
        out = staged(out, "typed")
    if options.decode_memo_glob:
        out = with_memos(out, fields, catalogue)
    if options.merge_heart_rates:
        out = with_heart_rates(staged(out, "typed") if options.decode_memo_glob else out)
    return out


def with_memos(messages: DataFrame, fields: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Texts that came in parts, put into the fields of the messages they belong to; without a target they are dropped."""
    parts = fields.where("kind = 'field' and mesg_num = 145")
    number = lambda n: F.max(F.when(F.col("fdn") == n, F.col("i")))
    of_array = F.unhex(F.array_join(F.transform("ai", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    of_one = F.unhex(F.lpad(F.hex("i"), 2, "0"))
    content = lambda n: F.max(F.when(F.col("fdn") == n, F.coalesce("b", of_array, of_one)))
    pieces = parts.groupBy(*HEAD).agg(number(1).cast("int").alias("to_mesg"), number(2).alias("parent"), number(3).cast("int").alias("to_fdn"), F.coalesce(number(250), F.lit(0)).alias("part"), F.coalesce(content(4), content(0), F.lit(b"")).alias("data"))
    pieces = pieces.where("to_mesg is not null and parent is not null and to_fdn is not null")
    whole = op.joined_parts(pieces, ["path", "to_mesg", "parent", "to_fdn"], ["part", "chain_idx", "seq"], "data", "content", binary=True)
    heads = messages.select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name").distinct()
    targets = op.ordinals(heads, ["path", "mesg_num"], ["chain_idx", "seq"])
    names = catalogue.table(messages.sparkSession, "fields").select(F.col("mesg_num").alias("n_mesg"), F.col("fdn").alias("n_fdn"), F.col("name").alias("n_name"))
    met = whole.withColumnRenamed("path", "w_path").join(targets, (F.col("w_path") == F.col("path")) & (F.col("to_mesg") == F.col("mesg_num")) & (F.col("parent") == F.col("ordinal")))
    met = met.join(F.broadcast(names), (F.col("to_mesg") == F.col("n_mesg")) & (F.col("to_fdn") == F.col("n_fdn")), "left").withColumn("name", F.coalesce("n_name", F.col("to_fdn").cast("string")))
    new = met.select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name", "name", F.lit("field").alias("kind"), F.col("to_fdn").alias("fdn"), value(F.lit("string"), s=fn.text_trimmed(F.col("content"))).alias("new"))
    return _replaced(messages, new, None)


def _replaced(messages: DataFrame, new: DataFrame, units: str | None) -> DataFrame:
    """Messages with the first field of a name given the value ``new``, or with that field added at their end."""
    keys = [*HEAD, "name"]
    named = new.select(*[F.col(c).alias(f"x_{c}") for c in keys], "new")
    first = Window.partitionBy(*keys).orderBy("pos", "sub_pos")
    hit = messages.join(named, op._all([F.col(c) == F.col(f"x_{c}") for c in keys]), "left").drop(*[f"x_{c}" for c in keys])
    plain, changed = hit.where("new is null").drop("new"), hit.where("new is not null")
    changed = changed.withColumn("__n", F.row_number().over(first)).withColumn("value", F.when(F.col("__n") == 1, F.col("new")).otherwise(F.col("value"))).drop("__n", "new")
    there = messages.select(*[F.col(c).alias(f"x_{c}") for c in keys]).distinct()
    added = new.join(there, op._all([F.col(c) == F.col(f"x_{c}") for c in keys]), "left_anti")
    added = added.select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name", F.lit(1 << 20).alias("pos"), F.lit(0).alias("sub_pos"), "name", "kind", "fdn", F.lit(None).cast("int").alias("ddi"), F.col("new").alias("value"), F.lit(units).cast("string").alias("units"))
    return plain.select(*OUT).unionByName(changed.select(*OUT)).unionByName(added.select(*OUT))


#: Event times count 22 bits of seconds.
EVENT_RANGE = 4_194_304.0


def heart_rate_samples(messages: DataFrame) -> DataFrame:
    """path, order, micros, bpm of the samples that hr messages hold, on the recording's time line."""
    hr = messages.where("mesg_num = 132")
    numbers = F.coalesce(F.col("value.af"), F.transform("value.ai", lambda x: x.cast("double")), F.when(as_f64(F.col("value")).isNotNull(), F.array(as_f64(F.col("value")))))
    long = hr.withColumn("xs", numbers)
    seconds = F.when(F.col("value.t").isNotNull(), F.unix_micros("value.t") / 1e6).otherwise(F.col("value.i").cast("double") + fn.EPOCH)
    by = long.groupBy(*HEAD).agg(
        F.max(F.when(F.col("name") == "timestamp", seconds)).alias("ts"),
        F.max(F.when(F.col("name") == "fractional_timestamp", F.element_at("xs", 1))).alias("frac"),
        F.array_sort(F.collect_list(F.when((F.col("name") == "event_timestamp") & (F.col("sub_pos") == 0), F.struct("pos", "sub_pos", "xs")))).alias("plain"),
        F.array_sort(F.collect_list(F.when((F.col("name") == "event_timestamp") & (F.col("sub_pos") > 0), F.struct("pos", "sub_pos", "xs")))).alias("lanes"),
        F.max(F.when(F.col("name") == "filtered_bpm", F.col("xs"))).alias("bpm"),
    )
    flat = lambda c: F.flatten(F.transform(c, lambda x: x["xs"]))
    by = by.withColumn("events", F.when(F.size("plain") > 0, flat("plain")).otherwise(flat("lanes")))
    w = Window.partitionBy("path").orderBy("chain_idx", "seq").rowsBetween(*op.RUN)
    by = by.withColumn("anchor", F.last(F.when(F.col("ts").isNotNull(), F.col("ts") + F.coalesce("frac", F.lit(0.0))), ignorenulls=True).over(w))
    by = by.withColumn("anchor_event", F.last(F.when(F.col("ts").isNotNull() & (F.size("plain") > 0) & (F.size("events") == 1), F.element_at("events", 1)), ignorenulls=True).over(w))
    each = by.where("anchor is not null and anchor_event is not null").select(*HEAD, "anchor", "anchor_event", "bpm", F.posexplode("events").alias("k", "event")).where(F.col("k") < F.size("bpm"))
    back = F.col("anchor_event") - F.col("event")
    moved = F.when(back <= 0, F.col("event")).when(back > EVENT_RANGE / 2, F.col("event") + EVENT_RANGE)
    each = each.withColumn("moved", moved).where("moved is not null")
    micros = F.round((F.col("anchor") + F.col("moved") - F.col("anchor_event")) * 1e6).cast("long")
    return each.select("path", "chain_idx", "seq", "k", micros.alias("micros"), F.element_at("bpm", F.col("k") + 1).cast("long").alias("bpm"))


def with_heart_rates(messages: DataFrame) -> DataFrame:
    """Records with the mean heart rate of the samples since the record before."""
    samples = op.gap_filled(heart_rate_samples(messages), ["path"], ["chain_idx", "seq", "k"], "micros", "bpm")
    seconds = F.when(F.col("value.t").isNotNull(), F.unix_micros("value.t")).otherwise((F.col("value.i") + fn.EPOCH) * 1_000_000)
    records = messages.where("mesg_num = 20 and name = 'timestamp'").select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name", seconds.alias("micros")).where("micros is not null")
    found = op.ranged_mean(records, samples, ["path"], "micros", ["chain_idx", "seq"], "bpm", "mean").where("mean is not null")
    new = found.select(*HEAD, "starts_new_chain", "mesg_num", "mesg_name", F.lit("heart_rate").alias("name"), F.lit("field").alias("kind"), F.lit(3).alias("fdn"), value(F.lit("uint"), i=F.col("mean"), u=F.col("mean")).alias("new"))
    return _replaced(messages, new, "bpm")


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages by name."""
    return messages.select(*HEAD, "mesg_name").distinct().groupBy("mesg_name").agg(F.count(F.lit(1)).alias("n"))


def counters(fields: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """By path: the message kinds that took definitions, the counters that were undone, and the developer fields declared."""
    catalogue = catalogue or Catalogue.built_in()
    marks = F.broadcast(catalogue.table(fields.sparkSession, "fields").where("accumulate").select(F.col("mesg_num").alias("c_mesg"), F.col("fdn").alias("c_fdn"), F.lit(True).alias("counts")))
    rows = fields.where("kind <> 'error'").join(marks, (F.col("mesg_num") == F.col("c_mesg")) & (F.col("fdn") == F.col("c_fdn")) & (F.col("kind") == "field"), "left")
    found = rows.groupBy("path").agg(F.count_distinct("mesg_num").alias("kinds"), F.count_distinct(F.when(F.col("counts"), F.struct("mesg_num", "fdn"))).alias("tracked"))
    declared = registry(fields, Options()).groupBy(F.col("path").alias("c_path")).agg(F.count_distinct("ddi", "fdn").alias("declared"))
    return found.join(declared, F.col("path") == F.col("c_path"), "left").select("path", "kinds", "tracked", F.coalesce("declared", F.lit(0)).alias("declared"))


def wide(messages: DataFrame, mesg_name: str, names: list[str]) -> DataFrame:
    """One message type as a wide table: a value column for each name, the first field of that name."""
    some = messages.where((F.col("mesg_name") == mesg_name) & F.col("name").isin(*names))
    return some.groupBy(*HEAD).agg(*[F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.struct("pos", "sub_pos"))).alias(n) for n in names])
