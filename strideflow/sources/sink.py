"""The way back: messages to recordings.

What is a matter of values (scales, enumerations, times, ranges) is undone by column
expressions; the sequential rest, sizing, slots, packing and checksums, is done segment
by segment, as slots are state of a segment.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..basetypes import BY_CODE, BY_NAME, TYPES, BaseType, named
from ..catalogue import Catalogue
from ..errors import RecordingError
from .wire import SIGNATURE, crc16

PROTOCOL, PROFILE, SLOTS = 0x20, 21200, 16
WIRE = "path string, chain_idx int, seq long, pos int, mesg_num int, kind string, fdn int, ddi int, base_type string, tag string, i decimal(20,0), f double, s string, b binary, ai array<decimal(20,0)>, af array<double>"


def wire_values(messages: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Messages to what goes on the wire: real fields, the first of each number, as whole numbers of their base type.

    Values out of a type's range, unknown enumeration names and unknown times become
    ``invalid``. Developer fields take the last declaration of the whole input; those
    without one are left out.
    """
    spark = messages.sparkSession
    infos = catalogue.table(spark, "fields").toDF("m1", "f1", "p_name", "type", "scale", "offset", "units1", "accumulate", "bits")
    subs = catalogue.table(spark, "subfields").select(F.col("mesg_num").alias("m2"), F.col("fdn").alias("f2"), F.col("name").alias("s_name"), F.col("type").alias("s_type"), F.col("scale").alias("s_scale"), F.col("offset").alias("s_offset")).distinct()
    known = catalogue.table(spark, "messages").select(F.col("mesg_num").alias("m0"))
    std = messages.where("kind = 'field'").join(F.broadcast(known), F.col("mesg_num") == F.col("m0"), "left")
    std = std.join(F.broadcast(infos), (F.col("mesg_num") == F.col("m1")) & (F.col("fdn") == F.col("f1")), "left")
    std = std.join(F.broadcast(subs), (F.col("mesg_num") == F.col("m2")) & (F.col("fdn") == F.col("f2")) & (F.col("name") == F.col("s_name")), "left")
    real = std.where((F.col("m0").isNull() | (F.col("name") == F.col("p_name")) | F.col("s_name").isNotNull() | ((F.col("name") == "unknown") & F.col("p_name").isNull())) & (F.col("sub_pos") == 0))
    w = Window.partitionBy("path", "chain_idx", "seq", "fdn").orderBy("pos", "sub_pos")
    real = real.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    # Counters go back to what their width holds.
    wrapped = F.pmod(F.col("value.i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")))
    counter = F.coalesce("accumulate", F.lit(False)) & F.col("value.i").isNotNull()
    real = real.withColumn("value", F.when(counter, F.col("value").withField("i", wrapped).withField("u", wrapped.cast("decimal(20,0)"))).otherwise(F.col("value")))
    sub = F.col("s_name").isNotNull()
    real = real.withColumn("type", F.when(sub, F.col("s_type")).otherwise(F.col("type"))).withColumn("scale", F.when(sub, F.col("s_scale")).otherwise(F.col("scale"))).withColumn("offset", F.when(sub, F.col("s_offset")).otherwise(F.col("offset")))
    bases = spark.createDataFrame([(t.name, t.name) for t in TYPES] + [(a, named(a).name) for a in ("bool", "date_time", "local_date_time")] + [(t, ENUM_BASES.get(t, "enum")) for t in sorted({e[0] for e in catalogue.enums} | set(ENUM_BASES))], "b_type string, b_base string")
    real = real.join(F.broadcast(bases), F.col("type") == F.col("b_type"), "left")
    v = F.col("value")
    inferred = F.when(v["tag"] == "sint", "sint32").when(v["tag"] == "float", "float64").when(v["tag"] == "string", "string").when(v["tag"] == "bytes", "byte").when(v["tag"] == "bool", "uint8").when(v["tag"] == "enum", "enum").when(v["af"].isNotNull(), "float64").otherwise("uint32")
    real = real.withColumn("base_type", F.coalesce("b_base", inferred))
    enums = catalogue.table(spark, "enums").toDF("e_type", "e_value", "e_name")
    real = real.join(F.broadcast(enums), (F.col("type") == F.col("e_type")) & (v["s"] == F.col("e_name")) & (v["tag"] == "enum"), "left")
    empty = messages.where("kind = 'empty'").select("path", "chain_idx", "seq", "pos", "mesg_num", "kind", F.lit(0).alias("fdn"), F.lit(None).cast("int").alias("ddi"), F.lit("enum").alias("base_type"), "value", F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit(None).cast("long").alias("code"))
    plain = real.select("path", "chain_idx", "seq", "pos", "mesg_num", "kind", "fdn", "ddi", "base_type", "value", "scale", "offset", F.col("e_value").alias("code"))
    return _numbers(plain.unionByName(empty).unionByName(_developer(messages, catalogue).withColumn("code", F.lit(None).cast("long"))))


#: Base types of enumerations that are wider than a byte (fixed values).
ENUM_BASES = {"manufacturer": "uint16", "mesg_num": "uint16", "message_index": "uint16", "fit_base_type": "uint8", "activity_type": "enum", "event": "enum", "event_type": "enum", "file": "enum", "sport": "enum", "wkt_step_duration": "enum", "wkt_step_target": "enum"}


def _developer(messages: DataFrame, catalogue: Catalogue) -> DataFrame:
    # A declared base type is a number, or the name that an enumeration of the profile gave it.
    named_codes = {t.name: t.code for t in TYPES} | {name: value & 31 for kind, value, name in catalogue.enums if kind == "fit_base_type"}
    code_of = F.create_map(*[x for name, code in sorted(named_codes.items()) for x in (F.lit(name), F.lit(code).cast("long"))])
    one = lambda name, part: F.max(F.when(F.col("name") == name, F.col("value")[part]))
    scale = F.coalesce(one("scale", "f"), one("scale", "i").cast("double"))
    offset = F.coalesce(one("offset", "f"), one("offset", "i").cast("double"))
    declared = messages.where("mesg_num = 206").groupBy("path", "chain_idx", "seq").agg(one("developer_data_index", "i").alias("r_ddi"), one("field_definition_number", "i").alias("r_fdn"), F.coalesce(one("fit_base_type_id", "i"), F.element_at(code_of, one("fit_base_type_id", "s"))).alias("r_code"), scale.alias("scale"), offset.alias("offset"))
    last = declared.groupBy(F.col("path").alias("r_path"), "r_ddi", "r_fdn").agg(F.max_by(F.struct("r_code", "scale", "offset"), F.struct("chain_idx", "seq")).alias("r"))
    names = F.create_map(*[x for t in BY_CODE.values() for x in (F.lit(t.code), F.lit(t.name))])
    met = messages.where("kind = 'dev'").join(last, (F.col("path") == F.col("r_path")) & (F.col("ddi") == F.col("r_ddi")) & (F.col("fdn") == F.col("r_fdn")))
    return met.select("path", "chain_idx", "seq", "pos", "mesg_num", "kind", "fdn", "ddi", F.element_at(names, F.col("r.r_code").bitwiseAND(F.lit(31)).cast("int")).alias("base_type"), "value", F.coalesce("r.scale", F.lit(1.0)).alias("scale"), F.coalesce("r.offset", F.lit(0.0)).alias("offset")).where("base_type is not null")


def _numbers(rows: DataFrame) -> DataFrame:
    limits = rows.sparkSession.createDataFrame([(t.name, str(t.low), str(t.high)) for t in TYPES], "l_base string, l_low string, l_high string")
    limits = limits.select("l_base", *[F.col(c).cast("decimal(20,0)").alias(c) for c in ("l_low", "l_high")])
    rows, low, high = rows.join(F.broadcast(limits), F.col("base_type") == F.col("l_base"), "left"), F.col("l_low"), F.col("l_high")
    v, scale, offset = F.col("value"), F.coalesce("scale", F.lit(1.0)), F.coalesce("offset", F.lit(0.0))
    floats = F.col("base_type").isin("float32", "float64")
    whole = lambda x: fn.unscaled(x, scale, offset, low.cast("double"), high.cast("double")).cast("decimal(20,0)")
    exact = F.coalesce(v["u"], v["i"].cast("decimal(20,0)"))
    number = F.when(v["tag"] == "enum", F.col("code")).when(v["tag"] == "datetime", fn.from_timestamp(v["t"])).when(v["tag"] == "float", whole(v["f"])).otherwise(exact).cast("decimal(20,0)")
    fits = F.when(number.between(low, high), number)
    real = F.coalesce(v["f"], exact.cast("double"))
    ints = F.when(v["af"].isNotNull(), F.transform(v["af"], whole)).otherwise(F.transform(v["ai"], lambda x: x.cast("decimal(20,0)")))
    decimals = F.coalesce(v["af"], F.transform(v["ai"], lambda x: x.cast("double")))
    tag = (
        F.when((F.col("base_type") == "string") & (v["tag"] == "string"), "string").when((F.col("base_type") == "byte") & (v["tag"] == "bytes"), "bytes")
        .when(v["tag"] == "array", F.when(floats, "floats").otherwise("ints")).when(floats & real.isNotNull(), "float")
        .when(~F.col("base_type").isin("string", "byte") & fits.isNotNull(), "int").otherwise("invalid")
    )
    return rows.select("path", "chain_idx", "seq", "pos", "mesg_num", "kind", "fdn", "ddi", "base_type", tag.alias("tag"), fits.alias("i"), real.alias("f"), v["s"].alias("s"), v["b"].alias("b"), ints.alias("ai"), decimals.alias("af"))


def pack_value(base: BaseType, tag: str, value, size: int) -> bytes:
    """One field's bytes, padded or filled with what means invalid."""
    if tag == "string":
        return value.encode("utf-8").ljust(size, b"\0")
    if tag == "bytes":
        return bytes(value).ljust(size, b"\xff")
    n = max(1, size // base.size)
    if base.name in ("string", "byte"):
        return (b"\0" if base.name == "string" else b"\xff") * n
    fill = struct.pack("<" + {1: "B", 2: "H", 4: "I", 8: "Q"}[base.size], base.invalid & ((1 << 8 * base.size) - 1))
    items = list(value) if tag in ("ints", "floats") else [] if tag == "invalid" else [value]
    out = b"".join(fill if x is None else struct.pack(f"<{base.fmt}", x if base.fmt in "fd" else int(x)) if base.fmt in "fd" or base.low <= int(x) <= base.high else fill for x in items)
    return out + fill * (n - len(items))


def wire_size(base: BaseType, tag: str, value) -> int:
    n = len(value.encode("utf-8")) + 1 if tag == "string" else max(1, len(value)) if tag == "bytes" else base.size * (max(1, len(value)) if tag in ("ints", "floats") else 1)
    if n > 255:
        raise RecordingError("FieldTooLarge", kind={"string": "String", "bytes": "ByteArray"}.get(tag, "Array"), size=n)
    return n


def encode_segment(records: list[tuple[int, list[tuple], list[tuple]]], protocol: int = PROTOCOL, profile: int = PROFILE) -> bytes:
    """A segment from (mesg_num, fields, developer fields), each field (fdn, base name, tag, value[, ddi]).

    Sixteen slots hold definitions; the one that was not used for longest gives way.
    """
    body = bytearray()
    slots: dict[int, tuple] = {}  # message number -> (slot, definition); in order of use
    for mesg_num, fields, devs in records:
        if len(fields) > 255 or len(devs) > 255:
            raise RecordingError("FieldTooLarge", kind="FieldList" if len(fields) > 255 else "DevFieldList", size=max(len(fields), len(devs)))
        sized = [(f, wire_size(BY_NAME[f[1]], f[2], f[3])) for f in fields]
        dev_sized = [(f, wire_size(BY_NAME[f[1]], f[2], f[3])) for f in devs]
        definition = struct.pack("<BBHB", 0, 0, mesg_num, len(sized)) + b"".join(bytes((f[0], n, BY_NAME[f[1]].wire)) for f, n in sized)
        if devs:
            definition += bytes((len(devs),)) + b"".join(bytes((f[0], n, f[4])) for f, n in dev_sized)
        slot, held = slots.pop(mesg_num, (None, None))
        if slot is None:
            slot = len(slots) if len(slots) < SLOTS else slots.pop(next(iter(slots)))[0]
        if held != definition:
            body += bytes((0x40 | (0x20 if devs else 0) | slot,)) + definition
        slots[mesg_num] = (slot, definition)
        body.append(slot)
        for f, n in sized + dev_sized:
            body += pack_value(BY_NAME[f[1]], f[2], f[3], n)
    head = struct.pack("<BBHI", 14, protocol, profile, len(body)) + SIGNATURE
    whole = head + struct.pack("<H", crc16(head)) + bytes(body)
    return whole + struct.pack("<H", crc16(whole))


_PART = {"int": "i", "float": "f", "string": "s", "bytes": "b", "ints": "ai", "floats": "af"}


_PARTS = tuple(_PART.values())


def encoded_segments(wire: DataFrame, protocol: int = PROTOCOL, profile: int = PROFILE) -> DataFrame:
    """path, chain_idx, content, error of each segment. A segment is one task's work, as its slots are sequential."""

    def pack(table: pa.Table) -> pa.Table:
        records: list[tuple[int, list, list]] = []
        table = table.sort_by([("seq", "ascending"), ("pos", "ascending")])
        last = None
        for seq, mesg_num, kind, fdn, ddi, base, tag, big, *parts in zip(*[table.column(c).to_pylist() for c in ("seq", "mesg_num", "kind", "fdn", "ddi", "base_type", "tag", "big", *_PARTS)], strict=True):
            if seq != last:
                records.append((mesg_num, [], []))
                last = seq
            item = (fdn, base, tag, (big if tag == "int" and big is not None else parts[_PARTS.index(_PART[tag])]) if tag in _PART else None)
            if kind == "field":
                records[-1][1].append(item)
            elif kind == "dev":
                records[-1][2].append((*item, ddi))
        content, error = None, None
        try:
            content = encode_segment(records, protocol, profile)
        except RecordingError as e:
            error = str(e)
        return pa.table({"path": table.column("path")[:1], "chain_idx": table.column("chain_idx")[:1], "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    # Numbers travel as longs; those beyond, of 64 bits without a sign, as decimals.
    slim = wire.select("path", "chain_idx", "seq", "pos", "mesg_num", "kind", "fdn", "ddi", "base_type", "tag", F.col("i").try_cast("long").alias("i"), F.when(F.col("i") > F.lit((1 << 63) - 1), F.col("i")).alias("big"), "f", "s", "b", "ai", "af")
    # As many tasks as the session asks for, however few the bytes: packing is what costs.
    slim = slim.repartition(int(wire.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "chain_idx")
    return slim.groupBy("path", "chain_idx").applyInArrow(pack, "path string, chain_idx int, content binary, error string")


def encoded(messages: DataFrame, catalogue: Catalogue | None = None, protocol: int = PROTOCOL, profile: int = PROFILE, mode: str = "PERMISSIVE") -> DataFrame:
    """path, content, error: each path's segments one after the other.

    A path of which a segment cannot be written has no content, and the first such segment's
    error; with mode "FAILFAST" it ends the job.
    """
    return chained(encoded_segments(wire_values(messages, catalogue or Catalogue.built_in()), protocol, profile), mode)


def chained(segments: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """path, content, error of ``encoded_segments``."""
    parts = F.array_sort(F.collect_list(F.struct("chain_idx", "content")))
    whole = F.aggregate(F.transform(parts, lambda x: x["content"]), F.lit(b""), lambda a, x: F.concat(a, x))
    out = segments.groupBy("path").agg(whole.alias("content"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chain_idx"))).alias("error"))
    content = F.when(F.col("error").isNull(), F.col("content"))
    if mode.upper() == "FAILFAST":
        content = content.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error")).cast("binary"))
    return out.select("path", content.alias("content"), "error")
