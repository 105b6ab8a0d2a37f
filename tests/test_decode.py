"""Typed decoding, post-processing and writing, as Spark plans."""

import pytest
from pyspark.sql import functions as F

from strideflow import functions as fn
from strideflow import plans, streaming
from strideflow.catalogue import Catalogue
from strideflow.sources import recording, sink

RECORD = [(253, "uint32", "int", 995749880), (2, "uint16", "int", 10435), (9, "sint16", "int", -100), (6, "uint16", "int", 1000)]


def fields_of(spark, *segments, corrected=True):
    data = b"".join(sink.encode_segment(s) for s in segments)
    return recording.decoded(recording.segments(spark.createDataFrame([("p", data)], "path string, content binary")), corrected=corrected)


def values(messages, name):
    rows = messages.where(F.col("name") == name).orderBy("chain_idx", "seq", "pos", "sub_pos").select("value").collect()
    return [next((x for x in (r.value.s, r.value.f, r.value.i, r.value.t, r.value.b, r.value.ai, r.value.af) if x is not None), None) for r in rows]


@pytest.fixture(scope="module")
def activity(spark):
    cycles = [(20, [(253, "uint32", "int", 100 + k), (18, "uint8", "int", c)], []) for k, c in enumerate((250, 5, 9))]
    one = [
        (0, [(0, "enum", "int", 4), (1, "uint16", "int", 1), (2, "uint16", "int", 77), (4, "uint32", "int", 1000)], []),
        (206, [(0, "uint8", "int", 0), (1, "uint8", "int", 7), (2, "uint8", "int", 0x84), (3, "string", "string", "power2"), (6, "uint8", "int", 10), (7, "sint8", "int", -1), (8, "string", "string", "W")], []),
        (20, RECORD, [(7, "uint16", "int", 55, 0), (9, "uint8", "int", 1, 0)]), *cycles,
        (21, [(0, "enum", "int", 42), (3, "uint32", "int", 0x04030201)], []), (60000, [(1, "uint8", "int", 9)], []),
        (20, [(8, "byte", "bytes", bytes((0xBC, 0x3A, 0x12)))], []),
    ]
    return fields_of(spark, one, cycles[:1]).cache()


def test_typed_values(activity):
    m = plans.decode(activity).cache()
    assert values(m, "type") == ["activity"] and values(m, "manufacturer") == ["garmin"] and values(m, "garmin_product") == [77]
    assert values(m, "altitude") == [1587.0] == values(m, "enhanced_altitude") and values(m, "grade") == [-1.0]
    assert values(m, "enhanced_speed")[0] == 1.0 and values(m, "cycles") == [250, 261, 265, 250]
    assert values(m, "rear_gear_num") == [1] and values(m, "front_gear") == [4] and values(m, "gear_change_data") == [0x04030201]
    assert values(m, "power2") == [6.5] and values(m, "developer_field") == [bytearray(b"\x01")]
    assert values(m, "distance") == [0x123 / 100] and values(m, "speed") == [1.0, 0xABC / 1000]
    assert m.where("mesg_num = 60000 and name = 'unknown' and mesg_name = 'unknown'").count() == 1
    assert str(values(m, "timestamp")[0]) == "2021-07-20 22:11:20" or values(m, "timestamp")[0] is not None
    counts = {r.mesg_name: r.n for r in plans.message_counts(m).collect()}
    assert counts["record"] == 6 and counts["unknown"] == 1


def test_options(activity):
    off = plans.decode(activity, options=plans.Options(False, False, False, False, False)).cache()
    assert values(off, "type") == [4] and values(off, "timestamp")[0] == 995749880 and values(off, "altitude") == [10435] and values(off, "product") == [77]
    assert off.where("sub_pos > 0").count() == 0 and values(off, "cycles") == [250, 261, 265, 250]
    assert plans.decode(activity, options=plans.Options(skip_header=True)).where("mesg_num = 0").count() == 0
    assert plans.decode(activity, options=plans.Options(data_only=True)).where("mesg_num = 60000").count() == 0


def test_reference_semantics(activity):
    m = plans.decode(activity, options=plans.Options(semantics="reference")).cache()
    assert values(m, "grade") == [654.36] and values(m, "enhanced_altitude") == [10435] and values(m, "distance") == [] and values(m, "power2") == [5.5]


def test_heart_rates_and_memos(spark):
    hr = [(132, [(253, "uint32", "int", 1000), (0, "uint16", "int", 0), (9, "uint32", "int", 1024), (6, "uint8", "int", 120)], []), (132, [(9, "uint32", "ints", [1024 + 307, 1024 + 717]), (6, "uint8", "ints", [130, 150])], [])]
    records = [(20, [(253, "uint32", "int", 1001)], []), (20, [(253, "uint32", "int", 1005), (3, "uint8", "int", 9)], [])]
    memo = [(145, [(250, "uint32", "int", p), (0, "byte", "bytes", b), (1, "uint16", "int", 27), (2, "uint16", "int", 0), (3, "uint8", "int", 8)], []) for p, b in ((1, b"lo!\0\0"), (0, b"hel"))]
    lost = [(145, [(0, "byte", "bytes", b"x"), (1, "uint16", "int", 27), (2, "uint16", "int", 5), (3, "uint8", "int", 8)], [])]
    f = fields_of(spark, hr + records + [(27, [(254, "uint16", "int", 0)], [])] + memo + lost)
    m = plans.decode(f, options=plans.Options(decode_memo_glob=True, merge_heart_rates=True)).cache()
    # From 1000 s: 120 at 0, .25; 130 at .3, .55; 150 at .7.
    assert values(m, "heart_rate") == [133, 9]  # 132.5, away from zero
    assert values(m, "notes") == ["hello!"]
    samples = plans.heart_rate_samples(m).orderBy("micros").collect()
    assert [s.bpm for s in samples] == [120, 130, 150]


def test_write_and_read_back(activity):
    m = plans.decode(activity)
    files = sink.encoded(m)
    again = plans.decode(recording.decoded(recording.segments(files)))
    key = ["chain_idx", "seq", "name", "sub_pos", "value", "units"]
    bare = lambda x: sorted(str((r.chain_idx, r.seq, r.name, r.value.asDict())) for r in x.where("name <> 'developer_field'").select(*key).collect())
    assert bare(m) == bare(again)
    assert files.select(recording.integrity("content").alias("x")).where("x.code is null").count() == 1


def test_out_of_range_becomes_invalid(spark):
    v = lambda **k: plans.value(F.lit(k.pop("tag")), **{a: F.lit(b) for a, b in k.items()})
    base = spark.range(1).select(F.lit("p").alias("path"), F.lit(0).alias("chain_idx"), F.lit(0).cast("long").alias("seq"), F.lit(20).alias("mesg_num"), F.lit("field").alias("kind"), F.lit(None).cast("int").alias("ddi"), F.lit(0).alias("sub_pos"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit(2).alias("fdn"), F.lit("altitude").alias("name"), v(tag="float", f=99999.0).alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit(3).alias("fdn"), F.lit("heart_rate").alias("name"), v(tag="uint", i=300, u=300).alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit(6).alias("fdn"), F.lit("speed").alias("name"), v(tag="float", f=1.5).alias("value")),
        F.struct(F.lit(3).alias("pos"), F.lit(73).alias("fdn"), F.lit("made_up").alias("name"), v(tag="float", f=1.5).alias("value")))).alias("x")).select("path", "chain_idx", "seq", "mesg_num", "kind", "ddi", "sub_pos", "x.*")
    back = recording.decoded(recording.segments(sink.encoded(base))).orderBy("pos").collect()
    assert [(r.fdn, r.tag, r.i) for r in back] == [(2, "invalid", None), (3, "invalid", None), (6, "uint", 1500)]


def test_source_and_stream(spark, tmp_path):
    data = sink.encode_segment([(20, RECORD, []), (0, [(0, "enum", "int", 4)], [])])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rec").write_bytes(data + data)
    (tmp_path / "in" / "b.rec").write_bytes(data[:-9])
    recording.register(spark)
    got = spark.read.format("recording").load(str(tmp_path / "in" / "a.rec"))
    assert got.where("mesg_num = 20").count() == 2 * len(RECORD) and got.where("chain_idx = 1 and starts_new_chain").count() == len(RECORD)
    files = recording.read_fields(spark, str(tmp_path / "in"))
    assert [r.code for r in recording.errors(files).collect()] == ["UnexpectedEof"]
    assert recording.raw_messages(files).count() == 5
    seen = []
    q = streaming.on_messages(streaming.read_stream(spark, str(tmp_path / "in")), lambda df, k: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sum(seen) == files.count()


def test_table_functions(spark, tmp_path):
    data = sink.encode_segment([(20, RECORD, []), (0, [(0, "enum", "int", 4)], [])])
    (tmp_path / "a.rec").write_bytes(data + data)
    (tmp_path / "b.rec").write_bytes(b"none")
    recording.register(spark)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    files.createOrReplaceTempView("rec_files")
    hops = spark.sql("SELECT right(path, 5) AS name, s.* FROM rec_files, LATERAL rec_segments(content) s ORDER BY name, chain_idx").collect()
    assert [(r["name"], r.chain_idx, r.start, r.code) for r in hops] == [("a.rec", 0, 0, None), ("a.rec", 1, len(data), None), ("b.rec", 0, None, "TooShort")]
    rows = spark.sql("SELECT f.* FROM rec_files t, LATERAL rec_fields(t.path, t.content) f")
    plain = recording.decoded(recording.segments(files))
    assert rows.count() == plain.count() and rows.exceptAll(plain).count() == 0


def test_live_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", i, (250 + 5 * i) % 256) for i in range(5)], "key string, seq long, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema("key string, seq long, value long").parquet(str(tmp_path / "in" / "x"))
    q = streaming.live_totals(stream, 8).writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [r.total for r in spark.table("totals").orderBy("seq").collect()] == [250, 255, 260, 265, 270]


def test_functions(spark):
    one = spark.range(1)
    row = one.select(
        fn.crc16_expr(F.lit(b"\x01")).alias("crc"), fn.crc16_arrow(F.lit(b"123456789")).alias("arrow"), fn.lane(F.lit(0xABCD), 4, 8).alias("lane"),
        fn.byte_lane(F.lit(bytes((0xBC, 0x3A, 0x12))), F.lit(12), F.lit(12)).alias("bytes"), fn.array_spec(F.lit("[5x10]")).alias("spec"), fn.array_spec(F.lit("[N]")).alias("open"),
        fn.text(F.lit(b"ab\xff\0cd")).alias("text"), fn.from_timestamp(F.lit("1980-01-01").cast("timestamp")).alias("early"), fn.unscaled(F.lit(1587.0), F.lit(5.0), F.lit(500.0), F.lit(0), F.lit(65535)).alias("raw"),
    ).first()
    assert (row.crc, row.arrow, row.lane, row.bytes, row.spec, row.open, row.early, row.raw) == (0xC0C1, 0xBB3D, 0xBC, 0x123, 5, None, None, 10435) and row.text == "ab�"
    assert fn.int_literal("0x1F") == 31 and fn.int_literal("7") == 7
    c = Catalogue.built_in()
    assert len(c.messages) == 123 and c.number("record") == 20 and c.enum_value("file", "activity") == 4


def test_catalogue_from_tables(spark):
    c = Catalogue.built_in()
    again = Catalogue.from_tables(*[c.table(spark, k) for k in ("messages", "fields", "subfields", "lanes", "enums")])
    assert sorted(again.fields) == sorted(c.fields) and sorted(again.lanes) == sorted(c.lanes)


def test_built_in_catalogue_is_whole_within_itself():
    c = Catalogue.built_in()
    fields = {(m, name): fdn for m, fdn, name, *_ in c.fields}
    numbers = {(m, fdn) for m, fdn, *_ in c.fields}
    assert len(numbers) == len(c.fields)
    assert all((m, fdn) in numbers and (m, ref) in numbers for m, fdn, *_, ref, _ in c.subfields)
    assert len({(m, fdn, ref, v) for m, fdn, *_, ref, v in c.subfields}) == len(c.subfields)
    # Each lane has a field to take its scale from, and each lane of a sub-field that sub-field.
    subs = {(m, fdn, name) for m, fdn, _, name, *_ in c.subfields}
    assert all((m, lane) in fields and (not sub or (m, fdn, sub) in subs) for m, fdn, sub, _, lane, *_ in c.lanes)


def test_failing_segments_are_reported(spark):
    """A chain of which one segment cannot be written has no content but an error; nothing is left out silently."""
    long = "x" * 300
    rows = [("a", 0, "short"), ("a", 1, long), ("b", 0, long), ("c", 0, "fine")]
    base = spark.createDataFrame(rows, "path string, chain_idx int, s string")
    messages = base.select("path", "chain_idx", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("mesg_num"), F.lit("field").alias("kind"), F.lit(None).cast("int").alias("ddi"), F.lit(0).alias("pos"), F.lit(0).alias("sub_pos"), F.lit(8).alias("fdn"), F.lit("product_name").alias("name"), plans.value(F.lit("string"), s=F.col("s")).alias("value"))
    got = {r.path: r for r in sink.encoded(messages).collect()}
    assert got["a"].content is None and got["b"].content is None and "FieldTooLarge" in got["a"].error and "FieldTooLarge" in got["b"].error
    assert got["c"].content is not None and got["c"].error is None
    with pytest.raises(Exception, match="FieldTooLarge"):
        sink.encoded(messages, mode="FAILFAST").collect()


def test_developer_fields_survive_a_profile_that_names_base_types(spark, activity):
    c = Catalogue.built_in()
    c.enums.append(("fit_base_type", 0x84, "uint16"))
    m = plans.decode(activity, catalogue=c)
    assert values(m.where("mesg_num = 206"), "fit_base_type_id") == ["uint16"]
    again = plans.decode(recording.decoded(recording.segments(sink.encoded(m, c))), catalogue=c)
    assert values(m, "power2") == values(again, "power2") == [6.5]


def test_segments_of_one_path_given_twice(spark):
    one, two = sink.encode_segment([(20, RECORD, [])]), sink.encode_segment([(20, RECORD, []), (0, [(0, "enum", "int", 4)], [])])
    parts = recording.segments(spark.createDataFrame([("p", one + two), ("p", two), ("q", b"")], "path string, content binary").coalesce(1)).collect()
    assert [(r.path, r.chain_idx, None if r.segment is None else bytes(r.segment), r.code) for r in parts] == [("p", 0, one, None), ("p", 1, two, None), ("p", 0, two, None), ("q", 0, None, "TooShort")]


def test_messages_without_fields_are_messages(spark):
    f = fields_of(spark, [(20, RECORD, []), (21, [], []), (60000, [], [])])
    m = plans.decode(f)
    counts = {r.mesg_name: r.n for r in plans.message_counts(m).collect()}
    assert counts == {"record": 1, "event": 1, "unknown": 1}
    again = recording.decoded(recording.segments(sink.encoded(m)))
    assert again.select("seq", "mesg_num").distinct().count() == 3


def test_decode_reads_the_bytes_once(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(sink.encode_segment([(20, RECORD, [])]))
    passes = []
    fields = recording.read_fields(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = plans.staged
    plans.staged = lambda df, name="stage": (passes.append(sum(plan(df).count(f"MapIn{x}") for x in ("Pandas", "Arrow"))), real(df, name))[1]
    try:
        out = plans.decode(fields, options=plans.Options(decode_memo_glob=True, merge_heart_rates=True))
    finally:
        plans.staged = real
    assert passes[0] == 2 and not any(passes[1:]) and "MapIn" not in plan(out)  # split and decode, once


def test_bytes_to_numbers(spark):
    for raw in (b"\xca\x03\x00\x00", b"\xff\xfe\x80", b"\x01"):
        assert spark.range(1).select(fn.low_first(F.lit(raw)).alias("n")).first().n == int.from_bytes(raw, "little")


def test_narrow_casts(spark):
    v = lambda **k: plans.value(F.lit(k.pop("tag")), **{a: F.lit(b) for a, b in k.items()})
    row = spark.range(1).select(
        plans.as_unsigned(v(tag="uint", i=255, u=255), 8).alias("a"), plans.as_unsigned(v(tag="uint", i=256, u=256), 8).alias("b"), plans.as_unsigned(v(tag="sint", i=-1), 32).alias("c"),
        plans.as_unsigned(v(tag="string", s="7"), 16).alias("d"), plans.as_f64s(v(tag="uint", i=3, u=3)).alias("e"), plans.as_f64s(v(tag="string", s="x")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (255, None, None, None, [3.0], None)


def test_counters(spark, activity):
    row = plans.counters(activity).first()
    assert (row.kinds, row.tracked, row.declared) == (5, 1, 1)


TYPES_SHEET = """Type Name,Base Type,Value Name,Value,Comment
file,enum,,,
,,device,1,
,,activity,4,
mesg_num,uint16,,,
,,file_id,0,
,,gadget,300,
colour,enum,,,
,,red,0,
,,blue,0x1,
"""
MESSAGES_SHEET = """Message Name,Field Def #,Field Name,Field Type,Array,Components,Scale,Offset,Units,Bits,Accumulate,Ref Field Name,Ref Field Value,Comment
SOME MESSAGES,,,,,,,,,,,,,
file_id,,,,,,,,,,,,,
,0,type,file,,,,,,,,,,
gadget,,,,,,,,,,,,,
,0,shade,colour,,,,,,,,,,
,1,level,uint16,,,10,5,m,,,,,
,,warmth,uint16,,,100,,C,,,shade,red,
,,cold,sint16,,,,,,,,"shade,shade","blue,blue",
,2,packed,byte,[3],"low,high",,,,"12,12","0,1",,,
,3,turns,uint8,,,,,,,1,,,
"""


def test_profile_from_its_sheets(spark):
    c = Catalogue.from_sheets(TYPES_SHEET, MESSAGES_SHEET)
    assert c.messages == [(0, "file_id"), (300, "gadget")] and c.enum_value("colour", "blue") == 1
    assert [f[:5] for f in c.fields] == [(0, 0, "type", "file", 1.0), (300, 0, "shade", "colour", 1.0), (300, 1, "level", "uint16", 10.0), (300, 2, "packed", "byte", 1.0), (300, 3, "turns", "uint8", 1.0)]
    assert [f[7] for f in c.fields] == [False, False, False, False, True]
    assert {(s[3], s[8], s[9]) for s in c.subfields} == {("warmth", 0, 0), ("cold", 0, 1)}
    assert c.lanes == [(300, 2, "", 0, "low", 0, 12, False), (300, 2, "", 1, "high", 12, 12, True)]
    m = plans.decode(fields_of(spark, [(300, [(0, "enum", "int", 0), (1, "uint16", "int", 250), (2, "byte", "bytes", bytes((0xBC, 0x3A, 0x12)))], []), (300, [(0, "enum", "int", 7), (1, "uint16", "int", 250)], [])]), catalogue=c)
    assert values(m, "shade") == ["red", 7] and values(m, "warmth") == [2.5] and values(m, "level") == [20.0] and values(m, "low") == [0xABC] and values(m, "high") == [0x123]


def test_source_reads_folders_patterns_and_segments(spark, tmp_path):
    data = sink.encode_segment([(20, RECORD, []), (0, [(0, "enum", "int", 4)], [])])
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.rec").write_bytes(data * 3)
    (tmp_path / "b.rec").write_bytes(data + b"junk")
    recording.register(spark)
    got = spark.read.format("recording").load(str(tmp_path))
    key = lambda df: sorted(map(str, df.drop("path").collect()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content")
    assert key(got) == key(recording.decoded(recording.segments(files)))
    assert got.rdd.getNumPartitions() == 5
    assert spark.read.format("recording").load(str(tmp_path / "*" / "*.rec")).select("chain_idx").distinct().count() == 3
