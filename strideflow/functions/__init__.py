"""Scalar functions as column expressions; all stay in the JVM, but where noted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.wire import NIBBLES, crc16

#: Seconds between 1970-01-01 and 1989-12-31, from which recordings count.
EPOCH = 631_065_600
U32 = (1 << 32) - 1


def crc16_expr(content: Column) -> Column:
    """CRC-16 of bytes without Python: a fold over their nibbles. For short values; see ``crc16_arrow``."""
    table = F.array(*[F.lit(x) for x in NIBBLES])
    half = lambda crc, n: F.shiftright(crc, 4).bitwiseXOR(F.element_at(table, (crc.bitwiseXOR(n).bitwiseAND(F.lit(15)) + 1).cast("int")))
    nibbles = F.transform(F.regexp_extract_all(F.hex(content), F.lit("[0-9A-F]{2}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(nibbles, F.lit(0), lambda crc, b: half(half(crc, b.bitwiseAND(F.lit(15))), F.shiftright(b, 4))).cast("int")


def _crc16(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else crc16(bytes(b))).astype("Int32")


def crc16_arrow(content: Column) -> Column:
    """CRC-16 of bytes, batch by batch in Python: for long values."""
    return F.pandas_udf(_crc16, "int")(content)


def to_timestamp(seconds: Column) -> Column:
    """A recording's seconds to a UTC timestamp."""
    return F.timestamp_seconds(seconds + F.lit(EPOCH))


def from_timestamp(t: Column) -> Column:
    """A timestamp to a recording's whole seconds, null outside 32 bits."""
    s = F.unix_seconds(t.cast("timestamp")) - F.lit(EPOCH)
    return F.when(s.between(0, U32), s)


def scaled(raw: Column, scale: Column, offset: Column) -> Column:
    """raw / scale - offset."""
    return raw.cast("double") / scale - offset


def unscaled(value: Column, scale: Column, offset: Column, low: Column, high: Column) -> Column:
    """The whole number that ``scaled`` undoes, null outside the wire type's range."""
    x = (value + offset) * scale
    rounded = F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(-x + 0.5))
    return F.when(rounded.between(low, high), rounded.cast("long"))


def lane(packed: Column, shift: Column | int, bits: Column | int) -> Column:
    """``bits`` bits of a whole number from bit ``shift`` up."""
    shift, bits = (x if isinstance(x, Column) else F.lit(x) for x in (shift, bits))
    mask = F.when(bits >= 63, F.lit((1 << 63) - 1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    return F.call_function("shiftrightunsigned", packed.cast("long"), shift).bitwiseAND(mask)


def low_first(content: Column) -> Column:
    """Up to seven bytes as a whole number, lowest byte first; 0 for none."""
    pairs = F.reverse(F.regexp_extract_all(F.hex(content), F.lit("[0-9A-F]{2}"), F.lit(0)))
    return F.coalesce(F.conv(F.array_join(pairs, ""), 16, 10).cast("long"), F.lit(0).cast("long"))


def byte_lane(content: Column, shift: Column, bits: Column) -> Column:
    """The same of bytes, lowest byte first; bits past the end are zero."""
    piece = F.substring(content, F.floor(shift / 8).cast("int") + 1, F.lit(7))
    return lane(low_first(piece), (shift % 8).cast("int"), bits)


def text(content: Column) -> Column:
    """Bytes up to the first zero as text; broken UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(F.split(F.make_valid_utf8(content.cast("string")), "\u0000", 2)[0])


def text_trimmed(content: Column) -> Column:
    """Bytes without trailing zeros as text."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\u0000+$", "")


def all_invalid(values: Column, sentinel: Column) -> Column:
    """Whether every element of an array is the sentinel."""
    return F.forall(values, lambda x: x == sentinel)


def int_literal(text_: str) -> int:
    """A decimal or 0x number, as sub-field conditions hold it."""
    return int(text_, 16) if text_.lower().startswith("0x") else int(text_)


def array_spec(spec: Column) -> Column:
    """Elements that an array notation fixes: [5] and [5x10] give 5, [N] null."""
    return F.nullif(F.regexp_extract(spec, r"^\[(\d+)(?:x\d+)?\]$", 1), F.lit("")).cast("int")


def record_tag(tag: Column) -> Column:
    """A record header byte as struct: kind, local number, time offset, whether developer fields follow."""
    bit = lambda n: tag.bitwiseAND(F.lit(n)) != 0
    kind = F.when(bit(128), "compressed").when(bit(64), "definition").otherwise("data")
    local = F.when(bit(128), F.shiftright(tag, 5).bitwiseAND(F.lit(3))).otherwise(tag.bitwiseAND(F.lit(15)))
    return F.struct(kind.alias("kind"), local.alias("local"), F.when(bit(128), tag.bitwiseAND(F.lit(31))).alias("offset"), (~bit(128) & bit(64) & bit(32)).alias("has_dev"))


def register(spark: SparkSession) -> None:
    """SQL names: rec_crc16, rec_timestamp."""
    spark.udf.register("rec_crc16", F.pandas_udf(_crc16, "int"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rec_timestamp(s BIGINT) RETURNS TIMESTAMP RETURN timestamp_seconds(s + {EPOCH})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rec_unpack(x BIGINT, s INT, n INT) RETURNS BIGINT RETURN shiftrightunsigned(x, s) & (shiftleft(1L, n) - 1)")
