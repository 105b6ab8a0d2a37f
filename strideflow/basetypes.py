"""The wire format's base types: one row each, in one table that everything else reads."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BaseType:
    code: int
    name: str
    size: int
    fmt: str  # struct format of one element, "" for text and bytes
    invalid: int | None  # what an element without a value holds (bit pattern)
    low: int
    high: int

    @property
    def wire(self) -> int:
        """The type byte: types of several bytes carry the endian flag."""
        return self.code | (0x80 if self.size > 1 else 0)


def _ints(code: int, name: str, size: int, fmt: str, signed: bool, zero: bool = False) -> BaseType:
    bits = 8 * size
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return BaseType(code, name, size, fmt, 0 if zero else high, low, high)


TYPES = (
    _ints(0x00, "enum", 1, "B", False),
    _ints(0x01, "sint8", 1, "b", True),
    _ints(0x02, "uint8", 1, "B", False),
    _ints(0x03, "sint16", 2, "h", True),
    _ints(0x04, "uint16", 2, "H", False),
    _ints(0x05, "sint32", 4, "i", True),
    _ints(0x06, "uint32", 4, "I", False),
    BaseType(0x07, "string", 1, "", None, 0, 0),
    BaseType(0x08, "float32", 4, "f", 0xFFFFFFFF, 0, 0),
    BaseType(0x09, "float64", 8, "d", 0xFFFFFFFFFFFFFFFF, 0, 0),
    _ints(0x0A, "uint8z", 1, "B", False, True),
    _ints(0x0B, "uint16z", 2, "H", False, True),
    _ints(0x0C, "uint32z", 4, "I", False, True),
    BaseType(0x0D, "byte", 1, "", 0xFF, 0, 255),
    _ints(0x0E, "sint64", 8, "q", True),
    _ints(0x0F, "uint64", 8, "Q", False),
    _ints(0x10, "uint64z", 8, "Q", False, True),
)
BY_CODE = {t.code: t for t in TYPES}
BY_NAME = {t.name: t for t in TYPES}
#: Semantic types of fixed width.
ALIASES = {"bool": "uint8", "date_time": "uint32", "local_date_time": "uint32"}


def named(type_name: str) -> BaseType | None:
    return BY_NAME.get(ALIASES.get(type_name, type_name))
