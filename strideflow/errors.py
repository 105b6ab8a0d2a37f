"""Structured errors, as codes with details."""

from __future__ import annotations


class RecordingError(ValueError):
    """A code of the taxonomy and what it is about.

    Codes: TooShort, InvalidHeaderSize, InvalidSignature, HeaderCrcMismatch,
    FileCrcMismatch, UnexpectedEof, UnknownBaseType, UndefinedLocalMesgNum,
    NonZeroReserved, MalformedField, TooManyLocalDefinitions, FieldTooLarge, Overrun.
    """

    def __init__(self, code: str, **detail):
        self.code, self.detail = code, {k: str(v) for k, v in detail.items()}
        super().__init__(code + (f" {self.detail}" if detail else ""))
