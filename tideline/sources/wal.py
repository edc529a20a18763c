"""Write-ahead log: length, op, key and value lengths, key, value, CRC-32; little endian."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from tideline.errors import LogCorruption, LogIncomplete

SET, DELETE = 1, 2
_HEAD = struct.Struct("<IBII")
_FRAME, _BODY = 8, 9  # length prefix and checksum; op and two lengths


@dataclass(frozen=True)
class Record:
    op: int
    key: str
    value: str | None = None

    def encode(self) -> bytes:
        key, value = self.key.encode(), (self.value or "").encode()
        body = _HEAD.pack(_BODY + len(key) + len(value), self.op, len(key), len(value)) + key + value
        return body + struct.pack("<I", zlib.crc32(body))


def decode_body(body: bytes) -> Record:
    """A record from its op, lengths, key and value bytes."""
    if len(body) < _BODY:
        raise LogCorruption("body is shorter than its header")
    op, n_key, n_value = struct.unpack_from("<BII", body)
    if len(body) < _BODY + n_key + n_value:
        raise LogCorruption("key or value reaches beyond the body")
    try:
        key, value = body[_BODY : _BODY + n_key].decode(), body[_BODY + n_key : _BODY + n_key + n_value].decode()
    except UnicodeDecodeError as e:
        raise LogCorruption("key or value is not UTF-8") from e
    if op == SET:
        return Record(SET, key, value)
    if op == DELETE:
        if n_value:
            raise LogCorruption("a delete carries a value")
        return Record(DELETE, key)
    raise LogCorruption(f"operation code {op} is neither set nor delete")


def _framed(data: bytes, at: int) -> bytes | None:
    """The checked body of a record that starts at a position, or None."""
    if at + 4 > len(data):
        return None
    (n,) = struct.unpack_from("<I", data, at)
    if n < _BODY or at + _FRAME + n > len(data):
        return None
    (stored,) = struct.unpack_from("<I", data, at + 4 + n)
    return data[at + 4 : at + 4 + n] if zlib.crc32(data[at : at + 4 + n]) == stored else None


def read(data: bytes, *, strict: bool = False) -> tuple[list[Record], int]:
    """Records of a log and the length of its valid part.

    A tail is torn only if no valid record follows it: a damaged length in the middle of a
    log is corruption, whereas a write that was cut short is discarded (strict: refused).
    """
    records, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else None
        complete = n is not None and n >= _BODY and at + _FRAME + n <= len(data)
        if not complete:
            if any(_framed(data, k) is not None for k in range(at + 1, len(data) - _FRAME - _BODY + 1)):
                raise LogCorruption("damaged length before valid records")
            if strict and not (n is not None and n < _BODY):
                raise LogIncomplete("the log ends within a record")
            break
        body = _framed(data, at)
        if body is None:
            raise LogCorruption("checksum of a record differs")
        records.append(decode_body(body))
        at += _FRAME + n
    return records, at


def read_file(path: str, *, strict: bool = False) -> tuple[list[Record], int]:
    with open(path, "rb") as f:
        return read(f.read(), strict=strict)


class LogWriter:
    """Appends records; each is durable once sync has returned."""

    def __init__(self, path: str):
        self._file = open(path, "ab")  # noqa: SIM115

    def append(self, record: Record) -> None:
        self._file.write(record.encode())
        self._file.flush()

    def sync(self) -> None:
        os.fsync(self._file.fileno())

    def truncate(self, size: int = 0) -> None:
        self._file.truncate(size)
        self._file.seek(0, os.SEEK_END)
        self.sync()

    def size(self) -> int:
        return os.fstat(self._file.fileno()).st_size

    def close(self) -> None:
        self._file.close()


def records_as_rows(records: list[Record], first_seq: int) -> Iterator[tuple[str, int, int, str | None]]:
    for k, r in enumerate(records):
        yield r.key, first_seq + k, r.op, r.value
