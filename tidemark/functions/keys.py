"""Event names, user ids and the composite row key, as Column expressions.

An event name is a path of levels, ``visit.a1.``, closed by a dot. A user id of five bytes is a bucket
(one byte) before an inner id (four bytes). A row key is day (8 bytes), event, 0xFF, user id (5 bytes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 5
NO_LEVEL = "*"
BUCKETS = 256
MAX_UID = (1 << 40) - 1
_DAY, _UID = 8, 5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def level(event: Column | str, n: int) -> Column:
    """Level n of an event name, ``*`` where it has fewer."""
    parts = F.split(F.regexp_replace(_col(event), r"\.+$", ""), r"\.")
    return F.coalesce(F.get(parts, F.lit(n)), F.lit(NO_LEVEL))


def levels(event: Column | str, count: int = LEVELS) -> list[Column]:
    return [level(event, n).alias(f"l{n}") for n in range(count)]


def all_levels(event: Column | str) -> Column:
    """Every level as an array, also those beyond l4."""
    return F.split(F.regexp_replace(_col(event), r"\.+$", ""), r"\.")


def event_name(*parts: Column | str) -> Column:
    """The name from its levels; it ends before the first that is null or ``*``."""
    given = F.array(*map(_col, parts))
    end = F.array_position(F.transform(given, lambda x: F.coalesce(x, F.lit(NO_LEVEL))), NO_LEVEL).cast("int")
    own = F.when(end > 0, F.slice(given, F.lit(1), end - 1)).otherwise(given)
    return F.concat(F.array_join(own, "."), F.when(F.size(own) > 0, ".").otherwise(""))


def sort_key(event: Column | str) -> Column:
    """Orders names as row keys do: a name comes after the names below it."""
    return F.concat(_col(event).cast("binary"), F.lit(bytearray([255])))


def wrap_int(x: Column | str) -> Column:
    """The low 32 bits as a signed int; a plain cast would be an overflow error."""
    low = _col(x).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return (low.bitwiseXOR(F.lit(0x80000000)) - F.lit(0x80000000)).cast("int")


def inner_uid(uid: Column | str) -> Column:
    return wrap_int(uid)


def bucket_of(uid: Column | str) -> Column:
    return F.shiftright(_col(uid).cast("long"), 32).cast("int")


def hash_bucket(uid: Column | str) -> Column:
    """A bucket for an id that has none: the first byte of its MD5 as text."""
    return F.conv(F.substring(F.md5(_col(uid).cast("string").cast("binary")), 1, 2), 16, 10).cast("long")


def bucketed(uid: Column | str) -> Column:
    return F.shiftleft(hash_bucket(uid), 32).bitwiseOR(_col(uid).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def in_buckets(uid: Column | str, start_bucket: int = 0, count: int = BUCKETS) -> Column:
    """Whether an id without a bucket hashes to one of ``count`` buckets: a comparison of texts, with nothing converted."""
    digest, end = F.md5(_col(uid).cast("string").cast("binary")), start_bucket + count
    low = digest >= f"{start_bucket:02x}"
    return low if end >= BUCKETS else low & (digest < f"{end:02x}")


def uid_range(start_bucket: int = 0, count: int = BUCKETS) -> tuple[int, int]:
    """[start, end) of the ids in ``count`` buckets; the end is at most MAX_UID."""
    end = start_bucket + count
    return start_bucket << 32, MAX_UID if end >= BUCKETS else end << 32


def prefix_end(prefix: str) -> str:
    """The least string, in the order of code points, after all that begin with the prefix."""
    kept = prefix.rstrip(chr(0x10FFFF))
    if not kept:
        raise ValueError("nothing comes after every string with this prefix")
    after = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if after == 0xD800 else after)  # surrogates are no characters


def row_key(day: Column | str, event: Column | str, uid: Column | str) -> Column:
    tail = F.unhex(F.lpad(F.hex(_col(uid).cast("long")), 2 * _UID, "0"))
    return F.concat(_col(day).cast("binary"), _col(event).cast("binary"), F.lit(bytearray([255])), tail)


def key_day(key: Column | str) -> Column:
    return F.substring(_col(key), 1, _DAY).cast("string")


def key_event(key: Column | str) -> Column:
    key = _col(key)
    return key.substr(F.lit(_DAY + 1), F.octet_length(key) - F.lit(_DAY + 1 + _UID)).cast("string")


def key_uid(key: Column | str) -> Column:
    key = _col(key)
    return F.conv(F.hex(key.substr(F.octet_length(key) - F.lit(_UID - 1), F.lit(_UID))), 16, 10).cast("long")


def with_uid(key: Column | str, uid: Column | str) -> Column:
    """The key with another user id."""
    return row_key(key_day(key), key_event(key), uid)


def days_of(start: bytes, end: bytes) -> tuple[str | None, str | None]:
    """The first and last day that keys from start up to end can have; None where a bound doesn't begin with a day."""
    from .times import plain_day

    def day(key: bytes) -> str | None:
        try:
            return plain_day(key[:_DAY].decode())
        except ValueError:  # also what isn't text
            return None

    return day(start), day(end)


def key_bounds(first_day: str, last_day: str, events: list[str], start_bucket: int = 0, count: int = BUCKETS) -> tuple[bytes, bytes]:
    """First and last row key of days, events (in any order) and buckets."""
    from .times import plain_day

    ordered = sorted(events, key=lambda e: e.encode() + b"\xff")
    start, end = uid_range(start_bucket, count)
    make = lambda day, event, uid: plain_day(day).encode() + event.encode() + b"\xff" + uid.to_bytes(_UID, "big")
    return make(first_day, ordered[0], start), make(last_day, ordered[-1], end)
