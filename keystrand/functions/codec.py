"""Key and value encodings, hashes and bit layouts as column expressions (all inside code generation, no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a of 64 bits, its 60-bit mask, rolling checksum base, record header bytes, alignment, payload layout.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211
CLEAN_MASK = (1 << 60) - 1
ROLLING_BASE = 131
RECORD_HEADER = 24
ALIGNMENT = 8
BLOCK = 16
OFFSET_BITS = 48
INLINE_KEY, INLINE_VALUE = 16, 8
SIGN = -(1 << 63)
TWO_64 = 1 << 64
HALF = (1 << 32) - 1


def _d(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


# ---------------------------------------------------------------- keys and values


def int_key(c: Column, bits: int = 64, signed: bool = True) -> Column:
    """Big-endian bytes of the type's width, sign bit flipped: byte order is numeric order."""
    flipped = c.cast("long").bitwiseXOR(F.lit(-(1 << 63) if bits == 64 else 1 << (bits - 1))) if signed else c.cast("long")
    width = bits // 4
    return F.unhex(F.right(F.lpad(F.hex(flipped), 16, "0"), F.lit(width)))


def decode_int_key(key: Column, bits: int = 64, signed: bool = True) -> Column:
    """The number of :func:`int_key` (unsigned keys of at most 32 bits)."""
    if not signed or bits < 64:
        raw = F.conv(F.hex(key), 16, 10).cast("long")
        return raw - (1 << (bits - 1)) if signed else raw
    return F.conv(F.hex(key), 16, -10).cast("long").bitwiseXOR(F.lit(SIGN))


def int_value(c: Column) -> Column:
    """Eight bytes, little-endian, whatever the integer's width."""
    h = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


def decode_int_value(value: Column) -> Column:
    h = F.hex(value)
    return F.conv(F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]), 16, -10).cast("long")


def text(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def composite_key(*parts: Column) -> Column:
    return F.concat(*parts)


class Codec:
    """A registered codec for a user's type: ``encode`` builds BINARY from columns, ``decode`` the way back."""

    registry: dict[str, Codec] = {}

    def __init__(self, name: str, encode: Callable[..., Column], decode: Callable[[Column], Column] | None = None):
        self.name, self.encode, self.decode = name, encode, decode
        self.registry[name] = self


# ---------------------------------------------------------------- hashes


def byte_values(c: Column) -> Column:
    """Array of 0..255 for a BINARY column; each byte is looked at once, in whatever length of text."""
    return F.transform(F.array_remove(F.split(F.decode(c, "ISO-8859-1"), ""), ""), F.ascii)


def _times(high: Column, low: Column, factor: int, add: Column | None = None) -> Column:
    """(high * 2^32 + low) * factor + add modulo 2^64, the bits of a BIGINT; no step overflows for halves of 32 bits, a byte to add and FNV's prime."""
    up, down = factor >> 32, factor & HALF
    lower = low * down if add is None else low * down + add
    upper = high * down + F.shiftrightunsigned(lower, 32)
    return F.shiftleft(upper + low * up if up else upper, 32).bitwiseOR(lower.bitwiseAND(F.lit(HALF)))


def _unsigned(bits: Column) -> Column:
    return F.conv(F.hex(bits), 16, 10).cast("decimal(20,0)")


def _fnv_bits(c: Column, start: Column | None = None) -> Column:
    """FNV-1a as the bits of a BIGINT, so that no byte costs a decimal."""
    first = F.lit(FNV_BASIS - TWO_64) if start is None else F.conv(F.pmod(start.cast("decimal(20,0)"), _d(TWO_64)).cast("string"), 10, -10).cast("long")
    return F.aggregate(byte_values(c), first, lambda h, b: _times(F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(HALF)).bitwiseXOR(b.cast("long")), FNV_PRIME))


def fnv1a64(c: Column, start: Column | None = None) -> Column:
    """FNV-1a over bytes as DECIMAL(20,0); ``start`` continues an earlier hash."""
    return _unsigned(_fnv_bits(c, start))


def clean_hash(c: Column) -> Column:
    """The low 60 bits of the hash, BIGINT."""
    return _fnv_bits(c).bitwiseAND(F.lit(CLEAN_MASK))


def rolling(c: Column) -> Column:
    """h * 131 + byte modulo 2^64, DECIMAL(20,0)."""
    return _unsigned(F.aggregate(byte_values(c), F.lit(0).cast("long"), lambda h, b: _times(F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(HALF)), ROLLING_BASE, b.cast("long"))))


def record_checksum(lsn: Column, op: Column, key: Column, value: Column) -> Column:
    """Checksum of a log record, STRING: the hash of its header fields, then of key and value."""
    head = F.concat(int_value(lsn), text(op), int_value(F.octet_length(key)), int_value(F.coalesce(F.octet_length(value), F.lit(0))))
    return F.sha2(F.concat(head, key, F.coalesce(value, F.lit(b""))), 256)


# ---------------------------------------------------------------- layouts


def prefix16(key: Column) -> Column:
    """First 16 bytes, zero-padded, as hex."""
    return F.rpad(F.substring(F.hex(key), 1, 32), 32, "0")


def align(c: Column, to: int = ALIGNMENT) -> Column:
    return F.floor((c + (to - 1)) / to).cast("long") * to


def record_length(key_bytes: Column, value_bytes: Column) -> Column:
    return align(key_bytes.cast("long") + value_bytes.cast("long") + RECORD_HEADER)


def blocks(length: Column) -> Column:
    """16-byte blocks of an aligned record."""
    return F.floor(align(length, BLOCK) / BLOCK).cast("long")


def pack(offset: Column, block_count: Column) -> Column:
    return F.shiftleft(block_count.cast("long"), OFFSET_BITS).bitwiseOR(offset.cast("long"))


def unpack_offset(payload: Column) -> Column:
    return payload.bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def unpack_size(payload: Column) -> Column:
    return F.shiftrightunsigned(payload, OFFSET_BITS) * BLOCK


def embed(clean: Column, size: Column) -> Column:
    """Inline flag and size (8 as 0) above a 60-bit hash."""
    return clean.bitwiseAND(F.lit(CLEAN_MASK)).bitwiseOR(F.shiftleft(size.cast("long").bitwiseAND(F.lit(7)), 60)).bitwiseOR(F.lit(SIGN))


def is_inline(stored: Column) -> Column:
    return stored < 0


def inline_size(stored: Column) -> Column:
    code = F.shiftrightunsigned(stored, 60).bitwiseAND(F.lit(7))
    return F.when(code == 0, F.lit(8)).otherwise(code).cast("int")


def may_inline(key: Column, value: Column) -> Column:
    return (F.octet_length(key) <= INLINE_KEY) & F.octet_length(value).between(1, INLINE_VALUE)


def is_sentinel(value: Column) -> Column:
    """The one value that inserts and updates reject: eight bytes of ones."""
    return F.coalesce(value == F.lit(b"\xff" * 8), F.lit(False))


def stripe(c: Column) -> Column:
    return F.pmod(c, F.lit(256)).cast("int")


# ---------------------------------------------------------------- names and labels


def formatted_key(i: Column) -> Column:
    return F.format_string("k%015x", i.cast("long"))


def value_size(i: Column, target: int) -> Column:
    """Every fifth key holds eight bytes, the others ``target``."""
    return F.when(F.lit(target) == 8, F.lit(8)).when(i % 5 == 0, F.lit(8)).otherwise(F.lit(target)).cast("int")


def badge(ratio: Column) -> Column:
    """How a rival compares: much slower, slower, even, faster, much faster (for the rival over native ratio's inverse)."""
    return F.when(ratio.isNull(), "n/a").when(ratio <= 0.85, "lose").when(ratio < 0.95, "behind").when(ratio <= 1.05, "even").when(ratio < 1.15, "ahead").otherwise("win")


def timeout_text(seconds: Column, timed_out: Column) -> Column:
    return F.when(timed_out, F.format_string("≥%ds (timeout)", seconds.cast("int"))).otherwise(F.format_string("%.2fs", seconds.cast("double")))


def file_name(c: Column) -> Column:
    return F.translate(c, "/()% ", "_____")


def scrambled(i: Column, words: int) -> Column:
    """``words`` pseudo-random 64-bit words for a key's number, as an array of BIGINT: incompressible filler.

    A shift-register sequence seeded by the number; the words depend on the number alone.
    """
    seed = F.xxhash64(i)

    def step(state: Column, _: Column) -> Column:
        x = state[F.size(state) - 1]
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        return F.concat(state, F.array(x.bitwiseXOR(F.shiftleft(x, 17))))

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(words)), F.array(seed), step), 2, words)


def scrambled_value(i: Column, target: int) -> Column:
    """BINARY of the key's size by the fifth-key rule."""
    n = value_size(i, target)
    words = max(1, -(-target // 8))
    whole = F.array_join(F.transform(scrambled(i, words), lambda w: F.lpad(F.hex(w), 16, "0")), "")
    return F.unhex(F.substr(whole, F.lit(1), n * 2))
