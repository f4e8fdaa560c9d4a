"""Column functions on modes, times, section entries, ranges and names; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.model import OFFSET_BITS, SECTION_TYPES, TYPE_BITS


def _bits(c: Column, mask: int) -> Column:
    return c.cast("long").bitwiseAND(F.lit(mask).cast("long"))


def type_bits(mode: Column) -> Column:
    return _bits(mode, 0o170000)


def mode_bits(mode: Column) -> Column:
    return _bits(mode, 0o7777)


def permission_bits(mode: Column) -> Column:
    return _bits(mode, 0o777)


def compose_mode(kind: Column, permissions: Column) -> Column:
    """Type bits of a kind with permission bits."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_BITS.items() for x in kv])
    return F.element_at(table, kind).cast("long").bitwiseOR(permissions.cast("long"))


def mode_string(mode: Column) -> Column:
    """``drwxr-sr-t`` for a mode; ``?`` for an unknown type."""
    letters = {"dir": "d", "symlink": "l", "file": "-", "blkdev": "b", "chardev": "c", "fifo": "p", "socket": "s"}
    kind = F.lit("?")
    for name, letter in letters.items():
        kind = F.when(type_bits(mode) == TYPE_BITS[name], letter).otherwise(kind)
    flag = lambda bit, on: F.when(_bits(mode, bit) != 0, on).otherwise("-")
    parts = [kind]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        run, extra = _bits(mode, 1 << shift) != 0, _bits(mode, special) != 0
        last = F.when(run & extra, letter).when(extra, letter.upper()).when(run, "x").otherwise("-")
        parts += [flag(4 << shift, "r"), flag(2 << shift, "w"), last]
    return F.concat(*parts)


def octal(value: Column) -> Column:
    return F.conv(value.cast("string"), 10, 8)


def mode_debug(mode: Column) -> Column:
    """``0o100644/-rw-r--r--``."""
    return F.concat(F.lit("0o"), octal(mode), F.lit("/"), mode_string(mode))


def entry_time(offset: Column, base: Column, resolution: Column, scaled: Column) -> Column:
    """Seconds of a stored time: base and resolution count only if the image has options."""
    return F.when(scaled, (base + offset) * resolution).otherwise(offset)


def optional_time(offset: Column, base: Column, resolution: Column, scaled: Column, mtime_only: Column) -> Column:
    """Access and change times; null where only modification times are kept."""
    return F.when(~mtime_only, entry_time(offset, base, resolution, scaled))


def stored_time(seconds: Column, resolution: int = 1, source_date_epoch: int | None = None) -> Column:
    """What the writer stores: clamped to the build's epoch, in whole steps of resolution."""
    clamped = seconds if source_date_epoch is None else F.least(seconds, F.lit(source_date_epoch).cast("long"))
    return F.floor(clamped / resolution) if resolution != 1 else clamped


def pack_index_entry(section_type: Column, offset: Column) -> Column:
    """Type in the high 16 bits, offset in the low 48; null if the offset needs more."""
    return F.when(offset < (1 << OFFSET_BITS), F.shiftleft(section_type.cast("long"), OFFSET_BITS).bitwiseOR(offset.cast("long")))


def index_entry_type(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, OFFSET_BITS)


def index_entry_offset(entry: Column) -> Column:
    return _bits(entry, (1 << OFFSET_BITS) - 1)


def section_type_name(number: Column) -> Column:
    """A section type's name, ``SectionType(n)`` if unknown."""
    name = F.concat(F.lit("SectionType("), number.cast("string"), F.lit(")"))
    for n, known in SECTION_TYPES.items():
        name = F.when(number == n, known).otherwise(name)
    return name


def zigzag(x: Column) -> Column:
    return F.shiftleft(x.cast("long"), 1).bitwiseXOR(F.shiftright(x.cast("long"), 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-_bits(x, 1))


def classify(inode_num: Column, starts: dict[str, Column]) -> Column:
    """The kind of an inode by the number ranges of the kinds, never by its mode."""
    return (
        F.when(inode_num < starts["symlink"], "dir")
        .when(inode_num < starts["file"], "symlink")
        .when(inode_num < starts["shared"], "file")
        .when(inode_num < starts["device"], "shared")
        .when(inode_num < starts["ipc"], "device")
        .otherwise("ipc")
    )


def mtree_escape(name: Column) -> Column:
    """ASCII 33 to 126 but ``\\``, ``/`` and ``#`` stays; other bytes become ``\\ooo``."""
    plain = name.rlike(r"\A[!-\"$-.0-\[\]-~]*\z")
    code = lambda b: F.conv(b, 16, 10).cast("int")
    stays = lambda v: v.between(33, 126) & ~v.isin(35, 47, 92)
    shown = lambda b: F.when(stays(code(b)), F.char(code(b))).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(b, 16, 8), 3, "0")))
    pairs = F.filter(F.split(F.regexp_replace(F.hex(name.cast("binary")), "(..)", "$1,"), ","), lambda b: b != "")
    return F.when(plain, name).otherwise(F.array_join(F.transform(pairs, shown), ""))


def lossy_utf8(raw: Column) -> Column:
    """Text of bytes, what isn't UTF-8 replaced."""
    return F.call_function("make_valid_utf8", raw.cast("string"))


def explode_range(df: DataFrame, low: Column, high: Column, out: str) -> DataFrame:
    """A row for each number of the half-open range; rows with an empty range give none.

    The guard matters: sequence(5, 4) counts down instead of being empty.
    """
    return df.where(high > low).withColumn(out, F.explode(F.sequence(low, high - 1)))
