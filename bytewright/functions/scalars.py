"""Scalar functions as Column expressions: formatting, parsing, file names, packed times, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coder and model names in order of their codes.
CODERS = ["NONE", "HUF", "AHUF", "RLE", "ARI", "ARI32", "ARI64", "BITARI", "ARIFPAQ"]
MODELS = ["UNKNOWN", "O0", "O1", "O2", "O3", "O0FIX", "O0SORT", "O0PAIR", "O3MIX", "O1FPAQ"]
#: Messages of the archive plug-in's error codes.
ERRORS = {
    10: "No more files in archive", 11: "Not enough memory", 12: "Data is bad", 13: "CRC error in archive data", 14: "Archive format unknown",
    15: "Cannot open existing file", 16: "Cannot create file", 17: "Error closing file", 18: "Error reading from file", 19: "Error writing to file",
    20: "Buffer too small", 21: "Function aborted by user", 22: "No files found", 23: "Too many files to pack", 24: "Function not supported",
}


def thousands(x: Column) -> Column:
    """A whole number in groups of three digits, a space between."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))


def split_drop_empty(s: Column, delimiter: str) -> Column:
    """The non-empty parts of ``s``."""
    return F.array_remove(F.split(s, f"\\Q{delimiter}\\E"), "")


def split_prefixes(s: Column, delimiter: str) -> Column:
    """For each delimiter what stands before it, earlier delimiters included, and at last all of ``s``; the empty prefix is dropped."""
    n = F.size(F.split(s, f"\\Q{delimiter}\\E"))
    return F.array_remove(F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", s, F.lit(delimiter), i)), "")


def trim_upper(s: Column) -> Column:
    """Without spaces at the ends, in upper case."""
    return F.upper(F.trim(s))


def parse_size(s: Column) -> Column:
    """Bytes of a size like ``64K`` or ``1m``; null if it doesn't begin with a number."""
    u = F.upper(s)
    factor = F.when(F.contains(u, F.lit("K")), 1024).when(F.contains(u, F.lit("M")), 1048576).otherwise(1)
    digits = F.regexp_extract(u, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.cast("bigint") * factor)


def _code(s: Column, names: list[str], what: str) -> Column:
    found = F.array_position(F.array(*map(F.lit, names)), trim_upper(s)).cast("int") - 1
    return F.when(s.isNull(), F.lit(None).cast("int")).when(found >= 0, found).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), s)).cast("int"))


def parse_model(s: Column) -> Column:
    """The code of a model's name; fails for an unknown one."""
    return _code(s, MODELS, "model")


def parse_coder(s: Column) -> Column:
    """The code of a coder's name; fails for an unknown one."""
    return _code(s, CODERS, "coder")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def millis_phrase(ms: Column) -> Column:
    """Hours (of a day), minutes, seconds and milliseconds in words, from the largest that isn't 0, seconds at least."""
    h, m, s, rest = (F.floor(ms / 3600000) % 24, F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    text = lambda *parts: F.concat(*[x for value, unit in parts for x in (value.cast("string"), F.lit(unit))])
    short = text((s, " seconds "), (rest, " ms"))
    middle = F.concat(text((m, " minutes ")), short)
    return F.when(h > 0, F.concat(text((h, " hours ")), middle)).when(m > 0, middle).otherwise(short)


def ellipsis(s: Column, width: int = 46) -> Column:
    """At most ``width`` characters, the last three dots if any are left out."""
    return F.when(F.length(s) > width, F.concat(F.left(s, F.lit(width - 3)), F.lit("..."))).otherwise(s)


def dos_time(ts: Column) -> Column:
    """Date and time packed into 32 bits as an unsigned number, the seconds as they are."""
    field = lambda x, n: F.shiftleft(x.cast("bigint"), n)
    parts = [field(F.year(ts) - 1980, 25), field(F.month(ts), 21), field(F.dayofmonth(ts), 16), field(F.hour(ts), 11), field(F.minute(ts), 5), field(F.second(ts), 0)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def dos_time_fields(packed: Column) -> Column:
    """``(year, month, day, hour, minute, second)`` of a packed time, whose seconds are stored halved."""
    take = lambda shift, mask: F.shiftrightunsigned(packed.cast("bigint"), shift).bitwiseAND(F.lit(mask).cast("bigint")).cast("int")
    return F.struct(
        (take(25, 127) + 1980).alias("year"), take(21, 15).alias("month"), take(16, 31).alias("day"),
        take(11, 31).alias("hour"), take(5, 63).alias("minute"), (take(0, 31) * 2).alias("second"),
    )


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"(?s)([^\\/]*)$", 1)


def directory(path: Column) -> Column:
    """What stands before the last slash or backslash, which is kept."""
    return F.regexp_extract(path, r"(?s)^(.*[\\/])?[^\\/]*$", 1)


def parse_bool(s: Column) -> Column:
    return F.lower(s).isin("1", "yes", "true")


def bool_text(b: Column) -> Column:
    return F.when(b, "true").otherwise("false")


def delete_list(s: Column) -> Column:
    """Names that each end with a NUL, the list ending with another."""
    return F.split(F.regexp_extract(s, r"(?s)^(.*?)(?:\x00\x00|\x00?$)", 1), "\x00")


def ratio(size: Column, compressed: Column) -> Column:
    """Size by compressed size; null if that is 0."""
    return F.try_divide(size.cast("double"), compressed.cast("double"))


def percent(done: Column, size: Column) -> Column:
    return F.try_divide(F.lit(100) * done, size)


def plan_runs(total: Column, part: int, workers: int) -> Column:
    """``array<(begin, size, parts)>``: runs of equal parts, each beginning where the one before it ends. Whole parts first, then the remainder in equal
    shares by worker and what is left of it; so at most three runs, however many parts."""
    run = lambda begin, size, parts: F.struct(*[x.cast("bigint").alias(n) for x, n in ((begin, "begin"), (size, "size"), (parts, "parts"))])
    whole, rest = F.floor(total / part), total % part
    each = F.floor(rest / workers)
    runs = F.array(run(F.lit(0), F.lit(part), whole), run(whole * part, each, F.lit(workers)), run(whole * part + each * workers, rest - each * workers, F.lit(1)))
    return F.filter(runs, lambda x: (x["size"] > 0) & (x["parts"] > 0))


def plan_parts(total: Column, part: int, workers: int) -> Column:
    """``array<(begin, size)>``: the parts of ``plan_runs`` one by one."""
    parts = lambda r: F.transform(F.sequence(F.lit(0).cast("bigint"), r["parts"] - 1), lambda i: F.struct((r["begin"] + i * r["size"]).alias("begin"), r["size"].alias("size")))
    return F.flatten(F.transform(plan_runs(total, part, workers), parts))


def attribute_flags(bits: Column) -> Column:
    """A letter of ``rhsvda`` for each of the lowest six bits that is set, else a dash."""
    return F.concat(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, c).otherwise("-") for i, c in enumerate("rhsvda")])


def is_directory(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(16)) != 0


def error_message(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Unknown error code ("), code.cast("string"), F.lit(")")))


def symbol_bits(symbol: Column) -> Column:
    """The eight bits of a byte value, the highest first."""
    return F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.shiftright(symbol, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
