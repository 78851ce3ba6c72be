"""Small building blocks shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A word character is a letter, a digit of any kind, or an underscore (Unicode-aware). The
# classes are spelt out so that results do not depend on the JVM's reading of \w and \b.
WORD = r"[\p{L}\p{N}_]"
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
# The white-space characters of Unicode, for functions that take characters.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# The code points that the JVM upper-cases otherwise than the SQL check, which maps
# each code point to one (ß to ẞ where the JVM writes SS), with the SQL check's upper case.
SIMPLE_UPPER = (
    (0xDF, 0x1E9E), (0x149, 0x149), (0x19B, 0x19B), (0x1F0, 0x1F0), (0x264, 0x264), (0x390, 0x390), (0x3B0, 0x3B0),
    (0x587, 0x587), (0x1C8A, 0x1C8A), (0x1E96, 0x1E96), (0x1E97, 0x1E97), (0x1E98, 0x1E98), (0x1E99, 0x1E99), (0x1E9A, 0x1E9A),
    (0x1F50, 0x1F50), (0x1F52, 0x1F52), (0x1F54, 0x1F54), (0x1F56, 0x1F56), (0x1F80, 0x1F88), (0x1F81, 0x1F89), (0x1F82, 0x1F8A),
    (0x1F83, 0x1F8B), (0x1F84, 0x1F8C), (0x1F85, 0x1F8D), (0x1F86, 0x1F8E), (0x1F87, 0x1F8F), (0x1F88, 0x1F88), (0x1F89, 0x1F89),
    (0x1F8A, 0x1F8A), (0x1F8B, 0x1F8B), (0x1F8C, 0x1F8C), (0x1F8D, 0x1F8D), (0x1F8E, 0x1F8E), (0x1F8F, 0x1F8F), (0x1F90, 0x1F98),
    (0x1F91, 0x1F99), (0x1F92, 0x1F9A), (0x1F93, 0x1F9B), (0x1F94, 0x1F9C), (0x1F95, 0x1F9D), (0x1F96, 0x1F9E), (0x1F97, 0x1F9F),
    (0x1F98, 0x1F98), (0x1F99, 0x1F99), (0x1F9A, 0x1F9A), (0x1F9B, 0x1F9B), (0x1F9C, 0x1F9C), (0x1F9D, 0x1F9D), (0x1F9E, 0x1F9E),
    (0x1F9F, 0x1F9F), (0x1FA0, 0x1FA8), (0x1FA1, 0x1FA9), (0x1FA2, 0x1FAA), (0x1FA3, 0x1FAB), (0x1FA4, 0x1FAC), (0x1FA5, 0x1FAD),
    (0x1FA6, 0x1FAE), (0x1FA7, 0x1FAF), (0x1FA8, 0x1FA8), (0x1FA9, 0x1FA9), (0x1FAA, 0x1FAA), (0x1FAB, 0x1FAB), (0x1FAC, 0x1FAC),
    (0x1FAD, 0x1FAD), (0x1FAE, 0x1FAE), (0x1FAF, 0x1FAF), (0x1FB2, 0x1FB2), (0x1FB3, 0x1FBC), (0x1FB4, 0x1FB4), (0x1FB6, 0x1FB6),
    (0x1FB7, 0x1FB7), (0x1FBC, 0x1FBC), (0x1FC2, 0x1FC2), (0x1FC3, 0x1FCC), (0x1FC4, 0x1FC4), (0x1FC6, 0x1FC6), (0x1FC7, 0x1FC7),
    (0x1FCC, 0x1FCC), (0x1FD2, 0x1FD2), (0x1FD3, 0x1FD3), (0x1FD6, 0x1FD6), (0x1FD7, 0x1FD7), (0x1FE2, 0x1FE2), (0x1FE3, 0x1FE3),
    (0x1FE4, 0x1FE4), (0x1FE6, 0x1FE6), (0x1FE7, 0x1FE7), (0x1FF2, 0x1FF2), (0x1FF3, 0x1FFC), (0x1FF4, 0x1FF4), (0x1FF6, 0x1FF6),
    (0x1FF7, 0x1FF7), (0x1FFC, 0x1FFC), (0xA7CD, 0xA7CD), (0xA7DB, 0xA7DB), (0xFB00, 0xFB00), (0xFB01, 0xFB01), (0xFB02, 0xFB02),
    (0xFB03, 0xFB03), (0xFB04, 0xFB04), (0xFB05, 0xFB05), (0xFB06, 0xFB06), (0xFB13, 0xFB13), (0xFB14, 0xFB14), (0xFB15, 0xFB15),
    (0xFB16, 0xFB16), (0xFB17, 0xFB17), (0x10D70, 0x10D70), (0x10D71, 0x10D71), (0x10D72, 0x10D72), (0x10D73, 0x10D73), (0x10D74, 0x10D74),
    (0x10D75, 0x10D75), (0x10D76, 0x10D76), (0x10D77, 0x10D77), (0x10D78, 0x10D78), (0x10D79, 0x10D79), (0x10D7A, 0x10D7A), (0x10D7B, 0x10D7B),
    (0x10D7C, 0x10D7C), (0x10D7D, 0x10D7D), (0x10D7E, 0x10D7E), (0x10D7F, 0x10D7F), (0x10D80, 0x10D80), (0x10D81, 0x10D81), (0x10D82, 0x10D82),
    (0x10D83, 0x10D83), (0x10D84, 0x10D84), (0x10D85, 0x10D85),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upper(text: Column) -> Column:
    """Upper case one code point at a time, as the SQL check does; the JVM alone expands some letters."""
    special = "[" + "".join(f"\\x{{{a:X}}}" for a, _ in SIMPLE_UPPER) + "]"
    parts = F.split(text, f"(?<={special})|(?={special})")
    source, target = ("".join(chr(p[i]) for p in SIMPLE_UPPER) for i in (0, 1))
    one = lambda p: F.when(p.rlike(f"^{special}$"), F.translate(p, source, target)).otherwise(F.upper(p))
    return F.when(text.rlike(special), F.array_join(F.transform(parts, one), "")).otherwise(F.upper(text))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` alone only removes blanks)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def safe_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def missing_if_nan(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def draw_key(seed: int, *cols: str) -> Column:
    """A reproducible 60-bit draw per row; it depends on the seed and the key only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def letter(position: Column) -> Column:
    """A for 0, B for 1, ..."""
    return F.char(position + F.lit(65))


def text_list(values: Column, sep: str = "|") -> Column:
    """An array as one string, missing entries shown as ``~``."""
    return F.array_join(values.cast("array<string>"), sep, "~")
