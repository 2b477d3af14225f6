"""Column expressions over text: code points, n-windows, legality, segmentation.

Everything here is a JVM-side Spark SQL expression (whole-stage codegen friendly);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
#
# Component codes: a character is its Unicode scalar value; a merged token is
# its id plus this offset (one past the largest scalar value).
TOK_ID_OFFSET = 1_114_112
# A window of components may become a token only if its whole text is one of:
# an optional single space and letters; one to three numerals; an optional
# single space and a run of "other" characters; a run of whitespace.
LEGAL_TOKEN_PATTERN = r"( ?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+)"
# ---------------------------------------------------------------------------

# Unicode White_Space spelled out, so that Java (Spark) and RE2 (DuckDB) agree:
# RE2's \s is ASCII-only, Java's is ASCII-only unless (?U) is given.
WS_CLASS = (r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def _spell_ws(pattern: str) -> str:
    """Replace ``\\s`` (in and out of brackets) with the explicit White_Space class."""
    out = []
    i = 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CLASS if in_class else f"[{WS_CLASS}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


# Legal-token test as a full match. Java's `$` would also match before a final
# newline, so anchor with \A ... \z (Spark's rlike is a find()).
LEGAL_BODY = _spell_ws(LEGAL_TOKEN_PATTERN)
LEGAL_JAVA = r"\A" + LEGAL_BODY + r"\z"
# Same body for DuckDB's regexp_full_match (RE2).
LEGAL_RE2 = LEGAL_BODY

# Segmentation: maximal runs inside which adjacent characters could still belong
# to one legal token.  Every cut between two pieces separates a pair that no legal
# token can contain (letter|other followed by space, numeral next to non-numeral,
# non-space whitespace followed by letter, ...), so counting windows or encoding
# per piece gives exactly the per-document result.
SEGMENT_BODY = _spell_ws(
    r"\s* \p{L}+|\p{L}+|\p{N}+|\s* [^\s\p{L}\p{N}]+|[^\s\p{L}\p{N}]+|\s+")


def char_codes(text: Column) -> Column:
    """Text -> ARRAY<BIGINT> of Unicode scalar values (empty text -> empty array)."""
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint")))


def char_array(text: Column) -> Column:
    """Text -> ARRAY<STRING> of single code points (empty text -> empty array)."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(text, ""))


def code_to_text(code: Column) -> Column:
    """Inverse of ``ascii`` for any scalar value (``chr`` wraps mod 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def nseq_windows(arr: Column, n: int) -> Column:
    """All overlapping length-``n`` windows of an array, in order.

    Arrays shorter than ``n`` give an empty array (``sequence`` would count down).
    """
    return F.when(F.size(arr) < n, F.array_repeat(F.slice(arr, 1, 1), 0)).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(arr) - n + 1),
                    lambda i: F.slice(arr, i, n)))


def legal(unrolled: Column) -> Column:
    """Whole-text match of the legal-token pattern."""
    return unrolled.rlike(LEGAL_JAVA)


def segments(text: Column) -> Column:
    """Split text into uncrossable pieces (their concatenation is the text)."""
    return F.regexp_extract_all(text, F.lit(SEGMENT_BODY), 0)


def nseq_sort_key(codes: Column) -> Column:
    """T06 tie-break key: descending order of this key = the reference's reversed order.

    Characters rank above tokens; characters by scalar value, tokens by id.
    """
    return F.transform(
        codes,
        lambda c: F.when(c < TOK_ID_OFFSET, c + F.lit(1 << 40)).otherwise(c - TOK_ID_OFFSET))
