"""Lexical functions as columns: tokens, kinds, lines, framed fingerprints, paths, integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the regular token language, longest alternatives first.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\rA-Za-z0-9_]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def _between(token: Column, a: str, b: str) -> Column:
    return (F.ascii(token) >= ord(a)) & (F.ascii(token) <= ord(b))


def is_identifier(token: Column) -> Column:
    """Whether a token is one, by its first code point alone; likewise the next two."""
    return _between(token, "a", "z") | _between(token, "A", "Z") | (F.ascii(token) == ord("_"))


def is_number(token: Column) -> Column:
    return _between(token, "0", "9")


def is_space(token: Column) -> Column:
    return (F.ascii(token) == ord(" ")) | _between(token, "\t", "\r")


def token_kind(token: Column) -> Column:
    return F.when(is_identifier(token), "identifier").when(is_number(token), "number").when(is_space(token), "space").otherwise("punctuation")


def significant(ts: Column) -> Column:
    """Tokens without white space."""
    return F.filter(ts, lambda t: ~is_space(t))


def framed(values: Column) -> Column:
    """Each value behind its byte length, so no two lists look alike."""
    return F.array_join(F.transform(values, lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)), "")


def fingerprint(prefix: str, values: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(framed(values), 256))


def is_fingerprint(value: Column, prefix: str) -> Column:
    return value.rlike(f"^{prefix}[0-9a-f]{{64}}$")


def splice_lines(text: Column) -> Column:
    """Backslash and line end removed."""
    return F.regexp_replace(text, "\\\\\r?\n", "")


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, kind, token, start, end): one row for each token, byte offsets by a running sum."""
    w = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = docs.select(key, F.posexplode(tokens(F.col(text))).alias("ord", "token")).withColumn("end", F.sum(F.octet_length("token")).over(w))
    return rows.select(key, F.col("ord").cast("long").alias("ord"), token_kind(F.col("token")).alias("kind"), "token", (F.col("end") - F.octet_length("token")).alias("start"), "end")


def line_table(docs: DataFrame, key: str, text: str, unit=F.octet_length) -> DataFrame:
    """(key, line, start, size): line from 1; offsets in bytes, or in code points with ``unit=F.length``."""
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "content")).select(key, (F.col("pos") + 1).cast("long").alias("line"), unit("content").cast("long").alias("size"))
    return rows.select(key, "line", (F.sum(F.col("size") + 1).over(w) - F.col("size") - 1).cast("long").alias("start"), "size")


def normalize_path(path: Column) -> Column:
    """Slashes forward, empty and ``.`` parts dropped; null where the path is absolute, climbs, or has a drive or NUL."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda c: (c != "") & (c != "."))
    bad = p.startswith("/") | F.exists(parts, lambda c: c == "..") | p.rlike("^[A-Za-z]:") | p.contains("\x00") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def parse_integer(token: Column) -> Column:
    """Value of a C integer literal of up to 64 bits: hexadecimal, binary, octal or decimal, suffix dropped; null if it is none."""
    body = F.regexp_replace(token, "(?i)[ul]+$", "")
    digits = F.regexp_replace(body, "^0[xXbB]", "")
    base = F.when(body.rlike("^0[xX][0-9a-fA-F]{1,15}$"), 16).when(body.rlike("^0[bB][01]{1,62}$"), 2).when(body.rlike("^0[0-7]{0,20}$"), 8).when(body.rlike("^[1-9][0-9]{0,17}$"), 10)
    return (
        F.when(base == 16, F.conv(digits, 16, 10)).when(base == 2, F.conv(digits, 2, 10)).when(base == 8, F.conv(digits, 8, 10)).when(base == 10, digits).try_cast("long")
    )
