"""Canonical payloads of distributed tables: an ordered digest that no partitioning changes, and envelopes that are checked before they are decoded."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import order
from .storage import drop, written

#: Rows of a block of the digest.
BLOCK = 4096


def canonical_line(columns: Sequence[str]) -> Column:
    """A row as minified JSON with its fields in the given order, nulls written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def ordered_digest(df: DataFrame, by: Sequence[str], line: Column, block: int = BLOCK) -> str:
    """SHA-256 (hex) over the rows' lines in the order of ``by``, then of the lines: rows are digested, blocks of ``block`` successive digests are, and so on up to one.

    Depends on rows and order alone. A task holds one block of digests; each level is ``block`` times smaller. An empty
    table has the digest of nothing.
    """
    rows = df.select(*[F.col(c) for c in by], line.alias("_line")).withColumn("_digest", F.sha2("_line", 256))
    level = order.ranked(rows.drop("_line"), [*by, "_digest"], "_rank").select("_rank", "_digest")
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_digest"))), lambda x: x["_digest"]), "")
        above = written(level.groupBy(F.expr(f"_rank div {block}").alias("_rank")).agg(F.sha2(joined, 256).alias("_digest")), "digests")
        n = above.count()
        if n <= 1:
            top = above.first()
            drop(above)
            return top["_digest"] if top else _sha_of_nothing(df.sparkSession)
        level = above


def _sha_of_nothing(spark: SparkSession) -> str:
    return spark.range(1).select(F.sha2(F.lit(""), 256).alias("x")).first()["x"]


def package_fingerprint(tables: dict[str, tuple[DataFrame, Sequence[str]]], prefix: str = "pkg2_") -> str:
    """Of tables by name, each with the columns that order it: their digests, framed by name and row count, in order of names."""
    from lodestrand.csource.extraction import framed_hash

    fields: list[str] = []
    for name in sorted(tables):
        df, by = tables[name]
        fields += [name, str(df.count()), ordered_digest(df, by, canonical_line(df.columns))]
    return framed_hash(prefix, *fields)


@dataclass(frozen=True)
class Limits:
    """What an envelope may hold; counted before anything of it is decoded."""

    max_bytes: int = 64 << 20
    entries: tuple[tuple[str, int], ...] = (("files", 16_384), ("declarations", 1_000_000), ("macros", 1_000_000), ("diagnostics", 1_000_000))


#: Tags whose value alone makes up an object, by tag.
UNIT_VARIANTS = {
    "status": ("supported",), "state": ("complete",), "policy": ("hermetic",),
    "kind": ("translation_unit", "void", "bool", "float", "double", "long_double", "float128", "incomplete", "flexible", "unspecified_parameters", "c", "cdecl", "stdcall", "fastcall", "vectorcall", "thiscall", "sys_v64", "win64", "aapcs"),
    "format": ("ieee_binary32", "ieee_binary64", "ieee_binary128", "x87_extended80", "ibm_double_double128", "decimal32", "decimal64", "decimal128"),
    "class": ("ilp32", "lp64", "llp64", "ilp64", "i_l_p32", "l_p64", "l_l_p64", "i_l_p64"),
}


def surplus_fields(json: Column) -> Column:
    """Whether some object has a unit variant's tag and other fields: objects are the innermost ``{...}`` of the text, and one with a unit tag has no object inside."""
    # strings with a brace, bracket, comma, colon or escape go first; each string is matched whole, so quotes stay paired
    bare = F.regexp_replace(json, r'("[^"\\{}\[\],:]*")|"(?:[^"\\]|\\.)*"', "$1")
    spelled = "|".join(f'"{tag}":"(?:{"|".join(values)})"' for tag, values in UNIT_VARIANTS.items())
    return bare.rlike(rf"\{{(?:{spelled})," + "|" + rf",(?:{spelled})[,}}]")


def header_problems(envelopes: DataFrame, kind: str, schema_id: str, version: int, limits: Limits = Limits()) -> DataFrame:
    """(*, problem): envelopes (id, json) with the first thing wrong with each, null if none, in the order that a reader would meet it.

    Size, then being JSON with exactly the four fields, kind, schema id and version, both schemas and both fingerprints alike,
    counts of the payload's tables, and fields beside unit variants. Payloads are only scanned for these; none is decoded.
    """
    text = F.col("json")
    get = lambda p: F.get_json_object(text, p)
    fields = F.array_sort(F.json_object_keys(text))
    too_many = [F.coalesce(F.json_array_length(get(f"$.payload.{t}")), F.lit(0)) > n for t, n in limits.entries]
    over = F.coalesce(*[F.when(bad, F.lit(f"limit {t}")) for (t, _), bad in zip(limits.entries, too_many)])
    problem = (
        F.when(F.octet_length(text) > limits.max_bytes, "limit bytes")
        .when(~F.coalesce(fields == F.array(*map(F.lit, ("fingerprint", "kind", "payload", "schema"))), F.lit(False)), "fields")
        .when(~F.coalesce(get("$.kind") == kind, F.lit(False)), "kind")
        .when(~F.coalesce(get("$.schema.id") == schema_id, F.lit(False)), "schema id")
        .when(~F.coalesce(get("$.schema.version") == str(version), F.lit(False)), "schema version")
        .when(~F.coalesce(get("$.payload.schema") == get("$.schema"), F.lit(False)), "payload schema")
        .when(~F.coalesce(get("$.payload.fingerprint") == get("$.fingerprint"), F.lit(False)), "envelope fingerprint")
        .otherwise(over)
    )
    return envelopes.withColumn("problem", F.coalesce(problem, F.when(surplus_fields(text), "unit variant field")))


def payload_digest(json: Column) -> Column:
    """SHA-256 (hex) of a payload's canonical text without its fingerprint, which stands last."""
    payload = F.regexp_extract(json, r'"payload":(\{.*\})\}\s*$', 1)
    return F.sha2(F.regexp_replace(payload, r',"fingerprint":"[^"]*"\}$', "}"), 256)


def unpacked(envelopes: DataFrame, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of accepted envelopes (id, json): for each name and schema (DDL) the rows of that payload array, with (envelope, position) first; a row that the schema doesn't fit is an error."""
    out = {}
    for name, ddl in tables.items():
        schema = f"array<{StructType.fromDDL(ddl).simpleString()}>"
        rows = F.from_json(F.get_json_object("json", f"$.payload.{name}"), schema, {"mode": "FAILFAST"})
        out[name] = envelopes.select(F.col("id").alias("envelope"), F.posexplode(rows).alias("position", "r")).select("envelope", F.col("position").cast("long").alias("position"), "r.*")
    return out


def sealed(df: DataFrame, kind: str, schema_id: str, version: int, payload: Column) -> DataFrame:
    """``df`` with ``json``: an envelope around ``payload``, a canonical JSON object of at least one field, fingerprinted and with the header that readers check."""
    schema = F.lit(f'{{"id":"{schema_id}","version":{version}}}')
    body = F.concat(F.lit('{"schema":'), schema, F.lit(","), F.substring(payload, F.lit(2), F.length(payload) - 2), F.lit("}"))
    mark = F.sha2(body, 256)
    whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"fingerprint":"'), mark, F.lit('"}'))
    return df.withColumn("json", F.concat(F.lit(f'{{"kind":"{kind}","schema":'), schema, F.lit(',"fingerprint":"'), mark, F.lit('","payload":'), whole, F.lit("}")))
