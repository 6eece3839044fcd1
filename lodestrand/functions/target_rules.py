"""Which facts of a target go together, as tables: rules are rows with wildcards, and a table of targets is joined with them for all violations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Machines with their pointer widths and byte orders; systems with families; what a system's rows allow. * stands for any.
MACHINES = (
    ("x86", 32, "little"), ("x86_64", 64, "little"), ("arm", 32, "*"), ("aarch64", 64, "*"), ("riscv32", 32, "little"), ("riscv64", 64, "little"), ("powerpc", 32, "*"), ("powerpc64", 64, "*"),
    ("mips", 32, "*"), ("mips64", 64, "*"), ("s390x", 64, "big"), ("sparc64", 64, "big"), ("loongarch64", 64, "little"), ("wasm32", 32, "little"), ("wasm64", 64, "little"),
)
APPLE = ("darwin", "macos", "ios", "tvos", "watchos")
BSD = ("freebsd", "netbsd", "openbsd", "dragonfly")
SYSTEMS = ("linux", "android", *APPLE, "windows", *BSD, "none")
ENVIRONMENTS = {
    "linux": ("none", "gnu", "gnuabi64", "musl", "android"), "android": ("none", "android"), "darwin": ("none",), "macos": ("none",), "ios": ("none", "simulator"), "tvos": ("none", "simulator"), "watchos": ("none", "simulator"),
    "windows": ("none", "gnu", "msvc"), "freebsd": ("none",), "netbsd": ("none",), "openbsd": ("none",), "dragonfly": ("none",), "none": ("none", "eabi", "eabihf"),
}
ONLY_ON = {"android": ("x86", "x86_64", "arm", "aarch64", "riscv64"), "darwin": ("x86", "x86_64", "aarch64"), "macos": ("x86", "x86_64", "aarch64"), "ios": ("x86", "x86_64", "arm", "aarch64"), "tvos": ("x86", "x86_64", "arm", "aarch64"), "watchos": ("x86", "x86_64", "arm", "aarch64"), "windows": ("x86", "x86_64", "arm", "aarch64")}
WASM = ("wasm32", "wasm64")
FLOATING = {"ieee_binary32": (32,), "decimal32": (32,), "ieee_binary64": (64,), "decimal64": (64,), "ieee_binary128": (128,), "ibm_double_double128": (128,), "decimal128": (128,), "x87_extended80": (80, 96, 128)}
CLASSES = {"ilp32": (32, 32, 32), "lp64": (32, 64, 64), "llp64": (32, 32, 64), "ilp64": (64, 64, 64)}


def combination_rows() -> list[tuple[str, ...]]:
    """(rule, a, b, c, d): what is allowed, by the rule's facts in order."""
    rows = [("environment", s, e, "*", "*") for s, es in ENVIRONMENTS.items() for e in es]
    for machine, width, endian in MACHINES:
        rows += [("machine", machine, str(width), endian, "*")]
        for s in SYSTEMS:
            if machine in ONLY_ON.get(s, (machine,)) and not (machine in WASM and s in ("linux", *BSD)) and not (machine == "s390x" and s in BSD):
                rows.append(("system", machine, s, "*", "*"))
            form = "mach_o" if s in APPLE else "coff" if s == "windows" else "elf"
            rows.append(("format", machine, s, "wasm" if machine in WASM else form, "*"))
        if machine in ("powerpc", "powerpc64"):
            rows.append(("format", machine, "none", "xcoff", "ibm"))
    rows += [("vendor", s, "apple" if s in APPLE else "*", "*", "*") for s in SYSTEMS]
    rows += [("compiler", "msvc", "windows", "msvc", "*"), ("compiler", "clang", "*", "*", "*")]
    rows += [("compiler", "apple_clang", s, "*", "*") for s in APPLE]
    rows += [("compiler", "gcc", s, e, "*") for s, es in ENVIRONMENTS.items() for e in es if e != "msvc"]
    rows += [("floating", f, str(bits), "*", "*") for f, sizes in FLOATING.items() for bits in sizes]
    return rows + [("model", name, *map(str, sizes)) for name, sizes in CLASSES.items()]


#: The facts of a target that each rule looks up, in the order of the rule's columns.
FACTS = {
    "environment": ("system", "environment"), "machine": ("machine", "pointer_bits", "endian"), "system": ("machine", "system"), "format": ("machine", "system", "object_format", "vendor"), "vendor": ("system", "vendor"),
    "compiler": ("compiler", "system", "environment"), "floating": ("long_double", "long_double_bits"), "model": ("data_model", "int_bits", "long_bits", "pointer_bits"),
}


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(combination_rows(), "rule string, a string, b string, c string, d string")


def target_violations(targets: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, rule, facts): every rule that no row of the rules table allows a target's facts by.

    Targets become a row for each rule and are anti-joined with the rules, a bounded table, on the rule and its first
    fact, with the others equal or any. Null facts are allowed nowhere.
    """
    lookups = [F.struct(F.lit(rule).alias("rule"), *[(F.col(f).cast("string") if f else F.lit("*")).alias(n) for n, f in zip("abcd", (*facts, None, None, None, None))]) for rule, facts in FACTS.items()]
    asked = targets.select(F.col(key), F.explode(F.array(*lookups)).alias("x")).select(key, "x.*")
    held = F.broadcast(rules.select(*[F.col(c).alias(f"_{c}") for c in ("rule", "a", "b", "c", "d")]))
    fits = reduce(lambda x, y: x & y, [(F.col(f"_{c}") == "*") | (F.col(f"_{c}") == F.col(c)) for c in "bcd"])
    bad = asked.join(held, (F.col("rule") == F.col("_rule")) & (F.col("a") == F.col("_a")) & fits, "left_anti")
    return bad.select(key, "rule", F.concat_ws("/", *[F.when(F.col(c) != "*", F.col(c)) for c in "abcd"]).alias("facts"))
