"""Facts of a compilation target: triples, layouts and the constraints between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestrand.csource.extraction import framed_hash

# What combines. Spellings of machines, systems by name and environments, and which go together.
MACHINES = {"x86_64": "x86_64", "amd64": "x86_64", "i386": "x86", "i486": "x86", "i586": "x86", "i686": "x86", "aarch64": "aarch64", "arm64": "aarch64", "arm": "arm", "armv7": "arm", "riscv64": "riscv64", "riscv32": "riscv32"}
POINTER = {"x86_64": 64, "x86": 32, "aarch64": 64, "arm": 32, "riscv64": 64, "riscv32": 32}
SYSTEMS = {"linux": "linux", "darwin": "macos", "macos": "macos", "ios": "ios", "windows": "windows", "freebsd": "freebsd", "none": "none"}
ENVIRONMENTS = {"gnu": ("linux", "windows"), "musl": ("linux",), "msvc": ("windows",), "android": ("linux",), "eabi": ("none", "linux"), "gnueabihf": ("linux",), "": ("linux", "macos", "ios", "windows", "freebsd", "none")}
FORMATS = {"linux": "elf", "freebsd": "elf", "none": "elf", "macos": "mach_o", "ios": "mach_o", "windows": "coff"}
CLASSES = {"ilp32": (32, 32, 32), "lp64": (32, 64, 64), "llp64": (32, 32, 64), "ilp64": (64, 64, 64)}
RANKS = ("char", "short", "int", "long", "long_long")


@dataclass(frozen=True)
class Triple:
    machine: str
    vendor: str
    system: str
    environment: str


def parse_triple(text: str) -> Triple:
    """Three or four parts; with three, the last is the system."""
    parts = text.split("-")
    if len(parts) not in (3, 4) or not all(parts):
        raise ValueError(f"a triple has three or four parts: {text}")
    machine, vendor, system, environment = parts[0], parts[1], parts[2], parts[3] if len(parts) == 4 else ""
    if machine not in MACHINES or system.rstrip("0123456789.") not in SYSTEMS or environment not in ENVIRONMENTS:
        raise ValueError(f"unknown machine, system or environment: {text}")
    return Triple(MACHINES[machine], vendor, SYSTEMS[system.rstrip("0123456789.")], environment)


@dataclass(frozen=True)
class Target:
    triple: str
    object_format: str
    pointer_bits: int
    data_model: str
    #: Bits and alignment by rank.
    integers: dict = field(default_factory=dict)
    extensions: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    endian: str = "little"

    def violations(self) -> list[str]:
        """All that is wrong, not the first."""
        bad = []
        try:
            t = parse_triple(self.triple)
        except ValueError as e:
            return [str(e)]
        if t.system not in ENVIRONMENTS[t.environment]:
            bad.append(f"environment {t.environment} does not go with {t.system}")
        if self.object_format != FORMATS[t.system]:
            bad.append(f"object format {self.object_format} does not go with {t.system}")
        if self.pointer_bits != POINTER[t.machine]:
            bad.append(f"pointers of {t.machine} have {POINTER[t.machine]} bits")
        if t.machine in ("x86", "x86_64") and self.endian != "little":
            bad.append(f"{t.machine} is little-endian")
        for name, (bits, align) in self.integers.items():
            if bits <= 0 or bits % 8:
                bad.append(f"{name}: width is not a multiple of 8")
            if align <= 0 or align & (align - 1) or align % 8:
                bad.append(f"{name}: alignment is not a power of two of bytes")
        widths = [self.integers[r][0] for r in RANKS if r in self.integers]
        if any(a > b for a, b in zip(widths, widths[1:])):
            bad.append("widths fall with rank")
        if self.data_model not in CLASSES:
            bad.append(f"unknown data model {self.data_model}")
        elif {"int", "long"} <= self.integers.keys() and (self.integers["int"][0], self.integers["long"][0], self.pointer_bits) != CLASSES[self.data_model]:
            bad.append(f"widths are not those of {self.data_model}")
        if list(self.extensions) != sorted(set(self.extensions)):
            bad.append("extensions are not sorted and distinct")
        bad += [f"flag has control characters: {f!r}" for f in self.flags if any(ord(c) < 32 for c in f) or not f]
        return bad

    def fingerprint(self) -> str:
        facts = [self.triple, self.object_format, str(self.pointer_bits), self.data_model, self.endian, *(f"{k}={v[0]}/{v[1]}" for k, v in sorted(self.integers.items())), str(len(self.extensions)), *self.extensions, *self.flags]
        return framed_hash("tgt1_", *facts)

    def default_visibility(self) -> str:
        """The last flag wins."""
        return next((f.partition("=")[2] for f in reversed(self.flags) if f.startswith("-fvisibility=")), "default")
