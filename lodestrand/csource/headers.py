"""Built-in headers and the macros that a target defines."""

from __future__ import annotations

#: Widths of the integer types by data model: short, int, long, long long, pointer.
MODELS = {"ilp32": (16, 32, 32, 64, 32), "lp64": (16, 32, 64, 64, 64), "llp64": (16, 32, 32, 64, 64)}
_NAMES = ("short", "int", "long", "long long")


def _type_of(width: int, model: str) -> str:
    """The first standard type of that width."""
    return "signed char" if width == 8 else next(n for n, w in zip(_NAMES, MODELS[model]) if w == width)


def builtin_headers(model: str = "lp64") -> dict[str, str]:
    """Seven headers, made from the widths of the model."""
    pointer = MODELS[model][4]
    long_bits = MODELS[model][2]
    fixed = "".join(f"typedef {_type_of(w, model)} int{w}_t;\ntypedef unsigned {_type_of(w, model).removeprefix('signed ')} uint{w}_t;\n" for w in (8, 16, 32, 64))
    word = _type_of(pointer, model)
    unsigned = f"unsigned {word}"
    limits = "".join(f"#define {n}_MAX {(1 << (b - 1)) - 1}{s}\n#define {n}_MIN (-{n}_MAX - 1)\n" for n, b, s in (("SCHAR", 8, ""), ("SHRT", 16, ""), ("INT", 32, ""), ("LONG", long_bits, "L"), ("LLONG", 64, "LL")))
    return {
        "stdint.h": fixed + f"typedef {word} intptr_t;\ntypedef {unsigned} uintptr_t;\ntypedef long long intmax_t;\ntypedef unsigned long long uintmax_t;\n",
        "stddef.h": f"typedef {unsigned} size_t;\ntypedef {word} ptrdiff_t;\ntypedef int wchar_t;\n#define NULL ((void*)0)\n",
        "stdbool.h": "#define bool _Bool\n#define true 1\n#define false 0\n#define __bool_true_false_are_defined 1\n",
        "limits.h": "#define CHAR_BIT 8\n" + limits,
        "stdarg.h": "typedef __builtin_va_list va_list;\n#define va_start(v, l) __builtin_va_start(v, l)\n#define va_end(v) __builtin_va_end(v)\n#define va_copy(d, s) __builtin_va_copy(d, s)\n",
        "sys/types.h": f"typedef {word} ssize_t;\ntypedef {unsigned} size_t;\ntypedef long off_t;\ntypedef int pid_t;\ntypedef unsigned int uid_t;\ntypedef unsigned int gid_t;\ntypedef unsigned int mode_t;\n",
        "unistd.h": "#include <sys/types.h>\n#include <stddef.h>\n",
    }


# The macros by which a target's machine and system are known.
_MACHINES = {"x86_64": ("__x86_64__", "__amd64__"), "aarch64": ("__aarch64__",), "x86": ("__i386__",), "arm": ("__arm__",), "riscv64": ("__riscv",)}
_SYSTEMS = {"linux": ("__linux__", "__unix__"), "macos": ("__APPLE__", "__MACH__"), "windows": ("_WIN32",), "freebsd": ("__FreeBSD__", "__unix__")}


def predefined(machine: str = "x86_64", system: str = "linux", model: str = "lp64", standard: str = "201112L") -> dict[str, str]:
    """Macros of a target, sorted by name; an unknown machine or system is an error."""
    if machine not in _MACHINES or system not in _SYSTEMS:
        raise ValueError(f"unsupported target {machine}-{system}")
    short, int_, long_, longlong, pointer = MODELS[model]
    made = {"__STDC__": "1", "__STDC_VERSION__": standard, "__STDC_HOSTED__": "1", "__CHAR_BIT__": "8"}
    made |= {f"__SIZEOF_{n}__": str(w // 8) for n, w in (("SHORT", short), ("INT", int_), ("LONG", long_), ("LONG_LONG", longlong), ("POINTER", pointer))}
    made |= dict.fromkeys((*_MACHINES[machine], *_SYSTEMS[system]), "1")
    if model == "lp64":
        made |= {"__LP64__": "1", "_LP64": "1"}
    if system == "windows" and pointer == 64:
        made["_WIN64"] = "1"
    return dict(sorted(made.items()))
