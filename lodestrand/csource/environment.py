"""What a scan takes from outside: named environment variables, and an external preprocessor's text."""

from __future__ import annotations

import os
import re
import signal
import subprocess
import tempfile
from dataclasses import dataclass

from .extraction import framed_hash


@dataclass(frozen=True)
class Captured:
    """Names with the hash of their value, null where unset; and the include roots that they add."""

    variables: tuple[tuple[str, str | None], ...]
    user_roots: tuple[str, ...] = ()
    system_roots: tuple[str, ...] = ()


def capture(names: tuple[str, ...] | None, environ: dict[str, str]) -> Captured:
    """``names`` null is hermetic: nothing is read. CPATH adds user roots, C_INCLUDE_PATH system roots."""
    if names is None:
        return Captured(())
    for name in names:
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"not the name of a variable: {name!r}")
    roots = {k: tuple(p for p in environ.get(k, "").split(":") if p) if k in names else () for k in ("CPATH", "C_INCLUDE_PATH")}
    return Captured(tuple((n, framed_hash("env1_", n, environ[n]) if n in environ else None) for n in sorted(set(names))), roots["CPATH"], roots["C_INCLUDE_PATH"])


class ExternalFailure(RuntimeError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def external(argv: list[str], seconds: float = 30.0, most_bytes: int = 64 << 20) -> tuple[str, str]:
    """(text, messages) of a command with an empty environment in a process group of its own.

    E2210 it took too long, E2211 it wrote too much, E2213 it failed, E2214 it did not write UTF-8.
    """
    with tempfile.TemporaryFile() as out, tempfile.TemporaryFile() as err:
        process = subprocess.Popen(argv, stdin=subprocess.DEVNULL, stdout=out, stderr=err, env={}, start_new_session=True)
        try:
            process.wait(seconds)
        except subprocess.TimeoutExpired:
            os.killpg(process.pid, signal.SIGKILL)
            process.wait()
            raise ExternalFailure("E2210", f"over {seconds} s") from None
        sizes = [f.seek(0, os.SEEK_END) for f in (out, err)]
        if sum(sizes) > most_bytes:
            raise ExternalFailure("E2211", f"over {most_bytes} bytes")
        out.seek(0)
        err.seek(0)
        text, messages = out.read(), err.read().decode("utf-8", "replace")
    if process.returncode:
        raise ExternalFailure("E2213", f"exit status {process.returncode}: {messages[:200]}")
    try:
        return text.decode(), messages
    except UnicodeDecodeError:
        raise ExternalFailure("E2214", "not UTF-8") from None
