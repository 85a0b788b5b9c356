"""The program of the process that user code runs in: one line of JSON in, one line out.  It stands alone and imports nothing of this library."""

from __future__ import annotations

import builtins
import json
import os
import resource
import sys


def limited(memory: int) -> None:
    """No files of any size, no further processes, so much memory.  (A limit that the system refuses to set is left as it is.)"""
    for what, most in ((resource.RLIMIT_FSIZE, 0), (resource.RLIMIT_CORE, 0), (resource.RLIMIT_NPROC, 0), (resource.RLIMIT_AS, memory)):
        try:
            resource.setrlimit(what, (most, most))
        except (ValueError, OSError):
            continue


def loaded(source: str, allowed: list[str], blocked: list[str]):
    """The code's run function, with imports from the allowed modules and without the blocked built-ins."""

    def safe_import(module, *args, **kwargs):
        if module.split(".")[0] not in allowed:
            raise ImportError(module)
        return __import__(module, *args, **kwargs)

    scope = {"__builtins__": {k: v for k, v in vars(builtins).items() if k not in blocked} | {"__import__": safe_import}, "__name__": "code"}
    exec(compile(source, "code", "exec"), scope)  # noqa: S102
    return scope["run"]


def serve() -> None:
    out = os.fdopen(os.dup(1), "w")
    os.dup2(2, 1)  # what the code prints is no answer

    def tell(message: dict) -> None:
        out.write(json.dumps(message, default=str) + "\n")
        out.flush()

    first = json.loads(sys.stdin.readline())
    try:
        for module in first["allowed"]:
            __import__(module)  # before the limits
        limited(first["memory"])
        run = loaded(first["source"], first["allowed"], first["blocked"])
    except BaseException as x:  # noqa: BLE001  whatever the code raises is told
        return tell({"error": f"{type(x).__name__}: {x}"})
    tell({})
    for line in sys.stdin:
        try:
            tell({"value": run(*json.loads(line)["values"])})
        except BaseException as x:  # noqa: BLE001
            tell({"error": f"{type(x).__name__}: {x}"})


if __name__ == "__main__":
    serve()
