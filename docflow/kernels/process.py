"""Child processes fed with bytes and read under caps, with one order of what went wrong."""

from __future__ import annotations

import shutil
import subprocess
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from docflow.errors import DocflowError, malformed

# Limits of a run.
MAX_STDERR = 64 << 10
DEFAULT_TIMEOUT = 30.0
_BLOCK = 1 << 16


@dataclass(frozen=True)
class Run:
    """A program, or one with its first arguments, its input and limits; ``cancelled`` is asked while it runs."""

    program: str | tuple[str, ...]
    args: list[str]
    stdin: bytes = b""
    timeout: float = DEFAULT_TIMEOUT
    max_output: int = 64 << 20
    media_type: str = "application/pdf"
    cancelled: Callable[[], bool] = field(default=lambda: False)


class Cancelled(Exception):
    """The caller gave up."""


def run(spec: Run, consume: Callable[[bytes], None] | None = None) -> bytes:
    """Standard output, or what ``consume`` left of it (nothing).

    Failures in order: program not found, output over the cap, cancelled, out of time, the consumer's own,
    could not start, ended by a signal, ended with an error.
    """
    program, *first = [spec.program] if isinstance(spec.program, str) else spec.program
    path = shutil.which(program)
    if path is None:
        raise DocflowError("ENGINE_UNAVAILABLE", f"{program} isn't installed")
    try:
        child = subprocess.Popen([path, *first, *spec.args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise DocflowError("ENGINE_FAILED", f"{program}: {e}") from e
    kept: list[bytes] = []
    errors = bytearray()
    state: dict = {"over": False, "consumer": None}

    def feed() -> None:
        try:
            child.stdin.write(spec.stdin)
            child.stdin.close()
        except (BrokenPipeError, OSError, ValueError):
            pass  # a program may stop reading early

    def drain() -> None:
        total = 0
        while block := child.stdout.read1(_BLOCK):
            total += len(block)
            if total > spec.max_output:
                state["over"] = True
                child.kill()
                return
            try:
                kept.append(block) if consume is None else consume(block)
            except Exception as e:
                state["consumer"] = e
                child.kill()
                return

    def listen() -> None:
        while block := child.stderr.read1(_BLOCK):
            errors.extend(block[: MAX_STDERR - len(errors)])

    threads = [threading.Thread(target=t, daemon=True) for t in (feed, drain, listen)]
    for t in threads:
        t.start()
    deadline, late, gone = time.monotonic() + spec.timeout, False, False
    while child.poll() is None:
        gone, late = spec.cancelled(), time.monotonic() > deadline
        if gone or late:
            child.kill()
            break
        time.sleep(0.005)
    child.wait()
    for t in threads:
        t.join(5)
    for pipe in (child.stdout, child.stderr):
        pipe.close()
    if state["over"]:
        raise DocflowError("OUTPUT_TOO_LARGE", f"{program}: output is over {spec.max_output} bytes")
    if gone:
        raise Cancelled(program)
    if late:
        raise malformed(spec.media_type, f"{program} took more than {spec.timeout:g} s")
    if state["consumer"] is not None:
        raise state["consumer"]
    if child.returncode < 0:
        raise DocflowError("ENGINE_CRASHED", f"{program}: ended by signal {-child.returncode}")
    if child.returncode:
        raise malformed(spec.media_type, f"{program}: {bytes(errors).decode('utf-8', 'replace').strip() or child.returncode}")
    return b"".join(kept)
