"""Heavy readers in a process of their own: a crash, a hang or a flood stays outside the worker."""

from __future__ import annotations

import json
import signal
import subprocess
import sys
import tempfile
import threading

from folio.operators.extract.dispatch import Extracted, extract

TIMEOUT_S, MAX_STDOUT, MAX_STDERR = 30, 32 << 20, 256 << 10


def extract_isolated(raw: bytes, kind: str, timeout_s: int = TIMEOUT_S, **flags: bool) -> Extracted:
    """As ``extract``, in a child that gets the bytes on stdin and is ended after the timeout, or once
    it has written more than its cap; no more than that is ever held."""
    command = [sys.executable, "-m", "folio.operators.isolate", kind, json.dumps(flags), str(timeout_s)]
    with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as said:
        given.write(raw)
        given.seek(0)
        child = subprocess.Popen(command, stdin=given, stdout=subprocess.PIPE, stderr=said)
        late = threading.Event()

        def stop() -> None:
            late.set()
            child.kill()

        timer = threading.Timer(timeout_s, stop)
        timer.start()
        try:
            assert child.stdout is not None
            out = child.stdout.read(MAX_STDOUT + 1)
            if len(out) > MAX_STDOUT:
                child.kill()
            child.stdout.close()
            code = child.wait()
        finally:
            timer.cancel()
        if len(out) > MAX_STDOUT:
            return Extracted("error", None, f"text is over {MAX_STDOUT} bytes")
        if late.is_set():
            return Extracted("error", None, f"timed out after {timeout_s} s")
        if code:
            said.seek(0, 2)
            said.seek(max(0, said.tell() - MAX_STDERR))
            return Extracted("error", None, said.read().decode("utf-8", "replace").strip().rsplit("\n", 1)[-1] or f"reader ended with {code}")
    return Extracted(**json.loads(out))


def main(args: list[str]) -> int:
    if len(args) > 2:  # should the parent be gone, the child ends by itself
        signal.alarm(int(args[2]) + 2)
    got = extract(sys.stdin.buffer.read(), args[0], **json.loads(args[1]))
    sys.stdout.write(json.dumps({"status": got.status, "text": got.text, "detail": got.detail}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
