"""Worker processes whose calls can be stopped: for functions that may hang or bring their process down, such as models.

Every worker runs one call at a time, so a call's time does not count what waits before it. A worker that is late is
killed, one that dies is noticed by the end of its pipe; its call is lost and, when the next one comes, another worker
takes its place. Workers end with the process that started them, however that ends.
"""

from __future__ import annotations

import os
import pickle
import selectors
import struct
import subprocess
import sys
import time
from collections import deque
from collections.abc import Callable, Iterable, Sequence

#: The result of a call that was stopped or took its worker along.
LOST = object()


class Failed(Exception):
    """A call that raised an error, with its text; the worker lives on."""


def serve() -> None:
    """The worker's side: the function comes first, then calls; answers go to the pipe that standard output was, prints to standard error."""
    try:
        import ctypes

        ctypes.CDLL(None).prctl(1, 9)  # ends with its parent, where the system can
    except Exception:  # noqa: BLE001 - another system; the end of the input ends the worker too
        pass
    source, sink = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)

    def take():
        head = source.read(8)
        return pickle.loads(source.read(struct.unpack("<Q", head)[0])) if len(head) == 8 else None

    def give(answer) -> None:
        body = pickle.dumps(answer)
        sink.write(struct.pack("<Q", len(body)) + body)
        sink.flush()

    call = take()[0]()
    give(("ready", None))
    while (args := take()) is not None:
        try:
            answer = ("done", call(*args))
        except Exception as e:  # noqa: BLE001 - goes to the caller
            answer = ("failed", f"{type(e).__name__}: {e}")
        give(answer)


class _Worker:
    def __init__(self, made: bytes, start_seconds: float):
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.process = subprocess.Popen([sys.executable, "-c", "from quillsift.functions.workers import serve; serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env)
        os.set_blocking(self.process.stdout.fileno(), False)
        self.buffer, self.ready, self.job, self.late = bytearray(), False, None, time.monotonic() + start_seconds
        self.send(made)

    def send(self, body: bytes) -> None:
        try:
            self.process.stdin.write(struct.pack("<Q", len(body)) + body)
            self.process.stdin.flush()
        except OSError:
            pass  # it is dead, which its other pipe says

    def answers(self) -> tuple[list, bool]:
        """Complete answers so far, and whether the pipe has ended."""
        ended = False
        while True:
            try:
                part = os.read(self.process.stdout.fileno(), 1 << 16)
            except BlockingIOError:
                break
            if not part:
                ended = True
                break
            self.buffer += part
        out = []
        while len(self.buffer) >= 8 and len(self.buffer) >= 8 + (n := struct.unpack("<Q", self.buffer[:8])[0]):
            out.append(pickle.loads(self.buffer[8 : 8 + n]))
            del self.buffer[: 8 + n]
        return out, ended

    def kill(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()


class Workers:
    """Up to ``size`` workers for the function that ``make`` makes; they start when calls come."""

    def __init__(self, make: Callable[[], Callable], size: int = 4, seconds: float = 5.0, start_seconds: float = 120.0):
        from pyspark import cloudpickle

        self.made = cloudpickle.dumps((make,))
        self.size, self.seconds, self.start_seconds = max(1, size), seconds, start_seconds
        self.workers: list[_Worker] = []

    def map(self, calls: Iterable[Sequence]) -> list:
        """The calls' results in order: LOST for those that were stopped or died, Failed for those that raised."""
        waiting = deque(enumerate(calls))
        out: list = [LOST] * len(waiting)
        open_, poll = len(waiting), selectors.DefaultSelector()
        for w in self.workers:
            poll.register(w.process.stdout, selectors.EVENT_READ, w)
        try:
            while open_:
                while len(self.workers) < min(self.size, open_):
                    self.workers.append(w := _Worker(self.made, self.start_seconds))
                    poll.register(w.process.stdout, selectors.EVENT_READ, w)
                for w in self.workers:
                    if w.ready and w.job is None and waiting:
                        w.job, args = waiting.popleft()
                        w.late = time.monotonic() + self.seconds
                        w.send(pickle.dumps(tuple(args)))
                busy = [w for w in self.workers if not w.ready or w.job is not None]
                poll.select(max(0.0, min(w.late for w in busy) - time.monotonic()))
                for w in busy:
                    answers, ended = w.answers()
                    for kind, value in answers:
                        if kind == "ready":
                            w.ready = True
                        elif w.job is not None:
                            out[w.job], w.job, open_ = Failed(value) if kind == "failed" else value, None, open_ - 1
                    if (w.job is not None or not w.ready) and (ended or time.monotonic() >= w.late) or ended:
                        if not w.ready:
                            raise RuntimeError("a worker did not start: " + ("its process ended" if ended else f"not ready after {self.start_seconds:g} seconds"))
                        open_ -= w.job is not None
                        poll.unregister(w.process.stdout)
                        self.workers.remove(w)
                        w.kill()
        finally:
            poll.close()
        return out

    def close(self) -> None:
        for w in self.workers:
            w.kill()
        self.workers = []

    def __enter__(self) -> Workers:
        return self

    def __exit__(self, *_) -> None:
        self.close()
