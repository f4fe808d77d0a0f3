"""One writer at a time: a lock file with the holder's process id, made exclusively, broken when its holder is gone."""

from __future__ import annotations

import os
import time


class LockTimeout(TimeoutError):
    pass


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


class RepositoryLock:
    def __init__(self, path: str, timeout: float = 30.0, poll: float = 0.05):
        self.path, self.timeout, self.poll, self.held = path, timeout, poll, False

    def acquire(self) -> None:
        end = time.monotonic() + self.timeout
        while True:
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                self._break_if_stale()
                if time.monotonic() >= end:
                    raise LockTimeout(f"{self.path} is held by another process") from None
                time.sleep(self.poll)
                continue
            with os.fdopen(fd, "w") as f:
                f.write(str(os.getpid()))
            self.held = True
            return

    def _break_if_stale(self) -> None:
        try:
            with open(self.path) as f:
                text = f.read().strip()
            if text.isdigit() and not alive(int(text)):
                aside = f"{self.path}.{os.getpid()}"
                os.rename(self.path, aside)  # only one breaker wins
                os.unlink(aside)
        except FileNotFoundError:
            pass

    def release(self) -> None:
        if self.held:
            self.held = False
            try:
                os.unlink(self.path)
            except FileNotFoundError:
                pass

    def __enter__(self) -> RepositoryLock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
