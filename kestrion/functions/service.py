"""A local model server: started detached, known by a pid file, with a log."""

from __future__ import annotations

import os
import re
import signal
import subprocess
import time
from collections import deque

from kestrion.functions.models import reachable

TAIL, WAIT_S, STEP_S = 200, 20.0, 0.25
#: The variables that a server sees of our environment; keys and tokens are not among them.
PASSED_ON = ("PATH", "HOME", "LANG", "LC_ALL", "TMPDIR", "HF_HOME", "XDG_CACHE_HOME")


class ServiceError(RuntimeError):
    """A command, pid file or server that doesn't work."""


def split_command(command: str) -> list[str]:
    """Words by white space; double quotes keep words together, and may be empty."""
    if command.count('"') % 2:
        raise ServiceError("unbalanced quotes in the command")
    words = [w.replace('"', "") for w in re.findall(r'(?:[^\s"]|"[^"]*")+', command)]
    if not words:
        raise ServiceError("empty command")
    return words


class Service:
    def __init__(self, home: str, command: str, url: str):
        self.pid_file, self.log, self.command, self.url = os.path.join(home, "server.pid"), os.path.join(home, "server.log"), command, url

    def pid(self) -> int | None:
        """The recorded process, if there is a record."""
        try:
            with open(self.pid_file, encoding="utf-8") as f:
                return int(f.read())
        except FileNotFoundError:
            return None
        except ValueError as error:
            raise ServiceError(f"{self.pid_file} holds no process number") from error

    def alive(self) -> bool:
        pid = self.pid()
        try:
            return pid is not None and (os.kill(pid, 0) is None)
        except ProcessLookupError:
            return False

    def status(self) -> str:
        return "ready" if reachable(self.url) else "starting" if self.alive() else "stopped"

    def start(self, wait: float = WAIT_S) -> str:
        if self.alive() or reachable(self.url):
            return self.status()
        os.makedirs(os.path.dirname(self.pid_file), mode=0o700, exist_ok=True)
        with open(self.log, "a", encoding="utf-8") as log:
            child = subprocess.Popen(split_command(self.command), env={k: os.environ[k] for k in PASSED_ON if k in os.environ}, stdin=subprocess.DEVNULL, stdout=log, stderr=log, start_new_session=True)
        with open(self.pid_file, "w", encoding="utf-8") as f:
            f.write(str(child.pid))
        end = time.monotonic() + wait
        while time.monotonic() < end and child.poll() is None and not reachable(self.url):
            time.sleep(STEP_S)
        return self.status() if child.poll() is None else "stopped"

    def stop(self) -> bool:
        """Whether something was stopped."""
        running = self.alive()
        if running:
            os.kill(self.pid(), signal.SIGTERM)
        if os.path.exists(self.pid_file):
            os.remove(self.pid_file)
        return running

    def logs(self, lines: int = TAIL) -> list[str]:
        """The log's last lines."""
        try:
            with open(self.log, encoding="utf-8", errors="replace") as f:
                return [x.rstrip("\n") for x in deque(f, lines)]
        except FileNotFoundError:
            return []
