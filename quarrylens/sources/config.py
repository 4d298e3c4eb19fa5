"""Driver-side settings and guards: per-key merge of configurations, path policies, coercion of arguments, retry plans."""

from __future__ import annotations

import os
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "max_file_size": 1_048_576, "index_staleness_ms": 5_000, "detail_files": 5, "tail_files": 12, "symbols_per_file": 20, "literals_per_file": 10, "callers_per_symbol": 5, "callees_per_symbol": 5,
    "output_bytes": 32_768, "annotation_bytes": 8_192, "grep_head_limit": 250, "grep_max_columns": 500, "find_limit": 100, "watch_debounce_ms": 500, "excluded_directories": [],
}


def merged_config(repo: dict, global_: dict, defaults: dict[str, Any] = DEFAULTS) -> dict[str, Any]:
    """Per key the repository's value, else the global one, else the default; a value of another type than the default's
    falls through, negative numbers too."""

    def good(k: str, v: Any) -> bool:
        want = defaults[k]
        if isinstance(want, bool) or isinstance(v, bool):
            return isinstance(v, bool) and isinstance(want, bool)
        return isinstance(v, type(want)) and not (isinstance(v, int) and v < 0) and not (isinstance(v, list) and not all(isinstance(x, str) for x in v))

    return {k: next((c[k] for c in (repo, global_) if k in c and good(k, c[k])), d) for k, d in defaults.items()}


def allowed_path(path: str, root: str, policy: str = "workspace", allowed_roots: tuple[str, ...] = ()) -> str:
    """The real path where the policy lets it be read; else PermissionError. Device, pipe and share paths are refused."""
    if path.startswith(("\\\\", "//")) or re.match(r"^/(?:dev|proc|sys)(?:/|$)", path):
        raise PermissionError(path)
    real = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
    if policy == "anywhere":
        return real
    roots = [os.path.realpath(root), *([os.path.realpath(r) for r in allowed_roots] if policy == "allowed_roots" else [])]
    if not any(real == r or Path(r) in Path(real).parents for r in roots):
        raise PermissionError(path)
    return real


ALIASES = {"file": "path", "filepath": "path", "file_path": "path", "query": "pattern", "regex": "pattern", "max": "limit", "count": "limit", "n": "limit", "start": "offset", "from": "offset"}


def coerced(args: dict[str, Any], kinds: dict[str, type]) -> dict[str, Any]:
    """Arguments with normalised names and values of the wanted kinds: numeric texts become numbers, "true" a boolean."""
    out: dict[str, Any] = {}
    for k, v in args.items():
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", k).replace("-", "_").lower()
        name = name if name in kinds else ALIASES.get(name.replace("_", ""), ALIASES.get(name, name))
        want = kinds.get(name)
        if want is int and isinstance(v, str) and re.fullmatch(r"\s*-?\d+\s*", v):
            v = int(v)
        elif want is int and isinstance(v, float) and v.is_integer():
            v = int(v)
        elif want is bool and isinstance(v, str) and v.strip().lower() in ("true", "false", "1", "0", "yes", "no"):
            v = v.strip().lower() in ("true", "1", "yes")
        elif want is list and isinstance(v, str):
            v = [v]
        if want is not None and v is not None and not isinstance(v, want):
            raise ValueError(f"{name} must be {want.__name__}")
        out[name] = v
    return out


def with_retries(work: Callable[[], Any], attempts: int = 3, waits: tuple[float, ...] = (5.0, 15.0), sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of ``work``, tried again after failures; the last failure is raised."""
    for i in range(attempts):
        try:
            return work()
        except Exception:
            if i + 1 == attempts:
                raise
            sleep(waits[min(i, len(waits) - 1)])
    return None


class Throttle:
    """True once per interval."""

    def __init__(self, interval_ms: int, now: Callable[[], float] = time.monotonic) -> None:
        self.interval, self.now, self.last = interval_ms / 1000, now, None

    def due(self) -> bool:
        t = self.now()
        if self.last is None or t - self.last >= self.interval:
            self.last = t
            return True
        return False


class TtlStore:
    """Values that expire when idle, the least recently used leaving first beyond the capacity."""

    def __init__(self, ttl_s: float, capacity: int, now: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.capacity, self.now, self.items = ttl_s, capacity, now, OrderedDict()

    def _expire(self) -> None:
        for k in [k for k, (t, _) in self.items.items() if self.now() - t >= self.ttl]:
            del self.items[k]

    def get(self, key: str) -> Any:
        self._expire()
        if key not in self.items:
            return None
        self.items[key] = (self.now(), self.items[key][1])
        self.items.move_to_end(key)
        return self.items[key][1]

    def put(self, key: str, value: Any) -> None:
        self._expire()
        self.items[key] = (self.now(), value)
        self.items.move_to_end(key)
        while len(self.items) > self.capacity:
            self.items.popitem(last=False)


class ClaimBoard:
    """Slots claimed by workers: at most ``active`` at once, never two of one pair, none before its predecessor is sealed,
    none beyond its attempts."""

    def __init__(self, active: int = 3, max_attempts: int = 3) -> None:
        self.active, self.max_attempts = active, max_attempts
        self.claimed: dict[str, str] = {}
        self.sealed: set[str] = set()
        self.attempts: dict[str, int] = {}

    def claim(self, slot: str, pair: str, predecessor: str | None = None) -> bool:
        if len(self.claimed) >= self.active or pair in self.claimed.values() or slot in self.sealed:
            return False
        if predecessor is not None and predecessor not in self.sealed or self.attempts.get(slot, 0) >= self.max_attempts:
            return False
        self.claimed[slot] = pair
        self.attempts[slot] = self.attempts.get(slot, 0) + 1
        return True

    def finish(self, slot: str, ok: bool) -> None:
        self.claimed.pop(slot, None)
        if ok:
            self.sealed.add(slot)


class ReloadingConfig:
    """A merged configuration that follows its files: read again when a file's time or size changes, at most once per interval."""

    def __init__(self, repo_file: str, global_file: str, debounce_ms: int = 500, now: Callable[[], float] = time.monotonic) -> None:
        self.files, self.throttle = (repo_file, global_file), Throttle(debounce_ms, now)
        self.seen: tuple | None = None
        self.value: dict[str, Any] = dict(DEFAULTS)

    def get(self) -> dict[str, Any]:
        if self.throttle.due():
            stamp = tuple((os.stat(f).st_mtime_ns, os.stat(f).st_size) if os.path.exists(f) else None for f in self.files)
            if stamp != self.seen:
                self.seen = stamp
                self.value = merged_config(*(self._load(f) for f in self.files))
        return self.value

    @staticmethod
    def _load(path: str) -> dict:
        import json

        try:
            with open(path, encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, ValueError):
            return {}
        return got if isinstance(got, dict) else {}


class LatestOnly:
    """A queue of one: a trigger that finds it full is dropped, a sender that must not lose its item waits for the slot."""

    def __init__(self) -> None:
        import queue

        self.slot: queue.Queue = queue.Queue(maxsize=1)

    def trigger(self, item: Any) -> bool:
        import queue

        try:
            self.slot.put_nowait(item)
            return True
        except queue.Full:
            return False

    def send(self, item: Any, timeout: float | None = None) -> None:
        self.slot.put(item, timeout=timeout)

    def take(self, timeout: float | None = None) -> Any:
        return self.slot.get(timeout=timeout)
