"""The order of pushes and pulls, skip rules, user switches and observers, over an explicit catalog of entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from ..errors import ReplicaError, UserSwitchError

PUSH_THEN_PULL, PULL_THEN_PUSH, PUSH_ONLY, PULL_ONLY = "pushThenPull", "pullThenPush", "pushOnly", "pullOnly"
PHASES = {PUSH_THEN_PULL: ("push", "pull"), PULL_THEN_PUSH: ("pull", "push"), PUSH_ONLY: ("push",), PULL_ONLY: ("pull",)}
SWITCHES = ("syncThenSwitch", "clearAndFetch", "promptIfUnsyncedData", "keepLocal")


@dataclass(frozen=True)
class Config:
    auto_sync_minutes: int = 15
    auto_start: bool = False
    sync_timeout_s: int = 120
    direction: str = PUSH_THEN_PULL
    user_switch: str = "syncThenSwitch"
    schema_version: int = 0
    max_retries: int = 3
    buffer_ms: int = 50
    dedup_ttl_s: float = 5.0
    parallel: bool = False
    batch: int = 10
    fail_fast: bool = True


@dataclass(frozen=True)
class Result:
    user_id: str
    synced: int = 0
    failed: int = 0
    conflicts: int = 0
    pushed_bytes: int = 0
    pulled_bytes: int = 0
    skipped: str | None = None

    @property
    def ok(self) -> bool:
        return self.skipped is None and self.failed == 0


def in_batches(work: Sequence[Any], run: Callable[[Any], Any], batch: int = 1, fail_fast: bool = True) -> tuple[list, list[tuple[Any, Exception]]]:
    """Runs run over work, batch items at once (1: one after another), and returns what came back and what failed.

    With fail_fast nothing starts after the batch in which one failed, and its error is raised."""
    done, failed = [], []
    for at in range(0, len(work), max(1, batch)):
        part = work[at : at + max(1, batch)]
        with ThreadPoolExecutor(len(part)) as pool:
            futures = [(x, pool.submit(run, x)) for x in part]
        for x, f in futures:
            if f.exception() is None:
                done.append(f.result())
            else:
                failed.append((x, f.exception()))
        if failed and fail_fast:
            raise failed[0][1]
    return done, failed


@dataclass
class Handler:
    """What an entity does for a user: push and pull return Results; pending counts queued operations."""

    push: Callable[[str], Result]
    pull: Callable[[str], Result]
    pending: Callable[[str], int] = lambda user: 0
    clear: Callable[[str], None] = lambda user: None


@dataclass
class Catalog:
    config: Config = field(default_factory=Config)
    handlers: dict[str, Handler] = field(default_factory=dict)
    observers: list[Callable[[str, Any], None]] = field(default_factory=list)
    status: dict[str, str] = field(default_factory=dict)
    online: Callable[[], bool] = lambda: True

    def register(self, name: str, handler: Handler) -> None:
        if name in self.handlers:
            raise ReplicaError(f"{name} is registered")
        self.handlers[name] = handler

    def _tell(self, event: str, what: Any) -> None:
        for observer in self.observers:
            observer(event, what)

    def pause(self, user: str) -> None:
        if self.status.get(user) != "paused":
            self.status[f"{user}/before"] = self.status.get(user, "idle")
            self.status[user] = "paused"

    def resume(self, user: str) -> None:
        if self.status.get(user) == "paused":
            self.status[user] = self.status.pop(f"{user}/before", "idle")

    def synchronize(self, user: str, direction: str | None = None) -> Result:
        """Phase by phase over all entities, so that every push comes before every pull (or after)."""
        direction = direction or self.config.direction
        now = self.status.get(user, "idle")
        skip = "already syncing" if now == "syncing" else "paused" if now == "paused" else None if self.online() else "offline"
        if skip is None and direction == PUSH_ONLY and not any(h.pending(user) for h in self.handlers.values()):
            skip = "nothing to push"
        if skip:
            return Result(user, skipped=skip)
        self.status[user] = "syncing"
        self._tell("started", user)
        found: list[tuple[str, Result]] = []
        try:
            for phase in PHASES[direction]:
                batch = self.config.batch if self.config.parallel else 1
                done, broken = in_batches(list(self.handlers.values()), lambda h: getattr(h, phase)(user), batch, self.config.fail_fast)  # noqa: B023
                found += [(phase, r) for r in done] + [(phase, Result(user, failed=1)) for _ in broken]
                for _, error in broken:
                    self._tell("error", error)
        except Exception as error:
            self.status[user] = "failed"
            self._tell("error", error)
            raise
        self.status[user] = "completed" if all(r.failed == 0 for _, r in found) else "failed"
        of = lambda name, phases=("push", "pull"): sum(getattr(r, name) for p, r in found if p in phases)
        # where pushes come first, failures of the pull phase are not added
        failed = of("failed", ("push",)) if direction == PUSH_THEN_PULL else of("failed")
        total = Result(user, of("synced"), failed, of("conflicts"), of("pushed_bytes"), of("pulled_bytes"))
        self._tell("completed", total)
        return total

    def switch_user(self, old: str | None, new: str, strategy: str | None = None) -> None:
        if not new:
            raise ValueError("the new user needs an id")
        strategy = strategy or self.config.user_switch
        waiting = bool(old) and any(h.pending(old) for h in self.handlers.values())
        if strategy == "promptIfUnsyncedData" and waiting:
            raise UserSwitchError(f"{old} has operations that are not pushed")
        if strategy == "syncThenSwitch" and waiting:
            self.synchronize(old)
        if strategy == "clearAndFetch":
            for h in self.handlers.values():
                h.clear(new)
            self.synchronize(new, PULL_ONLY)
        self._tell("userSwitched", (old, new))
