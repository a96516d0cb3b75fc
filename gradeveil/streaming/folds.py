"""State machines over a key's events, as pure Python folds: each takes a state and an event and returns both the
new state and the decision. The batch and the streaming form run the same folds.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass
class Limiter:
    """A sliding-window log: denied events are not recorded. distinct: events of one time count once."""

    limit: int = 120
    window: float = 60.0
    distinct: bool = False
    log: list[float] = field(default_factory=list)

    def step(self, now: float, event_type: str, value: float) -> dict:
        self.log = [t for t in self.log if t > now - self.window]
        if len(self.log) >= self.limit:
            return {"decision": "denied", "amount": float(max(1, int(self.log[0] + self.window - now + 0.999)))}
        if not (self.distinct and now in self.log):
            self.log.append(now)
        return {"decision": "allowed", "amount": 0.0}


@dataclass
class Breaker:
    """Opens after `threshold` failures in a row, lets one probe through after open_seconds. Event types in `failures`
    are failures; any other answer counts as success."""

    threshold: int = 3
    open_seconds: float = 30.0
    failures: tuple[str, ...] = ("error",)
    state: str = "closed"
    failed: int = 0
    until: float = 0.0

    def step(self, now: float, event_type: str, value: float) -> dict:
        if self.state == "open" and now < self.until:
            return {"decision": "open", "amount": self.until - now}
        probing = self.state == "open"
        if event_type in self.failures:
            self.failed += 1
            if probing or self.failed >= self.threshold:
                self.state, self.until = "open", now + self.open_seconds
        else:
            self.failed, self.state = 0, "closed"
        return {"decision": "probe" if probing else "called", "amount": float(self.failed)}


@dataclass
class RateGate:
    """Reserves moments at least `gap` apart and tells how long each event has to wait."""

    gap: float = 0.55
    next: float = 0.0

    def step(self, now: float, event_type: str, value: float) -> dict:
        start = max(now, self.next)
        self.next = start + self.gap
        return {"decision": "reserved", "amount": start - now}


@dataclass
class Clients:
    """Sliding-window logs of many clients (the events' values) in one bounded table: a new client that finds it full
    takes the place of the one whose last event is the oldest."""

    limit: int = 120
    window: float = 60.0
    max_clients: int = 10_000
    logs: dict[str, list[float]] = field(default_factory=dict)

    def step(self, now: float, event_type: str, value: float) -> dict:
        client = str(value)
        if client not in self.logs and len(self.logs) >= self.max_clients:
            del self.logs[min(self.logs, key=lambda c: self.logs[c][-1] if self.logs[c] else now)]
        log = [t for t in self.logs.get(client, []) if t > now - self.window]
        self.logs[client] = log
        if len(log) >= self.limit:
            return {"decision": "denied", "amount": float(max(1, int(log[0] + self.window - now + 0.999)))}
        log.append(now)
        return {"decision": "allowed", "amount": 0.0}


@dataclass
class JobTable:
    """Jobs with a time to live and a cap. An event submits a job or, with an event type in `completions` or `failures`,
    ends the oldest running one. As many jobs run as there is concurrency, others wait and are promoted when one ends. A
    full table drops jobs that have ended, oldest first; without any it refuses."""

    ttl: float = 300.0
    cap: int = 16
    concurrency: int = 2
    completions: tuple[str, ...] = ("purchase",)
    failures: tuple[str, ...] = ("error",)
    jobs: list[list] = field(default_factory=list)  # updated_at, state: queued, running, succeeded or failed

    def step(self, now: float, event_type: str, value: float) -> dict:
        self.jobs = [j for j in self.jobs if now - j[0] < self.ttl]
        self._promote()
        if event_type in self.completions or event_type in self.failures:
            running = next((j for j in self.jobs if j[1] == "running"), None)
            if running is None:
                return {"decision": "not_found", "amount": float(len(self.jobs))}
            running[:] = [now, "succeeded" if event_type in self.completions else "failed"]
            self._promote()
            return {"decision": running[1], "amount": float(len(self.jobs))}
        while len(self.jobs) >= self.cap:
            ended = [j for j in self.jobs if j[1] in ("succeeded", "failed")]
            if not ended:
                return {"decision": "queue_full", "amount": float(len(self.jobs))}
            oldest = min(ended, key=lambda j: j[0])
            self.jobs = [j for j in self.jobs if j is not oldest]
        self.jobs.append([now, "queued"])
        self._promote()
        return {"decision": self.jobs[-1][1], "amount": float(len(self.jobs))}

    def _promote(self) -> None:
        """Lets waiting jobs run, in the order in which they came."""
        free = self.concurrency - sum(j[1] == "running" for j in self.jobs)
        for j in self.jobs:
            if free > 0 and j[1] == "queued":
                j[1], free = "running", free - 1


@dataclass
class ActionKeys:
    """Refuses an action whose key is taken; a failure frees the key. Keys are forgotten `ttl` seconds after they were
    taken (0: never), so that the table is bounded by the rate of actions."""

    failures: tuple[str, ...] = ("error",)
    ttl: float = 0.0
    taken: dict[str, float] = field(default_factory=dict)  # key, when it was taken; in that order

    def step(self, now: float, event_type: str, value: float) -> dict:
        while self.ttl and self.taken and next(iter(self.taken.values())) <= now - self.ttl:
            del self.taken[next(iter(self.taken))]
        key = str(value)
        if event_type in self.failures:
            self.taken.pop(key, None)
            return {"decision": "released", "amount": float(len(self.taken))}
        if key in self.taken:
            return {"decision": "duplicate", "amount": float(len(self.taken))}
        self.taken[key] = now
        return {"decision": "accepted", "amount": float(len(self.taken))}


@dataclass
class AgentLoop:
    """observe, reason, verify, dispatch, settle in this order, with budgets of steps, drifts and seconds."""

    max_steps: int = 30
    max_drifts: int = 3
    seconds: float = 300.0
    at: int = 0
    steps: int = 0
    drifts: int = 0
    began: float = -1.0

    def step(self, now: float, event_type: str, value: float) -> dict:
        nodes = ("observe", "reason", "verify", "dispatch", "settle")
        if self.began < 0:
            self.began = now
        if now - self.began > self.seconds:
            return {"decision": "timed_out", "amount": float(self.steps)}
        if event_type == "drift":
            self.drifts, self.at = self.drifts + 1, 0
            return {"decision": "too_many_drifts" if self.drifts > self.max_drifts else "observe", "amount": float(self.drifts)}
        if self.steps >= self.max_steps:
            return {"decision": "out_of_steps", "amount": float(self.steps)}
        node = nodes[self.at]
        self.at = (self.at + 1) % len(nodes)
        self.steps += node == "settle"
        return {"decision": node, "amount": float(self.steps)}


FOLDS = {"limiter": Limiter, "breaker": Breaker, "gate": RateGate, "jobs": JobTable, "actions": ActionKeys, "agent": AgentLoop, "clients": Clients}


def new(name: str, parameters: dict):
    return FOLDS[name](**parameters)


def frozen(fold) -> dict:
    return asdict(fold)
