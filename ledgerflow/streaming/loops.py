"""Background work of followers: loops that wait between tries, and a hub that tells of new bundles."""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Iterable

from ledgerflow.plans.lifecycle import SyncError
from ledgerflow.streaming.watch import backoff

#: Waits of a follower's loops and between watches, in seconds.
LEAST, MOST, FALLBACK = 1.0, 60.0, 30.0


def next_wait(error: Exception | None, current: float, least: float = LEAST, most: float = MOST) -> float:
    """The wait after a try: the least after a success or where the follower's state forbids the work, else twice the last."""
    if error is None or isinstance(error, SyncError) and error.status == 409:
        return least
    return min(most, max(least, 2 * current))


class Loop:
    """Repeats `step` until stopped. A step that returns true did something and is followed at once by the next."""

    def __init__(self, step: Callable[[], bool], paused: threading.Event, least: float = LEAST, most: float = MOST):
        self.step, self.paused, self.least, self.most = step, paused, least, most
        self.pause, self.error, self.turns = least, None, 0

    def turn(self) -> float:
        """One try; the seconds to wait before the next. Errors are kept in `error`, not raised."""
        if self.paused.is_set():
            return self.pause
        self.turns += 1
        try:
            busy = self.step()
            self.error, self.pause = None, self.least
            return 0.0 if busy else self.least
        except Exception as e:
            self.error, before = e, self.pause
            self.pause = next_wait(e, before, self.least, self.most)
            return min(before, self.pause)

    def run(self, stop: threading.Event) -> None:
        while not stop.is_set():
            stop.wait(self.turn())


class Subscription:
    """What one subscriber of a scope has not been told: the newest bundle number only, so it never grows."""

    def __init__(self, hub: Hub, scope: str, after: int):
        self.hub, self.scope = hub, scope
        self._told = self._newest = after
        self._changed, self._closed = threading.Condition(), False

    def offer(self, bundle_seq: int) -> None:
        with self._changed:
            if bundle_seq > self._newest:
                self._newest = bundle_seq
                self._changed.notify_all()

    def wait(self, seconds: float | None = None) -> int | None:
        """The newest number, once it is above all told before; None if there is none in time or the subscription ends."""
        with self._changed:
            self._changed.wait_for(lambda: self._newest > self._told or self._closed, seconds)
            if self._newest == self._told:
                return None
            self._told = self._newest
            return self._newest

    def close(self) -> None:
        self.hub.leave(self)
        with self._changed:
            self._closed = True
            self._changed.notify_all()


class Hub:
    """Passes bundle numbers on to the subscribers of their scope."""

    def __init__(self):
        self._lock, self._members = threading.Lock(), defaultdict(set)

    def join(self, scope: str, after: int = 0) -> Subscription:
        one = Subscription(self, scope, after)
        with self._lock:
            self._members[scope].add(one)
        return one

    def leave(self, one: Subscription) -> None:
        with self._lock:
            self._members[one.scope].discard(one)
            if not self._members[one.scope]:
                del self._members[one.scope]

    def scopes(self) -> list[str]:
        """Scopes that somebody listens to."""
        with self._lock:
            return sorted(self._members)

    def publish(self, scope: str, bundle_seq: int) -> None:
        with self._lock:
            members = list(self._members.get(scope, ()))
        for one in members:
            one.offer(bundle_seq)


def listen(connect: Callable[[], Iterable[tuple[str, int]]], hub: Hub, newest: Callable[[str], int], stop: threading.Event, waits: Callable[[], Iterable[float]] = backoff) -> int:
    """Feed a hub from a stream of (scope, bundle_seq) that may break off; returns how often it was connected.

    After each connection the scopes that somebody listens to are brought up to
    date, as notices may have been missed. Broken connections are tried again
    after 0.1 seconds, then twice as long each time up to 2, until one delivers.
    """
    connections, pauses = 0, iter(waits())
    while not stop.is_set():
        try:
            stream = connect()
            connections += 1
            for scope in hub.scopes():
                hub.publish(scope, newest(scope))
            for scope, bundle_seq in stream:
                hub.publish(scope, bundle_seq)
                pauses = iter(waits())
                if stop.is_set():
                    return connections
        except (OSError, SyncError):
            pass
        stop.wait(next(pauses))
    return connections
