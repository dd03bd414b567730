"""Many calls to a scorer at a time within one task, answers in the order of the prompts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from heapq import heappop, heappush

Scorer = Callable[[str], str]


class InFlight:
    """Calls a scorer for a stream of prompts, up to ``limit`` calls at a time.

    Every thread opens a scorer of its own by ``factory``, so scorers need not be shared. A call that fails is put aside for
    ``backoff(attempt)`` seconds and asked again, up to ``max_attempts`` times; meanwhile its place is free for other
    prompts. The last failure becomes the answer. At most ``ahead`` prompts are read before the oldest of them is answered, so
    a slow one holds back the output but not the calls, and memory stays bounded. When the stream of answers is closed,
    calls that have not begun are cancelled.
    """

    def __init__(
        self,
        factory: Callable[[], Scorer],
        limit: int,
        *,
        max_attempts: int,
        backoff: Callable[[int], float],
        sleep: Callable[[float], None] = time.sleep,
        clock: Callable[[], float] = time.monotonic,
        ahead: int | None = None,
    ):
        if limit < 1 or max_attempts < 1:
            raise ValueError("limit and max_attempts must be at least 1")
        self.factory, self.limit, self.max_attempts = factory, limit, max_attempts
        self.backoff, self.sleep, self.clock = backoff, sleep, clock
        self.ahead = max(ahead or 32 * limit, limit)

    def answers(self, prompts: Iterable[str | None]) -> Iterator[str | None]:
        """One answer per prompt, in order; a null prompt is not asked and has none."""
        own = threading.local()

        def open_scorer() -> None:
            # A factory that fails should fail its calls, not break the pool.
            try:
                own.score = self.factory()
            except Exception as failure:
                own.failure = failure

        def call(prompt: str) -> str:
            if hasattr(own, "failure"):
                raise own.failure
            return own.score(prompt)

        source = enumerate(prompts)
        running: dict[Future, tuple[int, int, str]] = {}
        # Calls that failed: when to ask again, number of the prompt, attempts made, prompt.
        later: list[tuple[float, int, int, str]] = []
        done: dict[int, str | None] = {}
        emitted = read = 0
        more = True
        pool = ThreadPoolExecutor(self.limit, initializer=open_scorer)
        try:
            while True:
                while emitted in done:
                    yield done.pop(emitted)
                    emitted += 1
                if not more and not running and not later:
                    return
                self._start_due(pool, call, running, later)
                while more and len(running) < self.limit and read - emitted < self.ahead:
                    number, prompt = next(source, (None, None))
                    if number is None:
                        more = False
                        break
                    read += 1
                    if prompt is None:
                        done[number] = None
                    else:
                        running[pool.submit(call, prompt)] = (number, 0, prompt)
                if running:
                    pause = max(later[0][0] - self.clock(), 0) if later and len(running) < self.limit else None
                    self._gather(wait(running, pause, FIRST_COMPLETED).done, running, later, done)
                elif later and emitted not in done:
                    # Nothing else to do: wait for the first of them, whatever the clock says after.
                    self.sleep(max(later[0][0] - self.clock(), 0))
                    _, number, attempt, prompt = heappop(later)
                    running[pool.submit(call, prompt)] = (number, attempt, prompt)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _start_due(self, pool: ThreadPoolExecutor, call: Scorer, running: dict, later: list) -> None:
        now = self.clock()
        while later and later[0][0] <= now and len(running) < self.limit:
            _, number, attempt, prompt = heappop(later)
            running[pool.submit(call, prompt)] = (number, attempt, prompt)

    def _gather(self, finished: Iterable[Future], running: dict, later: list, done: dict) -> None:
        for future in finished:
            number, attempt, prompt = running.pop(future)
            try:
                done[number] = future.result()
            except Exception as failure:
                if attempt + 1 == self.max_attempts:
                    done[number] = f"ERROR: {failure}"
                else:
                    heappush(later, (self.clock() + self.backoff(attempt), number, attempt + 1, prompt))
