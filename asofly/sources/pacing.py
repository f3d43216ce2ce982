"""Pacing of requests to a rate-limited service as a state that steps (S5): no clock and no network in it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace


class RequestFailed(Exception):
    """A request that is not to be repeated, or was repeated too often."""


@dataclass(frozen=True)
class Answer:
    """A response; status 0 is a connection that failed before there was one."""

    status: int
    body: str = ""
    retry_after: str | None = None


@dataclass(frozen=True)
class Pace:
    """Least seconds between requests, and how often one is repeated.

    A refusal for going too fast (429) raises the interval to ``floor`` for good: it never falls again.
    """

    interval: float = 1.05
    floor: float = 2.0
    most_retries: int = 6
    longest: float = 60.0

    def wait(self, since_last: float) -> float:
        """Seconds to let pass before the next request."""
        return max(0.0, self.interval - since_last)

    def step(self, answer: Answer, attempt: int) -> tuple[Pace, float | None]:
        """The pace behind an answer to attempt number ``attempt`` (from 1), and the seconds until it is repeated: None if it is done."""
        if answer.status == 200:
            return self, None
        if answer.status and answer.status != 429 and answer.status < 500:
            raise RequestFailed(f"status {answer.status}")
        slower = replace(self, interval=max(self.interval, self.floor)) if answer.status == 429 else self
        if attempt > self.most_retries:
            raise RequestFailed(f"status {answer.status} after {attempt} attempts")
        backed_off = min(2.0**attempt, self.longest)
        if answer.status and answer.retry_after is not None:
            try:
                return slower, float(answer.retry_after)
            except ValueError:
                return slower, 2.0**attempt
        return slower, backed_off


def fetch(get: Callable[[], Answer], pace: Pace, clock: Callable[[], float], sleep: Callable[[float], None], last: float = float("-inf")) -> tuple[str, Pace, float]:
    """The body of a request, the pace behind it, and when the last attempt went out."""
    attempt = 0
    while True:
        if (w := pace.wait(clock() - last)) > 0:
            sleep(w)
        last = clock()
        attempt += 1
        answer = get()
        pace, delay = pace.step(answer, attempt)
        if delay is None:
            return answer.body, pace, last
        sleep(delay)
