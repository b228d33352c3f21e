"""Times between arriving queries."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Arrivals:
    """``poisson``, ``jitter`` (a fixed interval with noise), ``target`` (a rate with relative variation) or ``ramp``."""

    kind: str
    rate: float = 1.0
    end_rate: float | None = None
    jitter: float = 0.0
    base: str = "poisson"
    seed: int = 0
    rng: random.Random = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if self.kind not in ("poisson", "jitter", "target", "ramp"):
            raise ValueError(f"unknown arrivals {self.kind}")
        if self.rate <= 0:
            raise ValueError("the rate has to be positive")
        self.rng = random.Random(self.seed)

    def delay(self, progress: float = 0.0) -> float:
        """Seconds to the next query; ``progress`` in [0, 1] is the part of the phase that is over."""
        rate = self.rate
        if self.kind == "ramp":
            rate += (self.end_rate - self.rate if self.end_rate is not None else 0.0) * min(1.0, max(0.0, progress))
        kind = self.base if self.kind == "ramp" else self.kind
        if kind == "poisson":
            return self.rng.expovariate(rate)
        if kind == "jitter":
            return max(0.0, 1 / rate + self.rng.uniform(-self.jitter, self.jitter))
        return 1 / rate * self.rng.uniform(1 - self.jitter, 1 + self.jitter)
