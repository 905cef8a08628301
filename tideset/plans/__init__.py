"""How jobs are put together: checkpoints, size-checked broadcasts, distributed numbering and running aggregates."""

from .progress import Progress, observed
from .running import numbered, running
from .steps import BROADCAST, Kept, cut, shared_path, small

__all__ = ["BROADCAST", "Kept", "Progress", "cut", "numbered", "observed", "running", "shared_path", "small"]
