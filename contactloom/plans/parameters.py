"""Parameters of a feature run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RunParameters:
    window_size: int = 25_000
    mindist: int = 50_001
    maxdist: int = 1_500_000
    sample_size: int | None = None  # all contacts
    n_closest: int = 4
    n_closest_genes: int = 3
    binsize: int = 5_000
    smoothing: int = 2

    def tag(self) -> str:
        """Short name of this setting, for output paths."""
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]
