"""Chunking settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

#: Named settings: min, max, target, threshold, overlap (fixed values).
_PRESETS = {
    "default": {},
    "small_chunks": {"min_chunk_size": 100, "max_chunk_size": 500, "target_chunk_size": 300, "semantic_threshold": 0.8},
    "large_chunks": {"min_chunk_size": 500, "max_chunk_size": 2000, "target_chunk_size": 1200, "semantic_threshold": 0.6},
    "high_precision": {"min_chunk_size": 200, "max_chunk_size": 800, "target_chunk_size": 500, "semantic_threshold": 0.85, "overlap_ratio": 0.2},
    "fast_processing": {"min_chunk_size": 300, "max_chunk_size": 1200, "target_chunk_size": 800, "semantic_threshold": 0.6, "overlap_ratio": 0.05},
}
#: Limits of settings that arrive as JSON.
_BOUNDS = {
    "min_chunk_size": (50, 1000), "max_chunk_size": (500, 5000), "target_chunk_size": (200, 2000),
    "overlap_ratio": (0.0, 0.5), "semantic_threshold": (0.0, 1.0), "paragraph_merge_threshold": (0.0, 1.0),
}


@dataclass(frozen=True)
class ChunkConfig:
    min_chunk_size: int = 500
    max_chunk_size: int = 3000
    target_chunk_size: int = 1800
    overlap_ratio: float = 0.1
    semantic_threshold: float = 0.6
    paragraph_merge_threshold: float = 0.8
    language: str = "zh"
    preserve_structure: bool = True
    handle_special_content: bool = True

    @classmethod
    def preset(cls, name: str) -> ChunkConfig:
        if name not in _PRESETS:
            raise ValueError(f"unknown preset {name!r}; there are {', '.join(_PRESETS)}")
        return cls(**_PRESETS[name])

    @classmethod
    def factory(cls, min_size: int = 200, max_size: int = 1500, target_size: int = 800, semantic_threshold: float = 0.7, language: str = "zh") -> ChunkConfig:
        return cls(min_size, max_size, target_size, semantic_threshold=semantic_threshold, language=language)

    @classmethod
    def from_json(cls, payload: str | None, strict: bool = False) -> ChunkConfig:
        """Settings from a JSON object within bounds; what can't be read gives the defaults, or raises if ``strict``."""
        try:
            given = json.loads(payload) if payload else {}
            known = {f.name: type(f.default) for f in fields(cls)}
            if unknown := set(given) - set(known):
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            out = cls(**{k: known[k](v) for k, v in given.items()})
            for k, (low, high) in _BOUNDS.items():
                if k in given and not low <= getattr(out, k) <= high:
                    raise ValueError(f"{k} must be from {low} to {high}")
            if out.language not in ("zh", "en"):
                raise ValueError("language must be zh or en")
            return out
        except (ValueError, TypeError, AttributeError):
            if strict:
                raise
            return cls()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def with_(self, **changes) -> ChunkConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class CoherenceConfig:
    """How a new element's fit to the elements of a chunk is weighed."""

    position_weight_enabled: bool = True
    position_decay_factor: float = 0.5
    trend_analysis_enabled: bool = True
    trend_penalty_factor: float = 0.1
    similarity_window_size: int = 3

    def with_(self, **changes) -> CoherenceConfig:
        """Known keys replaced; unknown ones are reported."""
        known = {f.name for f in fields(self)}
        if odd := set(changes) - known:
            import warnings

            warnings.warn(f"unknown coherence settings left out: {sorted(odd)}", stacklevel=2)
        return replace(self, **{k: v for k, v in changes.items() if k in known})
