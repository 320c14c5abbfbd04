"""Lighting adjustments and the profiles made of them."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields


@dataclass(frozen=True)
class Adjustments:
    """Each -100..100; 0 changes nothing."""

    exposure: float = 0.0
    brightness: float = 0.0
    contrast: float = 0.0
    highlights: float = 0.0
    shadows: float = 0.0
    temperature: float = 0.0
    tint: float = 0.0
    saturation: float = 0.0

    @property
    def neutral(self) -> bool:
        return not any(astuple(self))

    def scaled(self, factor: float) -> Adjustments:
        return Adjustments(*(v * factor for v in astuple(self)))

    def clamped(self) -> Adjustments:
        return Adjustments(*(min(100.0, max(-100.0, float(v))) for v in astuple(self)))


NAMES = tuple(f.name for f in fields(Adjustments))

# The lighting profiles.
PROFILES: dict[str, Adjustments] = {
    "original": Adjustments(),
    "natural-daylight": Adjustments(exposure=5, contrast=10, highlights=-20, shadows=20, saturation=5),
    "bright-clean": Adjustments(exposure=20, brightness=15, contrast=5, highlights=-10, shadows=35, temperature=-3),
    "golden-hour": Adjustments(brightness=5, contrast=-5, highlights=-25, shadows=10, temperature=45, tint=8, saturation=10),
    "studio": Adjustments(exposure=10, brightness=10, contrast=15, highlights=-20, shadows=10, temperature=-2),
    "cinematic": Adjustments(exposure=-5, contrast=35, highlights=-30, shadows=-25, temperature=-8, tint=-4, saturation=-10),
    "low-light-recovery": Adjustments(exposure=30, brightness=25, contrast=-5, highlights=-35, shadows=60, saturation=10),
    "cool-daylight": Adjustments(contrast=15, highlights=-10, temperature=-35, tint=-5, saturation=5),
    "vivid": Adjustments(contrast=20, highlights=-10, shadows=5, saturation=45),
    "high-contrast": Adjustments(contrast=60, highlights=25, shadows=-35, saturation=5),
}


def register_profile(name: str, adjustments: Adjustments) -> None:
    PROFILES[name] = adjustments
