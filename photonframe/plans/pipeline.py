"""Plan builder for job rows: which stages a job's options ask for, in their fixed order.

A stage that would change nothing is not built. Stages are DataFrame to DataFrame functions;
Catalyst sees one plan from the source to the sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame

from photonframe.operators import lighting, repair, resample, stencil
from photonframe.operators.lighting import Adjustments, Look

Stage = Callable[[DataFrame], DataFrame]

# HDR enhancement profiles (shadows, highlights, local, detail, colour, vibrance) and their default share.
HDR_PROFILES = {
    "natural": ((0.6, 0.5, 0.35, 0.0, 0.5, 0.04), 60),
    "balanced": ((0.9, 0.8, 0.6, 0.1, 0.55, 0.08), 65),
    "dramatic": ((1.2, 1.1, 1.1, 0.2, 0.6, 0.12), 70),
}
# Sharpening at full strength, its radius, and how many deviations of the noise it leaves alone.
SHARPENING = (1.4, 0.9, 1.5)
# Finishes (adjustments, clarity).
FINISHES = {
    "natural": (Adjustments(contrast=6, highlights=-10, shadows=12, saturation=4), 0.10),
    "clean": (Adjustments(exposure=4, brightness=3, contrast=8, highlights=-15, shadows=18, saturation=3), 0.14),
    "vivid": (Adjustments(contrast=14, highlights=-12, shadows=12, saturation=20), 0.18),
    "professional": (Adjustments(contrast=10, highlights=-20, shadows=16, saturation=6), 0.22),
}


@dataclass(frozen=True)
class Options:
    """What a job asks for; the defaults change nothing."""

    dust: int = 0
    scratches: int = 0
    noise: float = 0.0  # the grain that defects stand out from, a deviation in 0..1
    fading: int = 0
    auto_colour: bool = False
    denoise: int = 0
    sharpness: int = 0
    lighting: Adjustments = field(default_factory=Adjustments)
    look: Look = field(default_factory=Look)
    cube: int = 0  # levels of a baked look; 0 reckons it for each pixel
    scale: int = 1
    hdr: str = ""
    hdr_intensity: int = 100
    finish: str = ""

    def validate(self) -> None:
        if self.scale not in (1, 2, 3, 4):
            raise ValueError("scale must be 1 to 4")
        if self.hdr and self.hdr not in HDR_PROFILES:
            raise ValueError(f"unknown HDR profile {self.hdr}")
        if self.finish and self.finish not in FINISHES:
            raise ValueError(f"unknown finish {self.finish}")


#: Upscalers by name; a model's stand-in repeats pixels.
UPSCALERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"nearest": resample.nearest}


def register_upscaler(name: str, f: Callable[[DataFrame, int], DataFrame]) -> None:
    UPSCALERS[name] = f


def _unit(stage: Stage) -> Stage:
    """A stage on 0..1 channels as one on 8-bit channels."""
    from pyspark.sql import functions as F

    from photonframe.functions.pixel import quantise

    def run(px: DataFrame) -> DataFrame:
        out = stage(px.withColumns({c: F.col(c) / 255.0 for c in "rgb"}))
        return out.withColumns({c: quantise(F.col(c)) for c in "rgb"})

    return run


def build(options: Options, upscaler: str = "nearest", side: int = 64) -> list[tuple[str, Stage]]:
    """The stages in order: specks, scratches, denoising, tones, finish, lighting, look,
    upscaling, sharpening, HDR, and the look's own sharpening and grain."""
    options.validate()
    out: list[tuple[str, Stage]] = []
    for name, strength in (("specks", options.dust), ("scratches", options.scratches)):
        if strength:
            out.append((name, partial(repair.clean, kind=name, strength=strength, noise=options.noise)))
    if options.denoise:
        out.append(("denoise", _unit(lambda px: stencil.denoise(px, options.denoise, options.noise or 0.02))))
    if options.fading or options.auto_colour:
        out.append(("levels", lambda px: repair.restore_levels(px, options.fading, options.auto_colour)))
    if options.finish:
        adjustments, amount = FINISHES[options.finish]
        out.append(("finish", lambda px: _unit(lambda p: stencil.clarity(p, amount, max(4.0, side / 150)))(lighting.apply_lighting(px, adjustments))))
    if not options.lighting.neutral:
        out.append(("lighting", lambda px: lighting.apply_lighting(px, options.lighting)))
    if not options.look.grade_neutral:
        out.append(("look", lambda px: lighting.apply_look(px, options.look, side, options.cube)))
    if options.scale > 1:
        out.append(("upscale", lambda px: UPSCALERS[upscaler](px, options.scale)))
    if options.sharpness:
        amount, radius, floor = SHARPENING
        strength = amount * min(100, options.sharpness) / 100
        factor = min(4.0, max(1.0, side * options.scale / 2000))
        out.append(("sharpen", _unit(lambda px: stencil.noise_aware_sharpen(px, strength, radius * factor, floor * options.noise))))
    if options.hdr:
        recipe, _ = HDR_PROFILES[options.hdr]
        share = min(100, max(0, options.hdr_intensity)) / 100
        values = [v * share if i != 4 else v for i, v in enumerate(recipe)]
        out.append(("hdr", lambda px: stencil.hdr_tone(px, *values, max(1, round(0.04 * side * options.scale)), side * options.scale)))
    if not options.look.finish_neutral:
        out.append(("look finish", lambda px: lighting.finish_look(px, options.look, side * options.scale)))
    return out


#: Stages that deal pixels themselves, or look at each pixel alone.
APART = {"specks", "scratches", "levels", "lighting", "upscale"}


def run(px: DataFrame, options: Options, upscaler: str = "nearest", side: int = 64) -> DataFrame:
    """The stages one after the other. After the repair stages pixels are dealt by picture once,
    where a later stage has windows; what comes between keeps them there."""
    stages = build(options, upscaler, side)
    dealt = all(name in APART for name, _ in stages)
    for name, stage in stages:
        if not dealt and name not in ("specks", "scratches"):
            px, dealt = stencil.by_picture(px, options.scale**2), True
        px = stage(px)
    return px
