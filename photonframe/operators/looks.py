"""The catalogue of looks, and what a user picks from it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from photonframe.functions.pixel import BT709
from photonframe.operators.adjustments import Adjustments

Bands = tuple[tuple[str, tuple[float, float, float]], ...]


@dataclass(frozen=True)
class Look:
    """A recipe; bands: name to (hue in degrees, saturation, luminance); tints: (hue, amount)."""

    tone: Adjustments = field(default_factory=Adjustments)
    vibrance: float = 0.0
    bands: Bands = ()
    rolloff: float = 0.0
    fade: float = 0.0
    shadow_tint: tuple[float, float] = (0.0, 0.0)
    highlight_tint: tuple[float, float] = (0.0, 0.0)
    monochrome: float = 0.0
    mix: tuple[float, float, float] = BT709
    clarity: float = 0.0
    sharpen: float = 0.0
    grain: float = 0.0
    skin: float = 0.0

    def scaled(self, f: float) -> Look:
        """At a share of its strength; skin protection stays."""
        shares = {n: getattr(self, n) * f for n in ("vibrance", "rolloff", "fade", "monochrome", "clarity", "sharpen", "grain")}
        tints = {n: (getattr(self, n)[0], getattr(self, n)[1] * f) for n in ("shadow_tint", "highlight_tint")}
        return replace(self, tone=self.tone.scaled(f), bands=tuple((n, tuple(v * f for v in b)) for n, b in self.bands), **shares, **tints)  # type: ignore[misc, arg-type]

    @property
    def grade_neutral(self) -> bool:
        amounts = (self.vibrance, self.rolloff, self.fade, self.shadow_tint[1], self.highlight_tint[1], self.monochrome, self.clarity)
        return self.tone.neutral and not any(amounts) and not any(any(b) for _, b in self.bands)

    @property
    def finish_neutral(self) -> bool:
        return not (self.sharpen or self.grain)


def _look(tone: dict[str, float], bands: dict[str, tuple[float, float, float]] | None = None, **more: object) -> Look:
    return Look(tone=Adjustments(**tone), bands=tuple((bands or {}).items()), **more)  # type: ignore[arg-type]


_CLASSIC_MIX, _RED_FILTER_MIX = (0.30, 0.59, 0.11), (0.42, 0.48, 0.10)

# The looks, and the strengths of the grain choices.
LOOKS: dict[str, Look] = {
    "original": Look(),
    "sony-natural": _look(dict(contrast=8, highlights=-10, shadows=6, temperature=-4, saturation=-4), dict(green=(3, 0, 0), blue=(0, 6, -4)), vibrance=6, rolloff=15, clarity=14, sharpen=22, skin=35),
    "sony-vivid": _look(dict(contrast=22, highlights=-12, shadows=-4, temperature=-3, saturation=16), dict(red=(0, 8, -4), green=(2, 14, -4), aqua=(0, 10, -2), blue=(-3, 14, -8)), vibrance=12, rolloff=15, clarity=18, sharpen=28, skin=40),
    "sony-portrait": _look(dict(contrast=6, highlights=-16, shadows=8, temperature=-1, tint=4, saturation=-4), dict(red=(3, -8, 4), orange=(0, -6, 6), blue=(0, 6, -4)), rolloff=30, sharpen=16, skin=75),
    "sony-cinematic": _look(dict(contrast=10, highlights=-25, shadows=8, temperature=2, saturation=-10), dict(orange=(0, 4, 4), green=(-8, -15, 0), blue=(-6, -5, -6)), rolloff=45, fade=12, shadow_tint=(190, 15), highlight_tint=(35, 10), clarity=6, sharpen=10, skin=55),
    "canon-natural": _look(dict(contrast=4, highlights=-10, shadows=6, temperature=6, saturation=-2), dict(red=(2, 4, 0)), rolloff=25, sharpen=10, skin=45),
    "canon-standard": _look(dict(contrast=14, highlights=-8, shadows=2, temperature=8, saturation=10), dict(red=(-2, 12, -2), orange=(0, 4, 2), yellow=(-4, 6, 0), green=(-4, 8, 0), blue=(0, 8, -4)), vibrance=8, rolloff=25, clarity=8, sharpen=20, skin=45),
    "canon-portrait": _look(dict(contrast=2, highlights=-18, shadows=12, temperature=12, tint=4, saturation=-2), dict(red=(4, 0, 6), orange=(2, -4, 8)), rolloff=35, clarity=-14, sharpen=4, skin=80),
    "canon-landscape": _look(dict(contrast=18, highlights=-15, shadows=4, temperature=4, saturation=14), dict(green=(-6, 22, -2), aqua=(0, 10, -4), blue=(-4, 20, -8)), vibrance=16, rolloff=20, clarity=22, sharpen=28, skin=25),
    "nikon-neutral": _look(dict(contrast=-4, highlights=-12, shadows=10, saturation=-8), rolloff=20, sharpen=10, skin=35),
    "nikon-standard": _look(dict(contrast=12, highlights=-8, temperature=-1, saturation=8), dict(yellow=(-4, 4, 0), green=(4, 8, -2), blue=(0, 10, -4)), vibrance=6, rolloff=15, clarity=10, sharpen=22, skin=40),
    "nikon-portrait": _look(dict(highlights=-14, shadows=12, temperature=6, saturation=-2), dict(red=(2, -6, 4), orange=(0, -8, 6), green=(2, 6, 0), blue=(0, 4, -2)), rolloff=25, clarity=-12, sharpen=4, skin=80),
    "nikon-landscape": _look(dict(contrast=16, highlights=-14, shadows=4, temperature=-3, saturation=12), dict(green=(4, 18, -4), aqua=(0, 12, -4), blue=(0, 22, -10)), vibrance=14, rolloff=15, clarity=20, sharpen=28, skin=25),
    "fujifilm-classic": _look(dict(contrast=12, highlights=-18, shadows=-6, temperature=2, saturation=-18), dict(red=(-2, -6, -4), yellow=(-4, -14, 0), green=(-6, -14, -4), blue=(-6, -8, -10)), rolloff=35, fade=6, shadow_tint=(200, 10), highlight_tint=(40, 6), clarity=10, grain=25, skin=55),
    "fujifilm-provia": _look(dict(contrast=10, highlights=-12, shadows=2, saturation=6), dict(green=(-4, 8, 0), blue=(-2, 6, -4)), vibrance=8, rolloff=25, clarity=6, sharpen=12, skin=50),
    "fujifilm-velvia": _look(dict(contrast=22, highlights=-12, shadows=-10, temperature=2, tint=3, saturation=20), dict(red=(-2, 14, -4), green=(-8, 24, -6), blue=(-4, 20, -10), purple=(0, 10, 0), magenta=(0, 10, 0)), vibrance=18, rolloff=20, clarity=14, sharpen=18, skin=60),
    "fujifilm-astia": _look(dict(contrast=4, highlights=-16, shadows=10, temperature=3, saturation=4), dict(red=(2, -4, 4), orange=(0, -6, 6), green=(-4, 8, 0), blue=(0, 10, -2)), vibrance=4, rolloff=35, clarity=-4, sharpen=8, skin=75),
    "fujifilm-classic-negative": _look(dict(contrast=18, highlights=-22, shadows=-8, temperature=-2, saturation=-10), dict(red=(4, 4, -6), orange=(-2, 0, 0), yellow=(6, -10, 0), green=(10, -10, -6), blue=(-8, -4, -10)), rolloff=40, fade=8, shadow_tint=(190, 14), highlight_tint=(45, 8), clarity=8, grain=25, skin=50),
    "leica-natural": _look(dict(contrast=8, highlights=-14, shadows=4, temperature=2, saturation=-6), dict(red=(0, 4, -4), blue=(0, 0, -6)), rolloff=30, clarity=16, sharpen=12, skin=65),
    "leica-monochrome": _look(dict(contrast=14, highlights=-16, shadows=-4), rolloff=30, monochrome=100, mix=_RED_FILTER_MIX, clarity=22, sharpen=14, grain=20),
    "leica-filmic": _look(dict(contrast=10, highlights=-20, shadows=4, temperature=4, saturation=-12), dict(green=(-6, -10, 0)), rolloff=40, fade=10, shadow_tint=(210, 8), highlight_tint=(40, 8), clarity=12, grain=20, skin=55),
    "hasselblad-natural": _look(dict(contrast=4, highlights=-16, shadows=8, saturation=2), dict(red=(0, 2, 0), orange=(0, -2, 4)), vibrance=4, rolloff=35, clarity=6, sharpen=10, skin=70),
    "hasselblad-filmic": _look(dict(contrast=10, highlights=-22, shadows=6, temperature=3, saturation=-6), rolloff=45, fade=8, shadow_tint=(200, 10), highlight_tint=(35, 8), clarity=8, grain=20, skin=60),
    "kodak": _look(dict(contrast=16, highlights=-14, shadows=-4, temperature=10, tint=2, saturation=12), dict(red=(2, 12, -4), yellow=(-2, 14, 2), green=(-6, 4, -4), blue=(-6, 10, -10)), vibrance=6, rolloff=30, fade=4, highlight_tint=(45, 8), grain=35, skin=50),
    "portra": _look(dict(contrast=-2, highlights=-22, shadows=12, temperature=8, saturation=-6), dict(red=(4, -8, 4), orange=(2, -6, 8), green=(-6, -8, 4), blue=(-4, -10, 4)), rolloff=45, fade=8, shadow_tint=(190, 6), highlight_tint=(40, 6), grain=35, skin=75),
    "ektar": _look(dict(contrast=18, highlights=-12, shadows=-4, temperature=3, saturation=18), dict(red=(0, 16, -4), orange=(0, 8, 0), yellow=(-2, 10, 0), green=(-4, 14, -4), blue=(-4, 22, -10)), vibrance=14, rolloff=25, clarity=8, grain=20, skin=60),
    "classic-film": _look(dict(contrast=12, highlights=-20, shadows=-2, temperature=6, saturation=-10), dict(green=(-6, -10, 0)), rolloff=40, fade=20, shadow_tint=(220, 10), highlight_tint=(40, 12), grain=55, skin=55),
    "modern-film": _look(dict(contrast=8, highlights=-18, shadows=8, temperature=3, saturation=-4), dict(orange=(0, -4, 4), green=(-4, -6, 0), blue=(-6, -4, -4)), rolloff=35, fade=8, shadow_tint=(195, 8), clarity=6, grain=25, skin=60),
    "cinematic-film": _look(dict(contrast=20, highlights=-24, shadows=-6, temperature=-2, saturation=-10), dict(orange=(0, 6, 4), green=(-10, -20, -4), blue=(-8, 0, -8)), rolloff=45, fade=6, shadow_tint=(190, 22), highlight_tint=(35, 16), clarity=8, skin=60),
    "black-white": _look(dict(contrast=18, highlights=-10, shadows=-6), rolloff=25, monochrome=100, mix=_CLASSIC_MIX, clarity=14, grain=25),
}
GRAIN: dict[str, float] = {"off": 0.0, "low": 30.0, "medium": 55.0, "high": 85.0}


def register_look(name: str, look: Look) -> None:
    LOOKS[name] = look


def _on_tone(look: Look, name: str, value: float) -> Look:
    return replace(look, tone=replace(look.tone, **{name: value}))


def _on_band(look: Look, name: str, value: float) -> Look:
    return replace(look, bands=(*look.bands, (name, (0.0, value, 0.0)))) if value else look


def _on_look(field: str) -> Callable[[Look, str, float], Look]:
    return lambda look, _, value: replace(look, **{field: value})


# The sliders of a look of one's own: what they set, and their range.
SLIDERS: dict[str, tuple[Callable[[Look, str, float], Look], int, int]] = {
    **dict.fromkeys(("exposure", "contrast", "highlights", "shadows", "temperature", "tint", "saturation"), (_on_tone, -100, 100)),
    "vibrance": (_on_look("vibrance"), -100, 100),
    **dict.fromkeys(("red", "orange", "yellow", "green", "aqua", "blue", "purple", "magenta"), (_on_band, -100, 100)),
    "sharpness": (_on_look("sharpen"), 0, 100),
}
OWN = (40.0, 15.0)  # fixed values: skin, and the shoulder of looks that are made brighter or harder


def custom(values: Mapping[str, float]) -> Look:
    """A look from sliders, each laid upon the look so far; whole numbers within their range."""
    look = Look(skin=OWN[0])
    for name, value in values.items():
        apply, low, high = SLIDERS[name]
        look = apply(look, name, float(min(high, max(low, round(value)))))
    harder = max(look.tone.contrast, look.tone.exposure) > 0
    return replace(look, rolloff=OWN[1]) if harder else look


def chosen(name: str, intensity: int = 50, grain: str = "auto") -> Look:
    """The look that a name, an intensity and a grain choice stand for; an unknown name
    stands for none, and the original never gains grain."""
    look = LOOKS.get(name, Look())
    if look == Look():
        return look
    if grain in GRAIN:
        look = replace(look, grain=GRAIN[grain])
    return look.scaled(min(100, max(0, intensity)) / 100)


# Makers by whose name looks are named.
MAKERS = ("sony", "canon", "nikon", "fujifilm", "leica", "hasselblad")


def categories(name: str) -> set[str]:
    """A look's maker or, without one, film; and monochrome, which is all that a plain
    black-and-white look is."""
    if name not in LOOKS or name == "original":
        return set()
    found = {m for m in MAKERS if name.split("-")[0] == m} | ({"monochrome"} if LOOKS[name].monochrome > 0 else set())
    return found or {"film"}


def in_category(name: str, category: str) -> bool:
    return category in categories(name)
