"""Render settings: defaults, presets, key/value setter, YAML file and command line, in that order of precedence."""

from __future__ import annotations

import argparse
import math
import warnings
from dataclasses import dataclass, field, replace

#: Particle types of the named flags, palettes, opacity functions, and the type mask by default.
GAS, DARK_MATTER, STARS = 0, 1, 4
PALETTES = ("coolwarm", "viridis", "magma", "inferno", "plasma", "hot", "grayscale", "fire", "ice", "custom")
PALETTE_ALIASES = {"grey": "grayscale", "gray": "grayscale"}
OPACITIES = ("flat", "linear", "sqrt", "power", "log", "threshold")
DEFAULT_MASK = 1 << DARK_MATTER
ALL_TYPES = -1
#: Fixed values of the scene presets.
SCENES = {
    "cluster": {"auto_pct_lo": 0.05, "auto_pct_hi": 1.0, "opacity_func": "sqrt", "colormap": "magma"},
    "scattered": {"auto_pct_lo": 0.10, "auto_pct_hi": 1.0, "opacity_func": "flat", "colormap": "plasma"},
    "filament": {"auto_pct_lo": 0.02, "auto_pct_hi": 1.0, "opacity_func": "power", "opacity_gamma": 0.5, "colormap": "inferno"},
}
SCENE_COMMON = {"log_scale": True, "opacity": 1.0}


@dataclass(frozen=True)
class RenderConfig:
    """All settings of a render; names match the YAML keys and command-line flags."""

    input: str = ""
    output: str = ""
    snap_prev: str = ""
    snap_a: str = ""
    snap_b: str = ""
    snap_next: str = ""
    isHDF5: bool = False
    units: int = 0
    xc: float = 0.5
    yc: float = 0.5
    zc: float = 0.5
    lbox: float = 0.0
    itmax: int = 1
    zoom: int = 0
    zoom_factor: float = 0.5
    rot_dangle: float = 0.0
    rot_axis: tuple[float, float, float] = (0.0, 0.0, 1.0)
    mask: int = DEFAULT_MASK
    colormap: str = "magma"
    reverse_colormap: bool = False
    colormap_file: str = ""
    opacity: float = 1.0
    opacity_func: str = "flat"
    opacity_gamma: float = 2.0
    opacity_threshold: float = 0.1
    vmin: float = 0.0
    vmax: float = 1.0
    log_scale: bool = True
    bg_color: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)
    auto_levels: bool = True
    lock_levels: bool = False
    auto_pct_lo: float = 0.10
    auto_pct_hi: float = 1.0
    num_ngb: int = 32
    sph_eta: float = 1.2
    sph_cache: str = ""
    fast_smooth: bool = False
    interp_frac: float = 0.0
    snap_dt: float = 0.0
    ngrid_z: int = 0
    width: int = 768
    height: int = 768
    kernel_smoothing: bool = False
    h_method: str = "leaf"
    max_h_voxels: float = 8.0
    smooth_grid: int = 128
    min_rho_frac: float = 0.1
    max_h_deposit_px: float = 8.0
    max_h_skip_px: float = 16.0
    kd_leaf_size: int = 32
    noise_floor_fraction: float = 1e-4
    max_fill_passes: int = 64
    compat: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def frames(self) -> int:
        return self.zoom if self.zoom > 0 else self.itmax

    @property
    def mode(self) -> str:
        """How snapshots become particles: catmull needs prev, a and b; hermite a and b; else one snapshot."""
        if self.snap_a and self.snap_b:
            return "catmull" if self.snap_prev else "hermite"
        return "single"

    def validated(self) -> RenderConfig:
        """The same settings; ValueError where they cannot be rendered."""
        if not self.lbox > 0:
            raise ValueError("lbox must be set and positive")
        if self.width < 1 or self.height < 1 or self.frames < 1:
            raise ValueError("width, height and the number of frames must be at least 1")
        if not 0 <= self.auto_pct_lo <= 1 or not 0 <= self.auto_pct_hi <= 1:
            raise ValueError("percentiles lie between 0 and 1")
        if self.colormap not in PALETTES or self.opacity_func not in OPACITIES:
            raise ValueError("unknown colormap or opacity_func")
        return replace(self, rot_axis=unit_axis(self.rot_axis))

    def in_box_units(self, box_size: float) -> RenderConfig:
        """Centre and lbox times the box size if units is 1."""
        if self.units != 1:
            return self
        return replace(self, xc=self.xc * box_size, yc=self.yc * box_size, zc=self.zc * box_size, lbox=self.lbox * box_size, units=0)


def unit_axis(axis: tuple[float, ...]) -> tuple[float, float, float]:
    """The axis at length 1; ValueError for a zero axis."""
    n = math.sqrt(sum(a * a for a in axis))
    if not n > 0:
        raise ValueError("the rotation axis has no length")
    return tuple(a / n for a in axis)


def palette_name(name: str) -> str:
    """A known palette, by any case or alias; unknown names warn and give viridis."""
    low = PALETTE_ALIASES.get(name.lower(), name.lower())
    if low not in PALETTES:
        warnings.warn(f"unknown palette {name!r}: viridis is used", stacklevel=2)
        return "viridis"
    return low


def yes(value) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "on")


def add_type(mask: int, name: str, number: int | None = None) -> int:
    """The mask with one more type flag, in the order that flags are given.

    gas, stars and ptype replace a mask that is still the default; dark_matter adds to whatever is there.
    """
    if name == "all_types":
        return ALL_TYPES
    if name == "dark_matter":
        return mask | 1 << DARK_MATTER
    t = {"gas": GAS, "stars": STARS}.get(name, number)
    if t is None or not 0 <= t < 32:
        raise ValueError(f"particle type {t} is not in 0 to 31")
    return (0 if mask == DEFAULT_MASK else mask) | 1 << t


def types_of(mask: int) -> list[int] | None:
    """The types that a mask selects; None for all."""
    return None if mask == ALL_TYPES else [t for t in range(32) if mask >> t & 1]


def set_option(cfg: RenderConfig, key: str, value) -> RenderConfig:
    """The settings with one more key set, as read from YAML or the command line. Unknown keys warn and change nothing."""
    if key in ("gas", "stars", "dark_matter", "all_types"):
        return replace(cfg, mask=add_type(cfg.mask, key)) if yes(value) else cfg
    if key == "ptype":
        for t in value if isinstance(value, (list, tuple)) else [value]:
            cfg = replace(cfg, mask=add_type(cfg.mask, "ptype", int(t)))
        return cfg
    if key == "scene":
        if str(value) not in SCENES:
            warnings.warn(f"unknown scene {value!r}", stacklevel=2)
            return cfg
        return replace(cfg, **SCENE_COMMON, **SCENES[str(value)])
    if key == "colormap":
        return replace(cfg, colormap=palette_name(str(value)))
    if key == "colormap_file":
        return replace(cfg, colormap="custom", colormap_file=str(value))
    if key == "opacity_func" and str(value) not in OPACITIES:
        warnings.warn(f"unknown opacity_func {value!r}", stacklevel=2)
        return cfg
    if key == "linear_scale":
        return replace(cfg, log_scale=not yes(value))
    if key == "no_auto_levels":
        return replace(cfg, auto_levels=not yes(value))
    if key == "zoom_factor":
        f = float(value)
        if 0 < f < 1:
            return replace(cfg, zoom_factor=f)
        warnings.warn("zoom_factor must lie between 0 and 1", stacklevel=2)
        return cfg
    if key in ("rot_axis", "bg_color"):
        parts = [float(x) for x in (value.split(",") if isinstance(value, str) else value)]
        if key == "rot_axis":
            return replace(cfg, rot_axis=unit_axis(tuple(parts[:3] + list(cfg.rot_axis)[len(parts) :])))
        if len(parts) < 3:
            raise ValueError("bg_color needs R,G,B[,A]")
        return replace(cfg, bg_color=tuple((parts + [1.0])[:4]))
    if key == "extra" or not hasattr(cfg, key):
        warnings.warn(f"unknown setting {key!r} is ignored", stacklevel=2)
        return cfg
    kind = type(getattr(RenderConfig(), key))
    return replace(cfg, **{key: yes(value) if kind is bool else kind(value)})


def load_yaml(path: str, cfg: RenderConfig | None = None) -> RenderConfig:
    """Settings of a flat YAML file: scalars and lists."""
    try:
        import yaml

        with open(path) as f:
            items = list((yaml.safe_load(f) or {}).items())
    except ImportError:
        items = list(_flat_yaml(path))
    cfg = cfg or RenderConfig()
    for k, v in items:
        cfg = set_option(cfg, str(k), v)
    return cfg


def _flat_yaml(path: str):
    """Pairs of `key: value` and `key: [a, b]` lines, for machines without a YAML library."""
    with open(path) as f:
        for line in f:
            line = line.split("#")[0].strip()
            if ":" in line:
                k, v = (x.strip() for x in line.split(":", 1))
                v = v.strip("\"'")
                yield k, [x.strip() for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else v


FLAGS = ("isHDF5", "gas", "dark_matter", "stars", "all_types", "reverse_colormap", "linear_scale", "no_auto_levels", "lock_levels", "fast_smooth", "kernel_smoothing", "compat")


class _Ordered(argparse.Action):
    """Collects options in the order given: presets and type flags depend on it."""

    def __call__(self, parser, namespace, values, option=None):
        namespace.given = [*getattr(namespace, "given", []), (self.dest, True if self.nargs == 0 else values)]


def parse_arguments(argv: list[str]) -> RenderConfig:
    """Defaults, then the YAML file of -config, then the command line."""
    parser = argparse.ArgumentParser(prog="skymill", prefix_chars="-", allow_abbrev=False)
    parser.add_argument("-config", dest="config")
    names = [n for n in RenderConfig.__dataclass_fields__ if n not in ("extra", "mask", "log_scale", "auto_levels")]
    for n in [*names, "ptype", "scene", "gas", "dark_matter", "stars", "all_types", "linear_scale", "no_auto_levels"]:
        parser.add_argument(f"-{n}", dest=n, action=_Ordered, **({"nargs": 0} if n in FLAGS else {}))
    got, unknown = parser.parse_known_args(argv)
    for u in unknown:
        warnings.warn(f"unknown argument {u!r} is ignored", stacklevel=2)
    cfg = load_yaml(got.config) if got.config else RenderConfig()
    for k, v in getattr(got, "given", []):
        cfg = set_option(cfg, k, v)
    return cfg
