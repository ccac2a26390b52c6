import warnings

import pytest

from skymill import config
from skymill.config import RenderConfig, add_type, parse_arguments, set_option


def test_defaults():
    c = RenderConfig()
    assert (c.colormap, c.auto_pct_lo, c.auto_pct_hi, c.mask, c.num_ngb, c.sph_eta, c.opacity_gamma) == ("magma", 0.10, 1.0, 2, 32, 1.2, 2.0)


@pytest.mark.parametrize(
    ("flags", "mask"),
    [(["-dark_matter", "-gas"], 1), (["-gas", "-dark_matter"], 3), (["-stars"], 16), (["-gas", "-stars"], 17), (["-ptype", "5", "-ptype", "2"], 36), (["-all_types"], -1), ([], 2)],
)
def test_type_flags_depend_on_order(flags, mask):
    assert parse_arguments(flags).mask == mask


def test_type_numbers_are_checked():
    with pytest.raises(ValueError):
        add_type(2, "ptype", 32)


def test_presets_hold_until_overridden():
    c = parse_arguments(["-scene", "filament", "-opacity_gamma", "3", "-linear_scale"])
    assert (c.colormap, c.opacity_func, c.opacity_gamma, c.auto_pct_lo, c.log_scale) == ("inferno", "power", 3.0, 0.02, False)
    assert parse_arguments(["-opacity_gamma", "3", "-scene", "filament"]).opacity_gamma == 0.5


def test_yaml_then_command_line(tmp_path):
    f = tmp_path / "c.yml"
    f.write_text("lbox: 2.5  # box\ngas: true\nptype: [4, 5]\nrot_axis: \"0,0,2\"\nlock_levels: yes\nbg_color: 0.1,0.2,0.3\nscene: cluster\n")
    c = parse_arguments(["-config", str(f), "-lbox", "3"])
    assert (c.lbox, c.mask, c.rot_axis, c.lock_levels, c.bg_color, c.opacity_func) == (3.0, 49, (0.0, 0.0, 1.0), True, (0.1, 0.2, 0.3, 1.0), "sqrt")
    plain = list(config._flat_yaml(str(f)))
    assert ("ptype", ["4", "5"]) in plain and ("lbox", "2.5") in plain


def test_unknown_names_warn():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert set_option(RenderConfig(), "nonsense", 1) == RenderConfig()
        assert config.palette_name("NOPE") == "viridis" and config.palette_name("Grey") == "grayscale"
        assert set_option(RenderConfig(), "zoom_factor", 1.5).zoom_factor == 0.5
        parse_arguments(["-wrong"])
    assert len(seen) >= 4


def test_validation():
    with pytest.raises(ValueError):
        RenderConfig().validated()
    with pytest.raises(ValueError):
        RenderConfig(lbox=1, rot_axis=(0, 0, 0)).validated()
    assert RenderConfig(lbox=0.5, units=1).in_box_units(10.0).lbox == 5.0


def test_mode():
    assert RenderConfig(snap_a="a", snap_b="b").mode == "hermite"
    assert RenderConfig(snap_a="a", snap_b="b", snap_prev="p").mode == "catmull"
    assert RenderConfig(snap_a="a").mode == "single"


@pytest.mark.parametrize(("value", "is_yes"), [("true", True), ("YES", True), ("on", True), (1, True), ("no", False), (0, False), (True, True)])
def test_yes(value, is_yes):
    assert config.yes(value) is is_yes
