"""The configuration of a run: a TOML file with defaults, checks and one overlay."""

from __future__ import annotations

import copy
import tomllib
import warnings
from dataclasses import dataclass
from pathlib import Path

from ..functions.grid import Threshold, decimals, linear_grid, log_grid, threshold
from ..operators.prepare import STEPS, TIE_POLICIES
from ..sources.readers import TIME_UNITS

# The sections, their keys and defaults.
DEFAULTS: dict[str, dict] = {
    "input": {"path": "", "format": "csv", "dataset": "", "source_descriptor": "", "value_column": 1, "time_column": "", "time_unit": "sample", "time_axis": "elapsed", "time_format": "", "epoch_unit": "second", "delimiter": "", "header": True, "missing_policy": "drop", "tie_policy": "error"},
    "preprocessing": {"steps": []},
    "gaps": {"declared": "", "detect": "cadence", "cadence": 1, "mode": "elapsed"},
    "quantization": {"digits": "auto", "auto_max_digits": 8, "auto_tolerance": 1e-3, "auto_step_ratio": 0.1},
    "thresholds": {"mode": "linear", "min": None, "max": None, "step": None, "points_per_decade": 10, "values": None},
    "algorithm": {"search": "auto", "backend": "none", "chunk_size": 4096, "reference_checks": 2, "reference_kernel": "theta"},
    "limits": {"max_ram_gb": 16, "max_vram_gb": 8, "max_reference_work": 1e12},
    "output": {"root": "data", "format": "parquet", "store_waiting_times": False, "overwrite": False},
    "run": {"seed": 12345, "log_level": "info", "checkpoint_seconds": 10},
}
CHOICES = {("input", "time_axis"): ("elapsed", "index"), ("input", "missing_policy"): ("drop", "error"), ("input", "tie_policy"): TIE_POLICIES, ("input", "time_unit"): TIME_UNITS, ("input", "format"): ("csv", "dat", "arrow", "tick", "parquet"), ("gaps", "detect"): ("cadence", "none"), ("gaps", "mode"): ("elapsed", "exact"), ("thresholds", "mode"): ("linear", "log", "explicit"), ("output", "format"): ("parquet", "csv"), ("run", "log_level"): ("debug", "info", "warn", "error")}


#: Keys that are known but mean nothing on a cluster: it has no device kernels, and Spark schedules.
IDLE = (("algorithm", "backend"), ("algorithm", "chunk_size"), ("limits", "max_vram_gb"))


@dataclass(frozen=True)
class Settings:
    """A checked configuration; ``settings["section"]["key"]``."""

    values: dict
    base: str = "."

    def __getitem__(self, section: str) -> dict:
        return self.values[section]

    def path(self, name: str) -> str:
        return name if "://" in name or Path(name).is_absolute() else str(Path(self.base) / name)


def merge_config(below: dict, above: dict) -> dict:
    out = copy.deepcopy(below)
    for k, v in above.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def effective_config(path: str) -> dict:
    """The file's tables over those of its ``base_config``, which has none itself."""
    own = tomllib.loads(Path(path).read_text())
    base = own.pop("base_config", None)
    if base is None:
        return own
    below = tomllib.loads((Path(path).parent / base).read_text())
    if "base_config" in below:
        raise ValueError("a base_config can't have one itself")
    return merge_config(below, own)


def validate(raw: dict, base: str = ".") -> Settings:
    values = {}
    for section, given in raw.items():
        if section not in DEFAULTS:
            warnings.warn(f"unknown section [{section}]", stacklevel=2)
    for section, defaults in DEFAULTS.items():
        given = raw.get(section, {})
        for k in given.keys() - defaults.keys():
            warnings.warn(f"unknown key {k} in [{section}]", stacklevel=2)
        values[section] = {k: given.get(k, v) for k, v in defaults.items()}
        for k, v in values[section].items():
            allowed = CHOICES.get((section, k))
            if allowed and isinstance(v, str):
                v = values[section][k] = v.lower()
            if allowed and v not in allowed:
                raise ValueError(f"[{section}] {k} must be one of {allowed}, not {v!r}")
    i, t, q, g = values["input"], values["thresholds"], values["quantization"], values["gaps"]
    if not i["path"]:
        raise ValueError("[input] path is needed")
    if i["format"] == "tick":
        i.update({k: v for k, v in {"time_column": "time_ns", "value_column": "price", "time_unit": "nanosecond", "epoch_unit": "nanosecond"}.items() if k not in raw.get("input", {})})
    if (i["time_column"] == "") != (i["time_unit"] == "sample"):
        raise ValueError("a time column needs a unit other than sample, and the other way round")
    if not isinstance(g["cadence"], int) or g["cadence"] < 1:
        raise ValueError("[gaps] cadence must be a positive integer")
    if q["digits"] != "auto" and not (isinstance(q["digits"], int) and 0 <= q["digits"] <= 15):
        raise ValueError('[quantization] digits must be in 0:15 or "auto"')
    if t["mode"] == "explicit" and not t["values"]:
        raise ValueError("[thresholds] values is needed")
    if t["mode"] != "explicit" and (t["min"] is None or t["max"] is None or t["mode"] == "linear" and t["step"] is None):
        raise ValueError("[thresholds] min, max and step are needed")
    for s in values["preprocessing"]["steps"]:
        if s.get("op") not in STEPS and s.get("op") != "suggest_digits":
            raise ValueError(f"unknown step {s.get('op')!r}")
    ignored = {"linear": ("values",), "log": ("values", "step"), "explicit": ("min", "max", "step")}[t["mode"]]
    for k in ignored:
        if raw.get("thresholds", {}).get(k) is not None:
            warnings.warn(f"[thresholds] {k} has no effect in mode {t['mode']}", stacklevel=2)
    for section, k in IDLE:
        if raw.get(section, {}).get(k) not in (None, DEFAULTS[section][k]):
            warnings.warn(f"[{section}] {k} has no effect here", stacklevel=2)
    if q["digits"] != "auto":
        threshold_list(t, q["digits"])
    elif threshold_decimals(t) > q["auto_max_digits"]:
        raise ValueError("thresholds have more decimals than auto_max_digits")
    return Settings(values, base)


def load_settings(path: str) -> Settings:
    return validate(effective_config(path), str(Path(path).parent))


def threshold_decimals(t: dict) -> int:
    """The decimals that a grid needs so that all thresholds of a configuration lie on it."""
    given = t["values"] if t["mode"] == "explicit" else [t["min"], t["max"], *([t["step"]] if t["mode"] == "linear" else [])]
    return max(len(x.strip().partition(".")[2].rstrip("0")) if isinstance(x, str) else decimals(x) for x in given)


def threshold_list(t: dict, digits: int) -> list[Threshold]:
    if t["mode"] == "explicit":
        return sorted({threshold(v, digits) for v in t["values"]})
    if t["mode"] == "linear":
        return linear_grid(t["min"], t["max"], t["step"], digits)
    return log_grid(t["min"], t["max"], t["points_per_decade"], digits)
