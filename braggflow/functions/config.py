"""Settings: classic key-value text, JSON or YAML, into one flat mapping with types and defaults.

One table says all: key, type, default. Text lines are ``Key value ...``; several values make a list.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from braggflow.functions.crystal import Detector, Lattice

#: The keys of the classic format, with types and defaults.
KEYS: dict[str, tuple[type, object]] = {
    "SpaceGroup": (int, 225),
    "Symmetry": (str, "F"),
    "LatticeParameter": (list, [0.35238, 0.35238, 0.35238, 90.0, 90.0, 90.0]),
    "P_Array": (list, [0.0, 0.0, 0.5]),
    "R_Array": (list, [0.0, 0.0, 0.0]),
    "PxX": (float, 0.0002),
    "PxY": (float, 0.0002),
    "NrPxX": (int, 2048),
    "NrPxY": (int, 2048),
    "Elo": (float, 5.0),
    "Ehi": (float, 30.0),
    "MinNrSpots": (int, 5),
    "MinGoodSpots": (int, 3),
    "MinIntensity": (float, 0.0),
    "MaxAngle": (float, 5.0),
    "MinArea": (int, 5),
    "MaxNrLaueSpots": (int, 30),
    "Threshold": (float, 0.0),
    "ThresholdMethod": (str, "adaptive"),
    "ThresholdPercentile": (float, 90.0),
    "WatershedImage": (bool, False),
    "OrientationSpacing": (float, 0.4),
    "OrientationFile": (str, ""),
    "ForwardFile": (str, ""),
    "HKLFile": (str, ""),
    "ResultDir": (str, "results"),
    "DoFwd": (bool, True),
    "Optimizer": (str, "simplex"),
    "tol_LatC": (list, [0.0] * 6),
    "tol_c_over_a": (float, 0.0),
}


def coerce(value, kind: type):
    """A value as its type; booleans may come as numbers or words."""
    if kind is bool:
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if kind is list:
        return [float(v) for v in (value.split() if isinstance(value, str) else value)]
    return kind(value)


def parse(text: str) -> dict:
    """Settings of a text in any of the three formats; unknown keys are kept as text."""
    if text.lstrip().startswith("{"):
        raw = json.loads(text)
    elif any(line.split("#")[0].rstrip().endswith(":") or ": " in line.split("#")[0] for line in text.splitlines()):
        import yaml

        raw = yaml.safe_load(text) or {}
    else:
        raw = {}
        for line in text.splitlines():
            key, _, value = line.split("#")[0].strip().partition(" ")
            if key:
                raw[key] = value.strip()
    return {k: d for k, (_, d) in KEYS.items()} | {k: coerce(v, KEYS[k][0]) if k in KEYS else v for k, v in raw.items()}


def with_environment(settings: Mapping, environ: Mapping[str, str] = os.environ, prefix: str = "BRAGGFLOW_") -> dict:
    """Settings overridden by variables like BRAGGFLOW_ELO."""
    upper = {prefix + k.upper(): k for k in KEYS}
    return dict(settings) | {upper[n]: coerce(v, KEYS[upper[n]][0]) for n, v in environ.items() if n in upper}


def render(settings: Mapping) -> str:
    """The classic text; parse(render(s)) gives s back."""
    plain = lambda v: " ".join(repr(x) for x in v) if isinstance(v, list) else str(int(v)) if isinstance(v, bool) else str(v)
    return "".join(f"{k} {plain(settings[k])}\n" for k in KEYS if k in settings)


def lattice(settings: Mapping) -> Lattice:
    return Lattice(*settings["LatticeParameter"], space_group=settings["SpaceGroup"])


def detector(settings: Mapping) -> Detector:
    return Detector(tuple(settings["P_Array"]), tuple(settings["R_Array"]), settings["PxX"], settings["PxY"], settings["NrPxX"], settings["NrPxY"], settings["Elo"], settings["Ehi"])
