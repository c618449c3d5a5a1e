"""Options of a run, from defaults, a mapping (as a YAML file gives) and the environment."""

from __future__ import annotations

import json
import os
import re

#: Defaults; the glossary's options are merged one level down.
DEFAULTS = {"concurrency": 16, "target": "Simplified Chinese", "glossary": {"enabled": True, "min_freq": 2, "max_terms": None}, "mask_math": True, "mask_code": True, "exclude": [], "keep": []}


def merged(given: dict | None) -> dict:
    given = given or {}
    return {**DEFAULTS, **given, "glossary": {**DEFAULTS["glossary"], **(given.get("glossary") or {})}}


def load(path: str) -> dict:
    """The options of a YAML (or JSON) file over the defaults."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        given = yaml.safe_load(text)
    except ImportError:  # JSON is what can be read without it
        given = json.loads(text)
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path}: not a mapping")
    return merged(given)


def check_input(path: str, suffix: str = ".epub", exists=os.path.exists, **selectors) -> None:
    """Raises unless the input exists and has the suffix, and exactly one of the selectors, if any are named, is given."""
    if not exists(path):
        raise FileNotFoundError(path)
    if not path.lower().endswith(suffix):
        raise ValueError(f"{path}: not a {suffix} file")
    if selectors and sum(bool(v) for v in selectors.values()) != 1:
        raise ValueError(f"give exactly one of {', '.join(selectors)}")


def env(name: str, default=None, kind=str, required: bool = False):
    """A variable as str, int, float or a JSON object (dict); an empty one counts as unset."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        if required:
            raise KeyError(name)
        return default
    if kind is dict:
        out = json.loads(raw)
        if not isinstance(out, dict):
            raise ValueError(f"{name}: not a JSON object")
        return out
    return kind(raw)


def index_ranges(spec: str, n: int) -> list[int]:
    """'0-3,6' as indexes in order, ends included; anything outside 0..n-1 is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m:
            raise ValueError(f"not a range: {part}")
        lo, hi = int(m[1]), int(m[2] or m[1])
        if lo > hi or hi >= n:
            raise ValueError(f"outside 0-{n - 1}: {part}")
        out.update(range(lo, hi + 1))
    return sorted(out)
