"""Files of settings: chunking policies, experiment protocols, samples of ids. Small; read and checked on the driver."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from marginalia.operators.chunking import SHORT_FRACTION, Policy


def read_mapping(path: str) -> dict:
    """A mapping from a JSON file, or from a YAML file where a YAML library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        content = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ValueError(f"{path}: reading YAML needs a YAML library; give the settings as JSON") from error
        content = yaml.safe_load(text)
    if not isinstance(content, dict):
        raise ValueError(f"{path} is not a mapping")
    return content


def policy(content: dict) -> tuple[str, Policy]:
    """Name and policy; ValueError for a blank name, unknown fields and sizes that do not fit."""
    fields = {f.name for f in dataclasses.fields(Policy)}
    unknown = set(content) - fields - {"name"}
    if unknown:
        raise ValueError(f"unknown fields of a policy: {', '.join(sorted(unknown))}")
    name = content.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a policy has a name")
    values = {k: v for k, v in content.items() if k != "name"}
    for k in ("chunk_size", "chunk_overlap"):
        if k in values and (isinstance(values[k], bool) or not isinstance(values[k], int)):
            raise ValueError(f"{name}: {k} is a whole number")
    if "separators" in values:
        values["separators"] = tuple(values["separators"])
    return name.strip(), Policy(**values)


def protocol(content: dict) -> tuple[dict[str, Policy], float]:
    """The policies of an experiment by name, and the fraction of a chunk below which one is short; ValueError for repeats and a fraction outside 0 to 1."""
    fraction = content.get("short_chunk_fraction", SHORT_FRACTION)
    if isinstance(fraction, bool) or not isinstance(fraction, (int, float)) or not 0 < fraction < 1:
        raise ValueError("short_chunk_fraction lies between 0 and 1")
    found: dict[str, Policy] = {}
    for item in content.get("policies") or []:
        name, own = policy(read_mapping(item) if isinstance(item, str) else item)
        if name in found:
            raise ValueError(f"{name}: repeated")
        found[name] = own
    if not found:
        raise ValueError("a protocol has policies")
    return found, float(fraction)


def sample_ids(content: dict) -> list[str]:
    """The ids of a sample for human review, in the file's order; ValueError for blanks and repeats."""
    ids = [i.get("id") if isinstance(i, dict) else i for i in content.get("items") or []]
    if not ids or not all(isinstance(i, str) and i.strip() for i in ids) or len({i.strip() for i in ids}) < len(ids):
        raise ValueError("a sample has ids, none blank or repeated")
    return [i.strip() for i in ids]
