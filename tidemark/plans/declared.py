"""Declarations from YAML files, read strictly: no key twice, none unknown, no tags, and evidence for what wasn't observed.

Keys: dataset, version, entity_key, event_time, available_time (may be null), availability_basis (needed with an
available_time, forbidden without), guarantees, provenance, payload_schema, source (type, locator), frequency,
time_semantics and notes. PyYAML is needed for load() only.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from ..functions import text
from .declaration import Declaration, PlanError, instant

# The keys of a declaration and of its parts, and the bases of availability with the evidence that each needs.
KEYS = {"dataset", "version", "entity_key", "event_time", "available_time", "availability_basis", "frequency", "guarantees", "provenance", "payload_schema", "source", "time_semantics", "notes"}
REQUIRED = ("dataset", "version", "entity_key", "event_time", "available_time", "source")
GUARANTEES = {"point_in_time", "vintage", "survivorship_free", "tradability_mask"}
SEGMENT = {"from", "until", "basis", "source", "lag", "rationale"}
EVIDENCE = {"observed": (), "reconstructed": ("source",), "assumed": ("lag", "rationale")}
#: What a segment may say besides; an assumption may name its source, and nothing else carries evidence that isn't its own.
ALSO = {"observed": (), "reconstructed": (), "assumed": ("source",)}
PROVENANCE = {"certified", "lineage_ref"}
#: Texts that other readers of YAML take for true or false, so that they must be quoted or written out.
LIKE_BOOLEANS = re.compile(r"^(y|n|yes|no|on|off)$", re.IGNORECASE)
EARLIEST = datetime(1, 1, 1, tzinfo=UTC)


def _bad(text_: str) -> PlanError:
    return PlanError("CONFIG", text_)


def _record(value: object, keys: set[str], what: str) -> dict:
    if not isinstance(value, dict):
        raise _bad(f"{what} is no mapping")
    if unknown := sorted(str(k) for k in value.keys() - keys):
        raise _bad(f"{what} has an unknown key {unknown[0]}")
    return value


def _name(value: object, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise _bad(f"{what} must be a text")
    return value


def _positive_duration(lag: str) -> bool:
    found = lag.strip()
    return bool(re.fullmatch(text.DURATION.strip("^$"), found)) and not found.endswith("T") and bool(re.search("[1-9]", found))


def _truth(value: object, what: str) -> bool:
    """true or false, and false where nothing is said."""
    if value is None:
        return False
    if not isinstance(value, bool):
        raise _bad(f"{what} must be true or false, not {value!r}")
    return value


def _guarantees(value: object) -> dict:
    promised = _record({} if value is None else value, GUARANTEES, "guarantees")
    for key in ("point_in_time", "vintage"):
        _truth(promised.get(key), key)
    free = promised.get("survivorship_free", "unknown")
    if not isinstance(free, bool) and free != "unknown":
        raise _bad(f"survivorship_free must be true, false or unknown, not {free!r}")
    if promised.get("tradability_mask") is not None:
        _name(promised["tradability_mask"], "tradability_mask")
    return promised


def _check_provenance(value: object) -> None:
    said = _record({} if value is None else value, PROVENANCE, "provenance")
    ref = said.get("lineage_ref")
    if ref is not None and _name(ref, "lineage_ref").startswith("sha256:") and not re.fullmatch("sha256:[0-9a-f]{64}", ref):
        raise _bad("lineage_ref is no SHA-256")
    if _truth(said.get("certified"), "certified") and ref is None:
        raise _bad("certified needs a lineage_ref")


def _segments(value: object) -> tuple:
    """(from, until, basis) for each segment, with the evidence that its basis needs."""
    listed = value if isinstance(value, list) else [value]
    if not listed:
        raise _bad("availability_basis is empty")
    out = []
    for one in listed:
        one = _record({"basis": one} if isinstance(one, str) else one, SEGMENT, "availability_basis")
        basis = one.get("basis")
        if basis not in EVIDENCE or (not isinstance(value, list) and (one.get("from") or one.get("until"))):
            raise _bad(f"availability_basis {basis!r}")
        if basis != "observed" and isinstance(value, str):
            raise _bad(f"{basis} needs its evidence")
        for key in EVIDENCE[basis]:
            _name(one.get(key), f"{key} of a {basis} segment")
        if stray := sorted(k for k in ("source", "lag", "rationale") if one.get(k) is not None and k not in (*EVIDENCE[basis], *ALSO[basis])):
            raise _bad(f"a segment that is {basis} can't carry {stray[0]}")
        if "lag" in EVIDENCE[basis] and not _positive_duration(one["lag"]):
            raise _bad(f"lag {one['lag']!r} is no duration above 0")
        out.append((instant(one["from"]) if one.get("from") else EARLIEST, instant(one["until"]) if one.get("until") else None, basis))
    for (_, until, _), (start, _, _) in zip(out, out[1:], strict=False):
        if until is None or until != start:
            raise _bad("segments of availability leave a gap or overlap")
    if any(until is not None and until <= start for start, until, _ in out):
        raise _bad("a segment of availability is empty")
    return tuple(out)


def declaration(parsed: object) -> Declaration:
    """The declaration that a parsed file says."""
    d = _record(parsed, KEYS, "the declaration")
    if missing := [k for k in REQUIRED if k not in d]:
        raise _bad(f"the declaration has no {missing[0]}")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", _name(d["dataset"], "dataset")):
        raise _bad(f"dataset {d['dataset']!r}")
    _name(d["version"], "version")
    available, basis = d["available_time"], d.get("availability_basis")
    if (available is None) != (basis is None):
        raise _bad("availability_basis goes with available_time")
    promised = _guarantees(d.get("guarantees"))
    _check_provenance(d.get("provenance"))
    if promised.get("point_in_time") and available is None:
        raise _bad("point_in_time needs an available_time")
    source = _record(d["source"], {"type", "locator"}, "source")
    payload = d.get("payload_schema") or {}
    if not isinstance(payload, dict) or not all(isinstance(k, str) and k.strip() and isinstance(v, str) and v.strip() for k, v in payload.items()):
        raise _bad("payload_schema is no mapping from columns to types")
    mask = promised.get("tradability_mask")
    return Declaration(
        d["dataset"], _name(d["entity_key"], "entity_key"), _name(d["event_time"], "event_time"), None if available is None else _name(available, "available_time"),
        None if mask is None else _name(mask, "tradability_mask"), _name(source.get("type"), "source type"), _name(source.get("locator"), "locator"),
        () if basis is None else _segments(basis), tuple(map(str, payload)),
    )


def load(path: str) -> Declaration:
    """The declaration in a YAML file."""
    import yaml

    class Strict(yaml.SafeLoader):
        """Without dates, which stay texts, and with an error on a key that repeats."""

        yaml_implicit_resolvers = {c: [r for r in rs if r[0] != "tag:yaml.org,2002:timestamp"] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def construct_yaml_bool(self, node):
            if LIKE_BOOLEANS.match(node.value):
                raise _bad(f"{node.value} is neither true nor false; quote it if it is a text")
            return super().construct_yaml_bool(node)

        def construct_mapping(self, node, deep=False):
            names = [self.construct_object(k, deep=True) for k, _ in node.value]
            if twice := sorted({str(n) for n in names if names.count(n) > 1}):
                raise _bad(f"{twice[0]} is there twice")
            return super().construct_mapping(node, deep)

    Strict.add_constructor("tag:yaml.org,2002:bool", Strict.construct_yaml_bool)
    try:
        with open(path, encoding="utf-8") as f:
            parsed = yaml.load(f, Strict)  # noqa: S506  (a safe loader)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise _bad(f"{path} is no readable YAML file: {type(e).__name__}") from None
    return declaration(parsed)
