"""Declared datasets: two clocks, an entity, a mask, and where the rows are."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime


class PlanError(ValueError):
    """A request that breaks an invariant; code names it (C1: nothing unavailable; C2: gaps; C4: mask first)."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Declaration:
    name: str
    entity: str
    event_time: str
    available_time: str | None = None
    mask: str | None = None
    kind: str = "parquet"
    locator: str = ""
    #: (from, until, basis): contiguous segments of event time, basis observed, reconstructed or assumed.
    segments: tuple[tuple[datetime, datetime | None, str], ...] = field(default=())
    #: Columns that the source must have besides.
    payload: tuple[str, ...] = ()

    @property
    def clock(self) -> str:
        """What a row is filtered by: when it was available, or when it happened if that isn't declared."""
        return self.available_time or self.event_time

    @property
    def digest(self) -> str:
        """The SHA-256 of what is declared, by which evidence names it: of a domain's name, a zero byte and JSON with its keys in order."""
        said = {k: v for k, v in asdict(self).items() if k != "segments"} | {"segments": [[x.isoformat() if isinstance(x, datetime) else x for x in s] for s in self.segments]}
        return hashlib.sha256(b"tidemark.declaration.v1\0" + json.dumps(said, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    @property
    def degradations(self) -> tuple[str, ...]:
        found = [] if self.available_time else ["PIT_UNSAFE"]
        found += [] if self.mask else ["NO_TRADABILITY_MASK"]
        return tuple(found + sorted({f"AVAILABILITY_{b.upper()}" for _, _, b in self.segments if b != "observed"}))


@dataclass(frozen=True)
class ReadPlan:
    declaration: Declaration
    as_of: datetime
    columns: tuple[str, ...]
    #: The columns asked for, and those that the guard needs.
    scanned: tuple[str, ...]


def instant(text: str) -> datetime:
    """An ISO instant in UTC; a date is its midnight, and a time without zone is an error."""
    if len(text) == 10:
        return datetime.fromisoformat(text).replace(tzinfo=UTC)
    found = datetime.fromisoformat(text)
    if found.tzinfo is None:
        raise PlanError("C1", f"{text} has no zone")
    return found.astimezone(UTC)


def read_plan(declaration: Declaration, as_of: str | None, columns: list[str] | None = None) -> ReadPlan:
    if not as_of:
        raise PlanError("C1", "a read needs a decision time")
    asked = tuple(dict.fromkeys(c.strip() for c in columns or ()))
    guard = [declaration.entity, declaration.event_time, declaration.clock, *([declaration.mask] if declaration.mask else [])]
    return ReadPlan(declaration, instant(as_of), asked, tuple(dict.fromkeys([*asked, *guard])) if asked else ())
