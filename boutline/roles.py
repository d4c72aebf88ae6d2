"""Column roles. Operators name columns through a Roles value, not by game."""

from __future__ import annotations

from dataclasses import dataclass, field

# The five roles and their column prefixes, in draft order.
ROLES = ("top", "jungle", "mid", "bot", "support")
ROLE_PREFIX = ("top", "jng", "mid", "bot", "sup")

UNKNOWN = "Unknown"
NO_BAN = "NoBan"


@dataclass(frozen=True)
class Roles:
    game: str = "gameid"
    row: str = "row_id"
    time: str = "match_date"
    entity: str = "team"
    outcome: str = "result"
    side: str = "side"
    league: str = "league"
    patch: str = "patch"
    split: str = "split_name"
    year: str = "year"
    playoffs: str = "playoffs"
    length: str = "game_length"
    champions: tuple[str, ...] = field(default=tuple(f"{p}_champion" for p in ROLE_PREFIX))
    players: tuple[str, ...] = field(default=tuple(f"{p}_player" for p in ROLE_PREFIX))
    bans: tuple[str, ...] = field(default=tuple(f"ban{i}" for i in range(1, 6)))


MATCH = Roles()
