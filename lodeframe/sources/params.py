"""Requirements as query parameters of a source: rounded outwards, so no row that qualifies is lost."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from typing import Any


def nearest_choice(value: Decimal, choices: list[Decimal], upper: bool) -> Decimal | None:
    """The next choice outwards, or None where even the last one would cut."""
    fitting = [c for c in choices if (c >= value if upper else c <= value)]
    return (min if upper else max)(fitting, default=None)


def nearest_step(value: Decimal, low: Decimal, high: Decimal, step: Decimal, upper: bool) -> Decimal | None:
    if step <= 0:
        raise ValueError("steps must be positive")
    if value > high if upper else value < low:
        return None
    way = ROUND_CEILING if upper else ROUND_FLOOR
    return min(high, max(low, low + step * ((value - low) / step).to_integral_value(way)))


@dataclass(frozen=True)
class Param:
    """One axis of a source: a list of choices, a grid, or a mapping for sets."""

    axis: str
    name: str
    upper: bool = True
    divisor: int = 1
    choices: tuple[Any, ...] = ()
    grid: tuple[Any, Any, Any] | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    template: str = "{}"

    def render(self, value: Any) -> dict[str, list[str]] | None:
        """Parameters, or None where the source can't express the value (everything is fetched then)."""
        if value is None or value == []:
            return None
        if self.mapping:
            found = [self.mapping.get(v) for v in value]
            return None if None in found else {self.name: list(dict.fromkeys(found))}
        number = Decimal(str(value)) / self.divisor
        if self.grid:
            placed = nearest_step(number, *(Decimal(str(x)) for x in self.grid), self.upper)
        else:
            placed = nearest_choice(number, [Decimal(str(c)) for c in self.choices], self.upper)
        if placed is None:
            return None
        text = self.template.format(placed)
        if self.codes and text not in self.codes:
            raise ValueError(f"{self.axis}: no code for {text}")
        return {self.name: [self.codes.get(text, text)]}


def query(params: list[Param], must: dict[str, Any]) -> list[tuple[str, str]]:
    """All renderable axes in order of their names."""
    made = [p.render(must.get(p.axis)) for p in sorted(params, key=lambda p: p.axis)]
    return [(name, v) for m in made if m for name, values in m.items() for v in values]
