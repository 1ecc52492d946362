"""Roles of columns: sample id, match id, label, weight; all others are features."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RoleSchema:
    sample_id: str
    match_id: str | None = None
    label: str | None = None
    weight: str | None = None
    features: tuple[str, ...] = ()
    site: str = "local"

    @property
    def ids(self) -> list[str]:
        return [self.sample_id] + ([self.match_id] if self.match_id else [])

    @property
    def operable(self) -> list[str]:
        """What operators work on: the features; without any, the weight; without that, the label."""
        if self.features:
            return list(self.features)
        return [c for c in (self.weight, self.label) if c][:1]

    def all_columns(self) -> list[str]:
        return self.ids + [c for c in (self.label, self.weight) if c] + list(self.features)

    def anonymous(self) -> dict[str, str]:
        """Alias of each field for reports to other parties."""
        names = {self.sample_id: "sample_id"} | ({self.match_id: "match_id"} if self.match_id else {})
        names |= {c: n for c, n in ((self.label, "y"), (self.weight, "w")) if c}
        names |= {c: f"x{i}" for i, c in enumerate(self.features)}
        return {c: f"{self.site}_{n}" for c, n in names.items()}

    def with_features(self, features) -> RoleSchema:
        return replace(self, features=tuple(features))
