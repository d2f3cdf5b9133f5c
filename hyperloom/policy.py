"""Who may do what. An unknown role may do nothing."""

from __future__ import annotations

from dataclasses import dataclass

ROLES = ("Administrator", "Analyst", "Researcher", "External Partner")
ALLOWED = {
    "search": ROLES,
    "experiments": ROLES,
    "documents": ROLES,
    "statistics": ROLES,
    "graph": ROLES,
    "counterfactuals": ("Administrator", "Analyst", "Researcher"),
    "gaps": ("Administrator", "Analyst", "Researcher"),
    "reason": ("Administrator", "Analyst"),
    "enrich_gap": ("Administrator", "Analyst"),
    "ingest": ("Administrator", "Researcher"),
    "audit_logs": ("Administrator",),
}


@dataclass(frozen=True)
class Session:
    username: str
    role: str

    def require(self, action: str) -> None:
        if self.role not in ALLOWED[action]:
            raise PermissionError(f"{self.role or 'nobody'} may not use {action}")

    @property
    def sees_sensitive(self) -> bool:
        return self.role in ROLES and self.role != "External Partner"
