"""Types, enumerations and thresholds of the hyperedge model."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTITY = "struct<type:string,value:string>"
RELATION = "struct<source:string,type:string,target:string>"
EXPERIMENT = f"""id string, ord long, name string, input_entities array<{ENTITY}>, process_entities array<{ENTITY}>,
output_entities array<{ENTITY}>, relations array<{RELATION}>, evidence array<string>, confidence double, year int,
geography string, source_type string, is_sensitive boolean"""
EVENT = f"event_id string, event_type string, experiment_id string, occurred_at timestamp, payload_version int, source string, experiment struct<{','.join(c.strip().replace(' ', ':', 1) for c in EXPERIMENT.replace(chr(10), ' ').split(', '))}>"
OUTBOX = """event_id string, event_type string, experiment_id string, payload_version int, source string, payload_json string,
status string, attempts int, message_id string, error_message string, occurred_at timestamp, created_at timestamp, updated_at timestamp"""

# Fixed values of the model.
ENTITY_TYPES = ["Material", "Process", "Equipment", "Property", "Expert", "Facility", "Publication"]
DOMAIN_TYPES = ["Material", "Process", "Equipment", "Property", "Facility"]
RELATION_TYPES = ["uses_material", "operates_at_condition", "produces_output", "located_at", "described_in", "validated_by", "contradicts"]
RELATION_ALIASES = {
    "used_at": "located_at",
    "located_in": "located_at",
    "located_on": "located_at",
    "used_with": "uses_material",
    "uses": "uses_material",
    "has_condition": "operates_at_condition",
    "operates_at": "operates_at_condition",
    "operates_under": "operates_at_condition",
    "produces": "produces_output",
    "produces_result": "produces_output",
    "described_by": "described_in",
    "documented_in": "described_in",
    "mentioned_in": "described_in",
}
CHUNK_STATUSES = ["ok", "skipped", "restored", "validation_failed", "moderation", "empty", "graph_sync_failed", "graph_sync_deferred"]
OUTBOX_STATUSES = ["pending", "published", "acked", "dead_letter"]
GENERIC_VALUES = ["завод", "оборудование", "руда", "руды", "рудой", "автор", "мосты", "пицца", "погода", "аргон", "метан", "пар", "ванна", "щелок", "экстракт", "электрум", "электроды", "катоды", "примеси", "рудник", "рудное", "олеум", "бор"]
BUNDLE_WEIGHTS = {"Material": 2, "Process": 2}
DIMENSION_CAPS = {1: 500, 2: 100, 3: 20}
DIMENSION_CAP_REST = 10


# The gate's thresholds and the rerank's weights.
@dataclass(frozen=True)
class GateThresholds:
    low: float = 0.08
    top: float = 0.05
    modest: float = 0.25
    margin: float = 0.02
    margin_overlap: float = 0.05
    margin_top: float = 0.20
    family_top: float = 0.10
    family_overlap: float = 0.20
    clarify_high: float = 0.15


@dataclass(frozen=True)
class RerankWeights:
    similarity: float = 0.72
    entity: float = 0.12
    metric: float = 0.05
    graph: float = 0.05
    source: float = 0.03
    raw: float = 0.15


@dataclass(frozen=True)
class SearchFilter:
    year_start: int | None = None
    year_end: int | None = None
    geography: str | None = None
    source_type: str | None = None
    exclude_sensitive: bool = False
    extra: dict = field(default_factory=dict)
