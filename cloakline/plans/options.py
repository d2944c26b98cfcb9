"""Scan options and presets; options choose which branches a plan has, so what is off costs nothing."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.patterns import CATEGORIES, CATEGORY_OF

THRESHOLDS = {"high": 0.80, "medium": 0.55}


@dataclass(frozen=True)
class Options:
    strict_email: bool = True
    detect_names: bool = True
    detect_faces: bool = True
    image_mode: str = "standard"
    confidence: str = "high"
    categories: frozenset[str] = field(default_factory=lambda: frozenset(CATEGORIES))

    def on(self, label: str) -> bool:
        """Whether a label's category is on; labels of no category always are."""
        return CATEGORY_OF.get(label, "other") in self.categories | {"other"}

    @property
    def threshold(self) -> float:
        return THRESHOLDS["medium" if self.confidence == "medium" else "high"]

    def broad(self) -> Options:
        """Everything on, for a diagnosis of what a narrow scan mutes."""
        return replace(self, detect_names=True, confidence="medium", categories=frozenset(CATEGORIES))


# The presets.
PRESETS = {
    "llm_safe": Options(),
    "paranoid": Options(image_mode="document_safe", confidence="medium"),
    "balanced": Options(confidence="medium"),
    "secrets_only": Options(detect_names=False, detect_faces=False, categories=frozenset({"network", "secrets"})),
    "structured_pii": Options(image_mode="document_safe", confidence="medium", categories=frozenset({"pii", "identity", "financial"})),
}
