"""Settings of retrieval, read from the session's configuration under ``quern.``, so a job sets them with --conf or SET."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

_ON = ("1", "true", "yes", "on")


def words(text: str | None) -> list[str] | None:
    """The parts of a list with commas; None for an empty or absent one."""
    return [w.strip() for w in text.split(",") if w.strip()] if text else None


def is_on(text: str) -> bool:
    return text.strip().lower() in _ON


@dataclass(frozen=True)
class Settings:
    """``quern.retrieval.<name>`` sets a field. A number that can't be read leaves the default; of a switch, all but 1, true, yes and on means off."""

    gate: bool = True
    threshold: float = 0.45
    least_overlap: float = 0.10
    least_results: int = 1
    need_evidence: bool = True
    n_vector: int = 5
    n_graph: int = 10
    n_evidence: int = 5
    budget: int = 12000
    no_context: str = "No relevant context was found in the knowledge base. Answer using general knowledge only, and do not claim the answer comes from it."
    context: str = "Vector context is the primary source of facts; graph context shows how entities relate, and graph_evidence supports it. Say so if they conflict or hold no answer."

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        out = cls()
        for f in fields(cls):
            text = spark.conf.get(f"quern.retrieval.{f.name}", None)
            if text is None:
                continue
            kind = type(f.default)
            try:
                out = replace(out, **{f.name: is_on(text) if kind is bool else kind(text)})
            except ValueError:
                pass
        return out

    def rules(self) -> dict:
        """What the gate takes."""
        return {"threshold": self.threshold, "least_overlap": self.least_overlap, "least_results": self.least_results, "need_evidence": self.need_evidence}
