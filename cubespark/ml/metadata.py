"""What is known of a model: its inputs, outputs and hyperparameters, as STAC properties of the MLM extension."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

EXTENSION = "https://stac-extensions.github.io/mlm/v1.5.1/schema.json"


@dataclass
class Structure:
    """The shape, the dimensions' order, and the type of an input or a result."""

    shape: list[int]
    dim_order: list[str]
    data_type: str = "float64"

    def to_dict(self) -> dict:
        return {"shape": self.shape, "dim_order": self.dim_order, "data_type": self.data_type}

    @classmethod
    def from_dict(cls, d: dict) -> Structure:
        return cls(list(d["shape"]), list(d["dim_order"]), d.get("data_type", "float64"))


@dataclass
class ModelInput:
    name: str
    bands: list[str]
    input: Structure

    def to_dict(self) -> dict:
        return {"name": self.name, "bands": self.bands, "input": self.input.to_dict()}

    @classmethod
    def from_dict(cls, d: dict) -> ModelInput:
        return cls(d["name"], list(d.get("bands", [])), Structure.from_dict(d["input"]))


@dataclass
class ModelOutput:
    name: str
    tasks: list[str]
    result: Structure
    classes: list[dict] | None = None

    def to_dict(self) -> dict:
        d: dict[str, Any] = {"name": self.name, "tasks": self.tasks, "result": self.result.to_dict()}
        if self.classes is not None:
            d["classification:classes"] = self.classes
        return d

    @classmethod
    def from_dict(cls, d: dict) -> ModelOutput:
        return cls(d["name"], list(d["tasks"]), Structure.from_dict(d["result"]), d.get("classification:classes"))


@dataclass
class MLModel:
    """An estimator (a Spark ML estimator or a network), what it became by training, and its metadata."""

    name: str
    architecture: str
    tasks: list[str]
    framework: str
    framework_version: str = ""
    estimator: Any = None
    fitted: Any = None
    dimension: list[str] = field(default_factory=lambda: ["bands"])
    hyperparameters: dict = field(default_factory=dict)
    feature_names: list[str] = field(default_factory=list)
    inputs: list[ModelInput] = field(default_factory=list)
    outputs: list[ModelOutput] = field(default_factory=list)
    parameters: int | None = None
    classes: list | None = None
    bbox: list[float] | None = None
    hull: list | None = None

    @property
    def trained(self) -> bool:
        return self.fitted is not None

    @property
    def n_features(self) -> int:
        return len(self.feature_names)

    def __repr__(self) -> str:
        return f"MLModel({self.name}, {self.architecture}, {'trained' if self.trained else 'untrained'})"

    def to_stac_properties(self) -> dict:
        p: dict[str, Any] = {"mlm:name": self.name, "mlm:architecture": self.architecture, "mlm:tasks": self.tasks, "mlm:framework": self.framework, "mlm:input": [i.to_dict() for i in self.inputs], "mlm:output": [o.to_dict() for o in self.outputs]}
        optional = {"mlm:framework_version": self.framework_version, "mlm:total_parameters": self.parameters, "mlm:hyperparameters": self.hyperparameters}
        return p | {k: v for k, v in optional.items() if v}

    def to_stac_item(self, item_id: str, href: str) -> dict:
        geometry = {"type": "Polygon", "coordinates": [[list(v) for v in self.hull]]} if self.hull else None
        item: dict[str, Any] = {
            "type": "Feature", "stac_version": "1.0.0", "stac_extensions": [EXTENSION], "id": item_id, "geometry": geometry,
            "properties": {"datetime": None} | self.to_stac_properties(), "links": [],
            "assets": {"model": {"href": href, "roles": ["mlm:model"], "type": "application/octet-stream"}},
        }
        if self.bbox:
            item["bbox"] = self.bbox
        return item

    @classmethod
    def from_stac_properties(cls, p: dict) -> MLModel:
        return cls(
            p["mlm:name"], p["mlm:architecture"], list(p["mlm:tasks"]), p["mlm:framework"], p.get("mlm:framework_version", ""),
            hyperparameters=p.get("mlm:hyperparameters", {}), parameters=p.get("mlm:total_parameters"),
            inputs=[ModelInput.from_dict(d) for d in p.get("mlm:input", [])], outputs=[ModelOutput.from_dict(d) for d in p.get("mlm:output", [])],
        )
