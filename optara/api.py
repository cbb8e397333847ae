"""The public surface: models, prediction, systems and building blocks in one place."""

from __future__ import annotations

from .operators.scorer import Config as ModelConfig
from .operators.scorer import Model as DecisionModel
from .operators.scorer import load as load_model
from .operators.scorer import predict, save
from .operators.systems import registry
from .plans.benchmark import report, stratified
from .plans.build import build
from .plans.loop import loop
from .sources.dump import read_products
from .sources.files import read_jsonl, write_jsonl

__all__ = ["DecisionModel", "ModelConfig", "build", "load_model", "loop", "predict", "read_jsonl", "read_products", "registry", "report", "save", "stratified", "write_jsonl"]
