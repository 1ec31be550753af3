"""Batch and streaming regression scoring of CSV uploads on Spark."""

from meterloom.functions.dumps import load_dump, parse_dump
from meterloom.functions.models import (
    CategorySplit,
    Ensemble,
    Leaf,
    Linear,
    Split,
    Stack,
    SymmetricTree,
    Tree,
    load_model,
    save_model,
)
from meterloom.plans.score_files import run, score_files, status_table
from meterloom.session import build_session
from meterloom.sources.typed import read_uploads_typed
from meterloom.sources.uploads import read_uploads
from meterloom.streaming.uploads import score_stream

__all__ = [
    "CategorySplit", "Ensemble", "Leaf", "Linear", "Split", "Stack", "SymmetricTree", "Tree",
    "build_session", "load_dump", "load_model", "parse_dump", "read_uploads",
    "read_uploads_typed", "run", "save_model", "score_files", "score_stream", "status_table",
]
