"""The core does not need the training-text subpackage, and the entry points hold together."""

import importlib.util
import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "quireflow").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "localCheckpoint(" not in "".join(p.read_text() for p in (ROOT / "quireflow").rglob("*.py"))


def test_training_text_queries_are_registered_only_with_their_package():
    there = importlib.util.find_spec("quireflow.llm") is not None
    assert ("p1_found" in entry.queries()) == there


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["document_id", "page_index", "block_id", "rule"] and df.count() > 0
