"""The driver's contract, with and without the training-data subpackage."""

import builtins
import importlib
import sys

import __spark_entry__ as entry
import pytest
from plumbline import catalog


def test_entry_has_rows(spark):
    got = entry.entry(spark)
    assert got.columns == ["img", "band", "target", "rendered"] and got.count() == 30


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith(("corpus_pipeline", "plumbline.llm")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    try:
        alone = importlib.reload(entry)
        assert set(alone.queries()) == set(catalog.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(sys.modules["__spark_entry__"])


def test_entry_does_not_hide_what_the_subpackage_needs(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    try:
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(entry)
    finally:
        monkeypatch.undo()
        importlib.reload(sys.modules["__spark_entry__"])
