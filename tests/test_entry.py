"""The registry without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry


def test_others_stay_without_optional_imports(monkeypatch):
    """A package that the optional queries need is missing: all other queries are still there."""
    every = set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("presage.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    left = set(entry.queries())
    assert left == {n for n in every if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())}
    assert "pooled_forecasts" in left and set(entry.oracle_sql()) <= left
    monkeypatch.undo()
    importlib.invalidate_caches()
    assert set(entry.queries()) == every
