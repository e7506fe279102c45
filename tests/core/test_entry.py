import importlib
import sys

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_the_core_stands_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("mnestra.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def without(name, *rest):
        if name.startswith("mnestra.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    names = set(entry.queries())
    assert "p3_found" in names and "p4_found" in names and "p1_found" not in names
    assert set(entry.oracle_sql()) <= names


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["qid", "place", "node_id"] and df.count() > 0
