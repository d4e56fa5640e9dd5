import importlib.util
import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_queries_and_sql_agree_in_names():
    e = entry()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p5_found"} <= set(e.queries())


def test_works_without_llm(monkeypatch):
    for k in [k for k in sys.modules if k.startswith("terrane.llm")]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "terrane.llm", None)
    e = entry()
    assert "p2_found" in e.queries() and "p1_found" not in e.queries() and e.oracle_sql()


def test_only_the_subpackage_may_lack(monkeypatch):
    if importlib.util.find_spec("terrane.llm") is None:
        return
    for k in [k for k in sys.modules if k.startswith("terrane.llm")]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "regex", None)
    with pytest.raises(ImportError):
        entry().queries()


def test_staged_tables_go(spark):
    from terrane import session

    with session.staging(spark):
        path = session.staged(spark.range(3)).inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_nothing_imports_llm():
    for folder, _, files in os.walk(f"{ROOT}/terrane"):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(from|import) terrane\.llm", open(f"{folder}/{f}").read(), re.M), f


def test_flagship(spark):
    d = "/root/testdata/sf0.001"
    if os.path.isdir(d):
        assert entry().entry(spark).count() > 0
