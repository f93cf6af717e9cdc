import importlib

import __spark_entry__
from tests.compare import same

SF = "/root/testdata/sf0.001"


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    same(found["agg_hash"](spark, SF), SF, __spark_entry__.oracle_sql()["agg_hash"])


def test_registries_without_the_corpus_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("tidemill.llm", "corpus_pipeline")) else real(name, *a))
    assert "agg_hash" in __spark_entry__.queries() and not any(n.startswith("op") or n == "pipeline" for n in __spark_entry__.queries())
    assert not any(n.startswith("op") for n in __spark_entry__.oracle_sql())
