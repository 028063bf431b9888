import builtins
import sys

import pytest

import __spark_entry__ as entry


def test_every_query_has_columns_like_its_sql(spark, tiny):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 40
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("missing", ["webgauge.llm", "corpus_pipeline", "xxhash"])
def test_llm_is_optional(monkeypatch, missing):
    for name in [n for n in sys.modules if n == missing or n.startswith(("webgauge.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def without(name, *args, **more):
        if name == missing or name.startswith(f"{missing}.") or missing == "webgauge.llm" and name == "webgauge" and "llm" in (args[2] if len(args) > 2 else ()) or ():
            raise ImportError(name)
        return real(name, *args, **more)

    monkeypatch.setattr(builtins, "__import__", without)
    assert not any(name.startswith("op") or name == "pipeline" for name in entry.queries())
    assert len(entry.queries()) >= 40 and entry.oracle_sql()
