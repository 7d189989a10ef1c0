import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p4_found", "p6_found"} <= set(entry.queries())


def test_the_core_does_not_need_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for f in (root / "skein").rglob("*.py"):
        if "llm" not in f.parts:
            assert "skein.llm" not in f.read_text(), f


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["budget", "path", "kept", "level", "tokens", "no_skeleton"] and df.count() > 0
