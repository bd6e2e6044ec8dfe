"""The library stands without the training-data operators."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_llm():
    for path in (ROOT / "colloq").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


def test_entry_registers_queries():
    import __spark_entry__

    names, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(names) >= 70 and set(oracles) <= set(names)
