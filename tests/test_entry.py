"""The entry point works without the corpus package."""

import builtins
import sys

import __spark_entry__ as entry


def test_queries_without_the_corpus_package(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("engram.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="corpus_pipeline" if name == "corpus_pipeline" else "engram.llm")
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("engram.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    names = entry.queries()
    assert entry.FLAGSHIP in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_corpus_package():
    from pathlib import Path
    root = Path(entry.__file__).parent
    for f in [*root.glob("engram/**/*.py"), root / "bench.py"]:
        if "llm" not in f.parts:
            assert "llm" not in [w for line in f.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()], f
