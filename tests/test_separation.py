"""The library without its training-data subpackage."""

import ast
import pathlib
import subprocess
import sys
import textwrap

ROOT = pathlib.Path(__file__).resolve().parents[1]


def library_files():
    return [p for p in (ROOT / "promospark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_no_module_imports_the_subpackage():
    for path in library_files():
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else \
                [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("promospark.llm") for n in names), path


def test_every_module_and_the_entry_import_with_the_subpackage_blocked():
    modules = sorted(".".join(p.relative_to(ROOT).with_suffix("").parts).removesuffix(".__init__") for p in library_files())
    code = textwrap.dedent(f"""
        import importlib, sys
        class Block:
            def find_spec(self, name, path=None, target=None):
                if name.startswith(("promospark.llm", "corpus_pipeline")):
                    raise ModuleNotFoundError(name, name=name)
        sys.meta_path.insert(0, Block())
        sys.path.insert(0, {str(ROOT)!r})
        for name in {modules!r}:
            importlib.import_module(name)
        import __spark_entry__ as entry
        found = entry.queries()
        assert "ktc_pages" in found and not any(n.startswith("op") and n[2].isdigit() for n in found), sorted(found)
        assert "pipeline" not in found
    """)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
