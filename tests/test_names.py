"""Names that one module takes from another exist there; a query that is only built when it runs would hide that."""

import ast
import importlib
from pathlib import Path

import fieldbook

ROOT = Path(fieldbook.__file__).parent


def test_modules_have_what_others_take_from_them():
    missing = []
    for f in sorted(ROOT.rglob("*.py")):
        if f.relative_to(ROOT).parts[0] == "llm":
            continue
        tree, modules = ast.parse(f.read_text()), {}
        for n in ast.walk(tree):
            if isinstance(n, ast.ImportFrom) and (n.module or "").startswith("fieldbook"):
                source = importlib.import_module(n.module)
                for a in n.names:
                    if (ROOT.parent / n.module.replace(".", "/") / f"{a.name}.py").exists():
                        modules[a.asname or a.name] = importlib.import_module(f"{n.module}.{a.name}")
                    elif not hasattr(source, a.name):
                        missing.append((f.name, a.name))
        missing += [(f.name, n.value.id, n.attr) for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in modules and not hasattr(modules[n.value.id], n.attr)]
    assert not missing
