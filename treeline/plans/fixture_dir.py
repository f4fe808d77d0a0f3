"""A small deterministic folder to try commands on: eleven files, two of them equal."""

from __future__ import annotations

import os

MODULES = ("app", "auth", "billing", "cache", "models", "routes", "utils", "legacy_utils")


def demo(folder: str) -> list[str]:
    """Writes the sample and returns its paths."""
    files = {f"src/{name}.py": f'"""{name.replace("legacy_", "")}"""\n\n' + "".join(f"def step_{k}(x):\n    return x + {k}\n\n\n" for k in range(8)) for name in MODULES}
    files |= {"README.md": "# Sample\n", "data/empty.txt": "", "data/numbers.csv": "".join(f"{k},{k * k}\n" for k in range(50))}
    for path, text in files.items():
        full = os.path.join(folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)
    return sorted(files)
