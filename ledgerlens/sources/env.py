"""Reader of ``KEY=VALUE`` files; nothing is put into the process environment."""

from __future__ import annotations

from pathlib import Path


def load_env_file(path) -> dict[str, str]:
    file = Path(path)
    if not file.exists():
        return {}
    out = {}
    for line in file.read_text(encoding="utf-8").splitlines():
        line = line.strip()
        key, sign, value = line.partition("=")
        if not sign or line.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip().removeprefix("export ").strip()] = value
    return out
