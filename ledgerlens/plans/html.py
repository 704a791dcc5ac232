"""The report as one HTML file with its data inside."""

from __future__ import annotations

import json
from pathlib import Path

SENTINEL = "__TRIAGE_DATA__"
TEMPLATE = Path(__file__).resolve().parent.parent / "data" / "report.html"


def embedded(data: dict) -> str:
    """JSON that can't close the script element it stands in."""
    return json.dumps(data, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "\\u003c!--")


def render(data: dict, template=TEMPLATE, text: str | None = None) -> str:
    """``text``: the template itself, for tasks that have no file of it."""
    text = Path(template).read_text(encoding="utf-8") if text is None else text
    if SENTINEL not in text:
        raise ValueError(f"{template}: no place for the data ({SENTINEL})")
    return text.replace(SENTINEL, embedded(data))
