"""Log lines as JSON objects, to the console and, if wanted, to a file."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["error"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False)


def configure(level: str = "INFO", path: str = "", name: str = "reelspark") -> logging.Logger:
    """The engine's logger, with fresh handlers: calling it again replaces them."""
    log = logging.getLogger(name)
    log.setLevel(level.upper())
    log.handlers[:] = [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]
    for h in log.handlers:
        h.setFormatter(JsonLines())
    return log
