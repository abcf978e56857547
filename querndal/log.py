"""Logging of the package: one logger, to the console or a file, as text or JSON lines."""

from __future__ import annotations

import json
import logging

NAME = "querndal"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "name": record.name, "message": record.getMessage()}, ensure_ascii=False)


def configure(level: str = "INFO", path: str | None = None, form: str = "text") -> logging.Logger:
    """Set level, place and form of the package's log; called again it replaces what was set before."""
    if form not in ("text", "json"):
        raise ValueError(f"unknown form: {form}")
    logger = logging.getLogger(NAME)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonLines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.addHandler(handler)
    logger.setLevel(level.upper())
    logger.propagate = False
    return logger
