"""Structured log lines: one JSON object an event, with its seconds where it was timed."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

LOGGER = logging.getLogger("lexloom")


def event(name: str, **fields) -> None:
    LOGGER.info(json.dumps({"event": name, **fields}, ensure_ascii=False, default=str))


@contextmanager
def timed(name: str, **fields) -> Iterator[dict]:
    """Times the block; ``seconds`` of the yielded dict is set when it ends, also by an error, which the line names."""
    out: dict = {}
    began = time.monotonic()
    try:
        yield out
    except BaseException as error:
        fields["error"] = type(error).__name__
        raise
    finally:
        out["seconds"] = time.monotonic() - began
        event(name, seconds=round(out["seconds"], 4), **fields)
