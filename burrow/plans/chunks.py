"""Chunks of input files under limits of number and size."""

from __future__ import annotations

import hashlib
import json


def plan(files: list[tuple[str, int]], *, max_files: int, max_bytes: int) -> list[dict]:
    """Files in order, packed greedily; a file over the limit is a chunk of its own. Ids follow from the contents."""
    if max_files < 1 or max_bytes < 1:
        raise ValueError("limits must be positive")
    out: list[dict] = []
    now: list[tuple[str, int]] = []
    for name, size in files:
        if now and (len(now) >= max_files or sum(s for _, s in now) + size > max_bytes):
            out.append(chunk(now))
            now = []
        now.append((name, size))
    return [*out, chunk(now)] if now else out


def chunk(files: list[tuple[str, int]]) -> dict:
    named = hashlib.sha256(json.dumps(files).encode()).hexdigest()[:16]
    return {"chunk_id": named, "files": [n for n, _ in files], "bytes": sum(s for _, s in files)}
