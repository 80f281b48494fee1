"""Input lists: files, directories, globs, comma lists, JSON arrays, and list files; first-seen order, each once."""

from __future__ import annotations

import glob
import json
import os

#: Names that end so are lists of inputs.
LIST_SUFFIXES = (".txt", ".list", ".manifest", ".uris")
LIMIT = 1_000_000


def resolve(spec: str, suffix: str = ".parquet") -> list[str]:
    """The inputs that a specification names. Explicit names and URIs are not probed; a glob or folder without matches is an error."""
    found: dict[str, None] = {}

    def add(item: str, seen: tuple[str, ...] = ()) -> None:
        item = item.strip()
        if not item or item.startswith("#"):
            return
        if item.startswith("["):
            for x in json.loads(item):
                add(str(x), seen)
        elif "," in item:
            for x in item.split(","):
                add(x, seen)
        elif item.startswith("@") or item.endswith(LIST_SUFFIXES):
            name = item.lstrip("@")
            if name in seen:
                raise ValueError(f"{name} lists itself")
            with open(name) as lines:
                for line in lines:
                    add(line, (*seen, name))
        elif "://" not in item and any(c in item for c in "*?["):
            if not (names := sorted(glob.glob(item))):
                raise FileNotFoundError(item)
            found.update(dict.fromkeys(names))
        elif "://" not in item and os.path.isdir(item) and not item.endswith(suffix):
            names = sorted(os.path.join(item, n) for n in os.listdir(item) if n.endswith(suffix))
            if not names:
                raise FileNotFoundError(item)
            found.update(dict.fromkeys(names))
        else:
            found[item] = None
        if len(found) > LIMIT:
            raise ValueError(f"more than {LIMIT} inputs")

    add(spec)
    if not found:
        raise FileNotFoundError(spec)
    return list(found)
