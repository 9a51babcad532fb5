"""Where logs lie: the folders of each harness, from the environment or below the home folder."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each harness the variable that lists its folders, the default below the home folder, and the folders of
# logs in them.
HOMES = {
    "claude": ("CLAUDE_CONFIG_DIR", ".claude", ("projects",)), "codex": ("CODEX_HOME", ".codex", ("sessions", "archived_sessions")), "pi": ("PI_CODING_AGENT_DIR", ".pi/agent", ("sessions",)),
    "grok": ("GROK_HOME", ".grok", ("sessions",)), "muse": ("MUSE_HOME", ".local/share/muse", ("sessions",)),
}


def source_roots(environ: Mapping[str, str], home: str) -> list[tuple[str, str]]:
    """(harness, folder) to be read, each once: the variable's folders (a comma list; ~ is the home folder), or the default
    one. A folder that is one of logs already is taken as it is."""
    found: dict[tuple[str, str], None] = {}
    for harness, (variable, default, inner) in HOMES.items():
        data = environ.get("XDG_DATA_HOME") if harness == "muse" else None
        given = [x for x in (v.strip() for v in environ.get(variable, "").split(",")) if x] or [os.path.join(data, "muse") if data else os.path.join(home, default)]
        for root in given:
            path = os.path.normpath(home if root == "~" else os.path.join(home, root[2:]) if root.startswith("~/") else os.path.abspath(root))
            for folder in [path] if os.path.basename(path) in inner else [os.path.join(path, name) for name in inner]:
                found[harness, folder] = None
    return list(found)


def grok_project(file: str = "file") -> Column:
    """The project that a session's folder names: .../<encoded absolute path>/<session>/<file>; null if it names none."""
    decoded = F.try_url_decode(F.try_element_at(F.split(file, "/"), F.lit(-3)))
    return F.when(decoded.startswith("/"), decoded)
