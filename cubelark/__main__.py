"""``python -m cubelark CATALOG.json agg NAME PATH AXES VARIABLES`` | ``list`` | ``run REQUEST [RESPONSE [PATH]]``.

``AXES`` is like ``t=time,y=lat``; ``VARIABLES`` a list with commas.
"""

from __future__ import annotations

import json
import os
import sys

from cubelark.engine import Engine
from cubelark.session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[1] not in ("agg", "list", "run"):
        print(__doc__)
        return 2
    engine = Engine(session())
    if os.path.exists(args[0]):
        engine.catalog.load(args[0])
    if args[1] == "agg":
        name, path, axes, variables = args[2:6]
        engine.catalog.register(name, path, dict(a.split("=") for a in axes.split(",")), variables.split(","))
        engine.catalog.save(args[0])
    elif args[1] == "list":
        print(json.dumps(engine.capabilities("variables"), indent=1))
    else:
        print(json.dumps(engine.execute(args[2], args[3] if len(args) > 3 else "dict", args[4] if len(args) > 4 else None), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
