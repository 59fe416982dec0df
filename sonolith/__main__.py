"""python -m sonolith add|query|compact|inspect|describe|damaged --index PATH [--preset NAME] ARGUMENT"""

from __future__ import annotations

import argparse

from .api import Engine
from .presets import PRESETS
from .session import local_session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sonolith", description=__doc__)
    parser.add_argument("mode", choices=["add", "query", "compact", "inspect", "describe", "damaged"])
    parser.add_argument("argument", nargs="?", default="", help="folder, clip, target path or hash; none for damaged")
    parser.add_argument("--index", required=True)
    parser.add_argument("--preset", choices=sorted(PRESETS), default="landmark")
    parser.add_argument("--top", type=int, default=-1)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--skip-damaged", action="store_true")
    parser.add_argument("--full", action="store_true")
    parser.add_argument("--cpus", type=int, default=8)
    given = parser.parse_args(args)
    engine = Engine(local_session(given.cpus), given.index, given.preset)
    if given.mode == "add":
        print(engine.add_segment(given.argument, given.force), "tracks")
    elif given.mode == "query":
        engine.query(given.argument, given.top, given.skip_damaged).orderBy("query_id", "rank").show(1000, truncate=False)
    elif given.mode == "compact":
        engine.compact(given.argument)
    elif given.mode == "damaged":
        engine.damaged(given.full).show(1000, truncate=False)
    else:
        (engine.inspect if given.mode == "inspect" else engine.describe)(given.argument).show(1000, truncate=False)


if __name__ == "__main__":
    main()
