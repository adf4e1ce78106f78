"""The engine as a process: ``python -m quillsift.plans.service CONFIG``.

The configuration has a line ``name = value`` for each setting; ``#`` begins a comment.  The
process serves requests until it is told to stop (SIGINT or SIGTERM); then it takes no more,
ends those under way and closes the engine.
"""

from __future__ import annotations

import logging
import signal
import sys
import threading
from collections.abc import Mapping

from pyspark.sql import SparkSession

from .engine import Engine
from .routes import server

LOG = logging.getLogger("quillsift")
DEFAULTS = {"root": "", "host": "127.0.0.1", "port": "9528", "merge_at": "100000", "max_segments": "16", "keep_seconds": "3600", "log_level": "INFO"}


def read_config(text: str) -> dict[str, str]:
    """Settings with their defaults; an unknown one, or a line that is none, is an error."""
    out = dict(DEFAULTS)
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#")[0].strip()
        if not line:
            continue
        name, eq, value = (x.strip() for x in line.partition("="))
        if not eq or name not in DEFAULTS:
            raise ValueError(f"line {number}: no setting {name!r}")
        out[name] = value
    if not out["root"]:
        raise ValueError("root is not set")
    return out


def run(spark: SparkSession, config: Mapping[str, str], stop: threading.Event, ready: threading.Event | None = None) -> None:
    """Serve until ``stop`` is set."""
    c = DEFAULTS | dict(config)
    with Engine(spark, c["root"], int(c["merge_at"]), max_segments=int(c["max_segments"]), keep_seconds=float(c["keep_seconds"])) as engine:
        web = server(engine, c["host"], int(c["port"]))
        web.daemon_threads = False  # so that closing waits for them
        thread = threading.Thread(target=web.serve_forever)
        thread.start()
        LOG.info("serving %s on port %s", c["root"], web.server_address[1])
        if ready is not None:
            ready.set()
        stop.wait()
        LOG.info("stopping")
        web.shutdown()
        thread.join()
        web.server_close()  # waits for the requests under way


def main(args: list[str]) -> None:
    with open(args[0], encoding="utf-8") as f:
        config = read_config(f.read())
    logging.basicConfig(level=config["log_level"], format="%(asctime)s %(levelname)s %(message)s")
    stop = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: stop.set())
    spark = SparkSession.builder.appName("quillsift").getOrCreate()
    run(spark, config, stop)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
