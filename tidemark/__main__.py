"""python -m tidemark query|plan|count|serve: the engine over a folder of tables.

query SQL                          a statement over project ``app`` (tables app_deu and fix_app)
plan FILE                          a JSON logical plan
count FIRST LAST [--mode M]        rows of the event table between two days, of the hot side, the cold side, or both
serve [--port N]                   the HTTP server
"""

from __future__ import annotations

import argparse
import time

from .operators.scan import MODES, merged, scan
from .plans.dialect import Engine
from .plans.logical import Runner
from .session import session
from .sources.events import from_table, stores


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data", required=True, help="folder with events.parquet and customer.parquet")
    p.add_argument("--hot", help="folder with events that aren't in --data yet")
    p.add_argument("--project", default="app")
    p.add_argument("--rows", type=int, default=100, help="rows to print")
    to = p.add_subparsers(dest="what", required=True)
    to.add_parser("query").add_argument("sql")
    to.add_parser("plan").add_argument("file")
    count = to.add_parser("count")
    count.add_argument("first")
    count.add_argument("last")
    count.add_argument("--mode", choices=MODES, default="both")
    to.add_parser("serve").add_argument("--port", type=int, default=9999)
    a = p.parse_args(argv)
    spark = session()
    if a.what == "plan":
        Runner(spark).run_file(a.file).show(a.rows, truncate=False)
        return 0
    events, properties = stores(spark, a.data)
    if a.what == "count":
        began = time.time()
        hot = scan(from_table(spark.read.parquet(f"{a.hot}/events.parquet")), first=a.first, last=a.last) if a.hot else None
        n = merged(hot, scan(events, first=a.first, last=a.last), a.mode, key=["event_id"]).count()
        print(f"{n} rows, {time.time() - began:.2f} s")
        return 0
    engine = Engine(spark).add(a.project, events, properties)
    if a.what == "query":
        engine.frame(a.sql).show(a.rows, truncate=False)
        return 0
    from .server import QueryServer

    server = QueryServer(engine, port=a.port).start()
    print(f"listening on {server.port}")
    server._thread.join()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
