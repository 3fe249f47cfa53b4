"""Run every (or the named) registry keys against DuckDB: python tests/run_oracle.py [sf_dir] [key...]"""

import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

from corpusforge.plans.registry import load_all  # noqa: E402
from corpusforge.session import get_spark  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    reg = load_all()
    keys = [k for k in reg if not args or any(k.startswith(a) for a in args)]
    spark = get_spark(8)
    con = duck(sf)
    summary = {}
    for k in keys:
        q = reg[k]
        t = time.time()
        try:
            r = compare(spark, k, q.build, q.sql, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "ERROR", "error": "".join(traceback.format_exception_only(e))[-600:]}
        r["sec"] = round(time.time() - t, 2)
        summary[k] = r["status"]
        print(json.dumps(r, default=str)[:1500], flush=True)
    bad = {k: s for k, s in summary.items() if s not in ("match", "rows-only")}
    print("TOTAL", len(summary), "BAD", len(bad), bad)
