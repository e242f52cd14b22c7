"""CLI: compare every (or the named) query against its oracle.

python tests/check_oracles.py /root/testdata/sf0.01 [name ...]
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from moodweave.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok = True
    for n in names or list(qs):
        if n not in orc:
            t = time.time()
            rows = qs[n](spark, sf_dir).count()
            print(json.dumps({"name": n, "rows_only": rows, "sec": round(time.time() - t, 2)}))
            continue
        t = time.time()
        try:
            r = compare(spark, n, sf_dir, qs, orc, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:2000]}
        r["sec"] = round(time.time() - t, 2)
        ok &= bool(r.get("match"))
        print(json.dumps(r, default=str))
    print("ALL OK" if ok else "SOME FAILED")


if __name__ == "__main__":
    main()
