"""Run queries beside their SQL: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402
from earshot.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
names = sys.argv[2:]
spark = local_session("check", 8)
sf_dir = f"/root/testdata/sf{sf}"
con = connect(sf_dir)
sqls = entry.oracle_sql()
bad = 0
for name, build in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = build(spark, sf_dir)
        if name in sqls:
            found = differences(df, con, sqls[name])
        else:
            found = []
            print("  no sql, rows", df.count())
    except Exception as e:  # noqa: BLE001
        found = [f"{type(e).__name__}: {str(e)[:1500]}"]
    bad += bool(found)
    print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
    for f in found:
        print("   ", f)
print("bad:", bad)
