"""Run the comparison from the command line: ``run_compare.py folder [query …]``."""

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from compare import difference, duck, rows_of  # noqa: E402

from tallyframe.plans import all_queries, all_sql  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

folder = sys.argv[1]
spark = local_session("8")
queries, sql = all_queries(), all_sql()
con = duck(folder)
bad = 0
for name in sys.argv[2:] or queries:
    start = time.time()
    try:
        if name in sql:
            found = difference(spark, folder, con, queries[name], sql[name])
            note = "same" if found is None else f"DIFFERENT {found}"
            bad += found is not None
        else:
            df = queries[name](spark, folder)
            note = f"no SQL, {len(rows_of(df.columns, df.collect()))} rows"
    except Exception as error:  # noqa: BLE001
        note, bad = f"FAILED {str(error)[:1500]}", bad + 1
        if len(sys.argv) > 2:
            traceback.print_exc()
    print(f"{name:32} {time.time() - start:6.2f}s {note}", flush=True)
print(f"{bad} bad")
