"""python tests/runq.py SF NAME...: run queries, compare with their SQL, print times."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from millrace.session import local_session  # noqa: E402
from tests.oracle import compare  # noqa: E402

if __name__ == "__main__":
    d = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:]
    q, sql = entry.queries(), entry.oracle_sql()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names or sorted(q):
        t = time.time()
        try:
            df = q[n](spark, d)
            rows = df.count()
            took = time.time() - t
            if n in sql:
                compare(df, sql[n], d)
            print(f"{n}: {rows} rows, {took:.1f} s, {'equal' if n in sql else 'no sql'}", flush=True)
            if not n in sql:
                df.show(5, 80)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n}: FAILED {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("bad", bad)
