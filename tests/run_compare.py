"""Compare queries with their SQL: python tests/run_compare.py [folder] [query ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from ticketlens.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                n = len(df.collect())  # a count would leave the columns out
                problem = None if n else "no rows"
                name += f" [rows only: {n}]"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
