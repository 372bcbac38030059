"""Command line: python tests/check_oracle.py SF [name-prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from storyloom.session import local_session  # noqa: E402


def main():
    folder, wanted = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = local_session("8")
    con = oracle.connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = oracle.compare(spark, con, fn, sqls[name], folder)
            else:
                problem = None if fn(spark, folder).count() > 0 else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.1f}s{'' if name in sqls else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{bad} failures of {len(queries)}")


if __name__ == "__main__":
    main()
