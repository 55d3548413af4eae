"""Print the formatted physical plan of registered queries, plus a one-line shape summary.

usage: python tools/explain.py <query> [<query> ...] [--sf DIR]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

from tsengine.plans.catalog import QUERIES  # noqa: E402
from tsengine.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf_dir = args[i + 1]
        args = args[:i] + args[i + 2 :]
    spark = local_session(8)
    for name in args:
        df = QUERIES[name](spark, sf_dir)
        df.explain("formatted")
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(
            f"== {name}: exchanges={plan.count('Exchange ')} windows={plan.count('Window [')} "
            f"python={plan.count('Python') + plan.count('ArrowEval')} broadcasts={plan.count('BroadcastExchange')}"
        )


if __name__ == "__main__":
    main()
