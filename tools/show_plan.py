"""Print the plan of a registered query: the one Spark starts with, or with --final the one it ran.

Usage: python tools/show_plan.py query [sf_dir] [--final]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mascate.plans.registry import QUERIES  # noqa: E402
from mascate.session import local_session  # noqa: E402

args = [a for a in sys.argv[1:] if not a.startswith("--")]
spark = local_session()
df = QUERIES[args[0]](spark, args[1] if len(args) > 1 else "/root/testdata/sf0.1")
if "--final" in sys.argv:
    df.collect()
    print(df._jdf.queryExecution().executedPlan().toString())
else:
    df.explain("formatted")
