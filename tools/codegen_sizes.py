"""Largest generated method per whole-stage-codegen subtree of each registered query.

HotSpot does not JIT methods above 8000 bytes of bytecode; such stages run interpreted.
Usage: python tools/codegen_sizes.py [sf_dir] [name ...]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from punchspark.plans.queries import REGISTRY  # noqa: E402
from punchspark.session import local_session  # noqa: E402

JIT_LIMIT = 8000


def sizes(df) -> list[int]:
    seq = df._jdf.queryExecution().debug().codegenToSeq()
    it = seq.iterator()
    out = []
    while it.hasNext():
        out.append(int(it.next()._3().maxMethodCodeSize()))
    return out


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session(2, shuffle_partitions=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: AQE hides the stages until run
    over = 0
    for n in names:
        s = sizes(REGISTRY[n](spark, sf))
        big = [x for x in s if x > JIT_LIMIT]
        over += bool(big)
        print(f"{n:28s} max={max(s) if s else 0:6d} stages={len(s):3d} {'OVER ' + str(big) if big else ''}")
    return 1 if over else 0


if __name__ == "__main__":
    sys.exit(main())
