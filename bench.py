"""Times the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from tessera.plans import registry
from tessera.session import build

NAMES = "agg_group_2 agg_count_distinct agg_having join_left join_4way join_multi_key sub_exists sub_not_in sub_corr_scalar topk distinct stats_columns mvcc_visible wal_replay".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: registry.QUERIES[n] for n in NAMES}
    try:
        from tessera.llm import queries as llm
    except ModuleNotFoundError:
        llm = None
    if llm is not None:
        queries |= llm.QUERIES
    registry.QUERIES["agg_count_star"](spark, folder).collect()  # start up
    seconds = {}
    for name, query in queries.items():
        began = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
