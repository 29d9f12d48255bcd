"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import spans
from maskloom.plans import catalog
from maskloom.session import local_session

#: One of each kind: flagship, detection, numbering, splicing, organizations, joins by position, evaluation.
HEADLINE = (
    "flagship", "email_hits", "card_hits_luhn", "span_offsets", "code_numbers", "masked_text_md5", "restored_equals", "cn_mobile", "cn_date_mask", "amount_collision",
    "org_peeled_alias", "offset_to_block", "overlap_resolve", "evaluation_counts", "chunks_6000_50", "locate_6000_50_3",
)


def locate_6000_50_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6,000 blocks, each searched for 50 organizations by three names."""
    names = [x for i in range(50) for x in (f"北京第{i}新能源科技有限公司", f"第{i}新能源", f"京能{i}")]
    i = F.col("id") % 50
    text = F.concat(F.lit("本合同由北京第"), i.cast("string"), F.lit("新能源科技有限公司（以下简称“京能"), i.cast("string"), F.lit("”）与第"), ((i + 7) % 50).cast("string"), F.lit("新能源签订，双方按约定交货并付款。"))
    return spark.range(6000).select("id", F.explode(spans.located_any(text, names, "公司")).alias("s")).select("id", "s.start", "s.end", "s.surface")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: (catalog.queries() | {"flagship": catalog.flagship, "locate_6000_50_3": locate_6000_50_3})[n] for n in HEADLINE}
    took: dict[str, float] = {}
    for name, f in todo.items():
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            f(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    said = {"metric": "total of the headline queries, best of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(said))
    spark.stop()


if __name__ == "__main__":
    main()
