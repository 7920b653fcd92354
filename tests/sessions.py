"""One local Spark session for tests and comparisons."""

from __future__ import annotations

import os

from placelens.session import build_session


def local_session(cores: str = "8"):
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = build_session(
        "placelens-tests",
        **{
            "spark.master": f"local[{cores}]",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
