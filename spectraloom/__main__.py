"""Command line: python -m spectraloom --psm_path ... --fragment_path ... --mzml_path ... --result_dir ..."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from .config import merged, write
from .plans.pipeline import run


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    config = merged(sys.argv[1:] if argv is None else argv)
    write(config, f"{config.result_dir}/settings.json")
    spark = SparkSession.builder.appName("spectraloom").getOrCreate()
    run(spark, config)


if __name__ == "__main__":
    main()
