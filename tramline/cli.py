"""python -m tramline.cli --gtfs-dir FEED --osm-file EXTRACT [--out-dir OUT]"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tramline.plans import pipeline


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(description="Finds the paths of public-transport services on a map.")
    a.add_argument("-g", "--gtfs-dir", required=True, help="folder of the feed's CSV files")
    a.add_argument("-o", "--osm-file", required=True, help="PBF file, or folder of nodes, ways and relations as Parquet")
    a.add_argument("--out-dir", help="where results go; default: OUT beside the feed, which itself is never written to")
    a.add_argument("-w", "--wipe-shapes", action="store_true", help="drop all old shapes (with all modes only)")
    a.add_argument("--skip-small-roads", action="store_true", help="leave out minor roads that no bus route names")
    a.add_argument("-m", "--mots", default="all", help="comma-separated modes")
    a.add_argument("--write-colours", "--write-colors", action="store_true", help="fill in route colours from the map")
    a.add_argument("--low-priority", action="store_true", help="run the driver at low priority")
    a.add_argument("--match-threads", type=int, help="local threads, where no cluster is configured")
    a.add_argument("--run", type=int, help="number of the run in new shape ids; default: the smallest unused")
    return a


def main(args: list[str] | None = None) -> dict[str, str]:
    a = parser().parse_args(args)
    if a.low_priority and hasattr(os, "nice"):
        os.nice(10)
    builder = SparkSession.builder.appName("tramline").config("spark.sql.session.timeZone", "UTC")
    if a.match_threads:
        builder = builder.master(f"local[{a.match_threads}]")
    out = a.out_dir or os.path.join(os.path.dirname(os.path.abspath(a.gtfs_dir)), "OUT")
    found = pipeline.run(builder.getOrCreate(), a.gtfs_dir, a.osm_file, out, a.mots, a.wipe_shapes, a.skip_small_roads, a.write_colours, a.run)
    for name, path in found.items():
        print(name, path)
    return found


if __name__ == "__main__":
    main()
