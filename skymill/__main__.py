"""python -m skymill -input snapshot.parquet -output frame -lbox 1 ...; -sequence list.txt renders a list of snapshots.

-bucketed folder: with -sequence the list is first written there as one table bucketed by id; alone, what lies there is rendered.
"""

import sys

from pyspark.sql import SparkSession

from .config import parse_arguments
from .plans.render import bucket_sequence, render_sequence, render_to_files
from .sources.bucketed import open_bucketed
from .sources.snapshots import register, snapshot_list


def main(argv: list[str]) -> None:
    own = {"-sequence": None, "-mode": "hermite", "-bucketed": None}
    for flag in own:
        if flag in argv:
            i = argv.index(flag)
            own[flag], argv = argv[i + 1], argv[:i] + argv[i + 2 :]
    sequence, mode, bucketed = own.values()
    cfg = parse_arguments(argv)
    spark = SparkSession.builder.appName("skymill").getOrCreate()
    register(spark)
    if sequence or bucketed:
        snaps = snapshot_list(spark, sequence) if sequence else None
        if bucketed and sequence:
            bucket_sequence(spark, cfg, snaps, bucketed)
        images = render_sequence(spark, cfg, open_bucketed(spark, bucketed) if bucketed else snaps, mode)
        images.select("file", "image").write.format("skymill_images").mode("append").save()
    else:
        counted = render_to_files(spark, cfg)
        print(", ".join(f"{k.removeprefix('n_')}: {v}" for k, v in counted.items() if k.startswith("n_")))


if __name__ == "__main__":
    main(sys.argv[1:])
