"""Command line: ``python -m tapeloom.cli NAME [--data DIR] [--out PATH] [--format csv|parquet|json]`` runs a query;
``--list`` names them; ``--search CODE FIRST LAST`` runs the similarity search, ``--formula TEXT`` the screener."""

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("name", nargs="?")
    p.add_argument("--data", default="/root/testdata/sf0.01")
    p.add_argument("--out")
    p.add_argument("--format", default="csv", choices=("csv", "parquet", "json"))
    p.add_argument("--list", action="store_true")
    p.add_argument("--search", nargs=3, metavar=("CODE", "FIRST", "LAST"))
    p.add_argument("--mode", default="fixed", choices=("fixed", "elastic"))
    p.add_argument("--formula")
    p.add_argument("--start", default="2020-01-01")
    got = p.parse_args(args)
    from tapeloom.plans import base, registry
    from tapeloom.screener.columns import screen
    from tapeloom.similarity.search import SearchRules, search

    if got.list:
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if got.search:
        df = search(base.bars(spark, got.data), *got.search, SearchRules(mode=got.mode))
    elif got.formula:
        df = screen(base.bars(spark, got.data), got.formula, got.start)
    elif got.name in registry.QUERIES:
        df = registry.QUERIES[got.name](spark, got.data)
    else:
        p.error("a query's name, --search or --formula is needed")
    if got.out:
        df.write.mode("overwrite").option("header", True).format(got.format).save(got.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
