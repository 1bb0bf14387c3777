"""Command line for ``spark-submit``: make tables, run the sampled join.

    generate     two synthetic tables, one CSV path per table and site
    centralized  the sampled join of all sites' files
    count, merge, sample, join     the four phases of the federated join
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from .plans import jobs
from .sources import synth
from .sources.sites import FORMATS, TABLE_SCHEMA, write_sites

KINDS = ("uniform", "sliced", "zipf", "mixed")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftsample", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for option in options:
            sub.add_argument(f"--{option}", **OPTIONS[option])
        return sub

    make = command("generate", "out", "sites", "seed")
    make.add_argument("--kind", choices=KINDS, required=True)
    make.add_argument("--num-keys", type=int, required=True)
    make.add_argument("--overlap", type=float, required=True)
    make.add_argument("--value-size", type=int, required=True)
    make.add_argument("--key-size", type=int, default=synth.KEY_SIZE)
    make.add_argument("--min-rpk", type=int, default=1)
    make.add_argument("--max-rpk", type=int, help="records per key")
    make.add_argument("--zipf-param", type=float)

    run = ("sites", "fraction", "seed", "null-safe", "metrics")
    table = ("key", "columns")
    command("centralized", "prefix", "out", "method", "format", "id", *table, *run)
    command("count", "prefix", "root", "site", "sites", "metrics", *table)
    command("merge", "root", "sites", "metrics", *table)
    command("sample", "prefix", "root", "site", "id", *table, *run)
    command("join", "root", "out", "format", "id", *table, *run)
    return top


OPTIONS: dict[str, dict] = {
    "prefix": dict(required=True, help="input files: {prefix}_t_{table}_p_{site}_of_{sites}.csv"),
    "root": dict(required=True, help="folder of the phase results"),
    "out": dict(required=True, help="folder to write to"),
    "site": dict(type=int, required=True),
    "sites": dict(type=int, required=True),
    "fraction": dict(type=float, required=True),
    "seed": dict(type=int, default=0),
    "method": dict(choices=("zip", "indexed"), default="zip"),
    "format": dict(choices=FORMATS, default="csv", help="of the sampled join"),
    "null-safe": dict(action="store_true", help="let NULL keys match each other"),
    "key": dict(action="append", help="key column; repeat for several (default: key)"),
    "id": dict(action="append", help="column that tells a site's rows apart; may be repeated"),
    "columns": dict(help="of the tables, as in 'key string, n long' (default: key and five values)"),
    "metrics": dict(help="folder to append rows and bytes written to, as JSON"),
}


def generate(spark: SparkSession, a: argparse.Namespace) -> str:
    """Write both tables; returns the prefix to read them by."""
    common = dict(
        overlap=a.overlap, sites=a.sites, value_size=a.value_size, key_size=a.key_size, seed=a.seed
    )
    positions = synth.key_positions(spark, a.num_keys)
    records = dict(min_rpk=a.min_rpk, max_rpk=a.max_rpk)
    if a.kind in ("zipf", "mixed") and a.zipf_param is None:
        raise SystemExit(f"{a.kind} needs --zipf-param")
    if a.kind != "zipf" and a.max_rpk is None:
        raise SystemExit(f"{a.kind} needs --max-rpk")
    if a.kind == "zipf" and a.max_rpk is not None:
        raise SystemExit("zipf takes no --max-rpk: counts follow the law alone")
    if a.kind == "mixed":
        tables = synth.synth_mixed(
            positions, a.num_keys, zipf_param=a.zipf_param, **records, **common
        )
        used = records | dict(zipf=a.zipf_param)
    elif a.kind == "zipf":
        used = dict(zipf=a.zipf_param)
        tables = [
            synth.synth_zipf(positions, a.num_keys, zipf_param=a.zipf_param, table=t, **common)
            for t in jobs.TABLES
        ]
    else:
        used = records
        make = {"uniform": synth.synth_uniform, "sliced": synth.synth_sliced}[a.kind]
        tables = [make(positions, a.num_keys, table=t, **records, **common) for t in jobs.TABLES]
    name = synth.dataset_name(
        a.kind, n=a.num_keys, **used, overlap=a.overlap, key=a.key_size, value=a.value_size,
        seed=a.seed,
    )
    for t, table in zip(jobs.TABLES, tables):
        prefix = write_sites(table.drop("table"), a.out, name, t, a.sites)
    return prefix


def run(spark: SparkSession, a: argparse.Namespace) -> object:
    if a.command == "generate":
        return {"prefix": generate(spark, a)}
    schema = StructType.fromDDL(a.columns) if a.columns else TABLE_SCHEMA
    table = dict(schema=schema, key=a.key or "key", sites=a.sites, metrics=a.metrics)
    if a.command == "count":
        return jobs.run_count(spark, a.prefix, a.root, site=a.site, **table)
    if a.command == "merge":
        return jobs.run_merge(spark, a.root, **table)
    common = table | dict(fraction=a.fraction, seed=a.seed, null_safe=a.null_safe, ids=a.id)
    if a.command == "centralized":
        return jobs.run_centralized(
            spark, a.prefix, a.out, method=a.method, fmt=a.format, **common
        )
    if a.command == "sample":
        return jobs.run_sample(spark, a.prefix, a.root, site=a.site, **common)
    return jobs.run_join(spark, a.root, a.out, out_fmt=a.format, **common)


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"weftsample {arguments.command}").getOrCreate()
    print(json.dumps(run(spark, arguments)))


if __name__ == "__main__":
    main()
