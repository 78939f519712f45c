"""Command line: python -m firnline ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from firnline.api import Service
from firnline.errors import FirnlineError
from firnline.functions.dates import parse_dates
from firnline.functions.grid import ALBERS_CRS, Grid
from firnline.operators.generate import elevation_tiles, generate, import_layers, local_pixels, warped
from firnline.plans.output import emitted, write_csv
from firnline.sources.basins import BasinStore
from firnline.sources.catalog import Catalogue
from firnline.sources.ingest import remove_date
from firnline.sources.ingesters import run_ingest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="firnline", description="Zonal statistics of dated grids.")
    out.add_argument("root", help="the catalogue's folder")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="begin a catalogue")
    commands.add_parser("status", help="dates of every dataset")
    stats = commands.add_parser("stats", help="statistics of one basin")
    stats.add_argument("dataset")
    stats.add_argument("triplet")
    stats.add_argument("--dates", help="a day, an interval start/end, or MM-DD with --years")
    stats.add_argument("--years", help="YYYY or YYYY..YYYY")
    stats.add_argument("--variable", action="append", default=[])
    stats.add_argument("--zone", action="append", default=[], help="LAYER or LAYER:PARAM=VALUE")
    stats.add_argument("--format", choices=("json", "csv"), default="csv")
    stats.add_argument("--out", help="a folder that executors write CSV files to, in place of printing")
    stats.add_argument("--allow-partial", action="store_true")
    stats.add_argument("--include-empty-zones", action="store_true")
    for name, words in {"list": (), "info": ("name",), "dates": ("name",), "values": ("name",), "create": ("template", "name"), "stage": ("template", "name"), "register": ("file",), "activate": ("name",), "deactivate": ("name",), "pack": ("name",), "remove-date": ("name", "date")}.items():
        sub = commands.add_parser(f"dataset-{name}")
        for word in words:
            sub.add_argument(word)
        if name in ("create", "stage"):
            sub.add_argument("--mask", help="a Parquet table of the pixel_ids of valid ground")
        if name == "register":
            sub.add_argument("--replace", action="store_true", help="replace a dataset of that name")
    ingest = commands.add_parser("ingest", help="take a source into a dataset")
    ingest.add_argument("dataset")
    ingest.add_argument("source")
    ingest.add_argument("--force", action="store_true", help="write dates that are known already, too")
    ingest.add_argument("--dry-run", action="store_true")
    layers = commands.add_parser("generate", help="make zone layers from local sources, once for all datasets given")
    layers.add_argument("dataset", nargs="+")
    layers.add_argument("--elevation", help="Parquet table of row, col, z on the grid of --grid")
    layers.add_argument("--tiles", help="in place of --elevation: a folder of one-degree tables, warped to the grid of --grid")
    layers.add_argument("--per-degree", type=int, default=10_800, help="pixels along a degree of the tiles")
    layers.add_argument("--landcover", help="Parquet table of row, col, nlcd on the grid of --grid")
    layers.add_argument("--grid", required=True, help="--grid=ORIGIN_X,ORIGIN_Y,PIXEL,COLS,ROWS of the sources, in EPSG:5070")
    layers.add_argument("--force", action="store_true", help="replace layers that are there")
    made = commands.add_parser("layers-import", help="take in zone layers made elsewhere: a Parquet table of row, col and the layers")
    made.add_argument("dataset")
    made.add_argument("source")
    made.add_argument("--force", action="store_true", help="replace layers that are there")
    for name, words in {"import": ("source",), "sync": ("source",), "list": (), "show": ("triplet",), "dump": ("triplet", "to"), "remove": ("triplet",), "reindex": (), "rasterize": ("dataset",)}.items():
        sub = commands.add_parser(f"pourpoint-{name}")
        for word in words:
            sub.add_argument(word)
        sub.add_argument("--dump-to")
        sub.add_argument("--dry-run", action="store_true")
        sub.add_argument("--rebuild", action="store_true")
    doctor = commands.add_parser("doctor", help="findings about a dataset; status 1 if there are any")
    doctor.add_argument("dataset")
    doctor.add_argument("--check", action="append")
    doctor.add_argument("--format", choices=("json", "csv", "table"), default="table")
    return out


def run(spark, args: argparse.Namespace) -> int:
    """Print the answer to a command."""
    catalogue = Catalogue.initialise(spark, args.root) if args.command == "init" else Catalogue.open(spark, args.root)
    store = BasinStore(spark, f"{args.root}/pourpoints")
    service, name = Service(catalogue, store), getattr(args, "name", "")
    active = [catalogue[n] for n in catalogue.active()]
    rows = lambda frame: [r.asDict(recursive=True) for r in frame.collect()]
    mask = lambda: spark.read.parquet(args.mask) if args.mask else None
    if args.command == "stats" and args.out:
        result = catalogue.zonal_stats(args.dataset, args.triplet, parse_dates(args.dates, args.years), args.variable, args.zone, store.index.read(), args.allow_partial, args.include_empty_zones)
        write_csv(result, args.out)
        return 0
    if args.command == "stats":
        answer = service.stats(args.dataset, args.triplet, parse_dates(args.dates, args.years), args.variable, args.zone, args.allow_partial, args.include_empty_zones, args.format)
        if args.format == "csv":
            sys.stdout.writelines(answer)
            return 0
    elif args.command == "doctor":
        lines = list(emitted(service.findings(args.dataset, args.check), args.format))
        print("".join(x if x.endswith("\n") else x + "\n" for x in lines), end="")
        return int(len(lines) > (args.format != "json"))
    else:
        answer = {
            "init": lambda: sorted(catalogue.datasets),
            "ingest": lambda: rows(run_ingest(spark, args.source, catalogue.registered(args.dataset), force=args.force, dry_run=args.dry_run)),
            "generate": lambda: _generate(spark, catalogue, args),
            "layers-import": lambda: import_layers(spark.read.parquet(args.source), catalogue.registered(args.dataset), args.force),
            "status": service.status,
            "dataset-list": service.datasets,
            "dataset-info": lambda: service.dataset(name),
            "dataset-dates": lambda: service.dates(name),
            "dataset-values": lambda: service.values(name),
            "dataset-create": lambda: catalogue.create(args.template, name, mask()).name,
            "dataset-stage": lambda: catalogue.stage(args.template, name, mask()).name,
            "dataset-register": lambda: catalogue.register(catalogue.resolve(args.file), args.replace).name,
            "dataset-activate": lambda: catalogue.set_active(name, True),
            "dataset-deactivate": lambda: catalogue.set_active(name, False),
            "dataset-pack": lambda: catalogue.pack(name),
            "dataset-remove-date": lambda: remove_date(spark, catalogue.registered(name).path, args.date),
            "pourpoint-import": lambda: rows(store.import_(store.sources(args.source), active, args.dry_run)),
            "pourpoint-sync": lambda: rows(store.sync(store.sources(args.source), active, args.dump_to, args.dry_run)),
            "pourpoint-list": service.pourpoints,
            "pourpoint-show": lambda: service.pourpoint(args.triplet),
            "pourpoint-dump": lambda: store.records.read().where(f"triplet = '{args.triplet}'").write.json(args.to),
            "pourpoint-remove": lambda: store.remove(args.triplet, active, args.dry_run),
            "pourpoint-reindex": lambda: store.reindex(active),
            "pourpoint-rasterize": lambda: rows(store.rasterise(catalogue[args.dataset], rebuild=args.rebuild)),
        }[args.command]()
    print(json.dumps(answer, indent=2, default=str))
    return 0


def _generate(spark, catalogue: Catalogue, args: argparse.Namespace) -> list[str]:
    x, y, pixel, cols, rows = (float(v) for v in args.grid.split(","))
    grid = Grid(x, y, pixel, int(cols), int(rows), crs=ALBERS_CRS)
    given = {"terrain": (args.elevation, "z", "double"), "landcover": (args.landcover, "nlcd", "smallint")}
    sources = {kind: (local_pixels(spark, path, value, dtype), grid) for kind, (path, value, dtype) in given.items() if path}
    targets = [catalogue.registered(n) for n in args.dataset]
    if args.tiles:
        degrees = [t.grid.bounds_in_degrees(spark) for t in targets]
        bounds = tuple(pick(b[k] for b in degrees) for k, pick in enumerate((min, min, max, max)))
        pixels, tiles_grid = elevation_tiles(spark, args.tiles, bounds, args.per_degree)
        sources["terrain"] = warped(pixels, tiles_grid, grid), grid
    generate(sources, targets, args.force)
    return args.dataset


def main() -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args()
    try:
        return run(SparkSession.builder.appName("firnline").getOrCreate(), args)
    except FirnlineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
