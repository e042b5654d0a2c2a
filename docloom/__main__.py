"""``python -m docloom ingest --raw FOLDER --out FOLDER``: reads new files into the archive.
``python -m docloom generate --out FOLDER``: writes the test corpus, its manifest and its splits.
"""

import argparse
from pathlib import Path

from docloom.operators import ingest
from docloom.session import local_session, setting, ship
from docloom.sources import corpus, tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="docloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    read = commands.add_parser("ingest")
    read.add_argument("--raw")
    read.add_argument("--out")
    read.add_argument("--min-chars-per-page", type=int)
    make = commands.add_parser("generate")
    make.add_argument("--out")
    make.add_argument("--seed", type=int, default=42)
    args = parser.parse_args()
    spark = ship(local_session())
    data = Path(setting(spark, "data.dir", "data"))
    if args.command == "generate":
        manifest, lines = corpus.generate(spark, args.out or str(data / "raw"), str(data / "splits.yaml"), args.seed)
        tables.overwrite_table(manifest, str(data / "generated"), "manifest")
    else:
        out = args.out or str(data / "parquet")
        lines = ingest.report(spark, out, ingest.ingest(spark, args.raw or str(data / "raw"), out, args.min_chars_per_page))
    print("\n".join(lines))


if __name__ == "__main__":
    main()
