"""Command line: python -m haggle STORE (import FILE SOURCE | import-saved FILE | search TEXT | list | sources | merge OUT PATH... | discover FILE)."""

from __future__ import annotations

import argparse

from haggle.engine import Engine
from haggle.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="haggle", description=__doc__)
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("import")
    one.add_argument("file")
    one.add_argument("data_source")
    one.add_argument("--limit", type=int, default=20)
    commands.add_parser("import-saved").add_argument("file")
    found = commands.add_parser("search")
    found.add_argument("text")
    found.add_argument("--limit", type=int, default=50)
    listed = commands.add_parser("list")
    listed.add_argument("--limit", type=int, default=50)
    listed.add_argument("--offset", type=int, default=0)
    listed.add_argument("--platform")
    listed.add_argument("--data-source")
    commands.add_parser("sources")
    merged = commands.add_parser("merge")
    merged.add_argument("out")
    merged.add_argument("paths", nargs="+")
    commands.add_parser("discover").add_argument("file")
    a = parser.parse_args(argv)

    spark = local_session("haggle")
    e = Engine(spark, a.store)
    if a.command == "import":
        print(f"saved {e.import_products(a.file, a.data_source, limit=a.limit)}")
    elif a.command == "import-saved":
        print(e.import_saved(a.file))
    elif a.command == "search":
        e.search(a.text, a.limit).show(a.limit, truncate=60)
    elif a.command == "list":
        e.products(limit=a.limit, offset=a.offset, platform=a.platform, data_source=a.data_source).show(a.limit, truncate=60)
    elif a.command == "sources":
        e.sources().show(1000, truncate=60)
    elif a.command == "merge":
        from haggle.plans import merge, outputs
        from haggle.sources.files import html_pages

        products, files, run = merge.merge_pages(html_pages(spark, *a.paths))
        files.show(1000, truncate=60)
        outputs.write_result(products, run, ["source_file", "item_ord"], a.out)
    else:
        from haggle.plans import outputs
        from haggle.sources.files import html_pages

        pages = html_pages(spark, a.file).selectExpr("path as page_id", "html")
        cards, fields = outputs.discovery(pages)
        print(outputs.text_report("saved page", a.file, cards, fields))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
