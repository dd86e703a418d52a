"""python -m paperloom FILE...: convert documents to Markdown or JSON."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperloom import VERSION
from paperloom.plans import convert
from paperloom.sources import scan


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="paperloom", description="HWP, HWPX, HWPML, XLSX, XLS, DOCX -> Markdown")
    p.add_argument("--version", action="version", version=f"paperloom {VERSION}")
    p.add_argument("files", nargs="*", metavar="FILE")
    p.add_argument("-o", "--output", metavar="PATH", help="output file for a single document")
    p.add_argument("-d", "--out-dir", metavar="DIR", help="output folder")
    p.add_argument("-p", "--pages", metavar="RANGE", help="sheets or sections, such as 1-3 or 1,3,5")
    p.add_argument("--format", choices=["markdown", "json"], default="markdown")
    p.add_argument("--no-header-footer", action="store_true", help="leave out running heads of PDF pages (no other format has them)")
    p.add_argument("--silent", action="store_true", help="no progress messages")
    out = p.parse_args(argv)
    if not out.files:
        p.print_help()
    return out


def _uri(p: Path) -> str:
    """The path with the letters escaped that would make it a pattern."""
    return "file://" + re.sub(r"([\\*?\[\]{}])", r"\\\1", str(p))


def _write(text: str, name: str, args: argparse.Namespace) -> None:
    """To the named file if there is one document, to the named folder, or to the standard output."""
    if args.output and len(args.files) == 1:
        target = Path(args.output)
    elif args.out_dir:
        target = Path(args.out_dir) / (Path(name).stem + (".json" if args.format == "json" else ".md"))
        target.parent.mkdir(parents=True, exist_ok=True)
    else:
        print(text)
        return
    target.write_text(text, encoding="utf-8")


def main(argv: list[str] | None = None) -> int:
    """Converts the named files in one job; 1 if any failed, was too large or is missing."""
    args = _arguments(argv)
    report = (lambda _: None) if args.silent else (lambda text: print(text, file=sys.stderr))
    paths = [Path(f).resolve() for f in args.files]
    there = [p for p in paths if p.is_file()]
    for p in set(paths) - set(there):
        print(f"not a file: {p}", file=sys.stderr)
    if not there:
        return int(bool(paths))
    spark = SparkSession.builder.appName("paperloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    docs = scan.read_documents(spark, [_uri(p) for p in there])
    failed = len(there) < len(paths)
    with convert.Conversion(docs, args.pages) as c:
        names = docs.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("name"))
        found = c.results()
        for r in found.join(convert.to_json(found, convert.warnings(c.rows)), "doc_id").join(names, "doc_id").orderBy("name").toLocalIterator():
            if r.success:
                report(f"{r.name}: converted from {r.file_type}")
                _write(json.dumps(json.loads(r.json), ensure_ascii=False, indent=2) if args.format == "json" else r.markdown, r.name, args)
            else:
                failed = True
                print(f"{r.name}: {r.code}, {r.error}", file=sys.stderr)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
