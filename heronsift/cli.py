"""Command lines: ``python -m heronsift.cli retrieve|generate|split``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heronsift import service
from heronsift.operators import chunking as C
from heronsift.sources import chunks as S


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heronsift")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("retrieve", "generate"):
        one = sub.add_parser(name)
        one.add_argument("--chunks", required=True, help="chunk files or a folder of them")
        one.add_argument("--q", required=True)
        one.add_argument("--mode", default=service.modes()[-1], choices=service.modes())
        if name == "generate":
            one.add_argument("--model", default="echo")
    split = sub.add_parser("split")
    split.add_argument("--sections", required=True, help="folder of section files")
    split.add_argument("--out", required=True)
    split.add_argument("--pdf", help="only the first file whose name holds this")
    split.add_argument("--most", type=int, default=C.MAX_TOKENS)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "split":
        found = S.read_chunks(spark, args.sections, keep_textless=True)
        found = S.one_target(found, args.pdf) if args.pdf else found
        rows = found.withColumn("key", F.coalesce("meta.section_id", F.lit("sec")))
        S.write_sections(C.keep_or_split(rows, "key", "text", args.most), args.out)
        return 0
    corpus = service.Corpus.read(spark, args.chunks)
    told = service.retrieve(corpus, args.q, args.mode) if args.command == "retrieve" else service.answer(corpus, args.q, args.model, args.mode)
    json.dump(told, sys.stdout, ensure_ascii=False, indent=2, default=str)
    sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
