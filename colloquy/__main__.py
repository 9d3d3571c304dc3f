"""`python -m colloquy COMMAND FILES...`: detect, formats, chunk, stats, speakers, report, lint, compare.

FILES may hold globs. Exit 0: fine; 1: a gate failed or files can't be read; 2: some file has no known format.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import chunker, diagnostics, reports, speakers
from colloquy.schema import as_turns
from colloquy.session import cut
from colloquy.sources.detect import FORMATS, VENDORS
from colloquy.sources.readers import parse_transcripts, quarantine, read_texts, with_format
from colloquy.sources.sinks import as_json


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    p.add_argument("command", choices=["detect", "formats", "chunk", "stats", "speakers", "report", "lint", "compare"])
    p.add_argument("files", nargs="*")
    p.add_argument("--target", type=int, default=2000)
    p.add_argument("--overlap", type=int, default=0)
    p.add_argument("--json", action="store_true", help="one JSON object per line")
    p.add_argument("--context", action="store_true", help="chunks as prompt text")
    p.add_argument("--fail-on", choices=list(diagnostics.LEVELS), help="lint: exit 1 on a finding of this confidence or higher")
    p.add_argument("--fail-on-issues", action="store_true", help="report: exit 1 on stubs, chunks that start mid-sentence or cut turns")
    return p.parse_args(argv)


def _rows(o: argparse.Namespace, texts: DataFrame) -> tuple[DataFrame, int]:
    """What the command shows, and its exit code."""
    if o.command == "detect":
        return with_format(texts).select("source", "format", "vendor").orderBy("source"), 0
    turns, names = speakers.resolve_speakers(cut(as_turns(parse_transcripts(texts))))  # parsed once, read by several steps
    if o.command == "stats":
        return reports.talk_share(turns).orderBy("transcript_id", F.desc("chars")), 0
    if o.command == "speakers":
        return reports.speaker_variants(names).orderBy("transcript_id", "resolved"), 0
    if o.command == "lint":
        found = diagnostics.diarization_warnings(turns).orderBy("transcript_id", "start_index", "kind")
        return found, int(bool(o.fail_on) and not diagnostics.at_least(found, o.fail_on).isEmpty())
    if o.command == "compare":
        blind = reports.recursive_split(texts, target=min(o.target, 600)).select("transcript_id", F.explode("pieces").alias("piece"))
        return blind.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(reports.attributed_speaker(F.col("piece")).isNull().cast("int")).alias("without_speaker")).orderBy("transcript_id"), 0
    source = F.element_at(F.split("transcript_id", "/"), -1)
    chunks = chunker.chunk(turns, o.target, o.overlap, source=source)
    if o.command == "report":
        r = reports.report(turns, chunks, o.target).orderBy("transcript_id")
        return r, int(o.fail_on_issues and not r.where("n_stubs + n_mid_sentence + n_cut > 0").isEmpty())
    chunks = chunks.orderBy("transcript_id", "chunk_no")
    return (chunks.select("transcript_id", "chunk_no", reports.to_context().alias("context")) if o.context else chunks.drop("members")), 0


def main(argv: Sequence[str] | None = None) -> int:
    o = _arguments(argv)
    if o.command == "formats":
        print("\n".join([*FORMATS, *(f"json:{v}" for v in VENDORS)]))
        return 0
    if not o.files:
        print("no files", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("colloquy").getOrCreate()
    try:
        texts = read_texts(spark, o.files)
        rows, code = _rows(o, texts)
        if o.json or o.context:
            for r in (rows.select("context") if o.context else as_json(rows)).toLocalIterator():
                print(r[0])
        else:
            print("\t".join(rows.columns))
            for r in rows.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in r))
        bad = quarantine(texts).select("source", "reason").collect()  # one row per file that was named
    except Exception as e:
        print(f"can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    for r in bad:
        print(f"{r['source']}: {r['reason']}", file=sys.stderr)
    return code or (2 if bad else 0)


if __name__ == "__main__":
    sys.exit(main())
