"""Commands over PDF files: ``python -m quire.cli VERB PATH... [--out PATH] [--pages N] [--from N] [--to N]``.

Paths may be folders or globs of any store that Spark reads; what a command makes is
printed as lines of JSON, or written below ``--out``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import __version__
from quire.functions import structure
from quire.operators import assemble, layout
from quire.session import session
from quire.sources import catalog, pdf


def _text(docs: DataFrame) -> DataFrame:
    runs = pdf.runs(docs).select(F.col("path").alias("doc_id"), "page_idx", F.coalesce("mcid", F.lit(-1)).alias("mcid"), "seq", "text", F.round("y", 1).alias("y"), "x")
    lines = runs.groupBy("doc_id", "page_idx", "y").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY x, seq)").alias("line"))
    return lines.groupBy(F.col("doc_id").alias("path"), "page_idx").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY y DESC)").alias("text"))


def _markdown(docs: DataFrame) -> DataFrame:
    runs = pdf.runs(docs).select(F.col("path").alias("doc_id"), "page_idx", F.round("y", 1).alias("line_idx"), F.col("seq").alias("word_idx"), "text", F.lower("font").contains("bold").alias("bold"))
    marked = layout.emphasis(runs).withColumn("text", F.concat("mark", "text"))
    lines = marked.groupBy("doc_id", "page_idx", "line_idx").agg((F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY word_idx)")).alias("line"))
    return lines.groupBy(F.col("doc_id").alias("path"), "page_idx").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_idx DESC)").alias("text"))


def _info(docs: DataFrame) -> DataFrame:
    facts = catalog.info(docs).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("info"))
    return pdf.documents(docs).join(facts, "path", "left")


def _export(docs: DataFrame) -> DataFrame:
    return structure.xfdf(catalog.fields(docs).where("terminal"), ["path"], "name", "value")


#: Verbs that print rows.
SHOW = {
    "info": _info, "extracttext": _text, "markdown": _markdown, "listbookmarks": catalog.bookmarks, "listfields": catalog.fields, "exportxfdf": _export, "attachments": catalog.attachments, "annotations": catalog.annotations,
    "urls": lambda d: catalog.annotations(d).where("uri IS NOT NULL").select("path", "page_idx", "uri"), "images": lambda d: pdf.painted(d).where("kind IN ('image', 'object')"), "colours": lambda d: pdf.painted(d).select("path", "page_idx", "fill", "stroke").distinct(),
    "fonts": lambda d: pdf.runs(d).groupBy("path").agg(F.array_sort(F.collect_set("font")).alias("fonts")), "signatures": catalog.signatures, "structure": catalog.structure, "objects": pdf.objects, "operators": pdf.operators,
    "xmp": lambda d: structure.xmp(catalog.packets(d), "path"), "labels": catalog.label_ranges, "pages": pdf.pages, "references": pdf.references, "sections": pdf.sections,
}
#: Verbs that make files.
MAKE = ("merge", "split", "decode")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("verb", choices=[*SHOW, *MAKE, "version"])
    p.add_argument("paths", nargs="*")
    p.add_argument("--out")
    p.add_argument("--pages", type=int, default=1)
    p.add_argument("--from", dest="start", type=int, default=1)
    p.add_argument("--to", dest="end", type=int)
    a = p.parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return 0
    if not a.paths or (a.verb in MAKE and not a.out):
        p.error("a path is needed, and --out for what makes files")
    spark = session("quire")
    docs = spark.read.format("binaryFile").load(a.paths).select("path", "content")
    if a.verb in SHOW:
        for row in SHOW[a.verb](docs).orderBy("path").toJSON().toLocalIterator():
            print(row)
        return 0
    if a.verb == "merge":
        made = assemble.merge(docs.withColumn("all", F.lit(1)), ["all"], "path").select(F.lit("merged.pdf").alias("name"), "content")
    elif a.verb == "split":
        made = assemble.split_every(docs, "path", a.pages, a.start, a.end).select(F.concat(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("-"), F.col("chunk") + 1, F.lit(".pdf")).alias("name"), "content")
    else:
        made = assemble.decode_streams(docs, "path").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    made.write.mode("overwrite").parquet(a.out)
    print(json.dumps({"files": spark.read.parquet(a.out).count(), "out": a.out}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
