"""Command line: ingest a folder, search what was ingested, evaluate a data set, and rescore traces."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lodestrata.operators import evaluation
from lodestrata.plans import evaluate, ingest
from lodestrata.session import get_session
from lodestrata.sources import evaluation as sources
from lodestrata.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    todo = p.add_subparsers(dest="command", required=True)
    c = todo.add_parser("catalog", help="files and kilobytes of each kind below a folder")
    c.add_argument("root")
    c = todo.add_parser("ingest", help="chunks and index a folder of files")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--max-files", type=int)
    c.add_argument("--max-pages", type=int)
    c.add_argument("--dry-run", action="store_true", help="counts a source, nothing is written")
    c = todo.add_parser("search", help="keyword search, with the context it would give")
    c.add_argument("out")
    c.add_argument("question", nargs="+")
    c.add_argument("--top", type=int, default=evaluate.CHOSEN)
    c = todo.add_parser("evaluate", help="retrieval metrics of a data set")
    c.add_argument("out")
    c.add_argument("dataset")
    c.add_argument("--pipeline", choices=tuple(evaluate.SCORED_STAGE), default="rrf")
    c.add_argument("--k", type=int, default=evaluate.CHOSEN)
    c.add_argument("--results", help="folder of the results and the trace")
    c = todo.add_parser("rescore", help="metrics of traces against labels")
    c.add_argument("paths", nargs="+")
    c.add_argument("--labels", required=True)
    c.add_argument("--k", type=int, default=evaluate.CHOSEN)
    c.add_argument("--per-question", action="store_true")
    return p


def run(spark: SparkSession, arguments: Sequence[str]) -> str:
    """What the command prints."""
    a = parser().parse_args(arguments)
    if a.command == "catalog":
        return evaluate.markdown(files.catalog(files.list_files(spark, a.root)), "doc_type")
    if a.command == "ingest":
        limits = {"max_files": a.max_files, "max_pages": a.max_pages}
        if a.dry_run:
            return evaluate.markdown(ingest.build_corpus(spark, a.root, **limits).stats, "source")
        return json.dumps(ingest.run_ingestion(spark, a.root, a.out, **limits))
    if a.command == "search":
        engine = evaluate.open_engine(spark, a.out)
        asked = spark.createDataFrame(list(enumerate(a.question)), "qid int, text string")
        got = evaluate.retrieve(engine, asked, "rrf", a.top)
        blocks = {r["qid"]: r["context"] for r in evaluate.contexts(engine, got)[0].collect()}  # a row a question
        return "\n\n".join(f"# {q}\n\n{blocks.get(i, 'Nothing found.')}" for i, q in enumerate(a.question)) + "\n"
    if a.command == "evaluate":
        items = sources.read_dataset(spark, a.dataset)
        done = evaluate.run_evaluation(spark, evaluate.open_engine(spark, a.out), items, "retrieval", a.pipeline, a.k, out=a.results, labels_file=a.dataset)
        return json.dumps({"status": done.status, **done.summary})
    items = sources.read_dataset(spark, a.labels)
    ranges, cells, marks = evaluate.report(spark, {"": a.paths}, sources.gold_works(items), sources.gold_passage_ids(items), a.k, (("rrf", "rerank"),))
    parts = [evaluate.markdown(ranges, "config")]
    if a.per_question:
        parts.append(evaluate.markdown(cells, "qid"))
        parts += [f"{after} against {before}\n\n{evaluate.markdown(evaluation.mark_tally(m), 'mark')}" for (before, after), m in marks.items()]
    return "\n".join(parts)


def main(arguments: Sequence[str] | None = None) -> None:
    given = sys.argv[1:] if arguments is None else list(arguments)
    parser().parse_args(given)  # says what is wrong before Spark is started
    print(run(get_session("lodestrata"), given))


if __name__ == "__main__":
    main()
