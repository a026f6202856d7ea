"""Commands over a workspace, and the registered queries: python -m tessera COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessera.plans.catalog import QUERIES
from tessera.session import session
from tessera.sources.adapters import eval_cases
from tessera.workspace import Workspace


def _questions(spark, given):
    """Stated questions: one on the command line, or a JSON lines file of (question_id, question)."""
    if given.question:
        return spark.createDataFrame([(1, given.question)], "question_id long, question string")
    return spark.read.schema("question_id long, question string").json(given.questions)


def _cases(spark, given):
    return eval_cases(spark.read.text(given.cases))


def _frames(spark, given):
    return spark.read.parquet(given.frames)


def _query(spark, given):
    if given.name is None:
        return spark.createDataFrame([(n,) for n in sorted(QUERIES)], "query string")
    return QUERIES[given.name](spark, given.data)


#: Command: what it takes besides the workspace, and what it does; a result is shown or written.
COMMANDS = {
    "ingest": (["path"], lambda w, g: w.ingest(g.path)),
    "process": (["--force"], lambda w, g: w.spark.createDataFrame([(str(v),) for v in w.process(g.force == "yes")], "processed string")),
    "find": (["--question", "--questions"], lambda w, g: w.find(_questions(w.spark, g))),
    "summarize": ([], lambda w, g: w.summarize()),
    "ask": (["--question", "--questions", "--mode"], lambda w, g: w.ask(_questions(w.spark, g), g.mode or "hybrid")),
    "chat": (["--question", "--questions", "--mode", "--frames"], lambda w, g: w.ask(_questions(w.spark, g), g.mode or "hybrid", _frames(w.spark, g) if g.frames else None)),
    "refine-frames": (["--question", "--questions", "--frames"], lambda w, g: w.refine_frames(_questions(w.spark, g), _frames(w.spark, g))),
    "export": ([], lambda w, g: w.export()),
    "rebuild-index": ([], lambda w, g: w.rebuild_index()),
    "audit": ([], lambda w, g: w.audit()),
    "eval": (["cases"], lambda w, g: w.evaluate(_cases(w.spark, g))),
    "quality-gate": (["cases"], lambda w, g: w.quality_gate(_cases(w.spark, g))),
    "show-config": ([], lambda w, g: w.spark.createDataFrame(sorted(w.spark.sparkContext.getConf().getAll()), "key string, value string").where(~F.lower("key").rlike("secret|password|token|key$"))),
    "remember": ([], lambda w, g: w.remember()),
    "memory-status": ([], lambda w, g: w.memory_status()),
    "memory-search": (["--question", "--questions"], lambda w, g: w.memory_search(_questions(w.spark, g))),
    "query": (["name?", "--data"], lambda w, g: _query(w.spark, g)),
}


def main(arguments: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (takes, _) in COMMANDS.items():
        own = commands.add_parser(name)
        for x in takes:
            own.add_argument(x.rstrip("?"), **({"nargs": "?"} if x.endswith("?") else {}))
        own.add_argument("--workspace", default="workspace")
        own.add_argument("--out", help="write the result as Parquet instead of showing it")
    given = parser.parse_args(arguments)
    found = COMMANDS[given.command][1](Workspace(spark or session("tessera"), given.workspace), given)
    if found is None:
        return
    if given.out:
        found.write.parquet(given.out)
    else:
        found.show(50, truncate=80)


if __name__ == "__main__":
    main()
