"""Command-line jobs (run with ``python -m ranqa`` or ``spark-submit``).

    corpus    template files + catalog tables -> chat-record JSONL, Q/A parquet, counts
    finetune  Q/A table -> train/val JSONL (exact-size or hashed split, shuffled)
    rerank    hit table (+ optional query table) -> kept hits as parquet
"""

from __future__ import annotations

import argparse
import json
import sys

from ranqa.session import get_session


def _corpus(args, spark) -> None:
    from ranqa.operators.corpus_jobs import assemble_corpus, export_corpus
    from ranqa.sources.tables import read_any

    tables = [read_any(spark, p) for p in args.catalog]
    corpus = assemble_corpus(spark, base_path=args.base, advanced_path=args.advanced,
                             negative_path=args.negative, no_entity_path=args.no_entity,
                             catalog_tables=tables, catalog_column=args.column,
                             num_samples=args.samples, seed=args.seed)
    print(json.dumps(export_corpus(corpus, args.out, seed=args.seed)))


def _finetune(args, spark) -> None:
    from ranqa.operators.corpus_jobs import export_finetuning, read_qa_table

    split = export_finetuning(read_qa_table(spark, args.qa), args.out, fraction=args.val_fraction,
                              seed=args.seed, exact=not args.hashed)
    print(json.dumps({r["split"]: r["n"] for r in split.groupBy("split").count()
                      .withColumnRenamed("count", "n").collect()}))


def _rerank(args, spark) -> None:
    from ranqa.functions.fuzzy import weighted_ratio, window_ratio
    from ranqa.operators.rerank import attach_queries, observed_rerank
    from ranqa.sources.tables import read_any

    hits = read_any(spark, args.hits)
    if args.queries:
        hits = attach_queries(hits, read_any(spark, args.queries))
    kw = {"limit": args.limit}
    if not args.native:
        kw.update(gate_scorer=window_ratio, rank_scorer=weighted_ratio)
    out, obs = observed_rerank(hits, dedupe_ids=args.dedupe_ids, **kw)
    out.write.mode("overwrite").parquet(args.out)
    print(json.dumps(obs.get))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="ranqa")
    sub = ap.add_subparsers(dest="cmd", required=True)

    c = sub.add_parser("corpus", help="build and export the question-answer corpus")
    c.add_argument("--base", required=True)
    c.add_argument("--advanced", required=True)
    c.add_argument("--negative", required=True)
    c.add_argument("--no-entity", dest="no_entity", required=True)
    c.add_argument("--catalog", nargs="+", required=True, help="tables (parquet/csv/json) holding the catalog column")
    c.add_argument("--column", default="Q")
    c.add_argument("--samples", type=int, default=1200)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--out", required=True)

    f = sub.add_parser("finetune", help="split a Q/A table into train/val JSONL")
    f.add_argument("--qa", required=True)
    f.add_argument("--val-fraction", dest="val_fraction", type=float, default=0.001)
    f.add_argument("--hashed", action="store_true", help="one-pass split of expected size")
    f.add_argument("--seed", type=int, default=42)
    f.add_argument("--out", required=True)

    r = sub.add_parser("rerank", help="re-rank a hit table")
    r.add_argument("--hits", required=True)
    r.add_argument("--queries", help="table with query_id, query_text (when the hits lack query_text)")
    r.add_argument("--limit", type=int, default=5)
    r.add_argument("--native", action="store_true", help="native edit ratio instead of the difflib scorers")
    r.add_argument("--dedupe-ids", dest="dedupe_ids", action="store_true")
    r.add_argument("--out", required=True)

    args = ap.parse_args(argv)
    spark = get_session()
    {"corpus": _corpus, "finetune": _finetune, "rerank": _rerank}[args.cmd](args, spark)


if __name__ == "__main__":
    main(sys.argv[1:])
