"""Command line: search a Parquet corpus (doc_id, title, text), evaluate retrievers, or make their indexes."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexmill.operators import pipeline as P
from lexmill.operators import retrieval as R
from lexmill.operators import verify as V
from lexmill.operators.hooks import map_texts
from lexmill.session import ship
from lexmill.sources import writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    p.add_argument("--corpus", required=True, help="Parquet folder with doc_id, title, text")
    p.add_argument("--query", "-q", help="claim to search for")
    p.add_argument("--model", "-m", default="bm25", choices=sorted(R.RETRIEVERS))
    p.add_argument("--top-k", "-k", type=int, default=5)
    p.add_argument("--sample", type=int, default=0, help="only so many documents, by hashed order; 0 or less: all")
    p.add_argument("--index", metavar="FOLDER", help="the model's stored index; made there if absent or of another corpus")
    p.add_argument("--refit", action="store_true", help="make the stored index anew")
    p.add_argument("--no-reranker", dest="reranker", action="store_false")
    p.add_argument("--reranker", action="store_true", default=True, help="score the hits anew (the default)")
    p.add_argument("--labelled", metavar="PARQUET", help="texts (text, label) to train the classifier of hits on")
    p.add_argument("--transformer", metavar="MODULE:FACTORY", help="a model factory (see hooks.map_texts) that gives P(real) of texts, in place of --labelled")
    p.add_argument("--history", metavar="FILE", help="append the search and its hits as a JSON line")
    p.add_argument("--warm-up", metavar="FOLDER", help="make the indexes there and print timings")
    p.add_argument("--verifier", action="store_true", help="show evidence, verdicts and their consensus")
    p.add_argument("--eval", metavar="PARQUET", help="queries (qid, text) and, with --qrels, relevant pairs: print metrics")
    p.add_argument("--qrels", metavar="PARQUET", help="relevant pairs (qid, doc_id)")
    p.add_argument("--models", nargs="+", default=["bm25", "tfidf"], choices=sorted(R.RETRIEVERS))
    return p


def loaded(name: str):
    """The classifier (doc_id, text) -> (doc_id, prob_real) of a factory named module:function."""
    module, _, factory = name.partition(":")
    made = getattr(importlib.import_module(module), factory)
    return lambda texts: map_texts(texts, "doc_id", "text", made, "double").withColumnRenamed("value", "prob_real")


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    ship(spark)
    corpus = spark.read.parquet(args.corpus).select("doc_id", "title", "text")
    if args.sample > 0:
        corpus = corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(args.sample)
    if args.warm_up:
        labelled = spark.read.parquet(args.labelled) if args.labelled else None
        out = "\n".join(f"{step}: {seconds} s" for step, seconds in P.warm_up(corpus, args.warm_up, labelled=labelled, refit=args.refit))
    elif args.eval:
        if not args.qrels:
            raise SystemExit("--eval needs --qrels")
        table = P.evaluate_models(corpus.select("doc_id", "text"), spark.read.parquet(args.eval), spark.read.parquet(args.qrels), args.models)
        out = "\n".join(str(r.asDict()) for r in table.collect())  # one row a model
    else:
        if not args.query:
            raise SystemExit("--query, --eval or --warm-up is needed")
        asked = spark.createDataFrame([(1, args.query)], "qid int, text string")
        labelled = spark.read.parquet(args.labelled) if args.labelled else None
        searcher = P.Searcher(corpus, model=args.model, index=args.index, refit=args.refit, labelled=labelled, classifier=loaded(args.transformer) if args.transformer else None)
        hits = searcher.search(asked, k=args.top_k, reranker=R.lexical_score if args.reranker else None).orderBy("rank").cache()
        found = hits.collect()  # top-k rows
        out = writers.console([r.asDict() for r in found])
        if args.verifier:
            out += "".join(f"\n{r['rank']:>3}. {r['verdict']} {r['decision']} {r['confidence']:.2f}: {r['evidence'][:200]}" for r in found)
            c = V.consensus(hits.withColumnRenamed("verdict", "fever_verdict"), "qid").first()
            out += f"\nconsensus: {c['dominant'] if c else 'NEI'}"
        if args.history:
            with open(args.history, "a", encoding="utf-8") as f:
                f.write(json.dumps({"query": args.query, "model": args.model, "hits": [[r["doc_id"], r["score"], r["decision"]] for r in found]}) + "\n")
    print(out)
    return out


if __name__ == "__main__":
    main()
