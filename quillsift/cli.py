"""Commands: the four steps of a search (``clean``, ``merge-supp``, ``preprocess``, ``search``, or all of them: ``pipeline``), ``split``,
``merge-results``, ``config``, and for parsed names ``process-names``, ``compare-parsers``, ``validate-names`` and ``generate-config``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import augment, clean, parsers, patterns, search
from .plans.config import Config, setup_logging
from .sources import files

STEPS = ("clean", "merge-supp", "preprocess", "search")
PARSING = ("process-names", "compare-parsers", "validate-names", "generate-config")


def augmented(spark: SparkSession, d: DataFrame, a: argparse.Namespace, c: Config) -> DataFrame:
    p = augment.read_prefixes(spark, a.prefixes, c.names.prefix_column) if a.prefixes else None
    n = augment.read_nicknames(spark, a.nicknames) if a.nicknames else None
    return augment.augment_names(d, p, n, c.names.prefix_column)


def expanded(spark: SparkSession, d: DataFrame, a: argparse.Namespace, c: Config) -> DataFrame:
    d = d.withColumn("uniqid", d["uniqid"].cast("long"))
    return patterns.preprocess(d, c.names.patterns, c.search.edits, files.read_drop_list(spark, a.drop) if a.drop else None)


def found(docs: DataFrame, names: DataFrame, c: Config) -> DataFrame:
    s = c.search
    m = search.mentions(docs, names, s.id_column, s.text_column, edits=s.edits, overlap=s.overlap, max_results=s.max_results, clean=s.clean)
    return search.wide(docs, m, s.id_column, k=s.max_results)


def cleaned(d: DataFrame, c: Config) -> DataFrame:
    return clean.clean_names(d, c.names.column, keep_all=c.names.keep_all)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillsift", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--log", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    for name in (*STEPS, "split", "merge-results", "config", "pipeline", *PARSING):
        s = sub.add_parser(name)
        s.add_argument("-o", "--output", required=name not in ("validate-names", "compare-parsers"))
        if name not in ("config", "generate-config"):
            s.add_argument("input", nargs="+" if name == "merge-results" else None)
        for option in ("prefixes", "nicknames", "drop", "names", "corpus"):
            s.add_argument(f"--{option}")
        s.add_argument("--size", type=int, default=1000)
        s.add_argument("--format", choices=files.FORMATS[:3])
        s.add_argument("--append", action="store_true", help="append to an output that is there")
        if name == "pipeline":
            for step in STEPS[:3]:
                s.add_argument(f"--skip-{step.partition('-')[0]}", action="store_true")
            s.add_argument("--stages", help="folder for the tables of the steps in between")
        if name in PARSING:
            s.add_argument("--column")
            s.add_argument("--parser", choices=("auto", "rule", "model"))
            s.add_argument("--batch-size", type=int)
            s.add_argument("--ml-threshold", type=float)
            s.add_argument("--least", type=float, default=0.7)
            s.add_argument("--no-confidence", action="store_true")
    return p


def pipeline(spark: SparkSession, a: argparse.Namespace, c: Config) -> DataFrame:
    """The steps in a row, each of the first three unless it is skipped; with ``--stages`` each is written and read again."""
    d = files.read_table(spark, a.input)
    steps = [("01_clean_names", a.skip_clean, cleaned), ("02_augmented_names", a.skip_merge, lambda d, c: augmented(spark, d, a, c)), ("03_preprocessed_names", a.skip_preprocess, lambda d, c: expanded(spark, d, a, c))]
    for name, skipped, step in steps:
        if not skipped:
            d = step(d, c)
            if a.stages:
                files.write_table(d, f"{a.stages}/{name}.csv")
                d = files.read_table(spark, f"{a.stages}/{name}.csv")
    return found(files.read_table(spark, a.corpus), d, c)


def parsing(spark: SparkSession, a: argparse.Namespace, c: Config) -> None:
    n = c.names
    column, kind = a.column or n.column, a.parser or n.parser
    options = {"model": c.function(c.language.model), "batch_size": a.batch_size or n.batch_size, "ml_threshold": n.ml_threshold if a.ml_threshold is None else a.ml_threshold}
    d = files.read_table(spark, a.input)
    if a.command == "compare-parsers":
        result = parsers.compare_parsers(d, column, **options).select(*[f"`{x}`" for x in d.columns], "parsed.*")
        if not a.output:
            result.show(truncate=False)
    else:
        result = parsers.parse_frame(d, column, kind, **options)
        stats = parsers.parsing_stats(result) if a.command == "process-names" else parsers.confidence_split(result, a.least)
        stats.show(truncate=False)
        if a.command == "validate-names":
            parsers.least_sure(result, column, a.least).show(truncate=False)
    if a.output:
        files.write_table(result, a.output, a.format, confidence=not a.no_confidence)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    setup_logging(a.log)
    c = Config.load(a.config)
    if a.command in ("config", "generate-config"):
        if a.command == "generate-config":
            c.names.parser, c.names.batch_size = a.parser or c.names.parser, a.batch_size or c.names.batch_size
            c.names.ml_threshold = c.names.ml_threshold if a.ml_threshold is None else a.ml_threshold
        return c.save(a.output)
    spark = spark or SparkSession.builder.appName("quillsift").getOrCreate()
    if a.command in PARSING:
        return parsing(spark, a, c)
    if a.command == "merge-results":
        files.merge_files(spark, a.input, a.output)
        return None
    if a.command == "pipeline":
        files.write_table(pipeline(spark, a, c), a.output, a.format, overwrite=not a.append)
        return None
    d = files.read_table(spark, a.input)
    if a.command == "split":
        files.split_corpus(d, a.output, a.size)
        return None
    if a.command == "clean":
        d = cleaned(d, c)
    elif a.command == "merge-supp":
        d = augmented(spark, d, a, c)
    elif a.command == "preprocess":
        d = expanded(spark, d, a, c)
    else:
        d = found(d, files.read_name_list(spark, a.names), c)
    files.write_table(d, a.output, a.format, overwrite=not a.append)
    return None


if __name__ == "__main__":
    main()
