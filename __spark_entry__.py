
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.answers import DECISION_MARK, EXPLANATION_MARK, decision_name, response_field
from evalspark.functions.bins import LENGTH_EDGES, bin_labels
from evalspark.functions.scores import COUNTS
from evalspark.functions.text import WHITESPACE, WORD
from evalspark.operators import annotate as ann
from evalspark.operators import dataset, evaluate, merge, sketches, slices, topics, transitions
from evalspark.operators.range_join import range_join
from evalspark.operators.upsert import MergedAnswers
from evalspark.schemas import Rubric, Variant
from evalspark.session import materialize, scratch_path
from evalspark.sources import derived, readers, writers
from evalspark.streaming import row_ranges
from evalspark.streaming.incremental import annotate_incrementally, read_batches

VARIANTS, DEFINITIONS, MODELS = derived.VARIANTS, derived.DEFINITIONS, derived.MODELS
WIDE_EDGES = (0, 500, 1000, 1500, 2000, 3000, 5000, 10000, 20000)
CUTOFFS = {"A": 3000, "B": 5000}
KEYWORDS = ["src1-en", "src2-en", "src3-fr", "src5-en"]
LIMIT, TOP_KEYWORDS, HISTOGRAM_BINS = 100, 15, 20
QUANTILES = (0.0, 0.25, 0.5, 0.95, 1.0)
RUBRICS = [
    Rubric("A", 'Definition A: rude or hurtful words.\n\nText: "', '"\n\nAnswer yes or no, then explain.'),
    Rubric("B", 'Definition B: {threats} only.\n\nText: "', '"\n\nAnswer yes or no, then explain at length.'),
]
STOP_WORDS = """
and are for from has have her his its not of on or our she that the their them they this to was were
will with you your
""".split()



def _optional(*names: str) -> list[ModuleType]:
    """Modules that may be absent as a whole; an error inside one of them is raised."""
    found = []
    for name in names:
        try:
            found.append(import_module(name))
        except ModuleNotFoundError as missing:
            if missing.name not in ("evalspark.llm", *names):
                raise
    return found


OPTIONAL = _optional("evalspark.llm.queries", "corpus_pipeline")


# -- shared inputs


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return derived.predictions(derived.labelled_items(spark, sf))


def _rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The last answer of every variant to every labelled item, with the item columns asked for."""
    return merge.evaluation_rows(_predictions(spark, sf), VARIANTS, ["item_id", "truth", *columns])


def _wide(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return merge.answers_by_item(_predictions(spark, sf), VARIANTS, ["item_id", "truth", *columns])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.classification_metrics(_rows(spark, sf))


def _binary_annotations(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    items = derived.items(spark, sf)
    return {
        m: merge.binarize(derived.annotations(items, m), DEFINITIONS).withColumn("model", F.lit(m))
        for m in MODELS
    }


def _round(df: DataFrame) -> DataFrame:
    """Ten decimals, where both engines agree whatever their order of summation."""
    return df.withColumns({c: F.round(c, 10) for c, t in df.dtypes if t == "double"})


# -- queries


def scan_items(spark, sf):
    return derived.items(spark, sf).drop("text_length")


def scan_items_split(spark, sf):
    """Items go through CSV files with line breaks in quoted fields, each read by many tasks."""
    path = scratch_path(spark, "items-csv")
    writers.write_items(derived.items(spark, sf), path)
    return readers.read_items(spark, path, splittable=True)


def scan_annotations(spark, sf):
    """Each model's annotations go through a CSV table and back."""
    tables = []
    for m in MODELS:
        path = scratch_path(spark, f"annotations-{m}")
        source = derived.annotations(derived.items(spark, sf), m)
        writers.write_annotations(source.select(*_ANNOTATED), path)
        tables.append(readers.read_annotations(spark, path, DEFINITIONS).withColumn("model", F.lit(m)))
    return tables[0].unionByName(tables[1]).drop("ingest_seq", "author", "created")


_ANNOTATED = [
    "item_id",
    "author",
    "created",
    "truth",
    "keyword",
    "text",
    *[f"{d}_{part}" for d in DEFINITIONS for part in ("Decision", "Explanation")],
]


def limited_scan(spark, sf):
    return readers.limited(derived.items(spark, sf), LIMIT).select(
        "item_id", "truth", "keyword", "text_length", "text"
    )


def definition_fanout(spark, sf):
    return ann.fan_out(derived.texts(spark, sf), RUBRICS).select("item_id", "definition", "keyword")


def build_prompt(spark, sf):
    fanned = ann.fan_out(derived.texts(spark, sf), RUBRICS)
    return ann.build_prompts(fanned).select("item_id", "definition", "prompt")


def annotate(spark, sf):
    return ann.annotate(derived.items(spark, sf), RUBRICS, "M", derived.length_scorer, sleep=derived.no_wait)


def annotate_concurrent(spark, sf):
    """Eight prompts in flight per partition."""
    return ann.annotate(
        derived.items(spark, sf), RUBRICS, "M", derived.length_scorer,
        sleep=derived.no_wait, backoff=derived.at_once, max_in_flight=8,
    )


def annotate_incremental(spark, sf):
    """The documents arrive as a stream of files; the labels are a table."""
    stream = (
        spark.readStream.schema(derived.DOCUMENTS)
        .option("maxFilesPerTrigger", 100)
        # As a pattern, for which the table may be one file or a folder of files.
        .parquet(f"{sf}/[d]ocuments.parquet")
    )
    items = derived.items_of(stream, derived.labels(spark, sf))
    output, checkpoint = scratch_path(spark, "incremental"), scratch_path(spark, "progress")

    def annotate_batch(batch, seq):
        return ann.annotate(
            batch, RUBRICS, "M", derived.length_scorer, ingest_seq=seq, sleep=derived.no_wait
        )

    annotate_incrementally(items, output, checkpoint, annotate_batch).awaitTermination()
    return read_batches(spark, output).drop("batch_id")


def annotate_ranges(spark, sf):
    """Four ranges of rows, each a part under its name; then all parts as rows per definition."""
    items = row_ranges.number_rows(derived.texts(spark, sf), scratch_path(spark, "numbered"))

    def annotate_batch(batch, first):
        return ann.annotation_table(
            batch, RUBRICS, derived.length_scorer, keep=["item_id"], sleep=derived.no_wait
        )

    parts = row_ranges.annotate_ranges(
        items, scratch_path(spark, "ranges"), DEFINITIONS, -(-items.count() // 4), annotate_batch
    )
    entries = ", ".join(
        f"struct('{d}' AS definition, {d}_Decision AS decision, {d}_Explanation AS explanation)" for d in DEFINITIONS
    )
    return parts.selectExpr("item_id", f"inline(array({entries}))")


def parse_response(spark, sf):
    parsed = derived.predictions(derived.items(spark, sf), quote_text=True)
    return parsed.select("item_id", "definition", "model", "ingest_seq", "decision", "explanation")


def response_body(spark, sf):
    """Stored JSON bodies, some of them without the field."""
    answers = derived.responses(derived.items(spark, sf), quote_text=True)
    raw = F.when(F.col("item_id") % 30 != 4, F.col("raw_response"))
    bodies = answers.withColumn("body", F.to_json(F.struct(raw.alias("response"))))
    return bodies.select(
        "item_id", "definition", "model", "ingest_seq", response_field(F.col("body")).alias("response")
    )


def decision_counts(spark, sf):
    return ann.decision_counts(derived.predictions(derived.items(spark, sf)))


def binarize_decisions(spark, sf):
    binary = _binary_annotations(spark, sf)["L"]
    return binary.select("item_id", "ingest_seq", *_DECIDED)


_DECIDED = [f"{d}_{part}" for d in DEFINITIONS for part in ("Decision", "Binary")]


def combine_models(spark, sf):
    items = derived.items(spark, sf)
    tables = {m: derived.annotations(items, m) for m in MODELS}
    return merge.combine_models(tables, DEFINITIONS).select(
        "item_id", "model", "ingest_seq", "truth", "keyword", "text", *_DECIDED
    )


def dedup_last_wins(spark, sf):
    answers = derived.predictions(derived.items(spark, sf))
    last = merge.last_answer(answers, ["item_id", "definition", "model"], ["pred", "decision_code"])
    return last.withColumn("decision", decision_name(F.col("decision_code"))).drop("decision_code")


def merge_comparative(spark, sf):
    binary = _binary_annotations(spark, sf)
    return merge.comparative(binary["S"], "S", {"L": binary["L"]}, DEFINITIONS)


def merge_upsert(spark, sf):
    """Answers come in three lots, the last ones first, and are merged into a stored table of 16 buckets."""
    answers = materialize(_predictions(spark, sf), "answers")
    columns = answers.select("item_id", "truth", "keyword", "text_length").schema
    merged = MergedAnswers(spark, scratch_path(spark, "merged"), VARIANTS, 16, columns)
    for lot in (2, 0, 1):
        merged.upsert(answers.where(F.pmod(F.col("item_id") + F.col("ingest_seq"), F.lit(3)) == lot))
    return merged.read()


def text_length(spark, sf):
    return readers.with_length(derived.texts(spark, sf)).select("item_id", "text_length")


def unpivot_predictions(spark, sf):
    return merge.unpivot_predictions(_wide(spark, sf), VARIANTS, ["item_id", "truth"])


def select_models(spark, sf):
    return merge.select_models(_rows(spark, sf, "keyword", "text_length"), ["L"])


def unscored_items(spark, sf):
    answers = derived.predictions(derived.items(spark, sf))
    return merge.unscored_items(derived.texts(spark, sf), answers, VARIANTS)


def fp_rows(spark, sf):
    return transitions.fp_rows(_rows(spark, sf, "keyword", "text_length"))


def filter_keywords(spark, sf):
    return slices.filter_keywords(_rows(spark, sf, "keyword"), KEYWORDS)


def fp_flags(spark, sf):
    return transitions.fp_flags(_wide(spark, sf), VARIANTS)


def fp_transitions(spark, sf):
    return transitions.fp_transitions(_wide(spark, sf), DEFINITIONS, "S", "L")


def _review(spark, sf, category):
    keep = ["item_id", "keyword", "text_length"]
    changes = transitions.fp_changes(_wide(spark, sf, *keep[1:]), DEFINITIONS, "S", "L", keep)
    return transitions.review_rows(changes, category, derived.texts(spark, sf))


def fp_fixed_rows(spark, sf):
    return _review(spark, sf, "fixed")


def fp_introduced_rows(spark, sf):
    return _review(spark, sf, "introduced")


def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_rows(spark, sf))


def classification_metrics(spark, sf):
    return _round(_scored(spark, sf))


def metric_comparison(spark, sf):
    return _round(evaluate.metric_comparison(_scored(spark, sf), VARIANTS))


def metric_improvement(spark, sf):
    return _round(evaluate.metric_improvement(_scored(spark, sf), DEFINITIONS, "S", "L"))


def metrics_by_slice(spark, sf):
    rows = _rows(spark, sf, "keyword")
    return _round(evaluate.classification_metrics(rows, ["keyword", "definition", "model"]))


def metrics_rollup(spark, sf):
    binned = slices.length_bins(_rows(spark, sf, "keyword", "text_length"), WIDE_EDGES)
    return _round(evaluate.metrics_rollup(binned, ["length_bin", "keyword"]))


def length_cutoff_metrics(spark, sf):
    return _round(evaluate.length_cutoff_metrics(_rows(spark, sf, "text_length"), CUTOFFS))


def length_cutoff_curve(spark, sf):
    return _round(evaluate.length_cutoff_curve(_rows(spark, sf, "text_length")))


def best_length_cutoff(spark, sf):
    """The cut-off of the best F1 that keeps at least half of the labelled items."""
    curve = evaluate.length_cutoff_curve(_rows(spark, sf, "text_length"))
    return _round(evaluate.best_length_cutoff(curve, "f1", min_share=0.5))


def length_bins(spark, sf):
    items = derived.texts(spark, sf).select("item_id", "text_length")
    return slices.length_bins(items)


def length_bins_wide(spark, sf):
    items = derived.texts(spark, sf).select("item_id", "text_length")
    return slices.length_bins(items, WIDE_EDGES, open_ended=True)


def fp_by_length(spark, sf):
    by_length = slices.fp_by_length(_rows(spark, sf, "text_length"))
    return _round(by_length.orderBy("definition", "model", "bin_ordinal"))


def fp_by_length_wide(spark, sf):
    by_length = slices.fp_by_length(_rows(spark, sf, "text_length"), WIDE_EDGES)
    return _round(by_length.orderBy("definition", "model", "bin_ordinal"))


def fp_length_curve(spark, sf):
    by_length = slices.fp_by_length(_rows(spark, sf, "text_length"), WIDE_EDGES)
    return _round(slices.fp_length_curve(by_length, VARIANTS))


def fp_by_keyword(spark, sf):
    by_keyword = slices.fp_by_keyword(_rows(spark, sf, "keyword"))
    return _round(slices.highest_rate_first(by_keyword, "keyword"))


def fp_keyword_topn(spark, sf):
    by_keyword = slices.fp_by_keyword(_rows(spark, sf, "keyword"))
    return _round(slices.top_keywords(by_keyword, TOP_KEYWORDS))


def dataset_overview(spark, sf):
    return _round(dataset.dataset_overview(derived.items(spark, sf)))


def keyword_counts(spark, sf):
    return dataset.keyword_counts(derived.texts(spark, sf))


def keyword_topn(spark, sf):
    return dataset.keyword_counts(derived.texts(spark, sf)).limit(TOP_KEYWORDS)


def keyword_topn_summary(spark, sf):
    """The same by a summary of bounded size that proposes candidates, which alone are counted."""
    return sketches.top_values(derived.texts(spark, sf), "keyword", TOP_KEYWORDS)


def keyword_length_quantiles(spark, sf):
    """Quantiles per keyword from mergeable sketches of parts, checked against exact ranks."""
    items = derived.texts(spark, sf).where("keyword IS NOT NULL").select("item_id", "keyword", "text_length")
    parts = sketches.quantile_sketches(items.withColumn("day", F.col("item_id") % 7), ["keyword", "day"])
    found = sketches.sketch_quantiles(sketches.merge_sketches(parts, ["keyword"]), QUANTILES)
    errors = sketches.rank_errors(found, items, ["keyword"])
    exact = F.when(F.col("share").isin(0.0, 1.0), F.col("quantile"))
    return errors.select(
        "keyword", "share", "n_items", exact.alias("extreme"), (F.col("rank_error") <= sketches.RANK_ERROR).alias("near")
    )


def length_bins_joined(spark, sf):
    """Items per bin, the bins being a table: 2,500 narrow ones, and wide ones that overlap and are open above."""
    items = derived.texts(spark, sf).select("item_id", "text_length")
    bins = spark.range(2500).selectExpr("id * 8 AS low", "id * 8 + 8 AS high", "concat('narrow ', id) AS bin")
    wide = spark.range(12).selectExpr("id * 500 AS low", "if(id < 11, id * 700 + 900, NULL) AS high", "concat('wide ', id) AS bin")
    return range_join(items, bins.unionByName(wide), "text_length").groupBy("bin").agg(F.count("*").alias("n_items"))


def keyword_positive_rate(spark, sf):
    rates = dataset.keyword_positive_rate(derived.labelled_items(spark, sf))
    return _round(rates.limit(TOP_KEYWORDS))


def length_stats(spark, sf):
    return _round(dataset.length_stats(derived.texts(spark, sf)))


def length_histogram(spark, sf):
    return _round(dataset.length_histogram(derived.texts(spark, sf), HISTOGRAM_BINS))


def _summary(spark, sf):
    scored = materialize(_scored(spark, sf), "scored")
    return dataset.run_summary(
        derived.items(spark, sf),
        VARIANTS,
        evaluate.metric_comparison(scored, VARIANTS),
        evaluate.metric_improvement(scored, DEFINITIONS, "S", "L"),
        transitions.fp_transitions(_wide(spark, sf), DEFINITIONS, "S", "L"),
    )


def run_summary_tables(spark, sf):
    """Every value of the three tables that the summary nests."""
    summary = materialize(_summary(spark, sf), "summary")
    names = [v.name for v in VARIANTS]
    tables = []
    for section, columns in (("comparison", names), ("improvement", DEFINITIONS), ("fp_changes", DEFINITIONS)):
        cells = F.array(*[F.struct(F.lit(c).alias("variant"), F.col("v")[c].cast("double").alias("value")) for c in columns])
        rows = summary.select(F.explode(section).alias("entry", "v"))
        tables.append(rows.select(F.lit(section).alias("section"), "entry", F.inline(cells)))
    return _round(tables[0].unionByName(tables[1]).unionByName(tables[2]))


def run_summary(spark, sf):
    summary = _summary(spark, sf)
    return _round(
        summary.select(
            "n_items",
            "n_positive",
            "n_negative",
            F.array_join("variants", ", ").alias("variants"),
            F.col("comparison")["precision"]["A_S"].alias("precision_a_s"),
            F.col("comparison")["recall"]["B_L"].alias("recall_b_l"),
            F.col("improvement")["fp_rate"]["A"].alias("fp_rate_gain_a"),
            F.col("fp_changes")["fixed"]["B"].alias("fixed_b"),
        )
    )


def _tokens(spark, sf, stop_words=None):
    return topics.fp_tokens(_wide(spark, sf), VARIANTS, stop_words, derived.texts(spark, sf))


def fp_tokens(spark, sf):
    tokens = _tokens(spark, sf, STOP_WORDS)
    return tokens.select(
        "item_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words")
    )


def fp_vocabulary(spark, sf):
    texts = topics.by_variant(_tokens(spark, sf, STOP_WORDS), VARIANTS)
    return topics.vocabulary(texts, ["definition", "model"])


_fitted: dict[tuple[str, str], topics.TopicTables] = {}


def _topics(spark, sf):
    """One fit per session and tables, shared by the topic queries: its results are written tables."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        _fitted[key] = topics.fit_topics(_tokens(spark, sf), VARIANTS)
    return _fitted[key]


def fp_topics(spark, sf):
    return topics.topic_counts(_topics(spark, sf))


def fp_topic_assignments(spark, sf):
    return _topics(spark, sf).assignments


def fp_topic_counts(spark, sf):
    return topics.topic_counts(_topics(spark, sf)).drop("label", "words", "weights")


def fp_topic_examples(spark, sf):
    return topics.topic_examples(_topics(spark, sf), derived.texts(spark, sf))


def entry(spark: SparkSession) -> DataFrame:
    """Scores of every variant on the labelled documents."""
    return classification_metrics(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "scan_items": scan_items,
        "scan_items_split": scan_items_split,
        "scan_annotations": scan_annotations,
        "limited_scan": limited_scan,
        "definition_fanout": definition_fanout,
        "build_prompt": build_prompt,
        "annotate": annotate,
        "annotate_concurrent": annotate_concurrent,
        "annotate_incremental": annotate_incremental,
        "annotate_ranges": annotate_ranges,
        "parse_response": parse_response,
        "response_field": response_body,
        "decision_counts": decision_counts,
        "binarize_decisions": binarize_decisions,
        "combine_models": combine_models,
        "dedup_last_wins": dedup_last_wins,
        "merge_comparative": merge_comparative,
        "merge_upsert": merge_upsert,
        "text_length": text_length,
        "unpivot_predictions": unpivot_predictions,
        "select_models": select_models,
        "unscored_items": unscored_items,
        "fp_rows": fp_rows,
        "filter_keywords": filter_keywords,
        "fp_flags": fp_flags,
        "fp_transitions": fp_transitions,
        "fp_fixed_rows": fp_fixed_rows,
        "fp_introduced_rows": fp_introduced_rows,
        "confusion_matrix": confusion_matrix,
        "classification_metrics": classification_metrics,
        "metric_comparison": metric_comparison,
        "metric_improvement": metric_improvement,
        "metrics_by_slice": metrics_by_slice,
        "metrics_rollup": metrics_rollup,
        "length_cutoff_metrics": length_cutoff_metrics,
        "length_cutoff_curve": length_cutoff_curve,
        "best_length_cutoff": best_length_cutoff,
        "length_bins": length_bins,
        "length_bins_wide": length_bins_wide,
        "fp_by_length": fp_by_length,
        "fp_by_length_wide": fp_by_length_wide,
        "fp_length_curve": fp_length_curve,
        "fp_by_keyword": fp_by_keyword,
        "fp_keyword_topn": fp_keyword_topn,
        "dataset_overview": dataset_overview,
        "keyword_counts": keyword_counts,
        "keyword_topn": keyword_topn,
        "keyword_topn_summary": keyword_topn_summary,
        "keyword_length_quantiles": keyword_length_quantiles,
        "length_bins_joined": length_bins_joined,
        "keyword_positive_rate": keyword_positive_rate,
        "length_stats": length_stats,
        "length_histogram": length_histogram,
        "run_summary": run_summary,
        "run_summary_tables": run_summary_tables,
        "fp_tokens": fp_tokens,
        "fp_vocabulary": fp_vocabulary,
        "fp_topics": fp_topics,
        "fp_topic_assignments": fp_topic_assignments,
        "fp_topic_counts": fp_topic_counts,
        "fp_topic_examples": fp_topic_examples,
    }
    return {**own, **{k: q for m in OPTIONAL for k, q in m.queries().items()}}


# -- the same in SQL


def _text(value: str) -> str:
    """A SQL string literal; control and non-ASCII characters by code point."""
    if value.isprintable() and value.isascii():
        return "'" + value.replace("'", "''") + "'"
    return "(" + " || ".join(f"chr({ord(c)})" for c in value) + ")"


def _prose(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ITEMS = """
items AS (
  SELECT d.doc_id AS item_id, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS created,
         l.toxic AS truth,
         CASE WHEN d.doc_id % 53 <> 7 THEN concat(d.source, '-', d.lang) END AS keyword,
         d.text, CAST(d.n_chars AS INTEGER) AS text_length
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

_RULES = "rules(definition, model, k1, k2, t0, t1) AS (VALUES {})".format(
    ", ".join(f"('{v.definition}', '{v.model}', {a}, {b}, {c}, {d})"
              for v, (a, b, c, d) in derived.ANSWER_RULES.items())
)


def _raw(yes: str, reason: str) -> str:
    return f"""CASE
      WHEN item_id % 30 = 4 THEN 'ERROR: Status code 500'
      WHEN item_id % 30 = 9 THEN 'Perhaps; the item is ambiguous.'
      WHEN item_id % 30 = 14 THEN 'DECISION: Cannot say' || chr(10) || 'EXPLANATION: unsure'
      WHEN item_id % 6 = 1 THEN '<think>weighing it</think>' || chr(10) || 'DECISION: ' ||
           CASE WHEN {yes} THEN 'yes' ELSE 'no' END || '.' || chr(10) || chr(10) ||
           'EXPLANATION:' || chr(9) || {reason} || '  '
      WHEN item_id % 6 = 2 THEN CASE WHEN {yes} THEN 'YES' ELSE 'NO' END || ', as the rubric states.'
      WHEN item_id % 6 = 3 THEN 'DECISION: ' || CASE WHEN {yes} THEN 'Yes' ELSE 'No' END ||
           chr(10) || 'EXPLANATION: first EXPLANATION: second DECISION: No'
      ELSE 'DECISION: ' || CASE WHEN {yes} THEN 'Yes' ELSE 'No' END ||
           chr(10) || 'EXPLANATION: ' || {reason} END"""


def _parse(raw: str) -> tuple[str, str]:
    """SQL of the decision and the explanation in ``raw``."""
    d, e = f"'{DECISION_MARK}'", f"'{EXPLANATION_MARK}'"
    formatted = f"(contains({raw}, {d}) AND contains({raw}, {e}))"
    judged = (
        f"CASE WHEN {formatted} THEN lower(split_part(split_part({raw}, {d}, 2), {e}, 1)) "
        f"ELSE substring(lower({raw}), 1, 50) END"
    )
    decided = (
        f"CASE WHEN {raw} IS NULL THEN 'Error' WHEN contains({judged}, 'yes') THEN 'Yes' "
        f"WHEN contains({judged}, 'no') THEN 'No' ELSE 'Unclear' END"
    )
    explained = (
        f"CASE WHEN {formatted} THEN trim(split_part({raw}, {e}, 2), {_text(WHITESPACE)}) "
        f"ELSE {raw} END"
    )
    return decided, explained


def _answers(reason: str = "'reason ' || CAST(item_id AS VARCHAR)") -> str:
    decided, explained = _parse("raw_response")
    return f"""{_ITEMS}, {_RULES},
attempts AS (
  SELECT i.*, r.*, CAST(a.n AS BIGINT) AS ingest_seq,
         ((item_id * k1 + text_length * k2) % 100 < t0 + t1 * coalesce(truth, 0)) = (a.n = 1) AS yes
  FROM items i, rules r, (VALUES (1), (2)) a(n)
  WHERE (model <> 'L' OR item_id % 37 <> 5) AND (a.n = 1 OR (model = 'L' AND item_id % 41 = 3))
),
responses AS (SELECT *, {_raw('yes', reason)} AS raw_response FROM attempts),
parsed AS (SELECT *, {decided} AS decision, {explained} AS explanation FROM responses),
predictions AS (
  SELECT * EXCLUDE (yes, k1, k2, t0, t1), CAST(decision = 'Yes' AS INTEGER) AS pred FROM parsed
)"""


def _variant_columns(source: str, value: str, cast: str = "") -> str:
    return ", ".join(
        f"max({source}) FILTER (WHERE definition = '{v.definition}' AND model = '{v.model}'){cast} "
        f"AS {v.name}" if value else ""
        for v in VARIANTS
    )


def _evaluation() -> str:
    """``ev``: a row per labelled item and variant; ``wide``: a row per labelled item."""
    return f"""{_answers()},
last AS (
  SELECT * FROM predictions WHERE truth IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY item_id, definition, model ORDER BY ingest_seq DESC) = 1
),
ev AS (
  SELECT i.item_id, i.truth, i.keyword, i.text_length, i.text, r.definition, r.model,
         l.decision, l.pred
  FROM items i CROSS JOIN rules r
  LEFT JOIN last l ON l.item_id = i.item_id AND l.definition = r.definition AND l.model = r.model
  WHERE i.truth IS NOT NULL
),
wide AS (
  SELECT item_id, truth, keyword, text_length, {_variant_columns('pred', 'pred')}
  FROM ev GROUP BY item_id, truth, keyword, text_length
)"""


_CELLS = """count(*) FILTER (WHERE truth = 1 AND pred = 1) AS tp,
         count(*) FILTER (WHERE truth = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE truth = 1 AND pred = 0) AS fn,
         count(*) FILTER (WHERE truth = 0 AND pred = 0) AS tn"""

_EXTRA = """count(*) FILTER (WHERE pred IS NULL) AS n_unscored,
         count(*) FILTER (WHERE decision = 'Unclear') AS n_unclear,
         count(*) FILTER (WHERE decision = 'Error') AS n_error"""


def _score_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    tp, fp, fn, tn = (f"CAST({c} AS DOUBLE)" for c in (tp, fp, fn, tn))

    def ratio(a: str, b: str) -> str:
        return f"coalesce(({a}) / nullif({b}, 0), 0.0)"

    recall, specificity = ratio(tp, f"{tp} + {fn}"), ratio(tn, f"{tn} + {fp}")
    return {
        "accuracy": ratio(f"{tp} + {tn}", f"{tp} + {fn} + {tn} + {fp}"),
        "precision": ratio(tp, f"{tp} + {fp}"),
        "recall": recall,
        "specificity": specificity,
        "f1": ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
        "fbeta": ratio(f"1.25::DOUBLE * {tp}", f"1.25::DOUBLE * {tp} + 0.25::DOUBLE * {fn} + {fp}"),
        "fp_rate": ratio(fp, f"{tn} + {fp}"),
        "mcc": ratio(
            f"{tp} * {tn} - {fp} * {fn}",
            f"sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))",
        ),
        "balanced_accuracy": f"CASE WHEN {tp} + {fn} = 0 THEN {specificity} "
        f"WHEN {tn} + {fp} = 0 THEN {recall} ELSE ({recall} + {specificity}) / 2 END",
        "g_mean": f"sqrt({recall} * {specificity})",
        "fp_share": f"{fp} / nullif({tp} + {fp}, 0)",
    }


def _metrics(by: str, source: str = "ev") -> str:
    """A query for all counts and scores grouped by the given columns."""
    scored = ", ".join(f"round({e}, 10) AS {n}" for n, e in _score_sql().items())
    return f"""SELECT {by}, tp, fp, fn, tn, n_unscored, n_unclear, n_error, {scored},
       tp + fp AS predicted_positive, fp + fn AS total_errors
FROM (SELECT {by}, {_CELLS}, {_EXTRA} FROM {source} GROUP BY {by})"""


def _curve() -> str:
    """``curve``: counts and scores of every variant at every length as a cut-off."""
    running = ", ".join(
        f"CAST(sum({c}) OVER (PARTITION BY definition, model ORDER BY cutoff) AS BIGINT) AS {c}" for c in COUNTS
    )
    every = "sum(tp + fp + fn + tn) OVER (PARTITION BY definition, model)"
    scored = ", ".join(f"{e} AS {n}" for n, e in _score_sql().items())
    return f"""{_evaluation()},
by_length AS (
  SELECT definition, model, CAST(text_length AS BIGINT) AS cutoff, {_CELLS} FROM ev
  WHERE truth IS NOT NULL AND pred IS NOT NULL AND text_length IS NOT NULL GROUP BY ALL),
running AS (SELECT definition, model, cutoff, {running}, {every} AS n_all FROM by_length),
curve AS (
  SELECT definition, model, cutoff, tp, fp, fn, tn, {scored}, tp + fp AS predicted_positive, fp + fn AS total_errors,
         tp + fp + fn + tn AS n_kept, (tp + fp + fn + tn) / CAST(n_all AS DOUBLE) AS share_kept FROM running)"""


def _bins(edges: tuple[int, ...], open_ended: bool = False, length: str = "text_length") -> str:
    """SQL of the bin's index and label."""
    last = len(edges) - 2
    inside = (
        f"{length} >= {edges[0]}" if open_ended
        else f"{length} > {edges[0]} AND {length} <= {edges[-1]}"
    )
    cases = " ".join(f"WHEN {length} <= {hi} THEN {i}" for i, hi in enumerate(edges[1:-1]))
    ordinal = f"CASE WHEN NOT ({inside}) OR {length} IS NULL THEN NULL {cases} ELSE {last} END"
    labels = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(bin_labels(edges)))
    return f"CAST({ordinal} AS INTEGER) AS bin_ordinal, CASE {ordinal} {labels} END AS length_bin"


def _fp_slice(by: str, source: str, min_items: int) -> str:
    return f"""SELECT {by}, definition, model, count(*) AS n_items,
       count(*) FILTER (WHERE truth = 0) AS n_negative,
       count(*) FILTER (WHERE truth = 0 AND pred = 1) AS n_fp,
       round(count(*) FILTER (WHERE truth = 0 AND pred = 1)
             / CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE), 10) AS fp_rate
FROM {source}
GROUP BY {by}, definition, model
HAVING count(*) FILTER (WHERE truth = 0) > 0 AND count(*) >= {min_items}"""


def _annotation_sql(model: str) -> str:
    """One model's annotation rows, wide by definition."""
    columns = ", ".join(
        f"max(decision) FILTER (WHERE definition = '{d}') AS {d}_Decision, "
        f"max(explanation) FILTER (WHERE definition = '{d}') AS {d}_Explanation, "
        f"max(pred) FILTER (WHERE definition = '{d}') AS {d}_Binary"
        for d in DEFINITIONS
    )
    return (
        f"SELECT item_id, ingest_seq, model, {columns} FROM predictions "
        f"WHERE model = '{model}' GROUP BY item_id, ingest_seq, model"
    )


def _change_sql(d: str) -> str:
    s, big = Variant(d, "S").name, Variant(d, "L").name
    return (
        f"CASE WHEN truth <> 0 OR {s} IS NULL OR {big} IS NULL THEN NULL "
        f"WHEN {s} = 1 AND {big} = 0 THEN 'fixed' WHEN {s} = 0 AND {big} = 1 THEN 'introduced' "
        f"WHEN {s} = 1 AND {big} = 1 THEN 'persistent' END"
    )


def _annotated_sql() -> str:
    rubrics = ", ".join(f"('{r.definition}', {_sql_lines(r.prefix)}, {_sql_lines(r.suffix)})" for r in RUBRICS)
    decided, explained = _parse("raw_response")
    return f"""WITH {_ITEMS},
rubrics(definition, prefix, suffix) AS (VALUES {rubrics}),
prompts AS (
  SELECT item_id, truth, keyword, text_length, definition, length(prefix || text || suffix) AS n
  FROM items CROSS JOIN rubrics
),
answers AS (
  SELECT *, CASE WHEN n % 10 = 0 THEN 'ERROR: Status code 500' WHEN n % 10 = 1 THEN 'Perhaps.'
    ELSE 'DECISION: ' || CASE WHEN n % 3 = 0 THEN 'Yes' ELSE 'No' END || chr(10) ||
         'EXPLANATION: ' || CAST(n AS VARCHAR) || ' characters ' END AS raw_response
  FROM prompts
),
decided AS (SELECT *, {decided} AS decision, {explained} AS explanation FROM answers)
SELECT item_id, truth, keyword, text_length, definition, 'M' AS model, CAST(1 AS BIGINT) AS ingest_seq,
       raw_response, decision, explanation, CAST(decision = 'Yes' AS INTEGER) AS pred
FROM decided"""


def _sql_lines(value: str) -> str:
    return " || chr(10) || ".join(_prose(line) for line in value.split("\n"))


def _token_sql() -> str:
    flags = ", ".join(
        f"CAST(coalesce(truth = 0 AND {v.name} = 1, false) AS INTEGER) AS {v.name}_fp" for v in VARIANTS
    )
    any_flag = " + ".join(f"{v.name}_fp" for v in VARIANTS)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""{_evaluation()},
flags AS (SELECT item_id, {flags} FROM wide),
tokens AS (
  SELECT f.*, list_filter(regexp_extract_all(lower(i.text), '{WORD}'),
                          lambda w: NOT list_contains([{stops}], w)) AS words
  FROM flags f JOIN items i USING (item_id) WHERE {any_flag} > 0
)"""


def oracle_sql() -> dict[str, str]:
    by_variant = "definition, model"
    scored = f"scored AS ({_metrics(by_variant)})"
    exact = ", ".join(f"{e} AS {n}" for n, e in _score_sql().items())
    rounded = ", ".join(f"round({n}, 10) AS {n}" for n in (*_score_sql(), "share_kept"))
    unrounded = (
        f"scored AS (SELECT {by_variant}, {exact} FROM "
        f"(SELECT {by_variant}, {_CELLS} FROM ev GROUP BY {by_variant}))"
    )
    unpivoted = "UNPIVOT scored ON {} INTO NAME metric VALUE value".format(", ".join(evaluate.REPORTED))
    pivoted = ", ".join(
        f"round(max(value) FILTER (WHERE definition = '{v.definition}' AND model = '{v.model}'), 10) "
        f"AS {v.name}"
        for v in VARIANTS
    )
    gain = (
        "(CASE WHEN metric = 'fp_rate' THEN small - large ELSE large - small END) "
        "/ greatest(0.0001::DOUBLE, small)"
    )
    improvement = f"""paired AS (
  SELECT metric, definition, max(value) FILTER (WHERE model = 'S') AS small,
         max(value) FILTER (WHERE model = 'L') AS large
  FROM ({unpivoted}) GROUP BY metric, definition
)"""
    gains = ", ".join(f"round(max({gain}) FILTER (WHERE definition = '{d}'), 10) AS {d}" for d in DEFINITIONS)
    category_counts = " UNION ALL ".join(
        "SELECT '{}' AS category, {}".format(
            c, ", ".join(f"count(*) FILTER (WHERE {_change_sql(d)} = '{c}') AS {d}" for d in DEFINITIONS)
        ) + " FROM wide"
        for c in transitions.CATEGORIES
    )
    changes = " UNION ALL ".join(
        f"SELECT item_id, keyword, text_length, '{d}' AS definition, {_change_sql(d)} AS category FROM wide"
        for d in DEFINITIONS
    )

    def review(category: str) -> str:
        return f"""WITH {_evaluation()}, changes AS ({changes})
SELECT c.*, i.text FROM changes c JOIN items i USING (item_id) WHERE category = '{category}'"""

    full = _score_sql("all_tp", "all_fp", "all_fn", "all_tn")
    cut = _score_sql("cut_tp", "cut_fp", "cut_fn", "cut_tn")
    cutoff = "CASE definition {} END".format(" ".join(f"WHEN '{d}' THEN {n}" for d, n in CUTOFFS.items()))
    cells = ", ".join(
        f"count(*) FILTER (WHERE truth = {t} AND pred = {p}{keep}) AS {prefix}{name}"
        for prefix, keep in (("all_", ""), ("cut_", f" AND text_length <= {cutoff}"))
        for name, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    )
    cutoffs = " UNION ALL ".join(
        f"SELECT definition, model, '{m}' AS metric, round({full[m]}, 10) AS original, "
        f"round({cut[m]}, 10) AS with_cutoff FROM counted"
        for m in evaluate.CUTOFF_REPORTED
    )
    flags = ", ".join(
        f"CAST(coalesce(truth = 0 AND {v.name} = 1, false) AS INTEGER) AS {v.name}_fp" for v in VARIANTS
    )
    names = ", ".join(v.name for v in VARIANTS)
    decided = ", ".join(_DECIDED)
    binned = f"binned AS (SELECT *, {_bins(WIDE_EDGES)} FROM ev)"
    curve = ", ".join(
        f"max(fp_rate) FILTER (WHERE definition = '{v.definition}' AND model = '{v.model}') AS {v.name}"
        for v in VARIANTS
    )
    vocabulary = " UNION ALL ".join(
        f"""SELECT '{v.definition}' AS definition, '{v.model}' AS model, word, count(*) AS n_texts
FROM (SELECT unnest(list_distinct(words)) AS word FROM tokens WHERE {v.name}_fp = 1)
GROUP BY word
HAVING count(*) >= 2
   AND count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM tokens WHERE {v.name}_fp = 1)"""
        for v in VARIANTS
    )
    rubric_values = ", ".join(
        f"('{r.definition}', {_sql_lines(r.prefix)}, {_sql_lines(r.suffix)})" for r in RUBRICS
    )
    keyword_rank = f"{_fp_slice('keyword', 'ev', 5)} AND keyword IS NOT NULL"
    histogram = f"""WITH bounds AS (
  SELECT CAST(min(n_chars) AS DOUBLE) AS lo,
         CAST(max(n_chars) - min(n_chars) AS DOUBLE) / {HISTOGRAM_BINS} AS width FROM documents
), placed AS (
  SELECT least(CAST(floor((n_chars - lo) / width) AS BIGINT), {HISTOGRAM_BINS - 1}) AS bin, count(*) AS n
  FROM documents, bounds GROUP BY 1
)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * width, 10) AS lower,
       round(lo + (b.bin + 1) * width, 10) AS upper, coalesce(n, 0) AS n_items
FROM range({HISTOGRAM_BINS}) b(bin) CROSS JOIN bounds LEFT JOIN placed p ON p.bin = b.bin"""
    own = {
        "scan_items": f"WITH {_ITEMS} SELECT * EXCLUDE (text_length) FROM items",
        "scan_items_split": f"WITH {_ITEMS} SELECT * EXCLUDE (text_length) FROM items",
        "scan_annotations": f"""WITH {_answers()},
tables AS ({_annotation_sql('S')} UNION ALL {_annotation_sql('L')})
SELECT t.item_id, i.truth, i.keyword, i.text, A_Decision, A_Explanation, B_Decision, B_Explanation, model
FROM tables t JOIN items i USING (item_id)""",
        "limited_scan": f"WITH {_ITEMS} SELECT item_id, truth, keyword, text_length, text FROM items "
        f"ORDER BY item_id LIMIT {LIMIT}",
        "definition_fanout": f"WITH {_ITEMS} SELECT item_id, definition, keyword "
        "FROM items CROSS JOIN (VALUES ('A'), ('B')) r(definition)",
        "build_prompt": f"WITH {_ITEMS}, rubrics(definition, prefix, suffix) AS (VALUES {rubric_values}) "
        "SELECT item_id, definition, prefix || text || suffix AS prompt FROM items CROSS JOIN rubrics",
        "annotate": _annotated_sql(),
        "annotate_concurrent": _annotated_sql(),
        "annotate_incremental": _annotated_sql(),
        "annotate_ranges": f"SELECT item_id, definition, decision, explanation FROM ({_annotated_sql()})",
        "parse_response": f"""WITH {_answers("'reason ' || text")}
SELECT item_id, definition, model, ingest_seq, decision, explanation FROM predictions""",
        "response_field": f"""WITH {_answers("'reason ' || text")}
SELECT item_id, definition, model, ingest_seq,
       CASE WHEN item_id % 30 = 4 THEN '' ELSE raw_response END AS response FROM responses""",
        "decision_counts": f"""WITH {_answers()}
SELECT definition, model, count(*) AS n_answers,
       count(*) FILTER (WHERE decision = 'Yes') AS n_yes, count(*) FILTER (WHERE decision = 'No') AS n_no,
       count(*) FILTER (WHERE decision = 'Unclear') AS n_unclear,
       count(*) FILTER (WHERE decision = 'Error') AS n_error
FROM predictions GROUP BY definition, model""",
        "binarize_decisions": f"WITH {_answers()} SELECT item_id, ingest_seq, {decided} "
        f"FROM ({_annotation_sql('L')})",
        "combine_models": f"""WITH {_answers()},
tables AS ({_annotation_sql('S')} UNION ALL {_annotation_sql('L')})
SELECT t.item_id, model, ingest_seq, truth, keyword, text, {decided}
FROM tables t JOIN items i USING (item_id)""",
        "dedup_last_wins": f"""WITH {_answers()}
SELECT item_id, definition, model, pred, decision FROM predictions
QUALIFY row_number() OVER (PARTITION BY item_id, definition, model ORDER BY ingest_seq DESC) = 1""",
        "merge_comparative": f"""WITH {_answers()},
base AS ({_annotation_sql('S')}),
other AS (SELECT * FROM ({_annotation_sql('L')})
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ingest_seq DESC) = 1)
SELECT i.* EXCLUDE (text_length), b.A_Binary AS A_S, b.B_Binary AS B_S, o.A_Binary AS A_L,
       o.B_Binary AS B_L, CAST(length(i.text) AS INTEGER) AS text_length
FROM base b JOIN items i USING (item_id) LEFT JOIN other o USING (item_id)""",
        "text_length": "SELECT doc_id AS item_id, CAST(length(text) AS INTEGER) AS text_length FROM documents",
        "unpivot_predictions": f"WITH {_evaluation()} SELECT item_id, truth, definition, model, pred FROM ev",
        "select_models": f"WITH {_evaluation()} SELECT * EXCLUDE (text) FROM ev WHERE model = 'L'",
        "unscored_items": f"""WITH {_answers()}
SELECT i.item_id, r.definition, r.model FROM items i CROSS JOIN rules r
ANTI JOIN predictions p ON p.item_id = i.item_id AND p.definition = r.definition AND p.model = r.model""",
        "fp_rows": f"WITH {_evaluation()} SELECT * EXCLUDE (text) FROM ev WHERE truth = 0 AND pred = 1",
        "filter_keywords": f"WITH {_evaluation()} SELECT * EXCLUDE (text, text_length) FROM ev "
        "WHERE keyword IN ({})".format(", ".join(f"'{k}'" for k in KEYWORDS)),
        "merge_upsert": f"WITH {_evaluation()} SELECT item_id, truth, keyword, text_length, {names} FROM wide",
        "fp_flags": f"WITH {_evaluation()} SELECT item_id, truth, {names}, {flags} FROM wide",
        "fp_transitions": f"WITH {_evaluation()} {category_counts}",
        "fp_fixed_rows": review("fixed"),
        "fp_introduced_rows": review("introduced"),
        "confusion_matrix": f"WITH {_evaluation()} SELECT definition, model, {_CELLS}, {_EXTRA} FROM ev "
        "GROUP BY definition, model",
        "classification_metrics": f"WITH {_evaluation()} {_metrics(by_variant)}",
        "metric_comparison": f"WITH {_evaluation()}, {unrounded} "
        f"SELECT metric, {pivoted} FROM ({unpivoted}) GROUP BY metric",
        "metric_improvement": f"WITH {_evaluation()}, {unrounded}, {improvement} "
        f"SELECT metric, {gains} FROM paired GROUP BY metric",
        "metrics_by_slice": f"WITH {_evaluation()} {_metrics('keyword, definition, model')}",
        "metrics_rollup": f"""WITH {_evaluation()}, {binned},
leveled AS (
  SELECT * EXCLUDE (length_bin, keyword), 0 AS level, CAST(NULL AS VARCHAR) AS length_bin,
         CAST(NULL AS VARCHAR) AS keyword FROM binned
  UNION ALL BY NAME
  SELECT * EXCLUDE (keyword), 1 AS level, CAST(NULL AS VARCHAR) AS keyword FROM binned
  UNION ALL BY NAME SELECT *, 2 AS level FROM binned
)
{_metrics('definition, model, level, length_bin, keyword', 'leveled')}""",
        "length_cutoff_metrics": f"WITH {_evaluation()}, "
        f"counted AS (SELECT definition, model, {cells} FROM ev GROUP BY definition, model) {cutoffs}",
        "length_cutoff_curve": f"WITH {_curve()} SELECT definition, model, cutoff, {rounded}, "
        "predicted_positive, total_errors, tp, fp, fn, tn, n_kept FROM curve",
        "best_length_cutoff": f"""WITH {_curve()},
ranked AS (
  SELECT definition, model, cutoff, n_kept, share_kept, f1,
         row_number() OVER (PARTITION BY definition, model ORDER BY f1 DESC, cutoff DESC) AS place,
         last_value(f1) OVER (PARTITION BY definition, model ORDER BY cutoff
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS original, share_kept >= 0.5 AS enough
  FROM curve)
SELECT definition, model, cutoff, n_kept, round(share_kept, 10) AS share_kept, round(f1, 10) AS with_cutoff,
       round(original, 10) AS original
FROM ranked WHERE enough QUALIFY place = min(place) OVER (PARTITION BY definition, model)""",
        "length_bins": f"WITH {_ITEMS} SELECT item_id, text_length, {_bins(LENGTH_EDGES)} FROM items",
        "length_bins_wide": f"WITH {_ITEMS} SELECT item_id, text_length, {_bins(WIDE_EDGES, True)} FROM items",
        "fp_by_length": f"WITH {_evaluation()}, binned AS (SELECT *, {_bins(LENGTH_EDGES)} FROM ev) "
        + _fp_slice("bin_ordinal, length_bin", "binned", 1) + " AND bin_ordinal IS NOT NULL",
        "fp_by_length_wide": f"WITH {_evaluation()}, {binned} "
        + _fp_slice("bin_ordinal, length_bin", "binned", 1) + " AND bin_ordinal IS NOT NULL",
        "fp_length_curve": f"WITH {_evaluation()}, {binned}, by_length AS ("
        + _fp_slice("bin_ordinal, length_bin", "binned", 1)
        + f" AND bin_ordinal IS NOT NULL) SELECT bin_ordinal, length_bin, {curve} FROM by_length "
        "GROUP BY bin_ordinal, length_bin",
        "fp_by_keyword": f"WITH {_evaluation()} {keyword_rank}",
        "fp_keyword_topn": f"""WITH {_evaluation()}, by_keyword AS ({keyword_rank})
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY definition, model ORDER BY fp_rate DESC, keyword)
                 AS INTEGER) AS rank FROM by_keyword
) WHERE rank <= {TOP_KEYWORDS}""",
        "dataset_overview": f"""WITH {_ITEMS}
SELECT count(*) AS n_items, count(truth) AS n_labelled, count(*) FILTER (WHERE truth = 1) AS n_positive,
       count(*) FILTER (WHERE truth = 0) AS n_negative, round(avg(truth), 10) AS positive_share FROM items""",
        "keyword_counts": f"WITH {_ITEMS} SELECT keyword, count(*) AS n_items FROM items "
        "WHERE keyword IS NOT NULL GROUP BY keyword",
        "keyword_topn": f"WITH {_ITEMS} SELECT keyword, count(*) AS n_items FROM items "
        f"WHERE keyword IS NOT NULL GROUP BY keyword ORDER BY n_items DESC, keyword LIMIT {TOP_KEYWORDS}",
        "keyword_topn_summary": f"WITH {_ITEMS} SELECT keyword, count(*) AS n_items FROM items "
        f"WHERE keyword IS NOT NULL GROUP BY keyword ORDER BY n_items DESC, keyword LIMIT {TOP_KEYWORDS}",
        "keyword_length_quantiles": f"""WITH {_ITEMS}, shares(share) AS (VALUES {', '.join(f'({q}::DOUBLE)' for q in QUANTILES)})
SELECT keyword, share, count(text_length) AS n_items,
       CASE share WHEN 0 THEN min(text_length) WHEN 1 THEN max(text_length) END::BIGINT AS extreme, true AS near
FROM items, shares WHERE keyword IS NOT NULL GROUP BY keyword, share""",
        "length_bins_joined": f"""WITH {_ITEMS}, bins(low, high, bin) AS (
  SELECT i * 8, i * 8 + 8, 'narrow ' || i FROM range(2500) t(i)
  UNION ALL SELECT i * 500, CASE WHEN i < 11 THEN i * 700 + 900 END, 'wide ' || i FROM range(12) t(i))
SELECT bin, count(*) AS n_items FROM items JOIN bins ON text_length > low AND (high IS NULL OR text_length <= high)
GROUP BY bin""",
        "keyword_positive_rate": f"""WITH {_ITEMS}
SELECT keyword, count(truth) AS n_items, round(avg(truth), 10) AS positive_rate FROM items
WHERE keyword IS NOT NULL AND truth IS NOT NULL GROUP BY keyword HAVING count(truth) >= 10
ORDER BY avg(truth) DESC, keyword LIMIT {TOP_KEYWORDS}""",
        "length_stats": """SELECT count(*) AS n_items, round(avg(n_chars), 10) AS mean_length,
       CAST(median(n_chars) AS DOUBLE) AS median_length, CAST(min(n_chars) AS INTEGER) AS min_length,
       CAST(max(n_chars) AS INTEGER) AS max_length FROM documents""",
        "length_histogram": histogram,
        "run_summary": f"""WITH {_evaluation()}, {scored}, {improvement},
changes AS ({category_counts})
SELECT (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM items WHERE truth = 1) AS n_positive,
       (SELECT count(*) FROM items WHERE truth = 0) AS n_negative, '{names}' AS variants,
       (SELECT precision FROM scored WHERE definition = 'A' AND model = 'S') AS precision_a_s,
       (SELECT recall FROM scored WHERE definition = 'B' AND model = 'L') AS recall_b_l,
       (SELECT round({gain}, 10) FROM (SELECT 'fp_rate' AS metric,
          (SELECT fp / CAST(fp + tn AS DOUBLE) FROM scored WHERE definition = 'A' AND model = 'S') AS small,
          (SELECT fp / CAST(fp + tn AS DOUBLE) FROM scored WHERE definition = 'A' AND model = 'L') AS large
       )) AS fp_rate_gain_a,
       (SELECT B FROM changes WHERE category = 'fixed') AS fixed_b""",
        "fp_tokens": f"WITH {_token_sql()} SELECT item_id, CAST(len(words) AS INTEGER) AS n_words, "
        "array_to_string(words, ' ') AS words FROM tokens",
        "fp_vocabulary": f"WITH {_token_sql()} {vocabulary}",
    }
    sections = [
        ("comparison", "metric_comparison", "metric", [v.name for v in VARIANTS]),
        ("improvement", "metric_improvement", "metric", DEFINITIONS),
        ("fp_changes", "fp_transitions", "category", DEFINITIONS),
    ]
    own["run_summary_tables"] = "WITH " + ", ".join(f"{n} AS ({own[query]})" for n, query, *_ in sections) + " UNION ALL ".join(
        f" SELECT '{n}' AS section, {key} AS entry, '{c}' AS variant, CAST({c} AS DOUBLE) AS value FROM {n}"
        for n, _, key, columns in sections
        for c in columns
    )
    return {**own, **{k: sql for m in OPTIONAL for k, sql in m.oracle_sql().items()}}
