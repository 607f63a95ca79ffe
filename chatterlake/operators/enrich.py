"""Enrichment: sentiment, topic and language for whole tables of posts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.functions import models as M
from chatterlake.functions import numbers as N
from chatterlake.functions import terms
from chatterlake.functions import text as X
from chatterlake.operators.silver import silver_extract, with_tags
from chatterlake.schemas import SILVER_POSTS

# Names under which the native baselines report.
TOPIC_MODEL = "local/tfidf-topic"
SENTIMENT_MODEL = "local/lexicon-sentiment"
#: Terms whose frequency every task knows.
FREQUENT_TERMS = 1 << 16
#: Row groups of work tables that are read by heavy stages, so that a file is many tasks.
WORK_MB = 8


def _scores(posts: DataFrame, text: str, topic: bool = True) -> DataFrame:
    """Add ``_a``: hits of the word lists and, for a ``topic``, its words."""
    return posts.withColumn("_a", M.analysed(F.col(text), M.word_lists(), M.STOP_WORDS if topic else None))


def _sentiment() -> Column:
    return M.sentiment(F.col("_a.pos"), F.col("_a.neg"))


def _language() -> Column:
    return M.language({code: F.col(f"_a.in_{code}") for code in M.LANGUAGE_WORDS})


def score_sentiment(posts: DataFrame, text: str = "text") -> DataFrame:
    """Add sentiment and sentiment_confidence from the lexicon baseline."""
    scored = _scores(posts, text, topic=False).withColumn("_s", _sentiment())
    return scored.withColumns({
        "sentiment": F.col("_s.label"), "sentiment_confidence": F.col("_s.confidence")
    }).drop("_a", "_s")


def detect_language(posts: DataFrame, text: str = "text") -> DataFrame:
    """Add language and language_confidence from the function-word baseline."""
    scored = _scores(posts, text, topic=False).withColumn("_l", _language())
    return scored.withColumns({
        "language": F.col("_l.code"), "language_confidence": F.col("_l.confidence")
    }).drop("_a", "_l")


def document_frequency(words: DataFrame) -> DataFrame:
    """Number of posts each term occurs in, combined per block of posts and map-side: (h1, h2, df).

    Terms are the words of column ``w`` and the pairs of neighbouring ones, named by 96 bits of hash.
    """
    counted = words.select("w").mapInArrow(terms.frequency_batches, "h1 bigint, h2 int, df bigint")
    return counted.groupBy("h1", "h2").agg(F.sum("df").alias("df"))


def _micro(score: Column) -> Column:
    return F.floor(score * F.lit(1e6) + F.lit(0.5))


def _idf(df: Column, total: Column) -> Column:
    return F.log((total + 1) / df) / F.log(total + 1)


def frequent_terms(df: DataFrame, total: Column, most: int = FREQUENT_TERMS) -> terms.Frequent:
    """The ``most`` most frequent terms with their idf: a table of a fixed number of rows."""
    rows = (df.orderBy(F.desc("df"), "h1", "h2").limit(most)
            .select("h1", "h2", _idf(F.col("df"), total).alias("idf")).toArrow())
    h1, h2, idf = (rows.column(c).to_numpy() for c in ("h1", "h2", "idf"))
    order = np.lexsort((h2, h1))
    # terms that are not stored have the highest idf there is
    others = max(float(idf.min()), 0.0) if len(idf) == most else 1.0
    return terms.Frequent(h1[order], h2[order], idf[order], others)


def extract_topic(posts: DataFrame, key: str, text: str = "text", work: str | None = None) -> DataFrame:
    """Best term of every post by TF-IDF: see :func:`topic_of_words`.

    The words are split off once and written, since frequencies and scores both read them.
    """
    work = work or storage.fresh_path(posts.sparkSession, "topics")
    words = _scores(posts.select(key, text), text).select(key, F.col("_a.w").alias("w"))
    return topic_of_words(storage.write_table(words, f"{work}/words", row_group_mb=WORK_MB), key, work)


def topic_of_words(words: DataFrame, key: str, work: str) -> DataFrame:
    """Best term of every post by TF-IDF: (key, topic_label, topic_confidence).

    ``words`` holds a post's usable words in column ``w``; term counts are written below ``work``,
    where a later run overwrites them. Stop words are gone before pairs are formed.

    Posts without a usable term get ('unknown', 0.0). Scores are compared as whole millionths
    and ties go to the smaller term, so the choice does not depend on the partitioning.

    Most terms of a post cannot win. The idf of the most frequent terms, a fixed number of them, goes to
    the tasks; any other term is at most as frequent as the last of those, and at least once there.
    Terms whose upper bound stays below the best lower bound of their post are dropped where they are
    counted. Those left are joined with their exact frequency by hash; a frequent term brings its
    score along, so no join key is hot.
    """
    total = words.select(F.count(F.lit(1))).scalar().cast("double")
    # most terms occur in one post only: those are not stored
    df = storage.write_table(document_frequency(words).filter("df > 1"), f"{work}/term_counts")
    frequent = frequent_terms(df, total)
    kind = words.schema[key].dataType.simpleString()
    candidates = storage.write_table(
        words.select(F.col(key).alias("key"), "w").mapInArrow(
            lambda batches: terms.candidate_batches(batches, frequent),
            f"key {kind}, n_terms bigint, term string, h1 bigint, h2 int, tf bigint, micro double"),
        f"{work}/candidates")
    joined = candidates.filter("micro IS NULL").drop("micro").join(df, ["h1", "h2"], "left").withColumn(
        "micro", _micro(F.col("tf") * _idf(F.coalesce("df", F.lit(1)), total)))
    scored = joined.select("key", "n_terms", "term", "micro").unionByName(
        candidates.filter("micro IS NOT NULL").select("key", "n_terms", "term", F.col("micro").cast("bigint").alias("micro")))
    top = scored.groupBy("key").agg(
        F.min(F.struct((-F.col("micro")).alias("below"), "term", "n_terms")).alias("best"))
    return words.select(key).join(top.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left").select(
        key, F.coalesce("best.term", F.lit(M.UNKNOWN)).alias("topic_label"),
        F.coalesce(N.half_up(-F.col("best.below") / F.lit(1e6) / F.col("best.n_terms"), 6), F.lit(0.0))
        .alias("topic_confidence"),
    )


def apply_model(
    posts: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.DataFrame]],
    text: str,
    result_schema: str,
    max_chars: int | None = None,
) -> DataFrame:
    """Run an external model over a table in Arrow batches, loading it once per task.

    ``load`` returns a function from a batch of texts to a frame with the result columns.
    ``max_chars`` cuts the model's input only, for models with a length limit.
    """
    source = posts.withColumn("_input", X.truncate(F.col(text), max_chars)
                              if max_chars else F.col(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            result = predict(batch.pop("_input"))
            result.index = batch.index
            yield pd.concat([batch, result], axis=1)

    return source.mapInPandas(run, f"{fields}, {result_schema}")


def max_ai_version(silver: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Highest version per post (0 when there is none) and the next one."""
    known = enrichment.groupBy("silver_post_id").agg(F.max("ai_version").alias("v"))
    joined = silver.select("id").join(known, F.col("id") == F.col("silver_post_id"), "left")
    highest = F.coalesce("v", F.lit(0))
    return joined.select(
        "id", highest.alias("max_version"), (highest + 1).alias("next_version")
    )


def enrichment_rows(tagged: DataFrame, annotations: DataFrame) -> DataFrame:
    """Enrichment table from tagged silver posts and model outputs per post and version.

    Tags and reach are computed before the join, so the post text is not shuffled.
    """
    facts = tagged.select(
        F.col("id").alias("silver_post_id"), "hashtags", "mentions", "created_at",
        N.reach_estimate(*[F.col(f"{c}_count") for c in ("like", "share", "reply", "view")])
        .alias("reach_estimate"),
    )
    return facts.join(annotations, "silver_post_id").select(
        F.concat_ws("-", F.lit("en"), "silver_post_id", "ai_version").alias("id"),
        "silver_post_id", F.col("ai_version").cast("int").alias("ai_version"),
        "hashtags", "mentions", "language", "topic_label", "topic_confidence",
        "reach_estimate", "sentiment", "sentiment_confidence",
        *_model_columns(), "created_at",
    )


def _model_columns() -> list[Column]:
    names = {"metadata": TOPIC_MODEL, "sentiment": SENTIMENT_MODEL}
    return [
        column
        for prefix, name in names.items()
        for column in (
            F.lit(name).alias(f"{prefix}_model_name"),
            X.model_version(F.lit(name)).alias(f"{prefix}_model_version"),
        )
    ]


class Enriched(NamedTuple):
    silver: DataFrame
    enrichment: DataFrame
    jobs: DataFrame


def scored_posts(bronze: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Silver rows with tags, sentiment, language, topic words (``w``) and payload error.

    One parse and one tokenisation per post, no shuffle. ``keep`` names further columns that stay.
    """
    tagged = with_tags(silver_extract(bronze, keep_extras=True, keep=keep))
    scored = _scores(tagged, "post_text").withColumn("_s", _sentiment()).withColumn("_l", _language())
    return scored.select(
        *tagged.columns, F.col("_s.label").alias("sentiment"),
        F.col("_s.confidence").alias("sentiment_confidence"),
        F.col("_l.code").alias("language"), F.col("_a.w").alias("w"),
    )


def _versions(scored: DataFrame, previous: DataFrame) -> DataFrame:
    return max_ai_version(scored, previous).select("id", F.col("next_version").alias("ai_version"))


def enrichment_jobs(
    scored: DataFrame, previous: DataFrame, at: Column, jobs: DataFrame | None = None
) -> DataFrame:
    """One job row per post: failed where the payload is not JSON, else completed.

    ``jobs`` holds earlier jobs: a post that was tried before has one attempt more than its last
    try, up to the maximum. Nothing but ids and states is read.
    """
    state = scored.select("id", "payload_error").join(_versions(scored, previous), "id")
    tried = F.lit(0)
    if jobs is not None:
        last = jobs.groupBy("silver_post_id").agg(F.max("attempts").alias("_tried"))
        state = state.join(last, F.col("id") == F.col("silver_post_id"), "left")
        tried = F.coalesce("_tried", F.lit(0))
    most = F.lit(3)
    return state.select(
        F.concat_ws("-", F.lit("job"), "id", "ai_version").alias("id"),
        F.col("id").alias("silver_post_id"), F.lit("full_enrichment").alias("job_type"),
        F.when(F.col("payload_error").isNull(), F.lit("completed")).otherwise(F.lit("failed"))
        .alias("status"),
        "ai_version", F.least(tried + 1, most).cast("int").alias("attempts"),
        most.alias("max_attempts"),
        F.col("payload_error").alias("error_message"), at.alias("started_at"),
        at.alias("completed_at"), at.alias("created_at"),
    )


def enrich_posts(
    scored: DataFrame, previous: DataFrame, at: Column, work: str, jobs: DataFrame | None = None
) -> Enriched:
    """Silver step for a whole table: typed rows, model outputs and one job row per post.

    ``scored`` comes from :func:`scored_posts`, best written to a table first because all three
    results read it. A post whose payload is not JSON gets a failed job and no enrichment; its
    silver row stays, as does every other post. The version is one above the stored highest.
    Only the topic step shuffles text, as terms; every other join is on narrow rows by id.
    """
    good = scored.filter("payload_error IS NULL")
    annotations = (
        good.select("id", "sentiment", "sentiment_confidence", "language")
        .join(topic_of_words(good.select("id", "w"), "id", work), "id")
        .join(_versions(scored, previous), "id").withColumnRenamed("id", "silver_post_id")
    )
    return Enriched(scored.select(*SILVER_POSTS), enrichment_rows(good, annotations),
                    enrichment_jobs(scored, previous, at, jobs))


def enrich_outcome(jobs: DataFrame) -> DataFrame:
    """Enriched and failed posts per model version."""
    return jobs.groupBy("ai_version").agg(
        F.count_if(F.col("status") == "completed").alias("enriched"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def latest_prompts(registrations: DataFrame) -> DataFrame:
    """Prompt in force per key: the latest registration. Columns key, version, prompt,
    registered_at, seq."""
    newest = F.max(F.struct("registered_at", "seq", "version", "prompt"))
    return registrations.groupBy("key").agg(newest.alias("r")).select(
        "key", "r.version", "r.prompt"
    )


def attach_prompt(calls: DataFrame, prompts: DataFrame, key: str = "key") -> DataFrame:
    """Prompt and version for every call; an unknown key stops the job when it is read."""
    joined = calls.join(prompts.withColumn("_known", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no prompt registered for key: "), F.col(key)))
    return joined.withColumn(
        "prompt", F.when(F.col("_known"), F.col("prompt")).otherwise(missing.cast("string"))
    ).drop("_known")


def provider_for(override: Column, default: Column) -> Column:
    """Provider of a feature: its own setting when given, else the default."""
    return F.coalesce(X.present(override), default)
