"""Named views over the layers, each defined on the one below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterlake.operators import gold as G
from chatterlake.operators.silver import silver_extract


def publish_views(
    spark: SparkSession, bronze: DataFrame, requests: DataFrame, enrichment: DataFrame,
    stored_silver: DataFrame, prefix: str = "",
) -> list[str]:
    """Register the view chain silver posts, enrichment, gold posts, daily and summary."""
    silver = G.silver_with_keyword(silver_extract(bronze), requests)
    bridged = G.enrichment_bridge(enrichment, stored_silver, silver)
    posts = G.gold_post_search_view(silver, bridged)
    views = {
        "silver_posts": silver, "silver_ai_enrichment": bridged, "gold_post_search": posts,
        "gold_campaign_daily": G.campaign_daily_sql(posts),
        "gold_campaign_summary": G.campaign_summary_sql(posts),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
