"""Lexical sentiment, event type and label scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.safe import let

# Word lists of the lexical model (matched as substrings).
BULLISH_TOKENS = ("beats", "rises", "surges", "growth", "profit", "wins", "raises", "bullish")
BEARISH_TOKENS = ("falls", "cuts", "loss", "probe", "penalty", "warns", "misses", "bearish")

# Event types in order of precedence with their words.
EVENT_WORDS = (
    ("guidance", "guidance|outlook|forecast|warns|cuts|raises"),
    ("earnings", "result|profit|loss|earnings|quarter|revenue"),
    ("corporate_action", "buyback|dividend|split|bonus|merger|acquisition"),
    ("regulatory", "sebi|rbi|approval|probe|penalty|regulator"),
    ("order_win", "order|contract|deal|project|tender"),
)

NEUTRAL_BAND = 0.15


def event_type(text: Column, words: Sequence[tuple[str, str]] = EVENT_WORDS) -> Column:
    chain = F
    for name, pattern in words:
        chain = chain.when(text.rlike(rf"(?iU)\b({pattern})\b"), name)
    return chain.otherwise(F.lit(None))


def lexical_sentiment(
    text: Column,
    bullish: Sequence[str] = BULLISH_TOKENS,
    bearish: Sequence[str] = BEARISH_TOKENS,
) -> Column:
    """STRUCT<sentiment, confidence, raw_scores> from the tokens present in the text."""
    def present(lowered: Column, tokens: Sequence[str]) -> Column:
        total = F.lit(0)
        for token in tokens:
            total = total + F.contains(lowered, F.lit(token)).cast("int")
        return total

    def judge(lowered: Column) -> Column:
        return let(present(lowered, bullish) - present(lowered, bearish), outcome)

    def outcome(lead: Column) -> Column:
        label = F.when(lead > 0, "bullish").when(lead < 0, "bearish").otherwise("neutral")
        confidence = F.when(lead == 0, 0.5).otherwise(F.least(F.lit(0.75), 0.45 + 0.1 * F.abs(lead)))
        scores = F.create_map(
            F.lit("positive"), F.when(lead > 0, confidence).otherwise(0.2),
            F.lit("negative"), F.when(lead < 0, confidence).otherwise(0.2),
            F.lit("neutral"), F.when(lead == 0, confidence).otherwise(0.2))
        return F.struct(label.alias("sentiment"), confidence.alias("confidence"), scores.alias("raw_scores"))

    return let(F.lower(text), judge)


def calibrate(scores: Column) -> Column:
    """STRUCT<sentiment, confidence, score> from a model's score map; positive wins ties, then negative."""
    def score(*names: str) -> Column:
        return F.coalesce(*[F.element_at(scores, n) for n in names], F.lit(0.0))

    pos, neg, neu = score("positive", "bullish"), score("negative", "bearish"), score("neutral")
    up, down = (pos >= neg) & (pos >= neu), (neg >= pos) & (neg >= neu)
    return F.struct(
        F.when(up, "bullish").when(down, "bearish").otherwise("neutral").alias("sentiment"),
        F.when(up, pos).when(down, neg).otherwise(neu).alias("confidence"),
        (pos - neg).alias("score"))


def signed_score(label: Column, confidence: Column) -> Column:
    lowered = F.lower(label)
    return (
        F.when(confidence.isNull(), F.lit(None)).when(lowered == "bullish", confidence)
        .when(lowered == "bearish", -confidence).otherwise(0.0))


def score_label(score: Column) -> Column:
    return F.when(score > NEUTRAL_BAND, "bullish").when(score < -NEUTRAL_BAND, "bearish").otherwise("neutral")


def default_score(score: Column, label: Column) -> Column:
    """Given score, else a fixed score for the label."""
    return F.coalesce(score, F.when(label == "bullish", 0.5).when(label == "bearish", -0.5).otherwise(0.0))
