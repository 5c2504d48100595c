"""Scores, costs and review intervals."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days until a card of each box is due again.
BOX_DAYS = {1: 0, 2: 1, 3: 3, 4: 7, 5: 14}
#: Dollars for 1,000 tokens; prompt and completion for chat models.
EMBEDDING_PRICES = {"text-embedding-ada-002": 0.0001, "text-embedding-3-small": 0.00002, "text-embedding-3-large": 0.00013}
CHAT_PRICES = {"gpt-3.5-turbo": (0.0015, 0.002), "gpt-4": (0.03, 0.06), "gpt-4-turbo": (0.01, 0.03)}


def next_box(box: Column, answer: Column) -> Column:
    return F.when(answer == "know", F.least(box + 1, F.lit(5))).when(answer == "unsure", F.greatest(box - 1, F.lit(1))).otherwise(F.lit(1))


def due(now: Column, box: Column) -> Column:
    days = F.create_map(*(F.lit(x) for kv in BOX_DAYS.items() for x in kv))[box]
    return now + F.make_dt_interval(days)


def embedding_cost(tokens: Column, model: Column) -> Column:
    prices = F.create_map(*(F.lit(x) for kv in EMBEDDING_PRICES.items() for x in kv))
    return tokens / 1000 * F.coalesce(prices[model], F.lit(0.0001))


def chat_cost(prompt: Column, completion: Column, model: Column, default: str = "gpt-3.5-turbo") -> Column:
    rate = lambda k: F.coalesce(F.create_map(*(F.lit(x) for m, p in CHAT_PRICES.items() for x in (m, p[k])))[model], F.lit(CHAT_PRICES[default][k]))
    return prompt / 1000 * rate(0) + completion / 1000 * rate(1)


def answer_cost(tokens: Column) -> Column:
    """An answer's tokens at $15 a million plus ten times as many prompt tokens at $5."""
    return F.round(tokens * 15 / 1e6 + tokens * 10 * 5 / 1e6, 6)


def confidence(mean_distance: Column) -> Column:
    return F.when(mean_distance < 0.3, "high").when(mean_distance < 0.5, "medium").otherwise("low")


def text_only(covered: Column, total: Column, chars: Column) -> Column:
    """Boxes cover more than half of an image and hold over 300 characters."""
    return (covered / total > 0.5) & (chars > 300)
