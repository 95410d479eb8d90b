"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera import session  # noqa: E402
from tessera.plans import registry  # noqa: E402

HEADLINE = (
    "price_move_alerts", "bollinger", "rsi", "candlestick_patterns", "backtest_sma_cross", "walk_forward", "correlation_matrix", "historical_var",
    "sentiment_ewma", "news_outcomes", "event_study", "triple_barrier", "continuous_futures", "feature_psi", "factor_zscores", "first_of_equal_texts", "semantic_search", "graph_neighbours",
    "stories", "market_regimes", "signals_directional", "macd_history",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build("bench")
    found, took = registry.queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles code
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
