"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lm_unigram_fit", "lm_bigram_fit", "score_text", "score_conditional", "score_tokens", "score_strided",
    "corpus_token_stream", "topk_next_token", "rank_class_large", "split_random", "split_length", "split_score",
    "split_score_qbuckets", "split_score_ubuckets", "split_fixed_train_buckets", "balance_atoms", "atom_divergence",
    "encode_tokens", "pad_batch", "rouge_n", "rouge_l", "multiset_match", "partial_scores", "hardness", "eval_levels",
    "join_fk_canon", "fk_canonical_ids", "result_set_match",
]


def main() -> None:
    from tailsplit.session import get_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus))
    from tailsplit.queries.catalogue import QUERIES

    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # Start the executors and the Python workers before the clock does.
    QUERIES["rouge_l"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(sorted(taken)[len(taken) // 2], 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
