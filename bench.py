"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no result is pulled
to the driver). One warm-up run of the flagship query first; then every query
once. Prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all] [key-prefix ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusforge.plans import q_core  # noqa: E402
from corpusforge.plans.registry import load_all  # noqa: E402
from corpusforge.session import get_spark  # noqa: E402

HEADLINE = [
    "T13_chunk_explode",
    "T03_vocab_build",
    "T01_tok_encode",
    "T18_mask_mlm",
    "D01_split_exact_seeded",
    "D04_shuffle_seeded",
    "B01_batch_assemble",
    "U03_unpivot_ordered_pairs",
    "J01_lookup_lang_name",
    "T16_template_instruction",
    "T21_labels_completion_only",
    "A04_accuracy_masked",
    "M03_fit_masked_token",
    "M04_fit_causal_lm",
    "M05_lexicon_gloss",
    "S06_src_aligned_lines",
    "W01_stream_examples",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    args = sys.argv[1:]
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus, app="corpusforge-bench")
    reg = load_all()
    if "--all" in args:
        keys = list(reg)
    elif args:
        keys = [k for k in reg if any(k.startswith(a) for a in args)]
    else:
        keys = HEADLINE
    t = time.time()
    run(q_core.entry_summary(spark, sf_dir))  # warm-up
    warm = time.time() - t
    times = {}
    t = time.time()
    run(q_core.entry_summary(spark, sf_dir))
    times["entry_chunk_summary"] = round(time.time() - t, 3)
    errors = {}
    for k in keys:
        t = time.time()
        try:
            run(reg[k].build(spark, sf_dir))
            times[k] = round(time.time() - t, 3)
        except Exception as e:  # keep the one-line report even if a query fails
            errors[k] = type(e).__name__ + ": " + str(e).splitlines()[0][:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "warmup_sec": round(warm, 3),
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
