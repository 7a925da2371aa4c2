"""Latency of searches on one opened engine: warm-ups, then samples; percentiles by floor of the rank."""

from __future__ import annotations

import time

WARM, SAMPLES = 5, 50


def percentile(ordered: list[float], percent: int) -> float:
    return ordered[(len(ordered) - 1) * percent // 100] if ordered else 0.0


def measure(engine, query: str, mode: str | None = None, warm: int = WARM, samples: int = SAMPLES) -> dict:
    took = []
    for turn in range(warm + samples):
        began = time.perf_counter()
        engine.search(query, mode=mode).collect()
        if turn >= warm:
            took.append((time.perf_counter() - began) * 1000)
    total = sum(took) / 1000
    return {"p50_ms": percentile(sorted(took), 50), "p99_ms": percentile(sorted(took), 99), "qps": len(took) / total if total else 0.0, "n": len(took)}
