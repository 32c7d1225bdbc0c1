"""Random event frames with ties, bursts, gaps, blank hosts and unknown times."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

US = 1_000_000
BASE = 1_767_225_600 * US  # 2026-01-01
TEXTS = ("OCSP lookup", "TLS Handshake Failed", "ocsp then handshake failed", "INFO ok", None, "crl fetch")


def random_events(seed: int, n: int, spread_s: int, step_us: int = US, null_times: bool = True) -> list[dict]:
    rng = random.Random(seed)
    centers = [rng.randrange(spread_s) for _ in range(4)]
    events = []
    for seq in range(n):
        if rng.random() < 0.4:  # bursts with many equal times
            at = rng.choice(centers) + rng.randrange(5)
        else:
            at = rng.randrange(spread_s)
        us = BASE + at * US + rng.randrange(max(1, US // step_us)) * step_us
        events.append({
            "seq": seq,
            "us": None if null_times and rng.random() < 0.05 else us,
            "host": rng.choice(["a", "b", "c", "d", None]),
            "raw": rng.choice(TEXTS),
            "value": None if rng.random() < 0.02 else float(rng.choice([10, 11, 12, 13, 500 if rng.random() < 0.3 else 9])),
        })
    rng.shuffle(events)
    return events


def as_frame(spark, events: list[dict]):
    rows = [(e["seq"], e["us"], e["host"], e["raw"], e["value"]) for e in events]
    df = spark.createDataFrame(rows, "seq bigint, us bigint, host string, _raw string, duration_ms double")
    return df.select("seq", F.timestamp_micros("us").alias("time"), "host",
                     F.concat(F.lit("st-"), "host").alias("sourcetype"), "_raw", "duration_ms")


def us(time) -> int:
    from datetime import timezone

    return round(time.replace(tzinfo=timezone.utc).timestamp() * 1e6)
