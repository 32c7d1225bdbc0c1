"""Plain sequential models of the order-dependent detectors, for comparison on small frames.

Events are dicts with ``us`` (or None), ``seq``, ``host``, ``raw``, ``value``.
"""

from __future__ import annotations

import statistics

US = 1_000_000


def in_order(events):
    return sorted((e for e in events if e["us"] is not None), key=lambda e: (e["us"], e["seq"]))


def spikes(events, window_s, threshold):
    rows, out, minutes = in_order(events), [], set()
    for i, first in enumerate(rows):
        inside = [e for e in rows[i:] if e["us"] - first["us"] <= window_s * US]
        minute = first["us"] // (60 * US)
        if len(inside) >= threshold and minute not in minutes:
            minutes.add(minute)
            hosts = sorted({e["host"] for e in inside if e["host"] is not None})
            out.append((first["us"], len(inside), tuple(hosts)))
    return out


def sessions(events, gap_s):
    groups = []
    for e in in_order(events):
        if groups and e["us"] - groups[-1][-1]["us"] <= gap_s * US:
            groups[-1].append(e)
        else:
            groups.append([e])
    return [
        (g[0]["us"], g[-1]["us"], len(g), tuple(sorted({e["host"] for e in g if e["host"] is not None})))
        for g in groups if len(g) > 1
    ]


def pairs(events, first, second, span_s):
    out = []
    for host in {e["host"] for e in events}:
        opened = None
        for e in in_order(x for x in events if x["host"] == host):
            text = (e["raw"] or "").lower()
            if opened is None:
                opened = e if first in text else None
                continue
            if e["us"] - opened["us"] > span_s * US:
                break
            if second in text:
                out.append((host, opened["us"], e["us"]))
                break
    return sorted(out, key=str)


def transactions(events, span_s):
    out = []
    for host in {e["host"] for e in events}:
        group = []
        for e in in_order(x for x in events if x["host"] == host):
            if group and e["us"] > group[0]["us"] + span_s * US:
                out.append((host, group[0]["us"], group[-1]["us"], len(group)))
                group = []
            group.append(e)
        if group:
            out.append((host, group[0]["us"], group[-1]["us"], len(group)))
    return sorted(out, key=str)


def anomalies(events, window, threshold):
    """(us, seq) -> (z, contaminated)."""
    rows = in_order(events)
    if len(rows) < window + 1:
        return {}
    flagged = []
    for i in range(window - 1, len(rows)):
        frame = [r["value"] for r in rows[i - window + 1:i + 1]]
        if None in frame:
            continue
        std = statistics.stdev(frame)
        if std > 1e-9:
            z = (frame[-1] - statistics.fmean(frame)) / std
            if abs(z) > threshold:
                flagged.append((i, z))
    out, run = {}, []

    def close():
        if run:
            lead = max(run, key=lambda f: (round(abs(f[1]), 9), -f[0]))
            for i, z in run:
                out[(rows[i]["us"], rows[i]["seq"])] = (round(z, 6), i != lead[0])

    for f in flagged:
        if run and f[0] - run[-1][0] > window:
            close()
            run = []
        run.append(f)
    close()
    return out
