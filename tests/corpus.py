"""Small transcript corpora for tests, as the reader would deliver them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.prices import prices_from_json
from ledgerline.sources.transcripts import FILE_COLUMNS, classify

PRICES = {
    "model-a": {
        "input_cost_per_token": 1e-6,
        "output_cost_per_token": 10e-6,
        "cache_creation_input_token_cost": 2e-6,
        "cache_creation_input_token_cost_above_1hr": 3.2e-6,
        "cache_read_input_token_cost": 0.1e-6,
    },
    "model-b": {"input_cost_per_token": 5e-6, "output_cost_per_token": 50e-6},
    "sample_spec": "not a rate entry",
}

T0 = "2026-07-01T00:00:00.000Z"
NO_VALUE = object()


def usage(input=10, output=100, c5=0, c1=0, cr=0, **more):
    return {
        "input_tokens": input,
        "output_tokens": output,
        "cache_creation_input_tokens": c5 + c1,
        "cache_read_input_tokens": cr,
        "cache_creation": {"ephemeral_5m_input_tokens": c5, "ephemeral_1h_input_tokens": c1},
        **more,
    }


def reply(id, uuid, session, origin=None, block=None, req=None, tokens=None, model="model-a", ts=T0, **more):
    """One assistant record holding one content block."""
    record = {
        "type": "assistant",
        "uuid": uuid,
        "requestId": req or f"req_{id}",
        "sessionId": session,
        "timestamp": ts,
        "cwd": "/home/x/proj",
        "version": "2.1.0",
        "message": {
            "id": id,
            "model": model,
            "stop_reason": "end_turn",
            "content": [block or {"type": "text", "text": "hi"}],
            "usage": usage() if tokens is None else tokens,
        },
        **more,
    }
    if origin:
        record["session_id"] = origin
    return record


def plain(type, uuid, session, ts, origin=None, **more):
    record = {"type": type, "uuid": uuid, "sessionId": session, "timestamp": ts, "cwd": "/home/x/proj", **more}
    if origin:
        record["session_id"] = origin
    return record


def copied(records, child, marked):
    """Records as a fork's file holds them: the session rewritten, the origin kept if marked."""
    out = []
    for r in records:
        r = {**r, "sessionId": child}
        if marked:
            original = [x for x in records if x["uuid"] == r["uuid"]][0]
            r["session_id"] = original.get("session_id", original["sessionId"])
        out.append(r)
    return out


class Corpus:
    """Files by path below one root, with optional creation times."""

    def __init__(self, slug="-home-x-proj"):
        self.slug = slug
        self.files: dict[str, list[str]] = {}
        self.created: dict[str, int] = {}

    def path(self, name):
        return f"/root-a/{self.slug}/{name}"

    def add(self, name, *records, created=None):
        path = self.path(name)
        lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
        self.files.setdefault(path, []).extend(lines)
        if created:
            self.created[path] = ms(created)
        return self

    def session(self, session, *records, created=None):
        return self.add(f"{session}.jsonl", *records, created=created)

    def merge(self, other):
        for path, lines in other.files.items():
            assert path not in self.files, path
            self.files[path] = lines
        self.created.update(other.created)
        return self

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        rows = [
            (line, path, 0, i, sum(map(len, lines)))
            for path, lines in self.files.items()
            for i, line in enumerate(lines)
        ]
        raw = spark.createDataFrame(
            rows, "value string, path string, splitStart long, lineIdx long, bytes long"
        )
        created = spark.createDataFrame(list(self.created.items()), "path string, created_ms long")
        listing = spark.createDataFrame(
            [(p, sum(map(len, lines))) for p, lines in self.files.items()], "path string, bytes long"
        )
        roots = ["/root-a"]
        return (
            classify(raw, roots, created),
            classify(listing, roots, created).select(*FILE_COLUMNS),
        )


def ms(iso):
    from datetime import datetime

    return round(datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)


def prices(spark):
    return prices_from_json(spark, json.dumps(PRICES), "test")


def collect_grains(result):
    """Every grain as plain dicts, timestamps as epoch milliseconds."""
    out = {}
    for name, df in result.grains.items():
        cols = [
            F.unix_millis(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes
        ]
        out[name] = [r.asDict() for r in df.select(*cols).collect()]
    return out
