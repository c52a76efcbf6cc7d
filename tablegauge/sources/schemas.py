"""Explicit schemas of everything read from or written to files."""

from __future__ import annotations

from tablegauge.fixed_values import MODEL_KEY

# The passenger table as distributed in CSV form.
PASSENGER_SCHEMA = ("survived int, pclass int, sex string, age double, sibsp int, parch int, fare double, "
                    "embarked string, `class` string, who string, adult_male boolean, deck string, "
                    "embark_town string, alive string, alone boolean")

SPEC_SCHEMA = ("dataset string, intent string, family string, truth_sql array<string>, "
               "phrasings array<string>, trap boolean, rate boolean")

SAMPLE_METADATA = ("struct<dataset: string, intent: string, family: string, variant: int, trap: boolean, "
                   "rate: boolean, expected_tools: array<string>, truth_sql: array<string>, "
                   "truth_rows: array<bigint>, truth_rates: array<double>, truth_values: array<double>>")

SAMPLE_SCHEMA = f"id string, input string, target string, metadata {SAMPLE_METADATA}"

TARGET_SCHEMA = "rows array<bigint>, rates array<double>, values array<double>"

TURNS = ("array<struct<role: string, tokens: array<bigint>, "
         "contents: array<struct<kind: string, text: string, name: string, query: string>>>>")

RUN_RESULT = ("struct<tools: array<string>, update_sql: string, query_sql: array<string>, text: string, "
              "error: string, reset: boolean, retries: int, tokens_in: bigint, tokens_out: bigint, "
              "tokens_cached: bigint, model: string, config: string, reasoning: string, provider: string>")

LOG_METADATA = (f"struct<{MODEL_KEY}: string, provider: string, config: string, dataset: string, "
                "reasoning: string>")

LOG_SAMPLE = (f"struct<id: string, input: string, epoch: int, metadata: {SAMPLE_METADATA}, "
              f"store: {RUN_RESULT}, scores: map<string, struct<value: string, metadata: map<string, string>>>>")

RUN_LOG_SCHEMA = (f"status string, created string, epochs int, max_samples int, metadata {LOG_METADATA}, "
                  f"samples array<{LOG_SAMPLE}>")

# One row per sample with its log header repeated: splittable, whatever one log holds.
FLAT_LOG_SCHEMA = (f"status string, created string, epochs int, max_samples int, metadata {LOG_METADATA}, "
                   f"sample {LOG_SAMPLE}")
